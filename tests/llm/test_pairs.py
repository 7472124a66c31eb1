import random
import re

from siftline.llm import decontaminate as D, jaccard_join as J


def shingle_set(text, k):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, similar):
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= similar * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(d, names.get(find(i), d))
    return sorted(((d, len(s), names.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def test_awkward_documents(documents, empty):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = sorted(map(tuple, J.jaccard_report(documents).collect()), key=str)
    assert got == brute(rows, 4, 85)
    assert J.jaccard_report(empty).count() == 0


def test_long_lists(spark, monkeypatch):
    """One passage in all documents, near copies in chains: lists are longer than a block and dealt out."""
    monkeypatch.setattr(J, "LIST", 4)
    monkeypatch.setattr(J, "LEADERS", 2)
    monkeypatch.setattr(J, "DEALT", 20)
    r = random.Random(8)
    base = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(i % 9):
            w[r.randrange(40)] = f"x{r.randrange(9)}"
        rows.append((i, " ".join(w + [f"own{i % 30}"] * (i % 5 == 0))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for k, similar in ((4, 85), (2, 60), (1, 80)):
        got = sorted(map(tuple, J.jaccard_report(df, k=k, similar=similar).collect()), key=str)
        assert got == brute(rows, k, similar)


def test_one_of_each(documents):
    out = J.one_of_each(documents, k=5, similar=80)
    assert out.columns == documents.columns
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = sorted({d for d, n, c in brute(rows, 5, 80) if d is not None and (n == 0 or d == c)})
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == want


def built(items, k=D.SHINGLE):
    """An index of all items in one part, weighed as _parts() weighs them."""
    lists = [D._shingle_list(t, k) for _, t in items]
    n = sum(len(h) > 0 for h, _ in lists)
    u, c = D.np.unique(D.np.concatenate([D.np.unique(s) for _, s in lists]), return_counts=True)
    often = c >= max(2, n / D.COMMON)
    return D.Index(D.pa.array([i for i, _ in items]), [t for _, t in items], D.Weights(n, u[often], c[often]), k)


def every_window(index, docs):
    """(document, item) to the best similarity of all windows, none passed over."""
    want = {}
    for d, text in docs:
        h, _ = D._shingle_list(text, D.SHINGLE)
        for j, size in enumerate(index.lengths):
            for a in range(len(h) - size + 1):
                part = h[a : a + size]
                s = D._bytes.shingles(part, D.np.array([0, size]), D.SHINGLE)[0] if size >= D.SHINGLE else D._bytes.runs(part, int(size))
                sim = index.similarity(j, s)
                if sim >= D.SIMILAR - 1e-12 and sim > want.get((d, index.ids[j].as_py()), (0, 0))[0] + 1e-12:
                    want[d, index.ids[j].as_py()] = (sim, a)
    return want


def test_decontamination_equals_brute_force(spark, monkeypatch):
    r = random.Random(3)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([6, 12, 20, 20, 33, 45, 3])] + [(50, None), (51, ""), (52, None)]
    docs = []
    for i in range(120):
        w = [r.choice(vocabulary) for _ in range(r.choice([0, 4, 30, 200]))]
        if i % 3 == 0:
            passage = r.choice(items[:7])[1].split()
            if i % 2:
                passage[-1] = "other"
            at = r.randint(0, len(w))
            w[at:at] = [x.upper() for x in passage]
        docs.append((i, " ".join(w) if i != 5 else None))
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as similarity")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = every_window(built(items), docs)
    bad = {d for d, _ in want}
    for part in (D.PART_ITEMS, 3):  # in one part, and in three
        monkeypatch.setattr(D, "PART_ITEMS", part)
        got = {(x.doc_id, x.item_id): (x.similarity, x.first_word) for x in D.contaminated(df, bench).collect()}
        assert got.keys() == want.keys() and len(want) > 20
        assert all(abs(got[x][0] - want[x][0]) < 1e-9 and got[x][1] == want[x][1] for x in want)
        out = D.clean(df, bench)
        assert out.columns == df.columns and {x.doc_id for x in out.collect()} == {d for d, _ in docs} - bad
    assert D.contaminated(df, bench.limit(0)).count() == 0 and D.contaminated(df.limit(0), bench).count() == 0
    named = D.contaminated(df.selectExpr("cast(doc_id as decimal(9, 0)) as doc_id", "text"), bench.selectExpr("named_struct('a', item_id) as item_id", "text"))
    assert {(int(x.doc_id), x.item_id.a) for x in named.collect()} == want.keys()


def test_repeated_shingles_are_found():
    """Items that end in one word again and again, weighed like the rest: documents at the threshold by all windows are found."""
    found = 0
    for own, again in ((180, 20), (240, 26), (400, 46)):
        for seed in range(30):
            w = [f"s{seed}w{i}" for i in range(own)]
            items = [(1, " ".join(w + ["la"] * again)), (2, " ".join(f"s{seed}o{i}" for i in range(60)))]
            doc = [f"a{i}" for i in range(seed)] + w + [f"b{i}" for i in range(again)]
            index = built(items)
            h, _ = D._shingle_list(" ".join(doc), D.SHINGLE)
            s = D._bytes.shingles(h[seed : seed + own + again], D.np.array([0, own + again]), D.SHINGLE)[0]
            assert index.similarity(0, s) >= D.SIMILAR
            found += 0 in D.hits_of(index, h)
    assert found == 90


def test_running_fingerprints_are_those_of_their_windows():
    r = D.np.random.default_rng(2)
    for kinds in (1, 3, 40, 10_000):
        s = D._bytes.mix(r.integers(0, kinds, 200).astype(D.np.uint64))
        weights = D.Weights(9, s[:2], D.np.array([4, 2]))
        starts = D.np.array([0, 1, 2, 5, 60, 61, 170])
        got = D.window_bits(s, starts, 30, weights)
        for w, bits in zip(starts, got):
            u, c = D.np.unique(s[w : w + 30], return_counts=True)
            times = D.np.concatenate([D.np.arange(x) for x in c])
            u = D.np.repeat(u, c)
            want = (D.normals(D.features(u, times)) * D.np.sqrt(weights(u))[:, None]).sum(0)
            assert (bits == (want > 1e-5))[abs(want) > 1e-3].all()


def test_multi_index_finds_all_within_radius():
    index = built([(i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(30))) for i in range(90)])
    r = D.np.random.default_rng(1)
    own = D.np.unpackbits(index.prints.view(D.np.uint8), axis=1)[:, : D.BITS]
    for _ in range(50):
        bits = own[r.integers(90)].copy()
        bits[r.choice(D.BITS, r.integers(0, 100), replace=False)] ^= 1
        exact = D.np.flatnonzero((own != bits).sum(1) <= D.RADIUS)
        assert index.near(bits[None, :] > 0)[0].tolist() == exact.tolist()


def test_stages_judge_rows_not_ids(spark):
    """Null and repeated ids: a contaminated row or a copy takes no other row of its id with it."""
    passage = " ".join(f"b{i}" for i in range(20))
    texts = [" ".join(f"{x}{i}" for i in range(30)) for x in "cdefg"]
    near = texts[0].replace("c29", "other")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = [(None, passage), (None, texts[0]), (7, passage), (7, texts[1]), (None, texts[2])]
    got = D.clean(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)
    rows = [(1, texts[0]), (None, near), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (4, texts[3] + " more"), (None, texts[4])]
    got = J.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), k=5, similar=80).collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[0], rows[2], rows[4], rows[6], rows[7]], key=str)


def test_lone_postings_of_dealt_lists(spark, monkeypatch):
    """Every shingle in two sets counts as frequent, and each set is alone in its part of every list."""
    monkeypatch.setattr(J, "LIST", 1)
    monkeypatch.setattr(J, "DEALT", 1)
    rows = []
    for g in range(40):
        w = [f"g{g}w{i}" for i in range(11)]
        rows += [(4 * g + c, " ".join(w)) for c in (0, 1)] + [(4 * g + c, " ".join(w + ["more"])) for c in (2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # parts of a list in different tasks
    try:
        got = sorted(map(tuple, J.jaccard_report(df).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows, 4, 85)


def test_random_near_copies(spark, monkeypatch):
    """Clusters that share passages, at thresholds around theirs: lists, ranges and groups of every kind."""
    for least, seed in ((1, 1), (3, 2), (64, 3)):
        monkeypatch.setattr(J, "LIST", least)
        monkeypatch.setattr(J, "BLOCK", 2)
        monkeypatch.setattr(J, "DEALT", 8)
        monkeypatch.setattr(J, "REACH", 0.7)
        r = random.Random(seed)
        passage = [f"p{i}" for i in range(60)]
        bases = [passage[: r.randrange(0, 60)] + [f"b{j}w{i}" for i in range(r.randrange(8, 60))] for j in range(8)]
        rows = []
        for i in range(150):
            w = list(r.choice(bases))
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(len(w))] = f"x{r.randrange(99)}"
            rows.append((i, " ".join(w)))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        for k, similar in ((3, 75), (1, 90)):
            assert sorted(map(tuple, J.jaccard_report(df, k=k, similar=similar).collect()), key=str) == brute(rows, k, similar)


def test_boilerplate_makes_no_pairs(spark):
    """Documents of 100 shared and 30 own words: no prefix holds what they share, so no pair is formed."""
    shared = [f"s{i}" for i in range(100)]
    rows = [(i, " ".join(shared + [f"o{i}w{j}" for j in range(30)])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = J.set_table(docs, 4, 85)
    classes = sets.withColumnRenamed("doc_id", "rep")
    short, long_ = J.prefixes(classes, docs, 4, 85)
    assert short.count() + long_.count() == 1500
    post = J.postings(short).unionByName(J.postings(long_))
    assert post.filter("salt > 0").count() == 0 and post.groupBy("token").count().filter("count > 1").count() == 0


def test_long_words_are_told_apart(spark):
    a, b = "a" + "x" * 4095 + "b", "b" + "x" * 4095 + "a"
    rows = [(1, a), (2, b), (3, a.upper()), (4, "u v w " + a), (5, "u v w " + b)]
    got = J.jaccard_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 1, 4), (5, 1, 5)]


def test_members_of_groups_link_though_no_leader_does(spark):
    """Pairs held together by a rare word; what links one pair to the other is in frequent lists only, between members that do not lead."""
    for seed in range(1):
        r = random.Random(seed)
        pool = [f"f{i}" for i in range(60)]
        texts = [r.sample(pool, 25) + [f"own{i}_{j}" for j in range(5)] for i in range(110)]
        for f in range(8):
            core = r.sample(pool, 40)
            rest = [w for w in pool if w not in core]
            changed = lambda n, seed: [w for i, w in enumerate(core) if i not in random.Random(seed).sample(range(40), n)] + random.Random(seed + 1).sample(rest, n)
            texts += [changed(4, 10 * f) + [f"rare{f}a"], changed(1, 10 * f + 2) + [f"rare{f}a"], changed(1, 10 * f + 4) + [f"rare{f}b"], changed(4, 10 * f + 6) + [f"rare{f}b"]]
        # the case of four sets of 41: 0 and 1, 2 and 3 share a rare word, and only 1 and 2 link across
        base = [f"f{i}" for i in range(36)]
        texts += [base + ["f36", "f40", "f41", "f42", "four_a"], base + ["f36", "f37", "f40", "f41", "four_a"], base + ["f36", "f37", "f50", "f51", "four_b"], base + ["f36", "f50", "f51", "f52", "four_b"]]
        rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert sorted(map(tuple, J.jaccard_report(df, k=1).collect()), key=str) == brute(rows, 1, 85)
