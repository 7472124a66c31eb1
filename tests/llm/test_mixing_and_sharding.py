import random
import time
from collections import Counter, defaultdict
from fractions import Fraction

from hypothesis import given, settings, strategies as st

from siftline.llm import mixing as M, sharding as S


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=7), st.integers(0, 60))
def test_apportion_is_highest_quotients(shares, house):
    shares = [Fraction(s) for s in shares]
    got = M.apportion(shares, house)
    want = [0] * len(shares)
    for _ in range(house if any(shares) else 0):
        i = max((i for i in range(len(shares)) if shares[i]), key=lambda i: (shares[i] / (2 * want[i] + 1), -i))
        want[i] += 1
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets_fill_up(sizes):
    got = M.targets(sizes)
    assert sum(got) == sum(sizes) and all(g <= 3 * s for g, s in zip(got, sizes))
    weight = [M.WEIGHTS[i % 3] for i in range(len(sizes))]
    open_ = {g / w for g, w, s in zip(got, weight, sizes) if g < 3 * s}
    assert len(open_) <= 1


def test_mix_meets_targets(documents):
    docs = documents.filter("doc_id is not null")
    rows = M.mix_report(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.mix_report(docs).collect()))
    texts = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    total, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.size == len((texts[r.doc_id][0] or "").split()) and 0 <= r.taken <= 3 * r.size
        total[texts[r.doc_id][1]] += r.size
        taken[texts[r.doc_id][1]] += r.taken
    order = sorted(total, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, M.targets([total[s] for s in order])))
    for r in rows:
        s = texts[r.doc_id][1]
        assert r.source_size == total[s] and abs(r.target - goal[s]) < 1e-6
    assert all(abs(taken[s] - goal[s]) <= M.BLOCK for s in order)


def test_quotas_by_shard(documents):
    """Each shard takes its integer quota of blocks of each source, and the first words of the seeded order that no shard before it took."""
    docs = documents.filter("doc_id is not null")
    laid, how = M.mixture(docs)
    rows = laid.select("_row.source", "size", "_from", "source_size", "taken", "taken_by_shard").collect()
    order = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    assert len(how["quotas"]) == M.SHARDS
    for i, s in enumerate(order):
        mine = [r for r in rows if r.source == s]
        for k in range(M.SHARDS):
            assert sum(r.taken_by_shard[k] for r in mine) == M.BLOCK * how["quotas"][k][i]
        place = 0  # brute force: word by word
        want = {id(r): [0] * M.SHARDS for r in mine}
        stream = [r for r in sorted((r for r in mine if r.size), key=lambda r: r._from) for _ in range(r.size)]
        for k in range(M.SHARDS):
            for _ in range(M.BLOCK * how["quotas"][k][i]):
                want[id(stream[place % len(stream)])][k] += 1
                place += 1
        assert all(list(r.taken_by_shard) == want[id(r)] and r.taken == sum(want[id(r)]) for r in mine)


def test_a_small_source_beside_a_large_one():
    how = M.plan([40, 10**12])
    got = [M.BLOCK * sum(q[i] for q in how["quotas"]) for i in range(2)]
    assert abs(got[0] - 120) <= M.BLOCK and abs(got[1] - (10**12 - 80)) <= M.BLOCK
    shares = [q[1] for q in how["quotas"]]
    assert max(shares) - min(shares) <= 2


def test_many_sources():
    r = random.Random(1)
    sizes = [r.randrange(1, 10**7) for _ in range(20_000)]
    begun = time.time()
    how = M.plan(sizes)
    assert time.time() - begun < 60
    for i, (g, s) in enumerate(zip(how["target"], sizes)):
        got = M.BLOCK * sum(q[i] for q in how["quotas"])
        assert abs(got - g) <= 2 * M.BLOCK and got <= 3 * s


def test_mixed_rows_hold_the_words_taken(documents, empty):
    docs = documents.filter("doc_id is not null")
    out = M.mixed(docs)
    assert out.columns == docs.columns
    words, shards = Counter(), Counter()
    for r in M.mixed(docs, shard="in_shard").collect():
        words[r.doc_id] += len(r.text.split())
        shards[r.doc_id, r.in_shard] += len(r.text.split())
    again = Counter()
    for r in out.collect():
        again[r.doc_id] += len(r.text.split())
    assert again == words
    taken, by_shard = Counter(), Counter()
    for r in M.mix_report(docs).collect():
        taken[r.doc_id] += r.taken
        for k, n in enumerate(r.taken_by_shard):
            by_shard[r.doc_id, k] += n
    assert +words == +taken and +shards == +by_shard
    assert M.mixed(empty).count() == 0 and M.mix_report(empty).count() == 0


def test_shards_are_even_and_groups_stay(documents, empty):
    rows = S.shard_documents(documents, shards=5).collect()
    assert len(rows) == documents.count()
    count = Counter(r.shard for r in rows)
    assert max(count.values()) - min(count.values()) <= 1
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))
    text = {r.doc_id: r.text for r in documents.collect() if r.text is not None}
    where = defaultdict(set)
    for r in rows:
        if r.doc_id in text:
            where[text[r.doc_id]].add(r.shard)
        else:
            assert r.size == 8 or r.doc_id is None
    groups = Counter(r.text for r in documents.collect() if r.text is not None)
    many = [t for t, n in groups.items() if n > 1]
    assert sum(len(where[t]) == 1 for t in many if t in where) >= 0.8 * sum(t in where for t in many)
    assert S.shard_documents(empty).count() == 0


def test_a_group_larger_than_a_shard_is_split(spark):
    df = spark.createDataFrame([(i, "same" if i < 60 else f"t{i}") for i in range(120)], "doc_id long, text string")
    rows = S.shard_documents(df, shards=6).collect()
    assert set(Counter(r.shard for r in rows).values()) == {20}
    hot = Counter(r.shard for r in rows if r.doc_id < 60)
    assert sorted(hot.values(), reverse=True)[:3] == [20, 20, 20] or max(hot.values()) == 20


def test_pairs_meet_where_all_rows_are_linked(spark):
    """No shard has room: only exchanges bring copies together."""
    df = spark.createDataFrame([(i, f"text {i % 1200}") for i in range(2400)], "doc_id long, text string")
    rows = S.shard_documents(df).collect()
    assert set(Counter(r.shard for r in rows).values()) == {100}
    where = defaultdict(set)
    for r in rows:
        where[r.doc_id % 1200].add(r.shard)
    assert sum(len(w) > 1 for w in where.values()) <= 0.04 * 1200


def test_keys_larger_than_a_shard_fill_shards(spark):
    df = spark.createDataFrame([(i, f"text {i % 4}") for i in range(240)], "doc_id long, text string")
    parts = Counter((r.shard, r.doc_id % 4) for r in S.shard_documents(df, shards=8).collect())
    assert sum(parts.values()) == 240 and len(parts) <= 20  # 32 as dealt, 8 at best


def test_flows_keep_quotas():
    asked = [[0, 5, 0], [3, 0, 4], [2, 0, 0]]
    got = S.granted_flows(asked, [0, 0, 0])
    assert got == [[0, 5, 0], [3, 0, 2], [2, 0, 0]]
    got = S.granted_flows([[0, 5, 0], [0, 0, 4], [0, 0, 0]], [0, 0, 3])
    assert all(sum(r[b] for r in got) - sum(got[b]) <= (0, 0, 3)[b] for b in range(3)) and sum(map(sum, got)) == 6
