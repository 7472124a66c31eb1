import base64
import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import functions as F

from siftline.llm import byte_bpe, queries, vector_codes, yinyang

VECTORS = "vec_id long, embedding array<float>, label int"


def rows_of(n, width, seed, spread=0.5):
    r = np.random.default_rng(seed)
    middles = r.normal(0, spread, (5, width))
    return [(i, [float(np.float32(x)) for x in middles[i % 5] + r.normal(0, 0.3, width)], i % 3 if i % 7 else None) for i in range(n)]


def awkward(rows, width):
    nan, inf = float("nan"), float("inf")
    return [*rows, *rows[:3], (1000, None, 1), (1001, [], 1), (1002, [nan] * width, 1), (1003, [inf] + [0.0] * (width - 1), None), (1004, [None] * width, 2), (1005, [0.5] * (width - 1), 2), (None, [0.25] * width, 2), *[(2000 + i, [0.125] * width, 9) for i in range(20)]]


def lloyd(rows, k, rounds, scale, size):
    """Plain rounds over Python integers."""
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, vs in groups.items():
            cents[j] = [sum(x) // len(vs) for x in zip(*vs)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, j, d in out:
        inertia[j] = inertia.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, j, d in out), key=repr)


@pytest.mark.parametrize("k,n", [(8, 150), (3, 40), (8, 4)])
def test_yinyang_is_an_exact_search(spark, k, n):
    rows = awkward(rows_of(n, 6, 2), 6)
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as near", "'x' as v").repartition(3)
    got, _ = yinyang.cluster(df, k=k, size=6, rounds=4)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == lloyd(rows, k, 4, 1024, 6)


def test_yinyang_few_vectors_and_none(spark):
    df = spark.createDataFrame([(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)], VECTORS)
    assert [(r["cluster"], r["distance"]) for r in yinyang.cluster(df, size=2)[0].collect()] == [(0, 0), (0, 0)]
    assert yinyang.cluster(df, size=64)[0].collect() == [] == yinyang.cluster(df.limit(0))[0].collect()


def test_yinyang_filters_skip_distances_and_keep_ties():
    r = np.random.default_rng(5)
    rows = np.concatenate([r.integers(-50, 50, (400, 4)) + 400 * i for i in range(3)] + [np.zeros((5, 4), np.int64)])
    cents = np.concatenate([rows[[0, 1, 400, 401, 800, 801]], [[1, 0, 0, 0], [-1, 0, 0, 0]]])  # the last two are equally far from zero
    groups, n = yinyang.grouped(cents), len(rows)
    near, upper, lower, made = np.full(n, -1), np.full(n, np.inf), np.zeros((n, groups.max() + 1)), []
    assert 1 <= groups.max() + 1 <= 2
    for _ in range(8):
        made.append(yinyang.scan(rows, near, upper, lower, cents, groups))
        full = ((rows[:, None] - cents[None]) ** 2).sum(2)
        assert (near == full.argmin(1)).all()
        assert (upper * (1 + 1e-9) >= np.sqrt(full[np.arange(n), near])).all()
        new = cents.copy()
        for c in np.unique(near):
            new[c] = rows[near == c].sum(0) // (near == c).sum()
        yinyang.moved(upper, lower, near, yinyang.lengths(yinyang.squared(new, cents)) * (1 + yinyang.WIDER), groups)
        cents = new
    assert made[0] == n * 8 and min(made[3:]) < n * 2


def coded(rows, parts, entries, rounds, scale):
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(order[0][1])
    w = size // parts
    books = [[v[p * w : p * w + w] for _, v, _ in [r for r in order if len(r[1]) == size][:entries]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    fit = [r for r in kept if len(r[1]) == size]
    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for _, v, _ in fit:
                x = v[p * w : p * w + w]
                met.setdefault(nearest(x, books[p])[1], []).append(x)
            for j, xs in met.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs)]
    out, by = [], {}
    for i, v, g in kept:
        best = [nearest(v[p * w : p * w + w], books[p]) for p in range(parts)] if len(v) == size else None
        out.append((i, "".join(f"{j:02x}" for _, j in best) if best else None, sum(d for d, _ in best) if best else None, g))
        if best:
            by[g] = by.get(g, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by.get(g), sha) for i, c, e, g in out), key=repr)


@pytest.mark.parametrize("n,entries", [(120, 16), (5, 16), (60, 3)])
def test_codes_are_an_exact_search(spark, n, entries):
    rows = awkward(rows_of(n, 8, 3), 8)
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as part", "'x' as _e").repartition(3)
    got = vector_codes.code_report(df, parts=4, entries=entries, rounds=3)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == coded(rows, 4, entries, 3, 4096)


def test_codes_of_nothing_and_of_odd_lengths(spark):
    df = spark.createDataFrame([(1, [0.5] * 9, 0), (2, [0.25] * 8, 0)], VECTORS)
    assert [(r["code"], r["error"], r["label_error"]) for r in vector_codes.code_report(df).collect()] == [(None, None, None)] * 2
    assert vector_codes.code_report(df.limit(0)).collect() == []
    with pytest.raises(Exception, match="beyond"):
        vector_codes.code_report(df.withColumn("embedding", F.expr("array_repeat(cast(1e30 as float), 8)"))).collect()


def test_screening_settles_what_floats_cannot():
    r = np.random.default_rng(1)
    base = r.integers(-(1 << 26), 1 << 26, (1, 8))
    entries = base + r.integers(-2, 3, (16, 8))  # float32 sees them as equal
    rows = base + r.integers(-3, 4, (300, 8))
    entries[9] = entries[4]
    full = ((rows[:, None] - entries[None]) ** 2).sum(2)
    at, exact = vector_codes.nearest(rows, entries)
    assert (at == full.argmin(1)).all() and exact > 300 * 8
    far, few = vector_codes.nearest(rows, np.concatenate([base, base + (1 << 24)]))
    assert (far == 0).all() and few == 0


def test_codes_decode(spark):
    rows = rows_of(60, 8, 3)
    codes, books = vector_codes.encode(spark.createDataFrame(rows, VECTORS), parts=4)
    got = {r["vec_id"]: (r["decoded"], r["error"]) for r in vector_codes.decode(codes, books).collect()}
    for i, v, _ in rows:
        want = np.floor(np.array(v) * 4096)
        assert ((np.array(got[i][0]) * 4096 - want) ** 2).sum() == got[i][1]


def tiktoken_of(path, pattern=public_tokenizers.PATTERN):
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.vocabulary(path), special_tokens={})


def texts():
    r = random.Random(3)
    out = [None, "", " ", "a", "\n\n \t  x", "it's we'll I'VE 1234567 ½ Ⅷ", "x" * 5000, "ab" * 700 + "a", " " * 3000 + "z", "=" * 999, "日本語のテキスト" * 40, "naïve café ÆØÅ Привет мир", "😀👩‍👩‍👧 zalgó̂", "a\x1cb\x1d \x85c d e", "<|endoftext|> stays text", "ࡰ\U000105c0\U00010d50\U0001e5d0 young letters\U00011de0", "aaaa" * 13 + "b", "".join(r.choice("abcde") for _ in range(900))]
    out += ["".join(r.choice("abcdefghijklmnop qrstuvwxyzABC0123456789.,;\n'é") for _ in range(r.randint(1, 400))) for _ in range(60)]
    return out


def encoded(df, **parameters):
    back = byte_bpe.decode(byte_bpe.encode(df, **parameters), path=parameters.get("path"))
    return sorted((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["n_tokens"], bytes(r["decoded"])) for r in back.collect())


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_ids_are_those_of_the_public_library(spark, name):
    path, all_texts = public_tokenizers.path(name), texts()
    df = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string").selectExpr("*", "1 as ids", "'x' as words").repartition(2)
    own = tiktoken_of(path)
    want = [own.encode_ordinary(t or "") for t in all_texts]
    assert encoded(df, path=path, chunk_bytes=2_000) == [(i, w, len(w), (t or "").encode()) for i, (t, w) in enumerate(zip(all_texts, want))]


def test_any_ranks_merge_in_the_same_order(spark, tmp_path):
    """Vocabularies whose ranks follow no training: joined pairs may go before those that they arise from, and long words merge together only where that is the same."""
    r = random.Random(8)
    for turn in range(2):
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 256 + 60:
            tokens.add(bytes(r.choice(b"abc") for _ in range(r.randint(2, 5))))
        tokens = list(tokens)
        r.shuffle(tokens)
        path = str(tmp_path / f"{turn}.tiktoken")
        with open(path, "wb") as f:
            f.writelines(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens))
        words = ["".join(r.choice("abc" if i % 2 else "ab") for _ in range(r.choice([2, 5, 9, 60, 90]))) for i in range(90)] + ["a" * 77, "ab" * 40]
        df = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string").coalesce(1)
        own = tiktoken_of(path)
        assert [x[1] for x in encoded(df, path=path)] == [own.encode_ordinary(w) for w in words]


def test_pieces_of_words_are_ints_until_they_fold(spark):
    """As longs they took twice the memory of a chunk's words."""
    path, tokens = public_tokenizers.path(byte_bpe.VOCABULARY), byte_bpe.vocabulary(public_tokenizers.path(byte_bpe.VOCABULARY))
    words = ["gfqzxwvkpj", "gfqzxwvkpj" * 6]
    df = spark.createDataFrame([([[tokens[bytes([b])] for b in w.encode()] for w in words],)], "words array<array<int>>")
    own = tiktoken_of(path)
    assert df.select(byte_bpe.merged(F.col("words"), path).alias("ids")).first()["ids"] == [own.encode_ordinary(w) for w in words]
    chunks = byte_bpe._chunks(spark.createDataFrame([(1, "gfqzxwvkpj")], "doc_id long, text string"), tokens, public_tokenizers.PATTERN, 1 << 20)
    assert chunks.schema["words"].dataType == df.schema["words"].dataType


@pytest.mark.parametrize("pieces", [2, 3, byte_bpe.LONG - 1, byte_bpe.LONG, byte_bpe.LONG + 1, byte_bpe.LONG + 2])
def test_short_and_long_words_fold_to_the_same(spark, pieces):
    """Ids of two bytes fill the number that holds a rank and a piece."""
    r = random.Random(pieces)
    words = ["".join(r.choice("etaoinqzñ") for _ in range(pieces)) for _ in range(20)]
    words = [w for w in words if w.encode() not in byte_bpe.vocabulary(public_tokenizers.path(byte_bpe.VOCABULARY))]
    own = tiktoken_of(public_tokenizers.path(byte_bpe.VOCABULARY))
    df = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    assert [x[1] for x in encoded(df)] == [own.encode_ordinary(w) for w in words]


def test_folds_copy_no_array_to_name_a_value(spark):
    """A value named as the element of a transformed array was copied, and its type worked out anew, in every round. Equal pairs of a word have keys of their own."""
    path, tokens = public_tokenizers.path(byte_bpe.VOCABULARY), byte_bpe.vocabulary(public_tokenizers.path(byte_bpe.VOCABULARY))
    words = [w * (byte_bpe.LONG // len(w)) for w in ("zq", "qqz", "xzxq", "z")] + ["zq" * 60]
    df = spark.createDataFrame([([[tokens[bytes([b])] for b in w.encode()] for w in words],)], "words array<array<int>>").select(byte_bpe.merged(F.col("words"), path).alias("ids"))
    own = tiktoken_of(path)
    assert df.first()["ids"] == [own.encode_ordinary(w) for w in words]
    assert "transform(array(" not in df._jdf.queryExecution().analyzed().toString()


def test_a_task_merges_a_word_once(spark):
    """Each chunk used to hand on its words anew."""
    tokens = byte_bpe.vocabulary(public_tokenizers.path(byte_bpe.VOCABULARY))
    df = spark.createDataFrame([(i, f"gfqzxwvkpj qqzzvvk own{i}zqx") for i in range(8)], "doc_id long, text string").coalesce(1)
    rows = byte_bpe._chunks(df, tokens, public_tokenizers.PATTERN, 40).collect()
    assert [len(r["ids"]) for r in rows] == [1] * 8
    words = {w.encode() for r in df.collect() for w in regex.findall(public_tokenizers.PATTERN, r["text"])} - tokens.keys()
    assert sum(len(r["words"]) for r in rows) == len(words)


@pytest.mark.parametrize("remembered", [1, 40, byte_bpe.REMEMBERED])
def test_remembered_and_forgotten_words_give_the_same(spark, monkeypatch, remembered):
    monkeypatch.setattr(byte_bpe, "PORTION", 3)
    r = random.Random(5)
    some = [None, "", " ", *(" ".join("".join(r.choice("eqzñx\n1") for _ in range(r.randint(1, 4))) for _ in range(20)) for _ in range(30))] * 2
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    for pattern in (public_tokenizers.PATTERN, r"\w+"):  # the second one leaves blanks out
        own = tiktoken_of(path, pattern)
        got = byte_bpe.encode(df, pattern=pattern, chunk_bytes=150, remembered=remembered).collect()
        assert [np.frombuffer(x["ids"], "<u4").tolist() for x in sorted(got)] == [own.encode_ordinary(t or "") for t in some]


def test_bpe_of_awkward_documents(spark, documents, empty):
    assert byte_bpe.encode(empty).collect() == []
    own = tiktoken_of(public_tokenizers.path(byte_bpe.VOCABULARY))
    got = byte_bpe.decode(byte_bpe.encode(documents)).collect()
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], own.encode_ordinary(r["text"] or "")) for r in documents.select("doc_id", "text").collect())
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == want
    missing = spark.createDataFrame([(None,)], "ids binary")
    assert byte_bpe.decode(missing).first()["decoded"] is None


def test_queries_of_the_new_operators(spark, tmp_path):
    path = str(tmp_path)
    rows = awkward(rows_of(90, 64, 6), 64)
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(1, "two words"), (2, None), (3, "x" * 300)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    assert sorted((tuple(r) for r in queries.op11_yinyang(spark, path).collect()), key=repr) == lloyd(rows, 8, 10, 1024, 64)
    assert sorted((tuple(r) for r in queries.op13_vector_codes(spark, path).collect()), key=repr) == coded(rows, 8, 16, 6, 4096)
    own = tiktoken_of(public_tokenizers.path(byte_bpe.VOCABULARY))
    for r in queries.op12_byte_bpe(spark, path).collect():
        text = {1: "two words", 2: "", 3: "x" * 300}[r["doc_id"]]
        ids = np.array(own.encode_ordinary(text), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
