import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siftline.llm import _bytes, language_id as L, ordinal_quality as O, toxicity as T


def test_words_and_shingles_equal_python():
    texts = ["One  two\tTHREE", "", None, "é ü\x0bx", " lead", "a b c d e f", "x" * 5000 + " y"]
    column = pa.array(texts)
    seen = {}
    for lo, hi, buf, offs in _bytes.chunks(column):
        starts, ends, first = _bytes.words(buf, offs)
        h = _bytes.word_hashes(buf, starts, ends)
        s, at = _bytes.shingles(h, first, 3)
        for i in range(hi - lo):
            words = [bytes(buf[a:b]).decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
            assert words == (texts[lo + i] or "").split()
            assert ((at >= first[i]) & (at < first[i + 1])).sum() == max(0, len(words) - 2)
            for w, x in zip(words, h[first[i] : first[i + 1]]):
                assert seen.setdefault(w.lower(), x) == x
    assert len(set(seen.values())) == len(seen)


def test_language_held_out(spark):
    r = random.Random(2)
    stems = {"en": ["the", "and", "ing", "tion", "wh"], "fr": ["eau", "é", "ou", "le", "què"], "de": ["sch", "ung", "ß", "ü", "zu"]}
    rows = [(i, " ".join("".join(r.choice(stems[a]) for _ in range(3)) for _ in range(r.randint(5, 200))), a) for i in range(300) for a in [r.choice(list(stems))]]
    rows += [(900, None, "en"), (901, "123 !?", "fr"), (902, rows[0][1] * 200, rows[0][2]), (None, rows[0][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = {x.doc_id: x for x in L.identify(df, held).collect()}
    lang = {d: a for d, t, a in rows}
    out = [d for d, x in got.items() if x.held_out and d and d < 900]
    assert len(out) > 30 and np.mean([got[d].lang_pred == lang[d] for d in out]) > 0.97
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == rows[0][2]
    assert all(0 <= x.score <= 1 for x in got.values())
    assert {x.lang_pred for x in L.identify(df.withColumn("lang", F.lit(None).cast("string")), held).collect()} == {"und"}
    assert L.identify(df.limit(0), held).count() == 0


def test_pair_tables_are_the_convolution():
    net = L.Network(["a", "b"])
    x = np.random.default_rng(0).integers(0, 256, (5, L.WINDOW)).astype(np.uint8)
    tables = net.pairs()
    h = np.concatenate([np.maximum(net.convolved(x, w).max(1), 0) for w in L.WIDTHS], 1)
    assert np.allclose(np.exp(net.log_shares(x, tables)), L._softmax(h @ net.dense + net.offset), atol=1e-5)


def labelled(n=600):
    r = random.Random(6)
    words = ["".join(r.choice("aeiounrtlsmd") for _ in range(r.randint(2, 8))) for _ in range(500)]
    texts, toxic = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(8, 120))]
        toxic.append(int(i % 5 == 0))
        if toxic[-1]:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(["wretchkin", "foulgrub", "scabling"]))
        texts.append(" ".join(w))
    return texts, toxic


def test_toxicity_held_out_and_gapped(spark):
    texts, toxic = labelled()
    extra = [(900, "they called it a fou-lgrub again"), (901, "Wret.chkin!"), (902, ""), (903, None), (904, "scabbling here")]
    docs = spark.createDataFrame([*enumerate(texts), *extra, extra[0]], "doc_id long, text string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    got = {x.doc_id: x for x in T.score_documents(docs, labels, F.col("toxic"), held, ~held).collect()}
    out = [i for i in range(len(texts)) if got[i].held_out]
    assert np.mean([got[i].predicted == toxic[i] for i in out]) > 0.97
    assert got[900].predicted == got[901].predicted == 1 and got[904].score > 0.3
    assert got[902].score == got[903].score == 0
    none = T.score_documents(docs, labels.limit(0), F.col("toxic"), held, ~held).collect()
    assert {x.score for x in none} == {0.0}


def test_decision_equals_sum_over_subsequences():
    text = "ab cde".encode()
    s, begins = T.symbols(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    starts = T.word_starts(s)
    weight = np.random.default_rng(0).normal(size=T._FEATURES).astype(np.float32)
    f = T.window_features(s, starts)
    assert np.allclose((weight[f] * T.fades()).sum(1), T.decisions(weight, s, starts), atol=1e-3)


def test_ordinal_grades(spark):
    r = random.Random(1)
    sound = [f"s{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(400):
        grade = i % 3
        w = [r.choice(sound) for _ in range(60)]
        for j in range(60):
            if grade == 0 and j % 2:
                w[j] += "%%%"
            if grade == 1 and j % 3 == 0:
                w[j] = "meh"
        rows.append((i, " ".join(w)))
        if i < 300:
            labels.append((i, grade))
    rows += [(900, None), (901, ""), (902, rows[2][1] * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tail", F.lit("t"))
    lab = spark.createDataFrame(labels + [(3, None)], "doc_id long, grade int")
    got = {x.doc_id: x for x in O.grade_documents(docs, lab, F.col("grade"), select_grade=2).collect()}
    assert np.mean([round(got[i].expected_grade) == i % 3 for i in range(300, 400)]) > 0.95
    assert np.mean([got[i].kept == (i % 3 == 2) for i in range(300, 400)]) > 0.95
    assert got[900].expected_grade == got[901].expected_grade and got[902].kept
    assert {x.expected_grade for x in O.grade_documents(docs, lab.limit(0), F.col("grade")).collect()} == {0.0}


def test_fitting_reads_whole_texts(spark, monkeypatch):
    """The telling word stands after 30,000 characters: all models are given it. A bound in bytes leaves out texts, not parts of them."""
    rows = [(i, "calm words " * 3_000 + f"end{i}", "ab"[i % 2]) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, y int")
    seen = []
    models = {
        "T": (lambda: T.learn(docs, labels, F.col("y"), F.lit(True), "doc_id", "text", "doc_id"), T, lambda texts, toxic: seen.extend(texts)),
        "O": (lambda: O.grade_documents(docs, labels, F.col("y")), O, lambda texts, grades: seen.extend(texts) or O.Model(np.zeros(1), np.zeros(0), np.array([0]))),
        "L": (lambda: L.learn(docs, F.lit(True), "doc_id", "text", "lang"), L, lambda texts, langs: seen.extend(texts)),
    }
    for run, module, fit in models.values():
        seen.clear()
        monkeypatch.setattr(module, "fit", fit)
        run()
        assert sorted(seen) == sorted(t for _, t, _ in rows)
        seen.clear()
        monkeypatch.setattr(module, "FIT_BYTES", 2 * len(rows[0][1]) + 9 if module is not T else len(rows[0][1]) + 9)
        run()
        assert len(seen) == 2 and set(seen) <= {t for _, t, _ in rows}


def test_rows_without_an_id_and_empty_tables(spark, documents, empty):
    labels = spark.createDataFrame([(i, int(i % 7 == 0), 1) for i in range(150)], "doc_id long, toxic int, quality int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    for out in (T.score_documents(documents, labels, F.col("toxic"), held, ~held), L.identify(documents, held)):
        got = out.select("doc_id", "held_out").collect()
        assert len(got) == documents.count() and all(r.held_out is (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert T.score_documents(empty, labels, F.col("toxic"), held, ~held).count() == 0
    assert O.grade_documents(empty, labels, F.col("quality")).count() == 0
    assert O.grade_documents(documents, labels, F.col("quality")).count() == documents.count()


def test_tails_equal_the_cumulative_link_word_by_word(spark):
    """Brute force: P(grade > k) from the mean weight of a text's words and shapes, one word at a time."""
    texts = ["Good words here 12 and more", "bad bad bad !!!", "", "Ünï cödé x", "a" * 100 + " tail"]
    r = np.random.default_rng(4)
    model = O.Model(r.normal(size=1 << O.BITS) * 5, np.array([-0.5, 0.8]), np.array([0, 1, 2]))
    half = 1 << (O.BITS - 1)

    def one(word, fold):
        b = word.encode()
        return int(_bytes.word_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]), fold)[0]) % half

    for text in texts:
        total, before = 0.0, None
        for w in text.split():
            total += model.weights[one(w, _bytes.LOWER)] + model.weights[half if w.lower() == before else half + one(w, _bytes.SHAPE)]
            before = w.lower()
        score = total / max(1, len(text.split()))
        want = [1 / (1 + np.exp(b - score)) for b in model.bias]
        for _, _, buf, offs in _bytes.chunks(pa.array([text])):
            word, shape, first = O.features(buf, offs)
            assert np.allclose(model.tails(O._means(model.weights[word] + model.weights[shape], first))[0], want)


def test_giant_texts_do_not_keep_out_the_rest(spark):
    """The first text is over the bound, or most of it: the others are still learnt from."""
    from siftline.llm._common import whole_texts

    rows = [(0, "x" * 2_000, "a"), (1, "y" * 900, "a"), *[(i, "z" * 10, "a") for i in range(2, 12)], (12, "w" * 950, "b"), (13, None, "b")]
    df = spark.createDataFrame(rows, "i int, text string, kind string")
    got = sorted(r.i for r in whole_texts(df, "text", 100, 1_000, F.col("i"), "kind").collect())
    assert got == [*range(1, 12), 12, 13]
    assert sorted(r.i for r in whole_texts(df, "text", 100, 899, F.col("i"), "kind").collect()) == [*range(2, 12), 13]
    assert sorted(r.i for r in whole_texts(df, "text", 3, 1_000, F.col("i"), "kind").collect()) == [2, 3, 4, 12, 13]
