"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade <= k) = logistic(threshold_k - w·x) with ordered thresholds and one weight vector for all grades. x holds the
shares of hashed words and of hashed word shapes (capitals, digits, marks, a word said
again) in the whole text. It is fitted on at most
FIT_ROWS labelled documents and FIT_BYTES of text; every document is scored, with its expected grade and the probability of reaching the
grade asked for.

Defined cases: a null or empty text has x = 0, so the thresholds alone decide. Labels with a null grade are left out;
without any, or with one grade only, every document gets that grade (or 0) with probability 1. Repeated rows get
equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftline.llm import _bytes
from siftline.llm._common import bound_batches, keyed_hash, sampled, whole_texts

#: Labelled documents that fitting uses at most, whole, and bytes of their texts.
FIT_ROWS, FIT_BYTES = 6_000, 24 << 20
BITS, STEPS, RATE, L2, SEED = 15, 300, 0.05, 1e-6, 5
#: Selection: probability of reaching this grade of at least this much.
SELECT_GRADE, SELECT_TAIL = 1, 0.5


@dataclass
class Model:
    weights: np.ndarray
    bias: np.ndarray
    grades: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for all but the last grade, a row a document."""
        return 1 / (1 + np.exp(np.clip(self.bias[None, :] - score[:, None], -40, 40)))


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, bucket of its shape, words before each text)."""
    starts, ends, first = _bytes.words(buf, offs)
    mask = np.uint64((1 << (BITS - 1)) - 1)
    hashes = _bytes.word_hashes(buf, starts, ends)
    word = (hashes & mask).astype(np.int64)
    shape = (_bytes.word_hashes(buf, starts, ends, _bytes.SHAPE) & mask).astype(np.int64) + (1 << (BITS - 1))
    again = np.zeros(len(starts), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[:-1][first[:-1] < len(again)]] = False
    shape[again] = 1 << (BITS - 1)  # a word that repeats the one before it has a shape of its own
    return word, shape, first


def _means(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    n = np.diff(first)
    return (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)


def fit(texts: list[str], grades: list[int]) -> Model:
    """Adam on the mean log-likelihood; all documents in every step."""
    kinds = np.unique(np.array(grades, np.int64)) if grades else np.array([0])
    if len(kinds) < 2:
        return Model(np.zeros(1 << BITS), np.zeros(0), kinds)
    y = np.searchsorted(kinds, np.array(grades))
    buckets, rows, shares = [], [], []
    for lo, hi, buf, offs in _bytes.chunks(pa.array(texts, pa.large_string())):
        word, shape, first = features(buf, offs)
        n = np.diff(first)
        row = np.repeat(np.arange(lo, hi), n)
        keys, count = np.unique(np.concatenate([row, row]) * (1 << BITS) + np.concatenate([word, shape]), return_counts=True)
        rows.append(keys >> BITS), buckets.append(keys & ((1 << BITS) - 1))
        shares.append(count / n[(keys >> BITS) - lo])
    bucket, row, share = (np.concatenate(x) for x in (buckets, rows, shares))
    w, theta = np.zeros(1 << BITS), np.linspace(-1, 1, len(kinds) - 1)
    gap = np.log(np.maximum(np.diff(theta), 1e-3))
    first_theta = theta[:1].copy()
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, first_theta, gap)]
    for step in range(1, STEPS + 1):
        theta = np.concatenate([first_theta, first_theta + np.cumsum(np.exp(gap))])
        s = np.bincount(row, share * w[bucket], len(y))
        cut = np.concatenate([[-np.inf], theta, [np.inf]])
        up, down = _logistic(cut[y + 1] - s), _logistic(cut[y] - s)
        p = np.maximum(up - down, 1e-12)
        d_up, d_down = up * (1 - up) / p, down * (1 - down) / p
        g_s = (d_up - d_down) / len(y)  # of the loss, by s
        g_theta = np.array([(np.sum(d_down[y == k + 1]) - np.sum(d_up[y == k])) / len(y) for k in range(len(theta))])
        grads = (np.bincount(bucket, share * g_s[row], len(w)) + L2 * w, np.array([g_theta.sum()]), np.array([np.exp(gap[j]) * g_theta[j + 1 :].sum() for j in range(len(gap))]))
        for x, g, m in zip((w, first_theta, gap), grads, moments):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            x -= RATE * 10 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-9)
    return Model(w, np.concatenate([first_theta, first_theta + np.cumsum(np.exp(gap))]), kinds)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: Column, doc_id: str, text: str, label_id: str, rows: int) -> list:
    """At most rows (text, label) and FIT_BYTES of a bounded sample by hash; labels of the sample are broadcast, the documents scanned once."""
    some = sampled(labels.select(F.col(label_id).alias("_id"), label.alias("_label")).filter("_label is not null and _id is not null"), rows, keyed_hash(SEED, F.col("_id").cast("string")))
    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(some), "_id").filter("_text is not null")
    order = keyed_hash(SEED, F.col("_id").cast("string"))
    return whole_texts(sampled(found, rows, order).withColumn("_all", F.lit(1)), "_text", rows, FIT_BYTES, order, "_all").select("_text", "_label").collect()


def grade_documents(docs: DataFrame, labels: DataFrame, grade: Column, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", select_grade: int = SELECT_GRADE, select_tail: float = SELECT_TAIL) -> DataFrame:
    """doc_id, expected_grade, tail (probability of select_grade or more) and kept for every document. grade: a column of labels."""
    spark = docs.sparkSession
    bound_batches(spark)
    known = labelled_texts(docs, labels, grade, doc_id, text, label_id, FIT_ROWS)
    model = fit([r[0] for r in known], [int(r[1]) for r in known])
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in batches:
            expected, tail = np.zeros(b.num_rows), np.zeros(b.num_rows)
            for lo, hi, buf, offs in _bytes.chunks(b.column(1)):
                word, shape, first = features(buf, offs)
                t = m.tails(_means(m.weights[word] + m.weights[shape], first))
                expected[lo:hi] = m.grades[0] + t @ np.diff(m.grades)
                at = int(np.searchsorted(m.grades, select_grade))
                tail[lo:hi] = 1.0 if at == 0 else 0.0 if at >= len(m.grades) else t[:, at - 1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(expected), pa.array(tail), pa.array(tail >= select_tail)], names=["doc_id", "expected_grade", "tail", "kept"])

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = narrow.select("doc_id").schema.add("expected_grade", "double").add("tail", "double").add("kept", "boolean")
    return narrow.mapInArrow(run, schema)
