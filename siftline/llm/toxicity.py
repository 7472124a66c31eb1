"""Toxicity: support vector machine on a gap-weighted subsequence kernel, with Nyström landmarks.

k(s, t) sums, over all subsequences of ORDER symbols that skip at most GAP symbols at a time, LAMBDA to the power of
the skipped symbols in s and t. Marks are dropped and accents folded, a blank is a symbol of its own; so insults with
inserted characters, marks or blanks keep most of their subsequences. Instances are windows of a sentence, begun at
each word. Landmarks are windows of the labelled sentences: words that set toxic texts apart, and words of others.
The machine is linear in the Nyström coordinates K_mm^(-1/2) k(landmarks, s); its decision is therefore one weight for
each subsequence, which scores every window of every text in a few array passes.

Labels are a text's, insults a sentence's: witness windows of toxic texts are chosen, the machine fitted, witnesses
and the hardest windows of other texts chosen again. The telling words are also learnt with an inserted character and
with blanks between their characters. A text's score is its worst window's decision through a logistic
curve that is fitted to the labels.

Defined cases: null, empty and wordless texts have score 0; without labels of both kinds every score is 0; repeated
rows get equal scores; a row without an id counts as held out. At most FIT_ROWS labelled texts and FIT_BYTES of text of
each kind are learnt from, whole.
"""

from __future__ import annotations

from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftline.llm import _bytes
from siftline.llm._common import bound_batches, keyed_hash, sampled, whole_texts

FIT_ROWS, FIT_BYTES, SEED = 2_000, 8 << 20, 9
ORDER, GAP, LAMBDA, WINDOW = 4, 2, 0.5, 7
LANDMARKS, WITNESS_WORDS, NEGATIVES, ROUNDS, COST = 400, 240, 4_000, 5, 10.0
#: How much an instance with inserted characters or blanks weighs.
VARIED = 1.0
#: Evidence for a telling word.
TELLING = 20.0
DECIDE = 0.7

_SYMBOLS, _DROP, _PAD = 28, 255, WINDOW + (ORDER - 1) * GAP + 1
#: Latin-1 letters of two UTF-8 bytes, from À to ÿ, as letters without accents (fixed values).
_LATIN = "aaaaaaaceeeeiiiidnooooo ouuuuytsaaaaaaaceeeeiiiidnooooo ouuuuyty"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    one, two = np.full(256, _DROP, np.uint8), np.full(256, _DROP, np.uint8)
    for i in range(26):
        one[65 + i] = one[97 + i] = i + 1
    one[[32, *range(9, 14)]] = 0
    one[194], one[196:] = _DROP, 27
    for i, c in enumerate(_LATIN):
        two[128 + i] = 0 if c == " " else ord(c) - 96
    two[[0x97, 0xB7]] = _DROP
    return one, two


_ONE, _TWO = _tables()
_STEPS = list(product(range(1, GAP + 1), repeat=ORDER - 1))
_FADE = np.array([LAMBDA ** (sum(d) - ORDER + 1) for d in _STEPS], np.float32)
_FEATURES = _SYMBOLS**ORDER


def symbols(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of texts laid end to end with blanks between, where each text begins)."""
    before = np.empty(len(buf), np.uint8)
    if len(buf):
        before[0], before[1:] = 0, buf[:-1]
    s = np.where(before == 0xC3, _TWO[buf], _ONE[buf])
    kept = np.flatnonzero(s != _DROP)
    upto = np.concatenate([[0], np.cumsum(s != _DROP)])[offs]
    shift = _PAD * (1 + np.arange(len(offs) - 1))
    out = np.zeros(len(kept) + _PAD * len(offs) + _PAD, np.uint8)
    out[np.arange(len(kept)) + np.repeat(shift, np.diff(upto))] = s[kept]
    return out, upto + _PAD * (1 + np.arange(len(offs)))


def word_starts(s: np.ndarray) -> np.ndarray:
    """Where windows begin: at the blank before each word."""
    return np.flatnonzero((s[1:] != 0) & (s[:-1] == 0))


def window_features(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Subsequence numbers of the windows, a row a window; their weights are fades()."""
    at = starts[:, None] + np.arange(WINDOW)[None, :]
    cols = []
    for d in _STEPS:
        i, f = at, s[at].astype(np.int64)
        for step in d:
            i = i + step
            f = f * _SYMBOLS + s[i]
        cols.append(f)
    return np.concatenate(cols, axis=1)


def fades() -> np.ndarray:
    return np.repeat(_FADE, WINDOW)


def decisions(weight: np.ndarray, s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Decision (without the offset) of the windows that begin at starts: shared passes over all symbols."""
    n = len(s) - (ORDER - 1) * GAP
    own = np.zeros(n, np.float32)
    for lo in range(0, n, _bytes.CHUNK):
        m = min(_bytes.CHUNK, n - lo)
        wide = s[lo : lo + m + (ORDER - 1) * GAP].astype(np.int32)
        pair = {d: wide[: len(wide) - d] * _SYMBOLS + wide[d:] for d in range(1, GAP + 1)}
        for d, fade in zip(_STEPS, _FADE):
            own[lo : lo + m] += weight.take(pair[d[0]][:m] * _SYMBOLS**2 + pair[d[2]][d[0] + d[1] : d[0] + d[1] + m]) * fade
    upto = np.concatenate([[0.0], np.cumsum(own, dtype=np.float64)])
    return upto[np.minimum(starts + WINDOW, n)] - upto[np.minimum(starts, n)]


class Model:
    """weight of each subsequence, offset, and the logistic curve's slope and offset."""

    def __init__(self, weight=None, offset=0.0, curve=(1.0, 0.0)):
        self.weight, self.offset, self.curve = weight, offset, curve

    def worst(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The highest decision of each text's windows; -inf without words."""
        s, begins = symbols(buf, offs)
        starts = word_starts(s)
        out = np.full(len(offs) - 1, -np.inf)
        if len(starts):
            f = decisions(self.weight, s, starts) + self.offset
            first = np.searchsorted(starts, begins - 1)
            some = np.flatnonzero(np.diff(first))
            out[some] = np.maximum.reduceat(f, first[some])
        return out

    def score(self, worst: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(worst), 1 / (1 + np.exp(-np.clip(self.curve[0] * np.where(np.isfinite(worst), worst, 0) + self.curve[1], -40, 40))), 0.0)


def _svm(z: np.ndarray, y: np.ndarray, share: np.ndarray, cost: float) -> tuple[np.ndarray, float]:
    """Squared-hinge machine by Newton steps on its support."""
    z1 = np.concatenate([z, np.ones((len(z), 1))], 1)
    ridge = np.eye(z1.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(z1.shape[1])
    on = np.ones(len(z), bool)
    for _ in range(25):
        zs = z1[on] * (cost * share[on])[:, None]
        w = np.linalg.solve(ridge + zs.T @ z1[on], zs.T @ y[on])
        now = y * (z1 @ w) < 1
        if (now == on).all():
            break
        on = now
    return w[:-1], float(w[-1])


def _telling(c1: int, c0: int, n1: int, n0: int) -> bool:
    """Whether a word is in more texts of the first kind than chance gives among many words: twice the log-likelihood ratio above TELLING."""
    e1 = (c1 + c0) * n1 / (n1 + n0)
    e0 = c1 + c0 - e1
    return c1 > e1 and 2 * (c1 * np.log(c1 / e1) + (c0 * np.log(c0 / e0) if c0 else 0.0)) > TELLING


def fit(texts: list[str], toxic: list[int]) -> Model | None:
    """None unless there are texts of both kinds with words."""
    y = np.array(toxic, np.int64)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(SEED)
    col = pa.array(texts, pa.large_string())
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t.encode()) for t in col.to_pylist()])])
    s, begins = symbols(data, offs)
    starts = word_starts(s)
    if not len(starts):
        return None
    owner = np.searchsorted(begins - 1, starts, "right") - 1
    ends = np.flatnonzero((s[1:] == 0) & (s[:-1] != 0)) + 1
    raw = s.tobytes()
    pool: dict[bytes, bytes] = {}
    word = [pool.setdefault(w, w) for w in (raw[a + 1 : b] for a, b in zip(starts.tolist(), ends.tolist()))]
    seen, firsts = [Counter(), Counter()], np.searchsorted(owner, np.arange(len(y) + 1))
    for o in range(len(y)):
        seen[y[o]].update(set(word[firsts[o] : firsts[o + 1]]))
    n1, n0 = int(y.sum()), int((1 - y).sum())
    odds = {w: np.log((c + 0.1) / (n1 + 0.2)) - np.log((seen[0][w] + 0.1) / (n0 + 0.2)) for w, c in seen[1].items() if c >= 3 and _telling(c, seen[0][w], n1, n0)}
    telling = sorted((w for w in odds if odds[w] > 1.5), key=lambda w: (-odds[w] * np.sqrt(seen[1][w]), w))[:WITNESS_WORDS]
    first_of: dict[bytes, int] = {}
    for i, w in enumerate(word):
        first_of.setdefault(w, i)
    calm = np.flatnonzero(y[owner] == 0)
    if not len(calm):
        return None
    rest = rng.choice(calm, min(len(calm), LANDMARKS - len(telling)), replace=False)
    marks = np.concatenate([np.array([first_of[w] for w in telling], np.int64), rest]).astype(np.int64)

    # The telling words with a character inserted, and spaced out: more instances, after the texts.
    more = []
    for w in telling:
        if len(w) > 3:
            at, c = 1 + int(rng.integers(len(w) - 1)), int(rng.integers(1, 27))
            more += [w[:at] + bytes([c]) + w[at:], b"\0".join(bytes([x]) for x in w)]
    varied = len(s) + np.cumsum([0] + [len(w) + _PAD for w in more])[: len(more)] - 1
    s = np.concatenate([s, np.frombuffer(b"".join(w + bytes(_PAD) for w in more), np.uint8)])
    n_words = len(starts)
    starts = np.concatenate([starts, varied.astype(np.int64)])
    varied = n_words + np.arange(len(more))

    # Kernel values with landmarks, over the subsequences that landmarks have.
    lf = window_features(s, starts[marks])
    known, flat = np.unique(lf, return_inverse=True)
    phi = np.zeros((len(marks), len(known) + 1), np.float32)
    np.add.at(phi, (np.repeat(np.arange(len(marks)), lf.shape[1]), flat.reshape(-1)), np.tile(fades(), len(marks)))
    phi[:, -1] = 0
    where = np.full(_FEATURES, len(known), np.int32)
    where[known] = np.arange(len(known))

    def kernel(at: np.ndarray) -> np.ndarray:
        out = []
        for lo in range(0, len(at), 400):
            f = where[window_features(s, starts[at[lo : lo + 400]])]
            dense = np.zeros((len(f), len(known) + 1), np.float32)
            np.add.at(dense, (np.repeat(np.arange(len(f)), f.shape[1]), f.reshape(-1)), np.tile(fades(), len(f)))
            out.append(dense @ phi.T)
        return np.concatenate(out).astype(np.float64)

    kmm = (phi @ phi.T).astype(np.float64)
    val, vec = np.linalg.eigh(kmm + 1e-6 * np.trace(kmm) / len(kmm) * np.eye(len(kmm)))
    root = vec @ np.diag(1 / np.sqrt(np.maximum(val, 1e-8))) @ vec.T

    best = np.array([odds.get(w, -9.0) for w in word])
    toxic_texts = np.flatnonzero(y == 1)
    hard = np.zeros(0, np.int64)
    model, score = Model(), best
    for turn in range(ROUNDS):
        witness = [firsts[o] + int(np.argmax(score[firsts[o] : firsts[o + 1]])) for o in toxic_texts if firsts[o + 1] > firsts[o]]
        witness = np.array([i for i in witness if (turn and score[i] > -0.5) or (not turn and score[i] > 1.5)], np.int64)
        if not len(witness):
            return None
        neg = np.unique(np.concatenate([rng.choice(calm, min(len(calm), NEGATIVES), replace=False), hard]))
        at = np.concatenate([witness, varied, neg])
        label = np.concatenate([np.ones(len(witness) + len(varied)), -np.ones(len(neg))])
        share = np.where(label > 0, len(neg) / len(witness), 1.0)
        share[len(witness) : len(witness) + len(varied)] = VARIED
        w, b = _svm(kernel(at) @ root, label, share, COST)
        weight = np.zeros(_FEATURES, np.float32)
        weight[known] = (phi.T @ (root @ w).astype(np.float32))[:-1]
        model = Model(weight, b)
        score = decisions(weight, s, starts[:n_words]) + b
        order = calm[np.argsort(-score[calm])]
        hard = np.unique(np.concatenate([hard, order[: NEGATIVES // 2]]))
    worst = np.full(len(y), -3.0)
    some = np.flatnonzero(np.diff(firsts))
    worst[some] = np.maximum.reduceat(score, firsts[some])
    model.curve = _curve(worst, y)
    return model


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton steps, each kind of label weighing as much as it occurs."""
    a, b = 1.0, 0.0
    x = np.clip(x, -3, 3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * x).sum() + 1e-2 * a, (p - y).sum()])
        r = p * (1 - p) + 1e-9
        h = np.array([[(r * x * x).sum() + 1e-2, (r * x).sum()], [(r * x).sum(), r.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    return max(a, 1e-3), b


def learn(docs: DataFrame, labels: DataFrame, toxic: Column, usable: Column, doc_id: str, text: str, label_id: str) -> Model | None:
    """Fit on a bounded sample of labelled texts of each kind; usable: which label rows may be learnt from."""
    known = labels.select(F.col(label_id).alias("_id"), toxic.cast("int").alias("_toxic"), usable.alias("_use")).filter("_use and _id is not null and _toxic in (0, 1)")
    order = keyed_hash(SEED, F.col("_id").cast("string"))
    some = sampled(known.filter("_toxic = 1"), FIT_ROWS, order).unionByName(sampled(known.filter("_toxic = 0"), FIT_ROWS, order)).drop("_use")
    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(some), "_id").filter("_text is not null")
    rows = whole_texts(sampled(found, 2 * FIT_ROWS, order), "_text", FIT_ROWS, FIT_BYTES, order, "_toxic").select("_text", "_toxic").collect()
    return fit([r[0] for r in rows], [r[1] for r in rows])


def score_documents(docs: DataFrame, labels: DataFrame, toxic: Column, held_out: Column, label_usable: Column, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score and predicted for every document. held_out is a column of docs, label_usable one of labels."""
    spark = docs.sparkSession
    bound_batches(spark)
    held = spark.sparkContext.broadcast(learn(docs, labels, toxic, label_usable, doc_id, text, label_id))

    def run(batches):
        model = held.value
        for b in batches:
            score = np.zeros(b.num_rows)
            for lo, hi, buf, offs in _bytes.chunks(b.column(2)) if model else ():
                score[lo:hi] = model.score(model.worst(buf, offs))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= DECIDE).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col(text).alias("text"))
    schema = narrow.select("doc_id", "held_out").schema.add("score", "double").add("predicted", "integer")
    return narrow.mapInArrow(run, schema)
