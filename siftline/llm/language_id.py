"""Language identification by a byte convolutional network.

Filters of several widths over bytes, a maximum over each fixed-length window, and a softmax over the languages,
trained in numpy by Adam on windows of whole labelled texts. A whole text is cut into windows of WINDOW bytes (the last one
padded); its prediction is the language with the highest mean log-probability, its score that language's share.
For prediction a filter of width w is a sum of table look-ups by pairs of bytes, which is the same convolution.

Defined cases: a null text, or one without a letter, is "und" with score 0. Without labelled texts everything is "und".
Repeated rows get equal predictions; a row without an id counts as held out. At most FIT_ROWS texts and FIT_BYTES of
text are learnt from, as many of each language, whole: each training step draws texts, and a window of each, from all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftline.llm import _bytes
from siftline.llm._common import bound_batches, keyed_hash, whole_texts

FIT_ROWS, FIT_BYTES, SEED = 2_400, 32 << 20, 13
WINDOW, WIDTHS, FILTERS, STEPS, BATCH, RATE = 128, (2, 3, 4), 12, 2_000, 128, 0.01


class Network:
    """tables[w]: (w, 256, FILTERS) weights of the filters of width w; dense: from the maxima to languages."""

    def __init__(self, languages: list[str], seed: int = SEED):
        r = np.random.default_rng(seed)
        self.languages = languages
        self.tables = {w: r.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.dense = r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.offset = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables.values(), *self.bias.values(), self.dense, self.offset]

    def convolved(self, x: np.ndarray, w: int) -> np.ndarray:
        n = x.shape[1] - w + 1
        return sum(self.tables[w][j][x[:, j : j + n]] for j in range(w)) + self.bias[w]

    def train(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = SEED) -> None:
        """x: the windows of all texts, those of text i from first[i] on; y: the texts' languages."""
        r, m, v, n = np.random.default_rng(seed), None, None, np.diff(first)
        texts = np.flatnonzero(n)
        for t in range(1, STEPS + 1):
            of = texts[r.integers(0, len(texts), BATCH)]
            grads = self._gradients(x[first[of] + (r.random(BATCH) * n[of]).astype(np.int64)], y[of])
            m = m or [np.zeros_like(g) for g in grads]
            v = v or [np.zeros_like(g) for g in grads]
            for p, g, a, c in zip(self.parameters(), grads, m, v):
                a *= 0.9
                a += 0.1 * g
                c *= 0.999
                c += 0.001 * g * g
                p -= RATE * (a / (1 - 0.9**t)) / (np.sqrt(c / (1 - 0.999**t)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        peaks, places = [], []
        for w in WIDTHS:
            c = self.convolved(x, w)
            at = c.argmax(1)
            places.append(at)
            peaks.append(np.take_along_axis(c, at[:, None, :], 1)[:, 0, :])
        h = np.concatenate(peaks, 1)
        on = np.maximum(h, 0)
        p = _softmax(on @ self.dense + self.offset)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = (p @ self.dense.T) * (h > 0)
        tables, bias = [], []
        for i, w in enumerate(WIDTHS):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            own = np.zeros_like(self.tables[w])
            rows, f = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
            for j in range(w):
                np.add.at(own[j], (x[rows, places[i] + j], np.broadcast_to(f, g.shape)), g)
            tables.append(own)
            bias.append(g.sum(0))
        return [*tables, *bias, on.T @ p, p.sum(0)]

    def pairs(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """For each width: (place, table of 65,536 pairs of bytes) whose sums are the convolution."""
        out = {}
        for w in WIDTHS:
            t = self.tables[w]
            both = [(j, (t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS)) for j in range(0, w - 1, 2)]
            if w % 2:
                both.append((w - 2, np.repeat(np.zeros((1, FILTERS), np.float32), 65536, 0) + np.tile(t[w - 1], (256, 1))))
            out[w] = both
        return out

    def log_shares(self, x: np.ndarray, tables) -> np.ndarray:
        """Log-probabilities of windows (rows of bytes)."""
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        peaks = []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            c = None
            for j, t in tables[w]:
                part = t.take(pair[:, j : j + n], axis=0)
                c = part if c is None else np.add(c, part, out=c)
            peaks.append(c.max(1) + self.bias[w])
        z = np.maximum(np.concatenate(peaks, 1), 0) @ self.dense + self.offset
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows as rows of bytes, number of windows before each text)."""
    size = np.diff(offs)
    n = -(-size // WINDOW)
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(int(first[-1]) * WINDOW, np.uint8)
    out[np.arange(len(buf)) + np.repeat(first[:-1] * WINDOW - offs[:-1], size)] = buf
    return out.reshape(-1, WINDOW), first


def fit(texts: list[str], languages: list[str]) -> Network | None:
    if not texts:
        return None
    names = sorted(set(languages))
    xs, sizes = [], []
    for _, _, buf, offs in _bytes.chunks(pa.array(texts, pa.large_string())):
        x, first = windows(buf, offs)
        xs.append(x), sizes.append(np.diff(first))
    net = Network(names)
    if len(names) > 1 and sum(map(len, xs)):
        net.train(np.concatenate(xs), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.array([names.index(a) for a in languages]))
    return net


def predictions(net: Network, tables, column: pa.Array, known: np.ndarray) -> tuple[list, np.ndarray]:
    """(language, score) of every text; "und" where known is false."""
    names, score = ["und"] * len(column), np.zeros(len(column))
    for lo, hi, buf, offs in _bytes.chunks(column):
        x, first = windows(buf, offs)
        total = np.zeros((hi - lo, len(net.languages)))
        of = np.repeat(np.arange(hi - lo), np.diff(first))
        for a in range(0, len(x), 1024):  # some megabytes at a time
            part = net.log_shares(x[a : a + 1024], tables)
            for k in range(part.shape[1]):
                total[:, k] += np.bincount(of[a : a + 1024], part[:, k], hi - lo)
        share = _softmax(total / np.maximum(np.diff(first), 1)[:, None])
        best = share.argmax(1)
        for i in np.flatnonzero(known[lo:hi]):
            names[lo + i], score[lo + i] = net.languages[best[i]], share[i, best[i]]
    return names, score


def learn(docs: DataFrame, usable: Column, doc_id: str, text: str, lang: str) -> Network | None:
    """Fit on as many texts of each language as FIT_ROWS allows: the least by hash, found among those below a hash bound."""
    rows = docs.filter(usable & F.col(lang).isNotNull() & F.col(doc_id).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # a row a language
    if not counts:
        return None
    each = max(1, FIT_ROWS // len(counts))
    order = keyed_hash(SEED, F.col(doc_id).cast("string"))
    bound = F.create_map(*[F.lit(x) for a, n in counts.items() for x in (a, min(1.0, 4.0 * each / n + 100.0 / n))])
    near = rows.filter(F.pmod(order, F.lit(1 << 30)) < F.element_at(bound, F.col(lang)) * (1 << 30))
    near = near.select(F.col(lang).alias("lang"), F.col(text).alias("text"), order.alias("_order")).filter(F.col("text").rlike(r"\p{L}"))
    some = whole_texts(near, "text", each, FIT_BYTES // len(counts), F.col("_order"), "lang").orderBy("_order", "text").select("text", "lang").collect()
    return fit([r[0] for r in some], [r[1] for r in some])


def identify(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document; learns from those that are not held out."""
    spark = docs.sparkSession
    bound_batches(spark)
    held_out = F.coalesce(held_out, F.lit(True))
    net = learn(docs, ~held_out, doc_id, text, lang)
    held = spark.sparkContext.broadcast(net)

    def run(batches):
        model = held.value
        tables = model.pairs() if model else None
        for b in batches:
            known = b.column(3).to_numpy(zero_copy_only=False).astype(bool)
            names, score = predictions(model, tables, b.column(2), known) if model else (["und"] * b.num_rows, np.zeros(b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    narrow = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("known"))
    schema = narrow.select("doc_id", "held_out").schema.add("lang_pred", "string").add("score", "double")
    return narrow.mapInArrow(run, schema)
