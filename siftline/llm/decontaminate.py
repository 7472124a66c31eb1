"""Benchmark decontamination: SimHash fingerprints of item-sized windows, looked up by Hamming radius, verified exactly.

Texts are lower-cased words; their features are K-word shingles, as often as they stand there (the second time that a
shingle stands in a window is a feature of its own). A shingle in a thousandth of the items, or two, weighs
log(1 + items / its items), any other log(1 + items). A document's window for an item is as long as the item in words.
A window can reach the threshold only if shingles of items of its length weigh that share of it, so only such windows
are fingerprinted (this loses nothing).

A fingerprint has BITS bits, each the sign of a projection of the features' roots of weights on normal numbers drawn
from the features' hashes. Bags of weighted Jaccard similarity J have a cosine of 2 J / (1 + J) at least, whatever
their weights and repeats: 0.889 for 0.8. So a bit differs with a probability of 0.152 at most, 38.2 bits are expected
to, with a deviation of 5.7, and more than RADIUS = 71 do with a probability of 4 in a hundred million, at the very
threshold. The multi-index cuts fingerprints into BLOCKS blocks; two that are within RADIUS < 2 BLOCKS differ by one
bit at most in some block, so each block and its one-bit neighbours find all within RADIUS. What is found is verified
by the exact weighted Jaccard similarity of the two bags.

Items are handled in parts that fit in memory, by hash; each part is searched for in all documents. Defined cases: null
and empty texts and items have no windows; an item shorter than K words is one shingle, found where its words stand;
items of equal words are all reported; repeated documents are reported once each time they occur; without items
nothing is reported; ids of any type are carried.
"""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftline.llm import _bytes
from siftline.llm._common import bound_batches, stored

SHINGLE, SIMILAR = 5, 0.8
BLOCKS, WIDTH, SEED = 36, 7, 3
BITS, RADIUS = BLOCKS * WIDTH, 2 * BLOCKS - 1
#: Items and words of a part of the benchmark; one item may be longer.
PART_ITEMS, PART_WORDS = 20_000, 1_000_000
#: Shingles in one of so many items, and in two, weigh by their frequency.
COMMON = 1_000
#: Windows, and bytes of look-ups, handled at once.
WINDOWS, LOOKUP = 2_048, 1 << 24

_NORMAL = np.array([NormalDist().inv_cdf((i + 0.5) / 256) for i in range(256)], np.float32)
_PLACES = 1 << np.arange(WIDTH)


class Weights:
    """Weight of a shingle: by frequency for the common ones (sorted hashes), that of a shingle in one item for others."""

    def __init__(self, items: int, common: np.ndarray, counts: np.ndarray):
        order = np.argsort(common)
        self.common, self.rare = common[order], float(np.log1p(max(items, 1)))
        self.weight = np.log1p(items / np.maximum(counts[order], 1))

    def __call__(self, s: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.full(len(s), self.rare)
        at = np.minimum(np.searchsorted(self.common, s), len(self.common) - 1)
        return np.where(self.common[at] == s, self.weight[at], self.rare)


def normals(h: np.ndarray) -> np.ndarray:
    """BITS standard normal numbers for each hash."""
    words = np.stack([_bytes.mix(h ^ np.uint64(0x632BE59BD9B4E019 * (j + SEED) & (1 << 64) - 1)) for j in range(-(-BITS // 8))], 1)
    return _NORMAL[words.view(np.uint8)[:, :BITS]]


def features(s: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A hash for the shingle's occurrence of that number (0 for the first)."""
    return np.where(times == 0, s, _bytes.mix(s + times.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


class Index:
    """A part of the items with their bags, fingerprints and blocks."""

    def __init__(self, ids: pa.Array, texts: list[str | None], weights: Weights, k: int = SHINGLE):
        self.k, self.weights = k, weights
        lists = [_shingle_list(t, k) for t in texts]
        kept = [i for i, (h, _) in enumerate(lists) if len(h)]
        self.ids = ids.take(pa.array(kept, pa.int64()))
        self.lengths = np.array([len(lists[i][0]) for i in kept], np.int64)
        self.bags = [np.unique(lists[i][1], return_counts=True) for i in kept]
        self.total = np.array([(weights(u) * c).sum() for u, c in self.bags])
        every = [u for u, _ in self.bags]
        self.known = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.known_of = {int(n): np.unique(np.concatenate([every[i] for i in np.flatnonzero(self.lengths == n)])) for n in np.unique(self.lengths)}
        bits = np.array([window_bits(lists[i][1], np.zeros(1, np.int64), len(lists[i][1]), weights)[0] for i in kept]).reshape(-1, BITS)
        self.prints = packed(bits)
        # For each block and value, the items that differ from it by one bit at most, as a set of bits.
        near = np.zeros((BLOCKS, 1 << WIDTH, -(-max(1, len(kept)) // 64) * 64), bool)
        values = block_values(bits)
        for flip in (0, *_PLACES):
            near[np.arange(BLOCKS)[None, :], values ^ flip, np.arange(len(kept))[:, None]] = True
        self.near_blocks = np.packbits(near, axis=2, bitorder="little").view(np.uint64)

    def is_known(self, s: np.ndarray) -> np.ndarray:
        """Numbers of the shingles that some item has."""
        at = np.flatnonzero(self.filter[(s & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(at):
            return at
        near = np.minimum(np.searchsorted(self.known, s[at]), len(self.known) - 1)
        return at[self.known[near] == s[at]]

    def near(self, bits: np.ndarray) -> list[np.ndarray]:
        """For each fingerprint, the items within RADIUS of it: every block's neighbours, then the distance."""
        out, step = [], max(1, LOOKUP // self.near_blocks[:, 0].nbytes)
        for lo in range(0, len(bits), step):
            some = bits[lo : lo + step]
            met = np.bitwise_or.reduce(self.near_blocks[np.arange(BLOCKS)[None, :], block_values(some)], axis=1)
            for p, row in zip(packed(some), met):
                c = np.flatnonzero(np.unpackbits(row.view(np.uint8), bitorder="little"))
                out.append(c[np.bitwise_count(self.prints[c] ^ p).sum(1, dtype=np.int64) <= RADIUS])
        return out

    def similarity(self, i: int, s: np.ndarray) -> float:
        """Weighted Jaccard of item i and a bag of shingles."""
        u, c = np.unique(s, return_counts=True)
        v, d = self.bags[i]
        both, x, y = np.intersect1d(u, v, assume_unique=True, return_indices=True)
        inner = (self.weights(both) * np.minimum(c[x], d[y])).sum()
        return float(inner / ((self.weights(u) * c).sum() + self.total[i] - inner))


def packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(np.pad(bits, ((0, 0), (0, -BITS % 64))), axis=1).view(np.uint64)


def block_values(bits: np.ndarray) -> np.ndarray:
    return bits.reshape(-1, BLOCKS, WIDTH).astype(np.int64) @ _PLACES


def _shingle_list(text: str | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, shingles) of one text; a short text's whole sequence is its shingle."""
    for _, _, buf, offs in _bytes.chunks(pa.array([text or ""], pa.large_string())):
        starts, ends, first = _bytes.words(buf, offs)
        h = _bytes.word_hashes(buf, starts, ends)
        if 0 < len(h) < k:
            return h, np.array([_bytes.whole(h)], np.uint64)
        return h, _bytes.shingles(h, first, k)[0]
    return np.zeros(0, np.uint64), np.zeros(0, np.uint64)


def window_bits(s: np.ndarray, starts: np.ndarray, n: int, weights: Weights) -> np.ndarray:
    """Fingerprints of the windows of n shingles at starts (sorted): a running sum over each stretch of them."""
    out = []
    for run in np.split(starts, np.flatnonzero(np.diff(starts) > n) + 1):
        for lo in range(0, len(run), WINDOWS):
            part = run[lo : lo + WINDOWS]
            a, m = int(part[0]), int(part[-1] - part[0])
            here = s[a : a + m + n]
            entered, left = _times(here, n)
            root = np.sqrt(weights(here))[:, None]
            gain = normals(features(here, entered)) * root
            loss = gain[:m] if left is None else normals(features(here[:m], left)) * root[:m]
            sums = np.cumsum(np.concatenate([gain[:n].sum(0, dtype=np.float64)[None, :], gain[n:] - loss], dtype=np.float64), axis=0)
            out.append(sums[part - a] > 1e-5)
    return np.concatenate(out)


def _times(s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray | None]:
    """(the number that each shingle's occurrence has when a window of n moves on to it, that of the occurrence given up when it leaves)."""
    u, which = np.unique(s, return_inverse=True)
    if len(u) == len(s):
        return np.zeros(len(s), np.int64), None
    held, entered, left, which = [0] * len(u), np.zeros(len(s), np.int64), np.zeros(len(s) - n, np.int64), which.tolist()
    for t, x in enumerate(which):
        if t >= n:
            gone = which[t - n]
            held[gone] -= 1
            left[t - n] = held[gone]
        entered[t] = held[x]
        held[x] += 1
    return entered, left


def hits_of(index: Index, h: np.ndarray, similar: float = SIMILAR) -> dict[int, tuple[float, int]]:
    """Item number to (similarity, first word) of the best window of one document, given its word hashes."""
    k, best = index.k, {}
    full = _bytes.shingles(h, np.array([0, len(h)]), k)[0]
    met = index.is_known(full)
    for size, known in index.known_of.items():
        if size > len(h):
            continue
        if size < k:  # an item of one short shingle
            s, n = _bytes.runs(h, size), 1
            at = np.flatnonzero(np.isin(s, known))
        else:
            s, n = full, size - k + 1
            at = met[np.isin(full[met], known)]
        if not len(at):
            continue
        lo, hi = np.maximum(at - n + 1, 0), np.minimum(at, len(s) - n)
        edge = np.zeros(len(s) + 1, np.int64)  # windows over such places
        np.add.at(edge, lo, 1), np.add.at(edge, hi + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        # The intersection weighs no more than the window's shingles that items of this size have, and must be `similar` of the union, so of the window.
        a, z = int(starts[0]), int(starts[-1]) + n
        weight = index.weights(s[a:z])
        shared = np.zeros(len(s))
        shared[at] = 1
        all_, own = np.concatenate([[0], np.cumsum(weight)]), np.concatenate([[0], np.cumsum(weight * shared[a:z])])
        own, all_ = own[starts - a + n] - own[starts - a], all_[starts - a + n] - all_[starts - a]
        may = own >= similar * all_ - 1e-9
        starts, own, all_ = starts[may], own[may], all_[may]
        if not len(starts):
            continue
        prints, which = np.unique(window_bits(s, starts, n, index.weights), axis=0, return_inverse=True)
        near = index.near(prints)
        for i in np.argsort(-own / all_, kind="stable"):  # the likeliest first: a window that cannot beat what is found is passed over
            w = int(starts[i])
            for item in near[which.reshape(-1)[i]]:
                if index.lengths[item] != size:
                    continue
                most = min(own[i], index.total[item])
                if item in best and most / (all_[i] + index.total[item] - most) < best[item][0] - 1e-9:
                    continue
                sim = index.similarity(item, s[w : w + n])
                if sim >= similar - 1e-12 and (item not in best or (-sim, w) < (-best[item][0], best[item][1])):
                    best[item] = (sim, w)
    return best


def _parts(benchmark: DataFrame, item_id: str, item_text: str, k: int) -> list:
    """The broadcast indexes of all items, part by part. Items' words and shingles are counted where they are."""
    spark = benchmark.sparkSession
    bound_batches(spark)
    items = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("t is not null")

    def counted(batches):
        for b in batches:
            lists = [_shingle_list(t.as_py(), k) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([len(h) for h, _ in lists], pa.int64()), pa.array([np.unique(s).view(np.int64) for _, s in lists], pa.list_(pa.int64()))], names=["n", "s"])

    facts = stored(items.select("t").mapInArrow(counted, "n long, s array<bigint>"), "items").filter("n > 0")
    n, words = facts.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n:
        return []
    often = facts.select(F.explode("s").alias("h")).groupBy("h").count().filter(F.col("count") >= max(2, n / COMMON)).toPandas()  # COMMON items' worth of shingles at most
    weights = Weights(n, often["h"].to_numpy(np.int64).view(np.uint64), often["count"].to_numpy(np.int64))
    parts = max(-(-words // PART_WORDS), -(-n // PART_ITEMS))
    out = []
    for p in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p).toArrow().combine_chunks()
        ids = rows.column(0)
        out.append(spark.sparkContext.broadcast(Index(ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, rows.column(1).to_pylist(), weights, k)))
    return out


def _hits_by_row(index: Index, texts: pa.Array, similar: float):
    """(row, its hits) of the rows that have a shingle of some item."""
    short = any(n < index.k for n in index.known_of)
    for lo, hi, buf, offs in _bytes.chunks(texts):
        starts, ends, first = _bytes.words(buf, offs)
        h = _bytes.word_hashes(buf, starts, ends)
        s, at = _bytes.shingles(h, first, index.k)
        touched = np.unique(np.searchsorted(first, at[index.is_known(s)], "right") - 1) if not short else range(hi - lo)
        for i in touched:
            yield lo + int(i), hits_of(index, h[first[i] : first[i + 1]], similar)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", similar: float = SIMILAR, k: int = SHINGLE) -> DataFrame:
    """doc_id, item_id, similarity and first word of the best window, for every document and item at or above the threshold."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = narrow.select("doc_id").schema.add(benchmark.select(F.col(item_id).alias("item_id")).schema["item_id"]).add("similarity", "double").add("first_word", "long")

    def search(held):
        def run(batches):
            index = held.value
            for b in batches:
                row, item, sim, word = [], [], [], []
                for i, hits in _hits_by_row(index, b.column(1), similar):
                    for j, (x, w) in hits.items():
                        row.append(i), item.append(j), sim.append(x), word.append(w)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), index.ids.take(pa.array(item, pa.int64())), pa.array(sim, pa.float64()), pa.array(word, pa.int64())], names=["doc_id", "item_id", "similarity", "first_word"])

        return narrow.mapInArrow(run, schema)

    parts = [search(held) for held in _parts(benchmark, item_id, item_text, k)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", similar: float = SIMILAR, k: int = SHINGLE) -> DataFrame:
    """docs without the rows whose text holds a benchmark item, in the columns of docs. Each row is judged by its own text, whatever its id."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def without(df, held):
        def run(batches):
            for b in batches:
                kept = np.ones(b.num_rows, bool)
                for i, hits in _hits_by_row(held.value, b.column(at), similar):
                    kept[i] = not hits
                yield b.filter(pa.array(kept))

        return df.mapInArrow(run, df.schema)

    parts = _parts(benchmark, item_id, item_text, k)
    for n, held in enumerate(parts):
        docs = without(docs if n == 0 else stored(docs, "cleaned"), held)  # one part's index in memory at a time
    return docs
