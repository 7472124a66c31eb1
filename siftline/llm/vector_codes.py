"""Vector code compression: product codes whose codebooks are learnt and applied in exact integers.

Vectors become integers and are cut into equal consecutive parts. Each part has a codebook, which starts as that part of
the vectors with the smallest ids and goes through rounds of assignment and floored means.

The nearest entry is found by a float32 matrix product first. A dot product of w terms in float32, of inputs that were
rounded to it, errs by at most g |x| |c| with g = (w + 2) u / (1 - (w + 2) u) and u = 2^-24, in whatever order it is summed,
so every entry's squared distance (less |x|^2) has a rigorous interval. Entries whose interval lies beyond the best one's
upper end are out; if others remain beside the best, all that overlap are computed again in 64-bit integers, and equal
distances go to the smaller index. The codes are therefore those of an exact search.

A round is one pass over the stored integers, without a shuffle of vectors: tasks give exact sums by part and entry, and only
these are added up. The driver holds the codebooks: parts x entries x width numbers, whatever the number of vectors.

Defined cases: rows whose vector is null or holds null or non-finite components give no row. The length is that of the
vector with the smallest id; vectors of another length, or all if it is no multiple of the number of parts (or zero), keep
their rows with a null code and error. Repeated rows count as often as they occur; equal ids go by the vector, null ids
last. Fewer vectors than entries give as many entries as vectors. An entry without parts stays. label_error sums a label's
errors, null labels together. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftline.llm._common import BROADCAST_ROWS, bound_batches, small, stored
from siftline.llm._vectors import digest, finite, integers, matrix, sums_by, totals

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BATCH = 8_192
_U = 2.0**-24


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, int]:
    """(the nearest entry of each row, ties to the smaller index; how many distances were computed in integers)."""
    w = rows.shape[1]
    gamma = (w + 2) * _U / (1 - (w + 2) * _U)
    dot = (rows.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    cc = np.einsum("ij,ij->i", entries, entries).astype(np.float64)
    xx = np.einsum("ij,ij->i", rows, rows).astype(np.float64)
    reach = np.sqrt(np.outer(xx, cc)) * (1 + 2.0**-20)
    error = 2 * gamma * reach + 2.0**-48 * (cc + 2 * reach)
    score = cc - 2 * dot
    near = score - error <= (score + error).min(axis=1, keepdims=True)
    out = near.argmax(axis=1)
    open_ = np.flatnonzero(near.sum(axis=1) > 1)
    if not len(open_):
        return out, 0
    at, entry = np.nonzero(near[open_])
    gap = rows[open_[at]] - entries[entry]
    exact = np.full((len(open_), len(entries)), np.iinfo(np.int64).max)
    exact[at, entry] = np.einsum("ij,ij->i", gap, gap)
    out[open_] = exact.argmin(axis=1)
    return out, len(at)


def _part_sums(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, n, sums: a row an entry and task."""
    parts, entries, width = books.shape

    def run(batches):
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            rows = matrix(b.column("v"), parts * width).reshape(-1, parts, width)
            for p in range(parts):
                n, s = sums_by(nearest(rows[:, p], books[p])[0], rows[:, p], entries)
                counts[p], sums[p] = counts[p] + n, sums[p] + s
        part, entry = np.indices(counts.shape)
        yield pa.RecordBatch.from_arrays([pa.array(part.ravel(), pa.int32()), pa.array(entry.ravel(), pa.int32()), pa.array(counts.ravel()), pa.array(list(sums.reshape(-1, width)), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return vectors.select("v").mapInArrow(run, "part int, entry int, n long, sums array<long>")


def _coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """code (a byte a part) and error beside each vector's id and label."""
    parts, entries, width = books.shape
    schema = vectors.select("vec_id", "label").schema.add("code", "binary").add("error", "long")

    def run(batches):
        for b in batches:
            rows = matrix(b.column("v"), parts * width).reshape(-1, parts, width)
            codes, error = np.zeros((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
            for p in range(parts if len(rows) else 0):
                codes[:, p] = at = nearest(rows[:, p], books[p])[0]
                gap = rows[:, p] - books[p][at]
                error += np.einsum("ij,ij->i", gap, gap)
            ends = np.arange(len(rows) + 1, dtype=np.int32) * parts
            code = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), code, pa.array(error)], names=schema.names)

    return vectors.select("vec_id", "label", "v").mapInArrow(run, schema)


def learnt(vectors: DataFrame, start: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks (part, entry, component) after the rounds. vectors: integers v; start: vectors in the order of entries."""
    books = start
    for _ in range(rounds):
        new = books.copy()
        for r in totals(_part_sums(vectors, books), ["part", "entry"], "sums"):
            if r["n"]:
                new[r["part"], r["entry"], r["pos"]] = r["total"] // r["n"]
        books = new
    return books


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code as a byte a part, error; the codebooks). vectors: vec_id, embedding, label; at most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("a code has a byte a part: 1 to 256 entries")
    bound_batches(vectors.sparkSession, BATCH)
    kept = vectors.select("vec_id", "label", F.col("embedding").alias("_e")).filter(finite(F.col("_e")))
    kept = stored(kept.select("vec_id", "label", integers(F.col("_e"), scale).alias("v")), "vectors")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").first()
    size = len(first["v"]) if first else 0
    if not size or size % parts:
        return kept.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    fit = kept.filter(F.size("v") == size)
    start = np.array([r["v"] for r in fit.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()], np.int64)
    books = learnt(fit, start.reshape(-1, parts, size // parts).transpose(1, 0, 2), rounds)
    odd = kept.filter(F.size("v") != size).select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    return _coded(fit, books).unionByName(odd), books


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """codes with `decoded`, the vector that a code stands for (null for a null code)."""
    width = books.shape[2]
    flat = F.array(*[F.array(*[F.lit(int(x)) for x in part.ravel()]) for part in books])
    pick = lambda p: F.slice(F.get(flat, p), F.conv(F.hex(F.substring("code", p + 1, F.lit(1))), 16, 10).cast("int") * width + 1, width)
    vector = F.transform(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), pick)), lambda x: x / scale)
    return codes.withColumn("decoded", F.when(F.col("code").isNotNull(), vector))


def code_report(vectors: DataFrame, **parameters) -> DataFrame:
    """vec_id, code in hex, error, label_error, codebooks_sha256."""
    coded, books = encode(vectors, **parameters)
    coded = stored(coded, "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    labels = by_label.limit(BROADCAST_ROWS + 1).count()
    side = small(by_label.withColumnRenamed("label", "_label"), labels)
    out = coded.join(side, F.col("label").eqNullSafe(F.col("_label")), "left")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books.ravel())).alias("codebooks_sha256"))
