"""Centroid clustering with Yinyang bounds, in exact integers.

Vectors become integers; centroids start as the vectors whose hashes are smallest. A round assigns every vector to its
nearest centroid and moves every centroid to the floored mean of its vectors. The centroids are put into groups once, at
the start. Each vector carries its centroid, an upper bound of the distance to it, and one lower bound a group of the
distances to that group's other centroids. When centroids have moved, the bounds move by as much as they may have lost.
A vector whose upper bound is below all its lower bounds keeps its centroid (the global filter); otherwise the upper bound is
made exact and tried again, and then only groups whose lower bound does not exclude them are scanned, with exact integer
distances (the group filter). Bounds are floats that rounding only widens, and a filter excludes only what is strictly
farther, so ties go to the smaller number as in a full scan.

A round is one pass of Arrow batches without any shuffle: a task writes its vectors with their new bounds, and a row a
centroid with the exact sums of what it assigned. Only these sums, tasks x centroids rows, are added up; the driver holds
the centroids. The pass's table in the shared folder is the next one's input, and the one before it is deleted.

Defined cases: rows whose vector is null, of another length than `size` (given or, if None, that of the longest) or holds
null or non-finite components are not clustered and give no row; repeated rows count as often as they occur; null ids
are clustered but start no centroid, unless there are no others; equal hashes go by the vector. Fewer vectors than centroids give
as many centroids as vectors; no vectors give no rows. A centroid without vectors stays. Other columns are ignored.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftline.llm._common import bound_batches, dropped, stored
from siftline.llm._vectors import digest, finite, integers, matrix, sums_by, totals

CENTROIDS, ROUNDS, SCALE, SEED = 8, 10, 1024, 3
#: Centroids to a group, about.
PER_GROUP = 4
#: Vectors handled at a time.
BATCH = 8_192
#: More than the relative error of a root, a sum or a conversion.
WIDER = 2.0**-50
_FAR = np.iinfo(np.int64).max
_LOG = logging.getLogger(__name__)


def grouped(centroids: np.ndarray, per_group: int = PER_GROUP, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: a few rounds of means over the centroids themselves."""
    n = max(1, len(centroids) // per_group)
    means = centroids[:: max(1, len(centroids) // n)][:n].astype(float)
    for _ in range(rounds):
        groups = ((centroids[:, None, :] - means[None]) ** 2).sum(2).argmin(1)
        for g in range(n):
            if (groups == g).any():
                means[g] = centroids[groups == g].mean(0)
    return np.unique(groups, return_inverse=True)[1]  # none is empty


def lengths(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def squared(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to its own centroid (or to the one given)."""
    gap = rows - centroids
    return np.einsum("ij,ij->i", gap, gap)


def scan(rows: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, groups: np.ndarray) -> int:
    """Bring near (-1: none yet), upper and lower up to date with the centroids; the number of distances computed.

    Bounds must hold for the centroids as they are now.
    """
    todo = np.flatnonzero((near < 0) | ~(upper < lower.min(axis=1)))
    known = todo[near[todo] >= 0]
    upper[known] = lengths(squared(rows[known], centroids[near[known]])) * (1 + WIDER)
    todo = todo[(near[todo] < 0) | ~(upper[todo] < lower[todo].min(axis=1))]
    if not len(todo):
        return len(known)
    x, old = rows[todo], near[todo]
    dist = np.full((len(todo), len(centroids)), _FAR, np.int64)
    at = np.flatnonzero(old >= 0)
    dist[at, old[at]] = squared(x[at], centroids[old[at]])
    made = len(known) + len(at)
    scanned = np.zeros((len(todo), groups.max() + 1), bool)
    for g in range(groups.max() + 1):
        # upper stays a bound of the nearest so far; a centroid that is as near must be seen for the tie
        rest = np.flatnonzero((old < 0) | ~(lower[todo, g] > upper[todo]))
        scanned[rest, g] = True
        for c in np.flatnonzero(groups == g):
            dist[rest, c] = squared(x[rest], centroids[c])
        made += len(rest) * int((groups == g).sum())
        best = dist[rest].min(axis=1)
        upper[todo[rest]] = lengths(best) * (1 + WIDER)
    new = dist.argmin(axis=1)  # the first of equals
    for g in range(groups.max() + 1):
        others = np.where((groups == g) & (np.arange(len(centroids)) != new[:, None]), dist, _FAR).min(axis=1)
        seen = lengths(others) * (1 - WIDER)
        lower[todo, g] = np.where(scanned[:, g], np.where(others == _FAR, np.inf, seen), np.where(others == _FAR, lower[todo, g], np.minimum(lower[todo, g], seen)))
    near[todo] = new
    return made


def moved(upper: np.ndarray, lower: np.ndarray, near: np.ndarray, drift: np.ndarray, groups: np.ndarray) -> None:
    """Widen the bounds by what the centroids have moved."""
    upper += drift[near]
    upper *= 1 + WIDER
    for g in range(groups.max() + 1):
        lower[:, g] -= drift[groups == g].max()
        lower[:, g] -= np.abs(lower[:, g]) * WIDER


def _assigned(vectors: DataFrame, centroids: np.ndarray, drift: np.ndarray | None, groups: np.ndarray, last: bool) -> DataFrame:
    """The vectors with their centroids and bounds, or at last their distances, and a row a centroid and task: n, scanned, distances and sums."""
    k, width, n_groups = *centroids.shape, int(groups.max()) + 1
    id_type = vectors.schema["vec_id"].dataType
    schema = vectors.sparkSession.createDataFrame([], "v array<int>, near int, upper double, lower array<double>, distance long, n long, scanned long, sums array<long>").schema.add("vec_id", id_type)
    bound_batches(vectors.sparkSession, BATCH)

    def run(batches):
        counts, sums, inertia, scanned, kind = np.zeros(k, np.int64), np.zeros((k, width), np.int64), np.zeros(k, np.int64), 0, None
        for b in batches:
            if not b.num_rows:
                continue
            rows, kind = matrix(b.column("v"), width), b.column("vec_id").type
            if drift is None:
                near, upper, lower = np.full(len(rows), -1), np.full(len(rows), np.inf), np.zeros((len(rows), n_groups))
            else:
                near, upper = b.column("near").to_numpy().astype(np.int64), b.column("upper").to_numpy().copy()
                lower = b.column("lower").flatten().to_numpy().reshape(len(rows), n_groups).copy()
                moved(upper, lower, near, drift, groups)
            scanned += scan(rows, near, upper, lower, centroids, groups)
            n, s = sums_by(near, rows, k)
            counts, sums = counts + n, sums + s
            none = lambda t: pa.nulls(len(rows), t)
            if last:
                distance = squared(rows, centroids[near])
                np.add.at(inertia, near, distance)
                parts = [none(pa.list_(pa.int32())), pa.array(near, pa.int32()), none(pa.float64()), none(pa.list_(pa.float64())), pa.array(distance)]
            else:
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * n_groups)
                parts = [b.column("v"), pa.array(near, pa.int32()), pa.array(upper), pa.ListArray.from_arrays(ends, pa.array(lower.ravel())), none(pa.int64())]
            yield pa.RecordBatch.from_arrays([*parts, none(pa.int64()), none(pa.int64()), none(pa.list_(pa.int64())), b.column("vec_id")], names=schema.names)
        if kind is not None:
            none = lambda t: pa.nulls(k, t)
            first = np.arange(k) == 0
            yield pa.RecordBatch.from_arrays([none(pa.list_(pa.int32())), pa.array(np.arange(k), pa.int32()), none(pa.float64()), none(pa.list_(pa.float64())), pa.array(inertia), pa.array(counts), pa.array(np.where(first, scanned, 0)), pa.array(list(sums), pa.list_(pa.int64())), none(kind)], names=schema.names)

    return vectors.mapInArrow(run, schema)


def cleaned(vectors: DataFrame, scale: int, size: int | None) -> DataFrame:
    """vec_id and integers v of the rows that are clustered."""
    fit = vectors.select("vec_id", F.col("embedding").alias("_e")).filter(finite(F.col("_e")))
    if size is None:
        size = fit.agg(F.max(F.size("_e"))).first()[0]
    return fit.filter(F.size("_e") == F.lit(size)).select("vec_id", integers(F.col("_e"), scale).alias("v"))


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, size: int | None = None, seed: int = SEED, per_group: int = PER_GROUP) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector; the final centroids).

    vectors: vec_id, embedding. Centroids, and what the driver holds, are k rows: a parameter, at most a few thousand.
    """
    spark = vectors.sparkSession
    kept = cleaned(vectors, scale, size)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = [r["v"] for r in kept.withColumn("_h", order).orderBy(F.col("_h").asc_nulls_last(), "v").limit(k).collect()]
    if not start or not start[0]:
        nothing = kept.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
        return nothing.limit(0), np.zeros((0, 0), np.int64)
    centroids = np.array(start, np.int64)
    groups, drift, state = grouped(centroids, per_group), None, kept
    for n in range(rounds + 1):
        before, state = state, stored(_assigned(state, centroids, drift, groups, n == rounds), "yinyang")
        if n:
            dropped(before)
        sums = state.filter("n is not null")
        if n < rounds:
            new = centroids.copy()
            for r in totals(sums, ["near"], "sums"):
                if r["n"]:
                    new[r["near"], r["pos"]] = r["total"] // r["n"]
            drift = lengths(squared(new, centroids)) * (1 + WIDER)
            centroids = new
        state = state.filter("n is null") if n == rounds else _vectors_of(state)
    ends = {r["near"]: r for r in sums.groupBy("near").agg(F.sum("distance").alias("inertia"), F.sum("scanned").alias("scanned")).collect()}
    _LOG.info("the last of %d passes computed %d distances", rounds + 1, sum(r["scanned"] for r in ends.values()))
    total = sum(r["inertia"] for r in ends.values())
    about = spark.createDataFrame([(c, int(r["inertia"]), int(total), digest(centroids[c])) for c, r in ends.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = state.select("vec_id", F.col("near").alias("cluster"), "distance").join(F.broadcast(about), "cluster")  # k rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids


def _vectors_of(state: DataFrame) -> DataFrame:
    out = state.filter("n is null")
    out.stored_at = state.stored_at
    return out
