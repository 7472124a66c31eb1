"""Whole-number vectors from lists of floats, and exact sums of them by task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Largest component as an integer: squared distances of up to 256 components then fit 64 bits.
LARGEST = 1 << 27


def finite(vector: Column) -> Column:
    """True for a list without null or non-finite components; false for null."""
    x = vector.cast("array<double>")
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double. A component beyond LARGEST ends the query with a message."""
    def whole(v: Column) -> Column:
        n = F.floor(v * float(scale))
        return F.when(F.abs(n) <= LARGEST, n.cast("int")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling")).cast("int"))

    return F.transform(vector.cast("array<double>"), whole)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of equal length as rows of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def sums_by(labels: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(count, exact sum) of the rows of each label below k."""
    counts, out = np.bincount(labels, minlength=k), np.zeros((k, rows.shape[1]), np.int64)
    order = np.argsort(labels, kind="stable")
    used = np.flatnonzero(counts)
    if len(used):
        out[used] = np.add.reduceat(rows[order], np.concatenate([[0], np.cumsum(counts[used])[:-1]]), axis=0)
    return counts, out


def totals(parts: DataFrame, key: list[str], sums: str) -> list:
    """Tasks' sums added up: rows (key, pos, n, total), as many as there are keys times components."""
    each = parts.select(*key, "n", F.posexplode(sums).alias("pos", "_x"))
    return each.groupBy(*key, "pos").agg(F.sum("n").alias("n"), F.sum("_x").alias("total")).collect()


def digest(numbers: Iterable[int]) -> str:
    """Lower-case hex sha256 of decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, map(int, numbers))).encode()).hexdigest()
