"""Places, running sums and tied ranks over whole tables, without a task that holds all rows.

Rows are dealt by range of the order, so that partition i lies before partition i + 1, and sorted within. A row's place is its
place in its partition plus the rows of the partitions before; only the partitions' totals, a row each, meet in one task. Ranges
come from a sample, so they differ from run to run: the dealt rows are stored before their totals are taken.

Orders must end in a key for places (equal rows are placed arbitrarily otherwise). Tied ranks need none: over all rows and in
large groups they come from the distinct values with their counts, so a value that a third of all rows share is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from siftline.operators.joins import counted, look_up
from siftline.scratch import stored

#: monotonically_increasing_id: the partition above these bits, the row's place in it below.
_ROW_BITS = 33
#: Most rows of a group that one task ranks.
GROUP_ROWS = 1_000_000


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _starts(totals: DataFrame) -> DataFrame:
    """_part, _start: what the partitions before sum up to. totals: _part, _total, a row a partition."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))


def placed_in_all(df: DataFrame, order: Sequence[Column], out: str = "place", parts: int | None = None) -> DataFrame:
    """Places from 1 over all rows, as long."""
    at = F.monotonically_increasing_id()
    rows = stored(df.repartitionByRange(parts or _parts(df), *order).sortWithinPartitions(*order).withColumn("_at", at), "ranged")
    rows = rows.withColumn("_part", F.shiftright("_at", _ROW_BITS))
    starts = _starts(rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_total")))
    place = F.col("_start") + F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1) + 1
    return rows.join(F.broadcast(starts), "_part").select(*[c for c in df.columns if c != out], place.alias(out))  # a row a partition


def placed_within(df: DataFrame, order: Sequence[Column], by: Sequence[str], out: str = "place", parts: int | None = None) -> DataFrame:
    """Places from 1 within groups that may each be larger than a task: places over all rows, less where the group begins."""
    keys = [F.struct(*by).alias("_group")]
    all_ = placed_in_all(df.withColumn("_group", *keys), [F.col("_group").asc(), *order], "_all", parts)
    first = all_.groupBy("_group").agg(F.min("_all").alias("_first")).withColumnRenamed("_group", "_of")
    met = look_up(all_, first, F.col("_group").eqNullSafe(F.col("_of")), "inner")
    return met.select(*[c for c in df.columns if c != out], (F.col("_all") - F.col("_first") + 1).alias(out))


def running_counts(counts: DataFrame, order: Sequence[str], count: str, out: str, parts: int | None = None) -> DataFrame:
    """counts with the sum of `count` over all rows before, in the order of the given columns."""
    n = parts or _parts(counts)
    rows = stored(counts.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranged_counts")
    starts = _starts(rows.groupBy("_part").agg(F.sum(count).alias("_total")))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.coalesce(F.sum(count).over(within), F.lit(0))).drop("_part", "_start")


def average_ranks(df: DataFrame, values: str | Sequence[str], outs: str | Sequence[str], by: Sequence[str] = (), parts: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Ranks from 1 of one value or several, within groups or over all rows, ties sharing the mean of their places; nulls rank first, as one tie.

    Groups of up to group_rows rows are ranked by windows, all values after one shuffle of the rows; only larger ones are dealt by range.
    """
    pairs = [(values, outs)] if isinstance(values, str) else list(zip(values, outs, strict=True))
    if not by:
        return _dealt_ranks(df, pairs, by, parts)
    group = F.struct(*by)
    large = stored(df.groupBy(group.alias("_of")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > group_rows).select("_of"), "large_groups")
    if large.isEmpty():
        return _windowed_ranks(df, pairs, by)
    side, keyed = counted(large), df.withColumn("_group", group)
    part = lambda how: keyed.join(side, F.col("_group").eqNullSafe(F.col("_of")), how).drop("_group")
    return _windowed_ranks(part("left_anti"), pairs, by).unionByName(_dealt_ranks(part("left_semi"), pairs, by, parts))


def _windowed_ranks(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str]) -> DataFrame:
    """A tie's first place is its rank, its last one the count up to it; a task holds whole groups."""
    for value, out in pairs:
        up_to = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_first())
        df = df.withColumn(out, (F.rank().over(up_to) + F.count(F.lit(1)).over(up_to)) / 2)
    return df


def _dealt_ranks(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str], parts: int | None) -> DataFrame:
    """By range of the distinct values: no task holds a group."""
    for value, out in pairs:
        df = _dealt_rank(df, value, out, by, parts)
    return df


def _dealt_rank(df: DataFrame, value: str, out: str, by: Sequence[str], parts: int | None) -> DataFrame:
    group = F.struct(*by) if by else F.lit(0)
    counts = df.groupBy(group.alias("_g"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    before = running_counts(counts, ["_g", "_v"], "_n", "_before", parts)
    if by:
        first = before.groupBy("_g").agg(F.min("_before").alias("_first")).withColumnRenamed("_g", "_of")
        before = look_up(before, first, F.col("_g").eqNullSafe(F.col("_of")), "inner").withColumn("_before", F.col("_before") - F.col("_first"))
    ranks = stored(before.select("_g", "_v", (F.col("_before") + (F.col("_n") + 1) / 2).alias("_rank")), "ranks")
    met = look_up(df.withColumn("_group", group), ranks, F.col("_group").eqNullSafe(F.col("_g")) & F.col(value).eqNullSafe(F.col("_v")), "inner")
    return met.select(*[c for c in df.columns if c != out], F.col("_rank").alias(out))
