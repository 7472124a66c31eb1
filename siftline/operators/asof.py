"""As-of joins of two event logs: each event of the one meets the latest event of the other at or before it.

Both logs are one list ordered by key and time, an event of the right log before one of the left at the same time, and the last right
event is carried forward. The list is dealt by range of (key, time), so a key that has a third of all events lies over as many
partitions as it needs; what a partition carries into the next ones is one row, its last right event, and the carried rows are a
row a partition. No range join, no window over a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from siftline.scratch import stored


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, take: Sequence[str], tie: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """left's rows with columns `take` of the latest right row of the same key at or before its time, null where there is none.

    Of right rows at the same time the last by `tie` counts. Rows with a null key or time meet nothing: left ones are kept with
    nulls, right ones are passed over. Names in `take` replace left's columns of that name.
    """
    n = parts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.struct(*left.columns)
    value = F.struct(*take)
    none_left, none_right = F.lit(None).cast(left.select(own.alias("x")).schema["x"].dataType), F.lit(None).cast(right.select(value.alias("x")).schema["x"].dataType)
    ties = F.struct(*tie) if tie else F.lit(0)
    no_tie = F.lit(None).cast(right.select(ties.alias("x")).schema["x"].dataType)
    known = right.filter(F.col(key).isNotNull() & F.col(right_time).isNotNull())
    both = known.select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), ties.alias("_tie"), none_left.alias("_left"), value.alias("_right"))
    both = both.unionByName(left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), no_tie.alias("_tie"), own.alias("_left"), none_right.alias("_right")))
    order = ["_k", "_t", "_side", "_tie"]
    # left rows of one key and time are alike in the order: a hash deals them to several ranges
    dealt = stored(both.withColumn("_deal", F.when(F.col("_side") == 1, F.xxhash64("_left"))).repartitionByRange(n, *order, "_deal").withColumn("_part", F.spark_partition_id()), "as_of")
    event = F.when(F.col("_side") == 0, F.struct(F.col("_k").alias("k"), F.col("_right").alias("v")))
    last = dealt.filter("_side = 0").groupBy("_part").agg(F.max_by(F.struct(F.col("_k").alias("k"), F.col("_right").alias("v")), F.struct(*order)).alias("_last"))
    # a row a partition
    every = dealt.select("_part").distinct().join(last, "_part", "left")
    before = every.select("_part", F.last("_last", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    so_far = F.last(event, ignorenulls=True).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    met = dealt.withColumn("_seen", so_far).filter("_side = 1").join(F.broadcast(before), "_part", "left")
    found = F.coalesce("_seen", "_carried")
    hit = (found["k"] == F.col("_k")) & F.col("_t").isNotNull()
    return met.select(*[F.col("_left")[c].alias(c) for c in left.columns if c not in take], *[F.when(hit, found["v"][c]).alias(c) for c in take])


def stale(missing: Column, opened: Column) -> Column:
    """Missed by a run, and not seen open at or after it."""
    return missing.isNotNull() & (opened.isNull() | (opened < missing))


def last_check(checks: DataFrame, key: str, at: str, status: str, open_status: str = "open") -> DataFrame:
    """The newest check of each key (ties: the greater status), and the newest conclusive open one; shown: whether the newest tells more than the open one."""
    newest = checks.groupBy(key).agg(F.max(F.struct(at, status)).alias("_n"), F.max(F.when(F.col(status) == open_status, F.col(at))).alias("opened_at"))
    told = (F.col(f"_n.{status}") != open_status) & (F.col("opened_at").isNull() | (F.col(f"_n.{at}") > F.col("opened_at")))
    return newest.select(key, F.col(f"_n.{at}").alias("checked_at"), F.col(f"_n.{status}").alias("status"), "opened_at", told.alias("shown"))
