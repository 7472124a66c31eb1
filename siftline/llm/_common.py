"""What the operators share: scratch tables, bounded Arrow batches, seeded running sums, bounded samples."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: Words are runs of anything but these (blank, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Most rows that an explicit broadcast may hold; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
#: Rows and bytes that an Arrow batch may hold, for bounded Python workers.
BATCH_ROWS, BATCH_BYTES = 1_000, "16m"


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the one that all executors share, as spark.checkpoint.dir names it.

    A local session that does not set it gets a folder of its own; a cluster that does not is an error, since no other
    folder is known to be shared.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="siftline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/siftline/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application has stored: call it when its results are written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Folders of the tables that stored() made within made_here(), and that are not dropped yet.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def made_here() -> Iterator[list[str]]:
    """A list that fills with the folders of the tables stored within, in this thread or task only."""
    here: list[str] = []
    token = _MADE.set(here)
    try:
        yield here
    finally:
        _MADE.reset(token)


def stored(df: DataFrame, label: str, level: int = 3) -> DataFrame:
    """df as written to a Parquet table in the shared folder and read again: lineage ends there and survives a lost executor."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    if _MADE.get() is not None:
        _MADE.get().append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables that stored() made and that no result needs any more."""
    for df in tables:
        if df is not None:
            forget(df.sparkSession, [df.stored_at])


def forget(spark: SparkSession, paths: list[str]) -> None:
    for p in list(paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if _MADE.get() and p in _MADE.get():
            _MADE.get().remove(p)


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small whatever the length of the texts; rows: more for rows of fixed length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows are within the limit; else left to a shuffle join, which AQE splits at hot keys."""
    return F.broadcast(df) if rows <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text as long; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def keyed_hash(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def running(df: DataFrame, group: list[str], value: Column, order: Column, ties: list[Column], rows: int, out: str) -> DataFrame:
    """Exclusive running sum of value within group, in the order (bucket of order, order, ties), as column out.

    No task holds a whole group: rows are dealt by (group, bucket), buckets are summed first, and each bucket starts
    from the sum of those before it. Of n rows there are about as many buckets as a bucket has rows, the root of n.
    group columns must not be null. order: a well-spread hash as long.
    """
    buckets = 1 + isqrt(rows)
    spread = df.withColumn("_order", order).withColumn("_bucket", F.pmod(F.shiftright("_order", 8), F.lit(buckets)).cast("int")).withColumn("_value", value)
    sums = spread.groupBy(*group, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group, "_bucket").orderBy("_order", *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        spread.join(starts, [*group, "_bucket"])
        .withColumn(out, F.col("_start") + F.coalesce(F.sum("_value").over(within), F.lit(0)))
        .drop("_order", "_bucket", "_value", "_start")
    )


def sampled(df: DataFrame, rows: int, order: Column) -> DataFrame:
    """The rows with the smallest order values, at most as many as given: a bounded sample that reruns repeat."""
    return df.withColumn("_order", order).orderBy("_order").limit(rows).drop("_order")


def whole_texts(df: DataFrame, text: str, rows: int, size: int, order: Column, kind: str) -> DataFrame:
    """Of a bounded sample, the first rows of each kind by order (ties by text) whose texts have so many bytes together: whole texts, so that fitting on them takes bounded memory.

    Texts of more than a sixteenth of the bytes come after all others, and those of more than all of them are passed over, so that
    a few giant texts do not keep out the rest.
    """
    long = F.coalesce(F.octet_length(text), F.lit(0))
    first = Window.partitionBy(kind).orderBy("_giant", "_order", text)
    so_far = F.sum(long).over(first.rowsBetween(Window.unboundedPreceding, 0))
    fits = df.filter(long <= size).withColumn("_order", order).withColumn("_giant", long * 16 > size)
    return fits.withColumn("_n", F.row_number().over(first)).withColumn("_bytes", so_far).filter((F.col("_n") <= rows) & (F.col("_bytes") <= size)).drop("_n", "_bytes", "_giant")
