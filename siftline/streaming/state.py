"""Structured Streaming forms of the stateful operators: first and last seen, upserts by micro-batch, windows, sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftline.operators import state


def seen(stream: DataFrame, key: str, ts: str, watermark: str | None = None) -> DataFrame:
    """First and last time of each key, for update or complete mode: two aggregates are all the state there is."""
    s = stream.withWatermark(ts, watermark) if watermark else stream
    return s.groupBy(key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("n"))


def windowed(stream: DataFrame, ts: str, size: str, slide: str | None, late: str, by: list[str], *aggregates: Column) -> DataFrame:
    """Tumbling or sliding windows with a bound on late rows."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size, slide), *by).agg(*aggregates)


def sessions(stream: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))


def once(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Each key once within the bound on late rows."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


class TableState:
    """A keyed table under versions: a micro-batch writes the next version from the last one, and the newest whole version is read.

    A version's number is the batch's, so a batch that runs again after a failure writes the same version again.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, keep_old: list[str], take_new: list[str]):
        self.spark, self.path, self.key, self.keep_old, self.take_new = spark, path, key, keep_old, take_new

    def versions(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root)]
        return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self) -> DataFrame | None:
        v = self.versions()
        return self.spark.read.parquet(f"{self.path}/v={v[-1]}") if v else None

    def merge(self, batch: DataFrame, number: int) -> None:
        before = [v for v in self.versions() if v < number]
        rows = batch.select(self.key, *self.keep_old, *self.take_new)
        if before:
            rows = state.upsert(self.spark.read.parquet(f"{self.path}/v={before[-1]}"), rows, self.key, self.keep_old, self.take_new)
        rows.write.mode("overwrite").parquet(f"{self.path}/v={number}")

    def sink(self, shape: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch: shape makes one row a key out of a micro-batch."""
        return lambda batch, number: self.merge(shape(batch), number)
