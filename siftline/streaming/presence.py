"""Presence as keyed state: when a key was first and last seen, how many runs in a row missed it, and when it is taken down.

State is kept by buckets of keys (a hash of the key): a bucket's keys are one Arrow table in the store, so a micro-batch costs a read
and a write a bucket it touches, and columns of numbers instead of calls by key. A bucket's event-time timeout is the next run that could
miss one of its keys. A sighting resets a key's count; when the watermark passes a run, the keys not seen since then missed it. Runs happen every `period` (a
day: at midnight); a key that missed `limit` runs in a row is down and waits for no run until it is seen. Late rows beyond the watermark are dropped by
the engine, other late ones only move first_seen back. The store is RocksDB, and is found again in the query's checkpoint after a restart; the
number of buckets belongs to the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Milliseconds, as timeouts count; times are kept in microseconds.
DAY = 86_400_000
#: Buckets of keys: of ten million keys, one holds about 20,000, which is a megabyte.
BUCKETS = 512
#: What is kept of a key; version numbers the rows that tell of it.
NUMBERS = ["first_us", "last_us", "sightings", "missed_runs", "version"]


def _held(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _step(key: str, kind: pa.DataType, time: str, limit: int, period: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    run = lambda us: us // (1_000 * period)  # noqa: E731  the number of the last run at or before a time

    def seen(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        """lo, hi, n by key, a chunk after the other."""
        out = None
        for part in rows:
            us = pd.Series(part[time].to_numpy().astype("datetime64[us]").astype(np.int64))
            new = us.groupby(part[key].to_numpy()).agg(lo="min", hi="max", n="count")
            out = new if out is None else pd.concat([out, new]).groupby(level=0).agg({"lo": "min", "hi": "max", "n": "sum"})
        return out

    def step(_, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.getOption
        table = pa.ipc.open_stream(old[0]).read_all().to_pandas() if old else pd.DataFrame({key: [], **{c: np.zeros(0, np.int64) for c in NUMBERS}})
        keys = pd.Index(table[key], dtype=object)
        numbers = [table[c].to_numpy(copy=True) for c in NUMBERS]
        told = np.zeros(len(keys), bool)
        new = None if state.hasTimedOut else seen(rows)
        if new is not None:
            at = keys.get_indexer(new.index.astype(object))
            fresh = at < 0
            lo, hi, n = (new[c].to_numpy() for c in ("lo", "hi", "n"))
            first, last, count, missed, version = (x[at[~fresh]] for x in numbers)
            later = hi[~fresh] > last
            # runs that were missed stay missed only if they are after the new sighting
            left = np.where(later, np.maximum(0, run(last) + missed - run(hi[~fresh])), missed)
            for x, y in zip(numbers, (np.minimum(first, lo[~fresh]), np.maximum(last, hi[~fresh]), count + n[~fresh], left, version)):
                x[at[~fresh]] = y
            told[at[~fresh]] = True
            none = np.zeros(fresh.sum(), np.int64)
            numbers = [np.concatenate([x, y]) for x, y in zip(numbers, (lo[fresh], hi[fresh], n[fresh], none, none))]
            keys, told = keys.append(new.index[fresh].astype(object)), np.concatenate([told, np.ones(fresh.sum(), bool)])
        first, last, count, missed, version = numbers
        watermark = state.getCurrentWatermarkMs()
        passed = np.minimum(limit, watermark // period - run(last))  # all runs up to the watermark
        told |= passed > missed
        missed = np.maximum(missed, passed)
        version = version + told
        out = pa.table({key: pa.Array.from_pandas(keys, type=kind), **dict(zip(NUMBERS, (first, last, count, missed, version)))})
        state.update((_held(out),))
        waits = (run(last) + missed + 1)[missed < limit]
        if len(waits):
            # a timeout fires when the watermark is beyond it: this one when the watermark is at the run
            state.setTimeoutTimestamp(int(waits.min()) * period - 1)
        yield out.filter(pa.array(told)).to_pandas()

    return step


def presence(stream: DataFrame, key: str, time: str, limit: int, late: str = "0 seconds", period: int = DAY, buckets: int = BUCKETS) -> DataFrame:
    """A row (key, first_seen, last_seen, sightings, missed_runs, down, version) each time a key's state changes. For update mode; the session's state store should be RocksDB (see `with_rocks`)."""
    kind = stream.schema[key].dataType
    rows = stream.select(key, time).filter(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    schema = f"`{key}` {kind.simpleString()}, " + ", ".join(f"{c} long" for c in NUMBERS)
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).groupBy("_bucket")
    told = dealt.applyInPandasWithState(_step(key, to_arrow_type(kind), time, limit, period), schema, "held binary", "update", GroupStateTimeout.EventTimeTimeout)
    at = lambda c, name: F.timestamp_micros(c).alias(name)
    return told.select(key, at("first_us", "first_seen"), at("last_us", "last_seen"), "sightings", "missed_runs", (F.col("missed_runs") >= limit).alias("down"), "version")


def with_rocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_to_end(changes: DataFrame, path: str, checkpoint: str) -> None:
    """What is there now, in micro-batches, appended to Parquet files under path; a later call goes on where this one ended."""
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that runs again writes the same folder again

    query = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()


def newest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Each key's last row."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path).drop("batch")
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "version").alias("_r")).select(key, "_r.*")
