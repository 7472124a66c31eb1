"""Token-ID output in training order.

Documents are tokenised, closed by an end token, and packed into sequences of `length` ids, partition by partition;
the last sequence of a partition is padded. Sequences are numbered 0 to n - 1 by partition and place. A keyed Feistel
network on the next even power of two, walked until it falls below n, is a permutation of those numbers: the slots of
the training order, known without sorting or shuffling random numbers. Slots are dealt by range, per_shard to a shard,
sorted and written as records of a fixed stride (little-endian ids and a newline), so slot s lies in shard
s // per_shard at byte (s % per_shard) * stride, and reading can stop and go on anywhere.

What a task sends to a shard travels as one compressed body, and a shard is put in order by the task that writes it.
Files go through Spark's own writer with its commit protocol to any store that Spark reaches. Defined cases: null texts
give no tokens, empty ones only the end token; repeated documents are packed as often as they occur; an empty table
writes no record. Ids of any type, and null ones, are carried. Other columns are ignored. Documents are packed within
the input's partitions, so the same files read with other partition sizes give other sequences; the index tells what
was written, and a rerun that reads the same partitions repeats it.
"""

from __future__ import annotations

import base64
import json
import uuid
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.llm import _bytes
from siftline.llm._common import bound_batches, dropped, scratch_dir, stored

#: A vocabulary as lines "base64 rank", and the pattern that cuts texts into pieces (fixed value of that vocabulary).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50_256
LENGTH, PER_SHARD, KEY, ROUNDS = 1024, 4096, 0x5EED, 6
#: Sequences that a task deals to shards at a time.
DEALT = 12_288


@dataclass(frozen=True)
class Layout:
    """What a reader needs; stride and offsets are in bytes."""

    path: str
    sequences: int
    length: int
    per_shard: int
    key: int
    end: int
    width: int = 2

    @property
    def stride(self) -> int:
        return self.length * self.width + 1

    @property
    def shards(self) -> int:
        return -(-self.sequences // self.per_shard)


@lru_cache(maxsize=4)
def encoding(data: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("shards", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def slots(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The permutation of 0 to n - 1 that the key names: a balanced Feistel network, walked until it lands below n."""
    half = max(1, (max(2, n) - 1).bit_length() + 1 >> 1)
    mask = np.uint64((1 << half) - 1)
    keys = _bytes.mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key & (1 << 64) - 1))
    x = numbers.astype(np.uint64)
    out, left = x.copy(), np.arange(len(x))
    while len(left):
        a, b = x >> np.uint64(half), x & mask
        for k in keys:
            a, b = b, a ^ (_bytes.mix(b ^ k) & mask)
        x = (a << np.uint64(half)) | b
        done = x < np.uint64(n)
        out[left[done]] = x[done]
        left, x = left[~done], x[~done]
    return out.astype(np.int64)


def packed(docs: DataFrame, vocabulary: bytes, pattern: str, length: int, end: int) -> DataFrame:
    """part, place, tokens (length ids of two bytes), n_tokens without padding, first_doc_id, n_docs (that begin or go on here)."""
    spark = docs.sparkSession
    bound_batches(spark)
    held = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        coder = encoding(held.value, pattern)
        part, place = pyspark.TaskContext.get().partitionId(), 0
        pending: list[np.ndarray] = []  # pieces of the open sequence and their documents
        size, first, docs_here = 0, None, 0
        rows: list[tuple] = []
        id_type = None

        def emit():
            nonlocal size, first, docs_here, place, pending
            body = np.concatenate(pending) if pending else np.zeros(0, np.uint16)
            full = np.full(length, end, np.uint16)
            full[: len(body)] = body
            rows.append((part, place, full.astype("<u2").tobytes(), len(body), first, docs_here))
            place, pending, size, first, docs_here = place + 1, [], 0, None, 0

        for b in batches:
            id_type = b.column(0).type
            for i, text in enumerate(b.column(1)):
                text = text.as_py()
                if text is None:
                    continue
                ids = np.array([*coder.encode_ordinary(text), end], np.uint16)
                at = 0
                while at < len(ids):
                    take = min(length - size, len(ids) - at)
                    if not pending:
                        first = b.column(0)[i].as_py()
                    pending.append(ids[at : at + take])
                    size, at, docs_here = size + take, at + take, docs_here + 1
                    if size == length:
                        emit()
                if len(rows) >= 512:
                    yield _rows(rows, id_type)
                    rows = []
        if size:
            emit()
        if rows:
            yield _rows(rows, id_type)

    narrow = docs.select(F.col("doc_id"), F.col("text"))
    schema = spark.createDataFrame([], "part int, place long, tokens binary, n_tokens int").schema
    schema = schema.add("first_doc_id", narrow.schema["doc_id"].dataType).add("n_docs", "integer")
    return narrow.mapInArrow(run, schema)


def _rows(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int32(), id_type, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["part", "place", "tokens", "n_tokens", "first_doc_id", "n_docs"])


def write_shards(docs: DataFrame, path: str | None = None, vocabulary: str = VOCABULARY, pattern: str = PATTERN, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, end: int = END) -> tuple[DataFrame, Layout]:
    """Write the shards under path; return (the index: a row a sequence, the layout). The vocabulary file is read on the driver."""
    spark = docs.sparkSession
    path = path or f"{scratch_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    with open(vocabulary, "rb") as f:
        data = f.read()
    sequences = stored(packed(docs, data, pattern, length, end), "packed", level=8)
    counts = {r["part"]: r["n"] for r in sequences.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a task
    before, total = [], 0
    for part in sorted(counts):
        before.append((part, total))
        total += counts[part]
    layout = Layout(path, total, length, per_shard, key, end)
    starts = spark.createDataFrame(before, "part int, before long")

    @F.pandas_udf("long")
    def slot_of(number: pd.Series) -> pd.Series:
        return pd.Series(slots(number.to_numpy(), total, key))

    placed = sequences.join(F.broadcast(starts), "part").withColumn("sequence", F.col("before") + F.col("place"))  # a row a task
    index = placed.select("sequence", slot_of("sequence").alias("slot"), "n_tokens", "first_doc_id", "n_docs", F.crc32("tokens").alias("tokens_crc32"))
    shard = F.floor(F.col("slot") / per_shard).cast("int")
    index = stored(index.select("slot", shard.alias("shard"), ((F.col("slot") % per_shard) * layout.stride).alias("byte_offset"), "sequence", "n_tokens", "first_doc_id", "n_docs", "tokens_crc32"), "slots")
    if total:
        dealt = _dealt(placed.select("sequence", "tokens"), layout).repartitionById(layout.shards, F.col("shard"))
        _ordered(dealt, layout).select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").text(f"{path}/shards")
    spark.createDataFrame([(json.dumps(asdict(layout)),)], "value string").coalesce(1).write.text(f"{path}/layout")
    dropped(sequences)
    return index, layout


def _dealt(placed: DataFrame, layout: Layout) -> DataFrame:
    """shard, slots and their records as one compressed body: what a task sends to a shard from DEALT sequences at a time."""

    def run(batches):
        numbers, records, n = [], [], 0

        def deal():
            at = slots(np.concatenate(numbers), layout.sequences, layout.key)
            body = np.concatenate(records)
            order = np.argsort(at, kind="stable")
            shards, first = np.unique(at[order] // layout.per_shard, return_index=True)
            coder = zstandard.ZstdCompressor(level=3)
            parts = np.split(order, first[1:])
            return pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), pa.array([at[p] for p in parts], pa.list_(pa.int64())), pa.array([coder.compress(body[p].tobytes()) for p in parts], pa.binary())], names=["shard", "slots", "body"])

        for b in batches:
            if not b.num_rows:
                continue
            numbers.append(b.column(0).to_numpy())
            records.append(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1))
            n += b.num_rows
            if n >= DEALT:
                yield deal()
                numbers, records, n = [], [], 0
        if n:
            yield deal()

    return placed.mapInArrow(run, "shard int, slots array<bigint>, body binary")


def _ordered(dealt: DataFrame, layout: Layout) -> DataFrame:
    """The records of each partition's shard in the order of their slots: one shard's bytes at a time."""
    size = layout.length * layout.width

    def run(batches):
        at, records = [], []
        for b in batches:
            for where, body in zip(b.column(1), b.column(2)):
                at.append(where.values.to_numpy())
                records.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(body.as_py()), np.uint8).reshape(-1, size))
        if at:
            records = np.concatenate(records)[np.argsort(np.concatenate(at), kind="stable")]
            for lo in range(0, len(records), 1024):
                part = records[lo : lo + 1024]
                ends = np.arange(len(part) + 1, dtype=np.int32) * size
                yield pa.RecordBatch.from_arrays([pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(part.tobytes())])], names=["value"])

    return dealt.mapInArrow(run, "value binary")


def read_layout(spark: SparkSession, path: str) -> Layout:
    return Layout(**json.loads(spark.read.text(f"{path}/layout").first()[0]))


def read_slots(spark: SparkSession, layout: Layout, first: int, end: int) -> DataFrame:
    """slot and ids of the slots from first up to end: only their shards are opened."""
    lo, hi = first // layout.per_shard, -(-end // layout.per_shard)
    names = "{" + ",".join(f"part-{s:05d}-*" for s in range(lo, hi)) + "}"
    files = spark.read.format("binaryFile").load(f"{layout.path}/shards/{names}").select("path", "content")
    shard = F.regexp_extract("path", r"part-(\d+)-", 1).cast("long")
    width, stride = layout.width, layout.stride
    n = F.floor(F.length("content") / stride).cast("int")
    rows = files.select(shard.alias("shard"), "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    rows = rows.select((F.col("shard") * layout.per_shard + F.col("i")).alias("slot"), F.substring("content", F.col("i") * stride + 1, F.lit(layout.length * width)).alias("tokens"))
    return rows.filter((F.col("slot") >= first) & (F.col("slot") < end)).orderBy("slot")


def shard_index(docs: DataFrame, **names) -> DataFrame:
    return write_shards(docs, **names)[0]
