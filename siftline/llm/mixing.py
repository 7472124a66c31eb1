"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets: all words shared by weight, each source's share stopped at CAP times its size, the excess shared again.
Every source's documents are laid end to end in a seeded order, and that again and again; blocks are runs of BLOCK
words there, equal for all sources, however small. Blocks are apportioned to sources by highest quotients
target / (2 awards + 1). Output shards are filled one after the other: a shard's quota of a source is what the house
up to it awards beyond the house before it (the method never takes an award back as the house grows), so each shard
holds the sources in proportion. A source's blocks are selected in its seeded order: shard k takes those from the sum
of the quotas before it up to its own. So whole documents are taken but at the ends of a shard's run, and every word
taken has a shard.

Defined cases: a null text has size 0; a null source is a source of its own, last in the order of weights; documents
without words take nothing; repeated rows are separate documents; empty tables give empty tables; columns of other
names pass through unchanged. The driver holds a row a source, nothing else.
"""

from __future__ import annotations

import heapq
import re
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftline.llm._common import bound_batches, keyed_hash, n_words, running, small, stored

WEIGHTS, CAP, SEED, SHARDS = (1, 2, 3), 3, 20_240_607, 8
#: Words of a block: what a source's words may miss its target by.
BLOCK = 8


def targets(sizes: list[int], weights=WEIGHTS, cap: int = CAP) -> list[Fraction]:
    """Words for each source, in their order: by weight, none above cap times its size. The sources that fill up first come first."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    order = sorted(range(len(sizes)), key=lambda i: (Fraction(sizes[i], w[i]), i))
    left, open_, out = sum(sizes), sum(w), [Fraction(0)] * len(sizes)
    for at, i in enumerate(order):
        if left * w[i] <= cap * sizes[i] * open_:
            share = Fraction(left, open_)
            for j in order[at:]:
                out[j] = share * w[j]
            break
        out[i] = Fraction(cap * sizes[i])
        left, open_ = left - cap * sizes[i], open_ - w[i]
    return out


def apportion(shares: list[Fraction], house: int) -> list[int]:
    """Sainte-Laguë seats: the house awards with the highest quotients share / (2 s + 1), ties to the earlier source.

    A divisor gives all awards but a few; the rest follow from heaps of quotients.
    """
    unit = lcm(*(x.denominator for x in shares)) if shares else 1
    whole = [x.numerator * (unit // x.denominator) for x in shares]
    total = sum(whole)
    if not house or not total:
        return [0] * len(shares)
    seats = [max(0, -((total - 2 * x * house) // (2 * total))) for x in whole]
    more = sum(seats) - house
    heap = [(Fraction(x, 2 * s - 1), -i) for i, (x, s) in enumerate(zip(whole, seats)) if s] if more > 0 else [(-Fraction(x, 2 * s + 1), i) for i, (x, s) in enumerate(zip(whole, seats)) if x]
    heapq.heapify(heap) if more else None
    for _ in range(abs(more)):
        i = abs(heap[0][1])
        seats[i] -= 1 if more > 0 else -1
        if more > 0 and not seats[i]:
            heapq.heappop(heap)
        else:
            heapq.heapreplace(heap, (Fraction(whole[i], 2 * seats[i] - 1), -i) if more > 0 else (-Fraction(whole[i], 2 * seats[i] + 1), i))
    return seats


def plan(sizes: list[int], weights=WEIGHTS, cap: int = CAP, shards: int = SHARDS, block: int = BLOCK) -> dict:
    """Targets, and quotas in blocks by shard and source; no source gets more blocks than cap times its words hold."""
    goal = targets(sizes, weights, cap)
    house = round(sum(goal) / block)
    most = [cap * s // block for s in sizes]
    marks = [[0] * len(sizes)] + [[min(a, m) for a, m in zip(apportion(goal, house * (k + 1) // shards), most)] for k in range(shards)]
    return {"target": goal, "quotas": [[b - a for a, b in zip(*pair)] for pair in zip(marks, marks[1:])]}


def mixture(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS, cap: int = CAP, seed: int = SEED, shards: int = SHARDS, block: int = BLOCK, keep: list[str] | None = None) -> tuple[DataFrame, dict]:
    """(docs, or their columns to keep, in a column _row, with size, source_size, target, taken, taken_by_shard, and _from and _ends for the places taken; the plan)."""
    spark = docs.sparkSession
    held = docs.select(
        F.struct(*(keep or docs.columns)).alias("_row"), n_words(F.col(text)).alias("size"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")).alias("_source"),
        keyed_hash(seed, F.col(doc_id).cast("string"), F.col(text)).alias("_hash"), F.col(doc_id).cast("string").alias("_id"),
    )
    held = stored(held, "sizes")  # words are counted once
    totals = held.groupBy("_source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()  # a row a source
    totals.sort(key=lambda r: (r["_source"] == "n", r["_source"]))
    how = plan([r["size"] for r in totals], weights, cap, shards, block)
    ends, at = [], [0] * len(totals)
    for quota in how["quotas"]:
        at = [a + block * q for a, q in zip(at, quota)]
        ends.append(at)
    facts = spark.createDataFrame(
        [(r["_source"], r["size"], float(g), [e[i] for e in ends]) for i, (r, g) in enumerate(zip(totals, how["target"]))],
        "_source string, source_size long, target double, _ends array<bigint>",
    )
    laid = running(held, ["_source"], F.col("size"), F.col("_hash"), [F.col("_id"), F.col("size")], sum(r["n"] for r in totals), "_from")
    laid = laid.join(small(facts, len(totals)), "_source")

    def upto(place: Column, end: Column) -> Column:
        """Words before a place of the source that stand before end in its repetitions."""
        size = F.greatest(F.col("source_size"), F.lit(1))
        return F.floor(end / size) * place + F.least(place, F.pmod(end, size))

    before = F.transform("_ends", lambda e: (upto(F.col("_from") + F.col("size"), e) - upto(F.col("_from"), e)).cast("long"))
    laid = laid.withColumn("_before", before).withColumn("taken", F.element_at("_before", -1))
    by_shard = F.transform("_before", lambda b, k: b - F.coalesce(F.get("_before", k - 1), F.lit(0)))
    return laid.withColumn("taken_by_shard", by_shard).drop("_before"), how


def mix_report(docs: DataFrame, **names) -> DataFrame:
    """A row a document: size, its source's size and target, and the words that the mix takes of it, in all and by output shard."""
    laid, _ = mixture(docs.select("doc_id", "text", "source"), keep=["doc_id"], **names)
    return laid.select("_row.doc_id", "size", "source_size", "target", "taken", "taken_by_shard")


_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _cut(text: str, lo: int, hi: int) -> str:
    """The text from its word number lo up to its word number hi."""
    at = [m.span() for m in _WORDS.finditer(text)]
    return text[at[lo][0] : at[hi - 1][1]]


def mixed(docs: DataFrame, text: str = "text", shard: str | None = None, **names) -> DataFrame:
    """The mix itself, in the columns of docs: a row for each time that a document is taken by a shard, holding the words taken. shard: name of a column that tells the shard."""
    bound_batches(docs.sparkSession)
    laid, _ = mixture(docs, text=text, **names)
    start, size = F.col("_from"), F.col("size")
    first = lambda k: F.coalesce(F.get("_ends", k - 1), F.lit(0))
    turns = F.sequence(F.lit(0).cast("long"), F.floor((F.element_at("_ends", -1) - 1) / F.col("source_size")).cast("long"))
    piece = lambda e, k: F.transform(turns, lambda t: F.struct(
        k.alias("shard"), F.greatest(F.lit(0), first(k) - start - t * F.col("source_size")).cast("long").alias("lo"), F.least(size, e - start - t * F.col("source_size")).cast("long").alias("hi")))
    pieces = F.filter(F.flatten(F.transform("_ends", piece)), lambda p: p["hi"] > p["lo"])
    rows = laid.filter("taken > 0").select("_row", "size", F.explode(pieces).alias("_p"))
    own = lambda c: F.col("_row")[c]
    extra = [F.col("_p.shard").alias(shard)] if shard else []
    fits = (F.col("_p.lo") == 0) & (F.col("_p.hi") == F.col("size"))
    whole = rows.filter(fits).select("_row.*", *extra)
    part = _with_cut(rows.filter(~fits).select("_row", own(text).alias("_text"), "_p"))  # two a shard and source
    cut = part.select(*[F.col("_cut").alias(c) if c == text else own(c).alias(c) for c in docs.columns], *extra)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return whole.unionByName(cut)


def _with_cut(part: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            cut = [_cut(t, p["lo"], p["hi"]) for t, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(cut, pa.string())], names=["_row", "_p", "_cut"])

    return part.mapInArrow(run, part.drop("_text").schema.add("_cut", "string"))
