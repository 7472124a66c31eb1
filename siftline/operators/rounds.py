"""Iteration to a fixed point, a table a round.

What a round reads and finds is appended to one table as a folder of its own, so the plan of round n reads a table and not
n unions, and a lost executor costs a retry of its round. The frontier is a range of places, the best so far are a table of their own
that each round makes from the last one and the round's rows; whether to stop is one aggregate over that, a row of numbers. Nothing
of the queue or of the scores is collected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from siftline.operators.joins import look_up
from siftline.scratch import deleted, fresh

Score = Callable[[DataFrame], DataFrame]
#: Passes that the first head of a queue is long enough for, and how much longer the next one is.
REACH = 16


@dataclass(frozen=True)
class Rounds:
    """rows: what was scored, with the number of its round; best: the top of it; why it ended, after how many rounds."""

    rows: DataFrame
    best: DataFrame
    why: str
    rounds: int


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_windows(queue: DataFrame, score: Score, key: str, window: int, top: int, patience: int, budget: int) -> Rounds:
    """Read a placed queue (key, place from 1) window by window through score(df) -> (key, score), the best first (ties: the smaller key).

    It ends when the queue is empty, when `patience` rows in a row let nobody into the best `top`, or when `budget` rows are read.
    """
    spark = queue.sparkSession
    root = fresh(spark, "windows")
    n, read, missed, best, old = 0, 0, 0, None, None
    while True:
        part = queue.filter((F.col("place") > n * window) & (F.col("place") <= (n + 1) * window))
        got = _kept(score(part).select(key, F.col("score").cast("double").alias("score"), F.lit(n).alias("round")), f"{root}/rows/n={n}")
        known = got if best is None else best.unionByName(got)
        best = _kept(known.orderBy(F.desc("score"), key).limit(top).coalesce(1), f"{root}/best-{n}")
        ranked, entered = got.agg(F.count(F.lit(1))).crossJoin(best.agg(F.count_if(F.col("round") == n))).first()  # one row each
        if old is not None:
            deleted(spark, old)
        old = f"{root}/best-{n}"
        rows = spark.read.schema(got.schema).option("recursiveFileLookup", "true").parquet(f"{root}/rows")
        if not ranked:
            return Rounds(rows, best, "queue empty", n)
        n, read, missed = n + 1, read + ranked, 0 if entered else missed + ranked
        if missed >= patience:
            return Rounds(rows, best, "patience", n)
        if read >= budget:
            return Rounds(rows, best, "budget", n)


def effective(prior: Column, refined: Column) -> Column:
    return F.coalesce(refined, prior)


def refine_top(scored: DataFrame, refine: Score, key: str, top: int, passes: int) -> Rounds:
    """Refine the best `top` by effective score (refined, else prior) until all of them are refined, or for so many passes.

    scored: key, prior. A pass refines those of the present top that have no refined score: others move up when these fall.
    rows: key, refined, round; best: the top by effective score. Reasons: refined, passes, or nothing to refine.

    After n passes at most n * top rows are refined, so the top is among those and the first (n + 1) * top by prior: a head of the
    queue, which is cut anew, REACH times as long, when the passes outgrow it. The queue is stored and sorted a few times, not once a pass.
    """
    spark = scored.sparkSession
    root = fresh(spark, "passes")
    base = _kept(scored.select(key, F.col("prior").cast("double").alias("prior")), f"{root}/base")
    done = base.select(key, F.col("prior").alias("refined"), F.lit(0).alias("round")).limit(0)
    rows, n, reach, head = done, 0, 0, base
    while True:
        if n + 1 > reach:
            reach = REACH * max(reach, 1)
            head = _kept(base.orderBy(F.desc("prior"), key).limit(reach * top), f"{root}/head-{reach}")
        seen = look_up(head, rows.select(key, "refined"), key)
        best = _kept(seen.withColumn("score", effective(F.col("prior"), F.col("refined"))).orderBy(F.desc("score"), key).limit(top).coalesce(1), f"{root}/best-{n}")
        if n:
            deleted(spark, f"{root}/best-{n - 1}")
        left = best.filter("refined is null")
        if left.isEmpty():
            return Rounds(rows, best, "refined" if n else "nothing to refine", n)
        if n >= passes:
            return Rounds(rows, best, "passes", n)
        _kept(refine(left.select(key, "prior")).select(key, F.col("score").cast("double").alias("refined"), F.lit(n).alias("round")), f"{root}/rows/n={n}")
        rows = spark.read.schema(done.schema).option("recursiveFileLookup", "true").parquet(f"{root}/rows")
        n += 1


def until_boundary_holds(step: Callable[[int], tuple[DataFrame, float]], most: int) -> tuple[DataFrame, int]:
    """Repeat step(n) -> (result, its boundary: the score of the last one let in) while the boundary falls, for at most so many turns."""
    out, last = step(0)
    for n in range(1, most):
        new, boundary = step(n)
        out = new
        if boundary is None or last is None or boundary >= last:
            return out, n + 1
        last = boundary
    return out, most
