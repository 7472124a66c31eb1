"""Queues, top-k with ties, anchors, stop rules, sections, samples, chunks, pages, diffs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from siftline.functions import vocabulary as V
from siftline.operators import places as P


def rank_queue(passed: DataFrame, ranked: DataFrame, prior: DataFrame, key: str, score: str) -> DataFrame:
    """What passed the gate and is not ranked yet, best prior first, then gate score, then key (place from 1)."""
    left = passed.join(ranked.select(key), key, "left_anti").join(prior.select(key, "prior"), key, "left").withColumn("prior", F.coalesce("prior", F.lit(0.0)))
    return left.orderBy(F.desc("prior"), F.desc(score), key)


def top_with_ties(df: DataFrame, score: Column, order: list[Column], n: int) -> DataFrame:
    """The first n rows by score and order, and all that tie with the last of them by score.

    The n-th score comes from a top-n (no global sort); the rows are then one filter against it.
    """
    edge = df.select(score.alias("_s")).orderBy(F.desc("_s")).limit(n).agg(F.min("_s").alias("_edge"))
    return df.withColumn("_s", score).join(F.broadcast(edge)).filter(F.col("_s") >= F.col("_edge")).orderBy(F.desc("_s"), *order).drop("_s", "_edge")


def anchors(df: DataFrame, score: str, key: str, targets: Iterable[int] = V.ANCHOR_TARGETS) -> DataFrame:
    """For each target in turn, the unused row nearest to it (ties: the higher score, then the smaller key)."""
    out, used = None, None
    for n, target in enumerate(targets):
        left = df if used is None else df.join(F.broadcast(used), key, "left_anti")  # at most a row a target
        near = F.struct(F.abs(F.col(score) - target), -F.col(score), F.col(key))
        one = left.agg(F.min_by(F.struct(*df.columns), near).alias("_r")).filter("_r is not null").select(F.lit(n + 1).alias("target_no"), F.lit(target).alias("target"), "_r.*")
        out = one if out is None else out.unionByName(one)
        used = out.select(key)
    return out


def miss_runs(windows: DataFrame, order: str, ranked: str, entered: str) -> DataFrame:
    """For each window, the rows ranked since the last window that let somebody in (0 there). windows: a row a round."""
    w = Window.orderBy(order)
    island = F.sum(F.when(F.col(entered) > 0, 1).otherwise(0)).over(w)
    own = F.when(F.col(entered) > 0, 0).otherwise(F.col(ranked))
    return windows.withColumn("_i", island).withColumn("miss_run", F.sum(own).over(Window.partitionBy("_i").orderBy(order))).drop("_i")


def rank_stop(windows: DataFrame, order: str, ranked: str, entered: str, queue_left: int, patience: int, budget: int) -> str:
    """empty, patience, budget or go on: the stop rule of a windowed reading, from its log (a row a round)."""
    if queue_left <= 0:
        return "queue empty"
    last = miss_runs(windows, order, ranked, entered).orderBy(F.desc(order)).first()
    if last is None:
        return "go on"
    if last["miss_run"] >= patience:
        return "patience"
    return "budget" if windows.agg(F.sum(ranked)).first()[0] >= budget else "go on"


def placed(df: DataFrame, order: list[Column], out: str = "place", by: list[str] | None = None) -> DataFrame:
    """Places from 1 within groups of a task's size, or over all rows (by range, in no single task)."""
    if by is None:
        return P.placed_in_all(df, order, out)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def sections(parts: list[tuple[str, DataFrame, list[Column], int | None]], columns: list[str]) -> DataFrame:
    """Named sections one below the other, each ordered and cut to its size, with places."""
    out = None
    for name, df, order, n in parts:
        # a section's first n rows are a page; one without a size is placed by range
        one = df.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")) if n else P.placed_in_all(df, order)
        one = one.select(F.lit(name).alias("section"), "place", *columns)
        out = one if out is None else out.unionByName(one)
    return out


def diff(new: DataFrame, old: DataFrame, key: str, score: str, least: int = V.MOVE_LEAST) -> DataFrame:
    """Changes between two snapshots: new, gone, and moved by at least so much."""
    a, b = new.select(key, F.col(score).alias("new_score")), old.select(key, F.col(score).alias("old_score"))
    j = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), key, "full_outer")
    change = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "gone").when(F.abs(F.col("new_score") - F.col("old_score")) >= least, "moved")
    return j.select(key, change.alias("change"), "new_score", "old_score", F.coalesce(F.col("new_score") - F.col("old_score"), F.lit(0)).alias("delta")).filter("change is not null")


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each stratum, by the hash of seed and key: reruns repeat. The top-n is taken within map tasks first."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(order, key))).filter(F.col("_r") <= n).drop("_r")


def uniform_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def every_nth(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return placed(df, order, "_p").filter((F.col("_p") - 1) % n == 0).drop("_p")


def chunked(df: DataFrame, order: list[Column], size: int, by: list[str] | None = None) -> DataFrame:
    return placed(df, order, "_p", by).withColumn("chunk", F.floor((F.col("_p") - 1) / size).cast("long")).drop("_p")


def page(df: DataFrame, order: list[Column], start: int, n: int) -> DataFrame:
    """One page of an ordered list with the total on every row."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(start).limit(n).join(F.broadcast(total))


def entered(before: DataFrame, after: DataFrame, fresh: DataFrame, key: str) -> int:
    """How many fresh rows are in the top now and were not before. Tops are small by nature."""
    return after.select(key).join(fresh.select(key), key, "left_semi").join(before.select(key), key, "left_anti").count()


def shuffled_twice(df: DataFrame, key: str, seed: int, size: int) -> DataFrame:
    """The rows in two seeded orders, in chunks: for scoring the same rows twice."""
    out = None
    for run in (1, 2):
        order = [F.md5(F.concat(F.lit(f"{seed}:{run}:"), F.col(key).cast("string"))), F.col(key)]
        one = chunked(df, order, size).withColumn("run", F.lit(run))
        out = one if out is None else out.unionByName(one)
    return out
