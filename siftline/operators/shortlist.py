"""Set-valued scoring: a function that sees a whole shortlist at once and gives a row for each of its members.

A shortlist's new members are scored beside its anchors, members whose score is known already, so that scores of several
calls are on one scale. A list that is over the budget of a call is split: its new members in their order, each split with all
anchors. The function is an Arrow table function over a table argument partitioned by (list, split): Spark brings a split's
rows together, the function gets them as Arrow data and may give any number of rows. A split is bounded by the budget, so no task
holds a list that is larger, and how far a list runs is summed by range, not in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from siftline.operators import places
from siftline.operators.joins import look_up

#: What a scorer gets: list, split, key, text, anchor (its score, null for a new member), in the order of anchor, place.
Scorer = Callable[[pa.Table], pa.Table]


def members(candidates: DataFrame, known: DataFrame, by: str, key: str, anchors: int, again: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new members, anchors). known: key, score. Anchors are the best known of each list, ties by key; again: all are new, none an anchor."""
    if again:
        return candidates, candidates.withColumn("anchor", F.lit(None).cast("double")).limit(0)
    new = candidates.join(known.select(key), key, "left_anti")
    scored = candidates.join(known.select(key, F.col("score").cast("double").alias("anchor")), key)
    place = F.row_number().over(Window.partitionBy(by).orderBy("_down", key))  # Spark keeps the first rows of each task's groups before it shuffles
    return new, scored.withColumn("_down", -F.col("anchor")).withColumn("_place", place).filter(F.col("_place") <= anchors).drop("_down", "_place")


def split(new: DataFrame, by: str, key: str, order: Sequence[str], size: Column, budget: int) -> DataFrame:
    """new with `split`: a list's members in order, a new split whenever another budget of size is full (what has come before, by budget)."""
    sized = new.withColumn("_size", size.cast("long")).withColumn("_list", F.struct(by))
    rows = places.running_counts(sized, ["_list", *order, key], "_size", "_before")
    first = rows.groupBy("_list").agg(F.min("_before").alias("_first")).withColumnRenamed("_list", "_of")
    met = look_up(rows, first, F.col("_list").eqNullSafe(F.col("_of")), "inner")
    return met.withColumn("split", F.floor((F.col("_before") - F.col("_first")) / budget).cast("int")).select(*new.columns, "split")


def prompt(texts: Column, most: int) -> Column:
    """An ordered list of texts as one text, each cut to so many characters."""
    return F.array_join(F.transform(texts, lambda t: F.substring(t, 1, most)), "\n\n")


def score_sets(new: DataFrame, anchors: DataFrame, scorer: Scorer, returns: str, by: str, key: str, text: str) -> DataFrame:
    """scorer's rows over every (list, split). new: by, split, key, text; anchors: by, key, text, anchor."""
    spark = new.sparkSession
    mine = new.select(F.col(by).alias("list"), "split", F.col(key).alias("key"), F.col(text).alias("text"), F.lit(None).cast("double").alias("anchor"))
    splits = new.select(F.col(by).alias("list"), "split").distinct()
    beside = anchors.select(F.col(by).alias("_list"), F.col(key).alias("key"), F.col(text).alias("text"), "anchor")
    both = mine.unionByName(look_up(splits, beside, F.col("list").eqNullSafe(F.col("_list")), "inner").select("list", "split", "key", "text", "anchor"))

    class Whole:
        def __init__(self):
            self.parts = []

        def eval(self, rows: pa.RecordBatch):
            self.parts.append(rows)
            return iter(())

        def terminate(self):
            if self.parts:
                yield scorer(pa.Table.from_batches(self.parts))

    name = f"whole_{uuid.uuid4().hex[:8]}"
    spark.udtf.register(name, F.arrow_udtf(Whole, returnType=returns))
    return spark.sql(f"SELECT * FROM {name}(TABLE({{rows}}) PARTITION BY (list, split) ORDER BY (anchor IS NULL, anchor DESC, key))", rows=both)
