"""Constrained selection: parts under slot limits, validation, defaults, greedy trimming to a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from siftline.operators.joins import look_up


def violations(parts: DataFrame, chosen: DataFrame, limits: DataFrame) -> DataFrame:
    """slot, part_id, problem: unknown, twice, too many, empty. parts: slot, part_id; chosen: slot, part_id; limits: slot, most, least."""
    unknown = chosen.join(parts, ["slot", "part_id"], "left_anti").select("slot", "part_id", F.lit("unknown").alias("problem"))
    twice = chosen.groupBy("slot", "part_id").count().filter("count > 1").select("slot", "part_id", F.lit("twice").alias("problem"))
    n = limits.join(chosen.groupBy("slot").agg(F.count(F.lit(1)).alias("n")), "slot", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    none = F.lit(None).cast("string").alias("part_id")
    many = n.filter("n > most").select("slot", none, F.lit("too many").alias("problem"))
    few = n.filter("n < least").select("slot", none, F.lit("empty").alias("problem"))
    return unknown.unionByName(twice).unionByName(many).unionByName(few)


def defaults(parts: DataFrame, limits: DataFrame) -> DataFrame:
    """The flagged parts of each slot, or its first ones, up to the slot's limit."""
    flagged = F.max(F.col("is_default").cast("int")).over(Window.partitionBy("slot")) == 1
    pool = parts.withColumn("_f", flagged).filter(~F.col("_f") | F.col("is_default"))
    place = F.row_number().over(Window.partitionBy("slot").orderBy("position", "part_id"))
    return look_up(pool.withColumn("_n", place), limits.select("slot", "most"), "slot", "inner").filter("_n <= most").select("slot", "part_id", F.col("_n").alias("position"))


def resolved(parts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Each slot's texts in the order chosen."""
    j = chosen.join(parts.select("slot", "part_id", "text"), ["slot", "part_id"])
    return j.groupBy("slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda r: r["text"]).alias("texts"))


def drop_order(chosen: DataFrame, wanted: DataFrame, by: str = "selection") -> DataFrame:
    """by, place, slot, part_id, problem: null for the first mention of a chosen part, else unknown or twice. wanted: by, place, slot, part_id."""
    known = chosen.select(by, "slot", "part_id").distinct().withColumn("_known", F.lit(True))
    j = wanted.join(known, [by, "slot", "part_id"], "left")
    again = F.row_number().over(Window.partitionBy(by, "slot", "part_id").orderBy("place")) > 1
    return j.select(by, "place", "slot", "part_id", F.when(F.col("_known").isNull(), "unknown").when(again, "twice").alias("problem"))


def heights(chosen: DataFrame, by: str = "selection") -> DataFrame:
    """What each selection's parts take together, with what its non-empty slots' headings take (a column header, once a slot)."""
    slots = chosen.groupBy(by, "slot").agg(F.sum("height").alias("_h"), F.max("header").alias("_head"), F.count(F.lit(1)).alias("_n"))
    return slots.groupBy(by).agg(F.sum(F.col("_h") + F.col("_head")).alias("height"), F.sum("_n").alias("parts"))


def trimmed(chosen: DataFrame, budgets: DataFrame, by: str = "selection", tolerance: float = 0.0) -> DataFrame:
    """Every selection trimmed to its budget at once: by, dropped (slot, part_id in the order they go), height that is left, fits.

    Parts go in the order of drop_order (null: not named there), ties by slot and part. A part stays if its slot would fall below its
    least; one that was passed over is not tried again. When no named part is left and the height is still too great, parts
    without a drop_order go by the fixed rule: from the last slot (by slot_order) that is above its least, its last part (by position).

    A selection is a row while it is trimmed: its parts are an array, and `aggregate` folds over the candidates with what is left
    as state. Selections are pages, so an array is small; there may be any number of them, over all tasks.
    chosen: by, slot, slot_order, part_id, position, height, least (of a slot: the greatest of its parts), drop_order. budgets: by, budget, error (by how much the real
    height is above the model's, null: 0).
    """
    part = F.struct(
        F.col("drop_order").isNull().alias("unnamed"), F.col("drop_order").alias("named"), F.when(F.col("drop_order").isNull(), -F.col("slot_order")).alias("from_last"),
        F.when(F.col("drop_order").isNull(), -F.col("position")).alias("last_part"), "slot", "part_id", F.col("height").cast("double").alias("height"), "least",
    )
    each = chosen.groupBy(by).agg(F.array_sort(F.collect_list(part)).alias("_parts"), F.array_sort(F.collect_set("slot")).alias("_slots"), F.sum(F.col("height").cast("double")).alias("_height"))
    each = look_up(each, budgets.select(by, F.col("budget").cast("double").alias("_budget"), F.coalesce(F.col("error").cast("double"), F.lit(0.0)).alias("_error")), by, "inner")
    of = lambda s: F.filter("_parts", lambda p: p["slot"] == s)
    counted = F.transform("_slots", lambda s: F.struct(s.alias("slot"), (F.size(of(s)) - F.array_max(F.transform(of(s), lambda p: p["least"]))).cast("int").alias("spare")))
    nothing = F.array().cast("array<struct<slot:string,part_id:string>>")

    def step(acc, p):
        spare = F.exists(acc["slots"], lambda s: (s["slot"] == p["slot"]) & (s["spare"] > 0))
        goes = (acc["height"] > F.col("_budget") - F.col("_error") + tolerance) & spare
        less = F.transform(acc["slots"], lambda s: F.struct(s["slot"].alias("slot"), F.when(s["slot"] == p["slot"], s["spare"] - 1).otherwise(s["spare"]).alias("spare")))
        after = F.struct((acc["height"] - p["height"]).alias("height"), less.alias("slots"), F.concat(acc["dropped"], F.array(F.struct(p["slot"].cast("string").alias("slot"), p["part_id"].cast("string").alias("part_id")))).alias("dropped"))
        return F.when(goes, after).otherwise(acc)

    start = F.struct(F.col("_height").alias("height"), counted.alias("slots"), nothing.alias("dropped"))
    done = each.withColumn("_done", F.aggregate("_parts", start, step))
    return done.select(by, F.col("_done.dropped").alias("dropped"), F.col("_done.height").alias("height"), (F.col("_done.height") <= F.col("_budget") - F.col("_error") + tolerance).alias("fits"))


def kept_parts(chosen: DataFrame, trims: DataFrame, by: str = "selection") -> DataFrame:
    """chosen without what the trims dropped."""
    gone = trims.select(by, F.inline("dropped"))
    return chosen.join(gone, [by, "slot", "part_id"], "left_anti")
