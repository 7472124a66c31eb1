"""Stages graded against decisions: labels, gates, orderings and what was never seen, as rows of named figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions import text as T, vocabulary as V
from siftline.operators import audit as A, state as K
from siftline.operators.places import placed_in_all


def labels(decisions: DataFrame, key: str = "job_id") -> DataFrame:
    """The newest decision of each key, over all users (ties go to the user last by name): status, reasons and good (true, false, or null where it says nothing)."""
    newest = K.latest(decisions, [key], ["decided_at", "user"])
    return newest.withColumn("good", F.when(F.col("status").isin(*V.GOOD_DECISIONS), True).when(F.col("status").isin(*V.BAD_DECISIONS), False))


def _figures(row: DataFrame, part: str) -> DataFrame:
    """One row's columns as rows (part, figure, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("value")) for c in row.columns])
    return row.select(F.lit(part).alias("part"), F.inline(pairs))


def decision_eval(decisions: DataFrame, filters: DataFrame, screen: DataFrame, scores: DataFrame, min_score: int, ks: Sequence[int] = (10, 20), key: str = "job_id") -> DataFrame:
    """(part, figure, value) about decided keys. filters: status, reasons; screen: relevant, screen_score; scores: score, the effective one.

    Parts: counts; screen (the gate's precision and recall); unseen (good keys that the screen never saw, by the rule
    category that dropped them); labelled (mean scores of good and bad, rank correlation); at k (precision of the best k).
    """
    each = labels(decisions, key)
    known = each.filter("good is not null").select(key, "good")
    wide = known.join(screen.select(key, "relevant", "screen_score"), key, "left").join(scores.select(key, "score"), key, "left").join(filters.select(key, F.col("status").alias("rule_status"), F.get("reasons", 0).alias("_why")), key, "left")
    seen = F.col("screen_score").isNotNull()
    passed = seen & F.col("relevant") & (F.col("screen_score") >= min_score)
    read = decisions.agg(F.count(F.lit(1)).alias("decisions_read"))
    decided = each.agg(F.count(F.lit(1)).alias("jobs_decided"), F.count_if(F.col("status").isin(*V.NO_DECISIONS)).alias("closed"), F.count_if(F.col("good").isNotNull()).alias("usable"), F.count_if("good").alias("positives"), F.count_if(~F.col("good")).alias("negatives"))
    counts = read.join(F.broadcast(decided)).withColumn("superseded", F.col("decisions_read") - F.col("jobs_decided"))  # one row each
    gate = A.gate_quality(wide.filter(seen), passed, F.col("good"))
    unseen = wide.filter(F.col("good") & ~seen).withColumn("figure", F.when(F.col("rule_status") == "drop", T.reason_category(F.coalesce("_why", F.lit("")))).otherwise("never_screened"))
    unseen = unseen.groupBy("figure").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("unseen").alias("part"), "figure", "value")
    scored = wide.filter("score is not null").withColumn("_y", F.col("good").cast("int"))
    means = scored.agg(F.count(F.lit(1)).alias("scored"), F.avg(F.when(F.col("good"), F.col("score"))).alias("mean_positive"), F.avg(F.when(~F.col("good"), F.col("score"))).alias("mean_negative"))
    rho = A.spearman(scored, "score", "_y").select("rho")
    best = A.precision_at(scored, [F.desc("score"), F.col(key)], F.col("good"), list(ks)).select(F.concat(F.lit("at "), F.col("k")).alias("part"), F.inline(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("value")) for c in ("k_used", "positives", "precision")])))
    parts = [_figures(counts, "counts"), _figures(gate, "screen"), unseen, _figures(means, "labelled"), _figures(rho, "labelled"), best]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def skip_reasons(decisions: DataFrame, scores: DataFrame, vocabulary: Sequence[str], key: str = "job_id") -> DataFrame:
    """reason, place in the vocabulary, count, scored and mean score over the newest decisions that skipped; one with several reasons counts under each."""
    skipped = labels(decisions, key).filter(F.col("status").isin(*V.BAD_DECISIONS)).join(scores.select(key, "score"), key, "left")
    order = F.create_map(*[F.lit(x) for i, r in enumerate(vocabulary) for x in (r, i)])
    means = A.reason_means(skipped.filter(F.col("reasons").isNotNull()), "reasons", "score")
    return means.withColumn("place", F.try_element_at(order, F.col("reason"))).filter("place is not null")


def orderings(measured: DataFrame, columns: Sequence[str], target: Column, truth: str, tie: str, key: str, depths: Sequence[int] = V.DEPTHS) -> DataFrame:
    """How early each of several orderings of the same rows reaches the targets, and how each agrees with the truth: a row an ordering.

    Rows without a score stand last; ties go by the column tie, then by key.
    """
    out = None
    for c in columns:
        rows = placed_in_all(measured.withColumn("_score", F.coalesce(c, F.lit(0.0))), [F.desc("_score"), F.desc(F.coalesce(tie, F.lit(0.0))), F.col(key)], "_place")
        deep = A.reading_depth(rows, "_place", target, depths)
        rho = A.spearman(measured.filter(F.col(c).isNotNull()), c, truth).select(F.col("n").alias("compared"), "rho")
        row = deep.join(F.broadcast(rho)).withColumn("ordering", F.lit(c))  # one row each
        out = row if out is None else out.unionByName(row)
    return out
