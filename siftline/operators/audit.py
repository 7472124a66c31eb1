"""Evaluation: label rates, rank correlation, reading depth, precision and recall, comparison of two score sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from siftline.functions import vocabulary as V
from siftline.operators.places import average_ranks


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole)


def label_rates(rows: DataFrame, category: str, label: str, totals: DataFrame) -> DataFrame:
    """Tallies of good, bad, unsure and blank labels, the rate good / (good + bad), and rate times the category's total."""
    x = F.lower(F.trim(F.coalesce(F.col(label), F.lit(""))))
    tally = rows.groupBy(category).agg(
        F.count(F.lit(1)).alias("sampled"), *[F.count_if(x == v).alias(v) for v in ("good", "bad", "unsure")],
        F.count_if(~x.isin("good", "bad", "unsure")).alias("unlabelled"), F.count_if(~x.isin("good", "bad", "unsure", "")).alias("invalid"),
    )
    rate = ratio(F.col("good"), F.col("good") + F.col("bad"))
    return tally.withColumn("rate", rate).join(totals.select(category, "total"), category, "left").withColumn("total", F.coalesce("total", F.lit(0))).withColumn("estimated_lost", F.col("rate") * F.col("total"))


def label_summary(rates: DataFrame) -> DataFrame:
    """All categories: the pooled rate, but the sum of the categories' estimates."""
    names = ("sampled", "good", "bad", "unsure", "unlabelled", "invalid", "total")
    return rates.agg(*[F.sum(n).alias(n) for n in names], F.coalesce(F.sum("estimated_lost"), F.lit(0.0)).alias("estimated_lost")).withColumn("rate", ratio(F.col("good"), F.col("good") + F.col("bad")))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation of each group, or of all rows if by is empty; null for fewer than two rows or a side that does not vary."""
    ranked = average_ranks(df.select(*by, x, y), [x, y], ["_rx", "_ry"], by)
    ok = (F.var_pop("_rx") > 0) & (F.var_pop("_ry") > 0)
    n, sx, sy, sxy, sxx, syy = F.count(F.lit(1)), F.sum("_rx"), F.sum("_ry"), F.sum(F.col("_rx") * F.col("_ry")), F.sum(F.col("_rx") ** 2), F.sum(F.col("_ry") ** 2)
    rho = F.try_divide(n * sxy - sx * sy, F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)))
    return ranked.groupBy(*by).agg(n.alias("n"), F.when(ok, rho).alias("rho"))


def reading_depth(ordered: DataFrame, place: str, is_target: Column, depths=V.DEPTHS) -> DataFrame:
    """How many targets an ordering has within each cut, and their median place."""
    hits = ordered.filter(is_target)
    return hits.agg(F.count(F.lit(1)).alias("found"), *[F.count_if(F.col(place) <= d).alias(f"at_{d}") for d in depths], F.median(place).alias("median_place"))


def gate_quality(df: DataFrame, passed: Column, positive: Column) -> DataFrame:
    """Precision and recall of a gate over labelled rows."""
    both = F.count_if(passed & positive)
    return df.agg(F.count(F.lit(1)).alias("screened"), F.count_if(passed).alias("passed"), F.count_if(positive).alias("positives"), both.alias("positives_passed"), ratio(both, F.count_if(passed)).alias("precision"), ratio(both, F.count_if(positive)).alias("recall"))


def precision_at(df: DataFrame, order: list[Column], positive: Column, ks: list[int]) -> DataFrame:
    """Hits among the first k, k capped at the rows there are. The first max(ks) rows come from a top-k."""
    head = df.withColumn("_y", positive).orderBy(*order).limit(max(ks)).withColumn("_p", F.row_number().over(Window.orderBy(*order)))
    cuts = head.select("_p", "_y", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).filter(F.col("_p") <= F.col("k"))
    return cuts.groupBy("k").agg(F.count(F.lit(1)).alias("k_used"), F.count_if("_y").alias("positives")).withColumn("precision", ratio(F.col("positives"), F.col("k_used")))


def compare_scores(old: DataFrame, new: DataFrame, key: str, score: str = "score", flag: str = "relevant") -> DataFrame:
    """One row about two score sets: who is where, the change's mean, deviation and median, flags that flipped."""
    a = old.select(key, F.col(score).alias("_o"), F.col(flag).alias("_fo"))
    b = new.select(key, F.col(score).alias("_n"), F.col(flag).alias("_fn"))
    j = a.join(b, key, "full_outer").withColumn("_d", F.col("_n") - F.col("_o"))
    both = F.col("_o").isNotNull() & F.col("_n").isNotNull()
    return j.agg(
        F.count_if(F.col("_n").isNull()).alias("old_only"), F.count_if(F.col("_o").isNull()).alias("new_only"), F.count_if(both).alias("both"), F.avg("_d").alias("mean_delta"),
        F.stddev_samp("_d").alias("sd_delta"), F.median("_d").alias("median_delta"), F.count_if(F.col("_fo") & ~F.col("_fn")).alias("true_to_false"), F.count_if(~F.col("_fo") & F.col("_fn")).alias("false_to_true"),
    )


def movers(old: DataFrame, new: DataFrame, key: str, score: str = "score", n: int = V.MOVERS) -> DataFrame:
    j = old.select(key, F.col(score).alias("old")).join(new.select(key, F.col(score).alias("new")), key).withColumn("delta", F.col("new") - F.col("old"))
    return j.filter("delta <> 0").orderBy(F.desc(F.abs("delta")), key).limit(n)


def top_jaccard(old: DataFrame, new: DataFrame, key: str, n: int, score: str = "score") -> DataFrame:
    """Overlap of the best n of two score sets over their shared keys; null without shared keys."""
    shared = old.select(key, F.col(score).alias("_a")).join(new.select(key, F.col(score).alias("_b")), key)
    x, y = shared.orderBy(F.desc("_a"), key).limit(n).select(key), shared.orderBy(F.desc("_b"), key).limit(n).select(key)
    both = x.join(y, key, "left_semi").agg(F.count(F.lit(1)).alias("shared"))
    return both.join(F.broadcast(x.union(y).distinct().agg(F.count(F.lit(1)).alias("united")))).withColumn("jaccard", ratio(F.col("shared"), F.col("united")))


def criteria_deltas(old: DataFrame, new: DataFrame, key: str, criteria: str = "criteria") -> DataFrame:
    """Mean change of each criterion over the keys that have it on both sides. criteria: a map."""
    a = old.select(key, F.explode(criteria).alias("criterion", "_o"))
    b = new.select(key, F.explode(criteria).alias("criterion", "_n"))
    return a.join(b, [key, "criterion"]).groupBy("criterion").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_n") - F.col("_o")).alias("mean_delta"))


def drift(df: DataFrame, x: str, y: str) -> DataFrame:
    d = F.col(x) - F.col(y)
    return df.agg(F.count(F.lit(1)).alias("n"), F.median(F.abs(d)).alias("median_abs"), F.percentile(F.abs(d), F.lit(0.9)).alias("p90_abs"), F.avg(d).alias("mean_signed"))


def reason_means(df: DataFrame, reasons: str, score: str) -> DataFrame:
    return df.select(F.explode(reasons).alias("reason"), score).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count(score).alias("scored"), F.avg(score).alias("mean_score"))
