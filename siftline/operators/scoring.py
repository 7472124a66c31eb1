"""Scores: lexical prior, calibration of two passes, effective score, weighted criteria, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions import text as T, vocabulary as V
from siftline.operators.joins import look_up


def query_terms(texts: DataFrame, weight: str = "weight", text: str = "text") -> DataFrame:
    """term, weight: the greatest weight over the sources that hold a term, never a sum."""
    return texts.select(F.explode(T.tokens(F.col(text))).alias("term"), weight).groupBy("term").agg(F.max(weight).alias("weight"))


def bm25(docs: DataFrame, query: DataFrame, doc_id: str, text: Column, k1: float = V.BM25_K1, b: float = V.BM25_B) -> DataFrame:
    """doc_id, score of all documents that hold a query term. The pool is docs itself; a document is a row.

    Tokens are cut down to the query's terms where they are made. One aggregate gives the pool's size and lengths and
    each term's documents: a row a query term. Scores are then sums over a document's own terms, so no text, token or
    document is shuffled. The query is a profile's words: its terms are held by the driver and in every task.
    """
    weight = {r["term"]: float(r["weight"]) for r in query.select("term", "weight").collect()}
    own = lambda t: F.struct(F.size(t).alias("n"), F.filter(t, lambda x: x.isin(*weight)).alias("hits"))
    base = docs.select(F.col(doc_id), F.element_at(F.transform(F.array(T.tokens(text)), own), 1).alias("_t"))
    seen = base.select("_t.n", F.explode_outer(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("_t.hits"))).alias("term"))
    stats = seen.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("n"))
    pool = F.max(F.when(F.col("term").isNull(), F.struct("df", "n"))).alias("pool")
    terms = stats.agg(pool, F.map_from_entries(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "df")))).alias("df"))  # a row, with a query's terms
    one = terms.select(F.col("pool.df").alias("_docs"), (F.col("pool.n") / F.col("pool.df")).alias("_mean"), F.col("df").alias("_df"))
    table = F.create_map(*[F.lit(x) for kv in weight.items() for x in kv]) if weight else F.lit(None).cast("map<string,double>")

    def part(term: Column) -> Column:
        df, tf = F.try_element_at("_df", term), F.size(F.filter("_t.hits", lambda x: x == term))
        return F.try_element_at(table, term) * F.log(1 + (F.col("_docs") - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_t.n") / F.col("_mean")))

    score = F.aggregate(F.array_sort(F.array_distinct("_t.hits")), F.lit(0.0), lambda s, term: s + part(term))
    return base.filter(F.size("_t.hits") > 0).join(F.broadcast(one)).select(doc_id, score.alias("score"))


def offset(rank: DataFrame, refine: DataFrame, key: str, least: int = V.MIN_CALIBRATION) -> DataFrame:
    """One row: mean of rank - refine over shared keys in tenths (half up on the scaled integer ratio), 0 for fewer than `least`."""
    both = rank.select(key, F.col("score").alias("_a")).join(refine.select(key, F.col("score").alias("_b")), key)
    return both.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_a") - F.col("_b")).alias("d")).select(F.when(F.col("n") < least, 0.0).otherwise(F.floor((20 * F.col("d") + F.col("n")) / (2 * F.col("n"))) / 10).cast("double").alias("offset"))


def calibrated(refine: Column, off: Column) -> Column:
    """A second-pass score on the scale of the first, in whole numbers from 0 to 100 (halves to even)."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.bround(refine + off, 0).cast("int")))


def effective(rank: Column, refine: Column, off: Column) -> Column:
    both = F.bround((rank + calibrated(refine, off)) / 2, 0).cast("int")
    return F.when(rank.isNotNull() & refine.isNotNull(), both).otherwise(F.coalesce(refine, rank))


def weighted_criteria(df: DataFrame, keys: list[str], criterion: str, value: str, weights: DataFrame) -> DataFrame:
    """Weighted mean of the criteria that are present; null where their weights sum to 0."""
    return look_up(df, weights, criterion, "inner").groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col("weight")), F.sum("weight")).alias("weighted"))


def costs(usage: DataFrame, model: str, prices: dict[str, tuple[float, float]] = V.PRICES) -> DataFrame:
    """Cost by model and in all (model null), from input, output, cache_read, cache_write and batch."""
    dim = usage.sparkSession.createDataFrame([(m, i, o) for m, (i, o) in prices.items()], "_model string, _in double, _out double")
    joined = usage.join(F.broadcast(dim), F.col(model) == F.col("_model"), "left")
    i, o = F.coalesce("_in", F.lit(V.PRICE_DEFAULT[0])), F.coalesce("_out", F.lit(V.PRICE_DEFAULT[1]))
    full = (F.col("input") * i + F.col("cache_write") * i * V.CACHE_WRITE + F.col("cache_read") * i * V.CACHE_READ + F.col("output") * o) / 1e6
    cost = F.when(F.col("batch"), full * V.BATCH_SHARE).otherwise(full)
    return joined.withColumn("_cost", cost).rollup(model).agg(F.sum("_cost").alias("cost"))


def normalised_criteria(raw: Column, names: dict[str, str]) -> Column:
    """A map of criteria by their own keys or labels (names: key to label), clamped to 0 and 100, in the order of names."""
    pairs = []
    for key, label in names.items():
        value = F.coalesce(F.element_at(raw, key), F.element_at(raw, label))
        pairs.append(F.when(value.isNotNull(), F.struct(F.lit(key).alias("k"), F.least(F.lit(100), F.greatest(F.lit(0), value)).alias("v"))))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x.isNotNull()))


def unknown_criteria(raw: Column, names: dict[str, str]) -> Column:
    return F.array_sort(F.array_except(F.map_keys(raw), F.array(*[F.lit(x) for kv in names.items() for x in kv])))
