"""Entity dedupe of postings: company and title keys, word-prefix parents, the best member of each group."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions import text as T, vocabulary as V
from siftline.operators.joins import look_up


def keyed(df: DataFrame, company: str, title: str, key: str, aliases: DataFrame | None = None) -> DataFrame:
    """df with _company and _title; a row without company is a group of its own (its id)."""
    own = T.company_key(F.col(company))
    df = df.withColumn("_title", T.alnum_key(F.col(title))).withColumn("_company", F.when(F.coalesce(F.trim(company), F.lit("")) != "", own))
    if aliases is not None:
        a = aliases.select(T.company_key(F.col("alias")).alias("_company"), T.company_key(F.col("name")).alias("_name"))
        df = look_up(df, a.dropDuplicates(["_company"]), "_company").withColumn("_company", F.coalesce("_name", "_company")).drop("_name")
    return df.withColumn("_group", F.when(F.col("_company").isNull(), F.concat(F.lit("\u0001"), F.col(key).cast("string"))).otherwise(F.col("_company")))


def parents(df: DataFrame) -> DataFrame:
    """_company, _title, _parent: the shortest name of two words or more, under the same title, that a name extends by words.

    A name's word prefixes are exploded and met by equality, so no title is joined with itself by pairs.
    """
    names = df.filter("_company is not null").select("_company", "_title").distinct()
    words = F.split("_company", " ")
    prefixes = F.transform(F.sequence(F.lit(2), F.size(words) - 1), lambda n: F.array_join(F.slice(words, 1, n), " "))
    longer = names.filter(F.size(words) > 2).select("_title", F.col("_company").alias("_long"), F.explode(prefixes).alias("_company"))
    return longer.join(names, ["_title", "_company"]).groupBy("_title", "_long").agg(F.min_by("_company", F.length("_company")).alias("_parent")).withColumnRenamed("_long", "_company")


def tier(country: Column, remote: Column, tiers: list[list[str]], keep_remote: bool) -> Column:
    """Rank of a location: listed tiers first, then unknown or remote, then the rest."""
    out = F.when(F.lit(False), 0)
    for n, codes in enumerate(tiers):
        out = out.when(F.upper(country).isin([c.upper() for c in codes] or [""]), n)
    return out.when((F.coalesce(country, F.lit("")) == "") | (F.lit(keep_remote) & (remote == "remote")), 3).otherwise(4)


def dedupe(df: DataFrame, key: str = "id", company: str = "company", title: str = "title", source: str = "source", location: Column | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Every row with kept (whether it is its group's best), kept_id and the group's size."""
    k = keyed(df, company, title, key, aliases)
    k = k.join(parents(k), ["_company", "_title"], "left").withColumn("_group", F.coalesce("_parent", "_group"))
    table = F.create_map(*[F.lit(x) for s, p in V.SOURCE_PRIORITY.items() for x in (s, p)])
    order = F.struct((location if location is not None else F.lit(0)).alias("t"), F.coalesce(F.element_at(table, F.col(source)), F.lit(V.DEFAULT_PRIORITY)).alias("p"), F.col(key).alias("k"))
    best = k.groupBy("_group", "_title").agg(F.min_by(key, order).alias("kept_id"), F.count(F.lit(1)).alias("group_size"))
    return k.join(best, ["_group", "_title"]).withColumn("kept", F.col(key) == F.col("kept_id")).drop("_group", "_title", "_company", "_parent")


def later_copies(df: DataFrame, keys: list[str], order: list[str], key: str) -> DataFrame:
    """Each later row of a key beside the first one."""
    at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(key).alias("key"))
    first = df.groupBy(*keys).agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")  # a row a key and task
    same = [F.col(f"_d.{k}").eqNullSafe(F.col(f"_f.{k}")) for k in keys]
    both = df.withColumn("_at", at).alias("_d").join(first.alias("_f"), reduce(and_, same)).filter(F.col("_at") > F.col("_first"))
    return both.select(F.col("_first.key").alias("first_id"), F.col(f"_d.{key}").alias("copy_id"))
