"""Facets of postings, faceted filters and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions import text as T


def facets(df: DataFrame, text: Column, language: Column, required: Column, optional: Column) -> DataFrame:
    """df with posting_language, languages_required, languages_optional (less the required), stacks, web_dev."""
    none = F.array().cast("array<string>")
    need, may = T.codes(F.coalesce(required, none)), T.codes(F.coalesce(optional, none))
    return df.withColumns({"posting_language": F.lower(F.trim(language)), "languages_required": need, "languages_optional": F.array_except(may, need), "stacks": T.stack_tags(text)}).withColumn("web_dev", F.array_contains("stacks", "web"))


def speaks(language: Column, required: Column, spoken: Sequence[str]) -> Column:
    """Whether the posting's language and all that it requires are spoken; unknown counts as spoken."""
    known = F.array(*[F.lit(s) for s in spoken])
    return F.coalesce(F.array_contains(known, language), F.lit(True)) & F.forall(required, lambda c: F.array_contains(known, c))


def matches(*, equal: dict[str, Sequence[str]] | None = None, overlap: dict[str, Sequence[str]] | None = None, least: dict[str, float] | None = None, contains: dict[str, str] | None = None, null_as: dict[str, str] | None = None) -> Column:
    """Conjunction of facet conditions; absent conditions hold. A null enum can be asked for by its stand-in name."""
    out = F.lit(True)
    for c, values in (equal or {}).items():
        column = F.coalesce(F.col(c).cast("string"), F.lit((null_as or {}).get(c)))
        out = out & (column.isin(*values) if values else F.lit(True))
    for c, values in (overlap or {}).items():
        out = out & (F.arrays_overlap(F.col(c), F.array(*[F.lit(v) for v in values])) if values else F.lit(True))
    for c, value in (least or {}).items():
        out = out & F.coalesce(F.col(c) >= value, F.lit(False))
    for c, value in (contains or {}).items():
        out = out & F.contains(F.lower(c), F.lit(value.lower()))
    return out


def codes_of(values: Sequence[str] | None, upper: bool = False) -> list[str]:
    """Parameters that repeat or hold commas, as one list."""
    out = [x.strip() for v in values or [] for x in v.split(",") if x.strip()]
    return [x.upper() if upper else x.lower() for x in out]


def counts(df: DataFrame, scalars: Sequence[str], arrays: Sequence[str] = ()) -> DataFrame:
    """facet, value, n: all facets from one pass over the rows, nulls left out."""
    own = [F.array(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"))) for c in scalars]

    def members(name: str) -> Column:
        return F.transform(F.coalesce(name, F.array().cast("array<string>")), lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))

    many = [members(c) for c in arrays]
    return df.select(F.explode(F.concat(*own, *many)).alias("f")).select("f.*").filter("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
