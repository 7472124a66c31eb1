"""Company boards: which postings of a board to keep, and what their paths, pages and payloads tell, as columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from siftline.functions import parsers as P, text as T

# Path parts that name no place; urls, tokens and cultures of requisition pages; wording of first jobs; who may work remotely.
NO_PLACE = ("multiple locations", "various locations", "remote", "virtual", "anywhere", "flexible")
REQUISITION = r"(?i)^(https?://[^/\s]+)/ux/ats/careersite/(\d+)/job/([\w.-]+)"
SITE_SLUG = r"[?&]c=([^&#]+)"
TOKENS = (r"csod\.context\.token\s*=\s*['\"]([^'\"]+)['\"]", r'"token"\s*:\s*"([^"]+)"')
ENGLISH = "1"
ENTRY_LEVEL = r"(?iuU)\b(?:junior|jr|intern|internship|working student|trainee|graduate|entry[- ]level|young professional|\w*(?:praktikum|praktikant|werkstudent|absolvent|berufseinsteiger|einsteiger)\w*)\b"
REMOTE_FOR = {"anywhere": "Anywhere", "onlycountry": "{} only", "countryandeu": "{} + EU"}
PROSE_FIELDS = (("description", None), ("responsibilitiesTextArea", "Responsibilities"), ("requirementsMustTextArea", "Requirements"), ("requirementsNiceTextArea", "Nice to have"))


def _group(text: Column, pattern: str, n: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def keeps(title: Column, include: str | None = None, exclude: str | None = None) -> Column:
    """Whether a board keeps a title: it fits what is included and nothing that is excluded."""
    text = F.coalesce(title, F.lit(""))
    return (text.rlike(include) if include else F.lit(True)) & (~text.rlike(exclude) if exclude else F.lit(True))


def in_region(country: Column, remote: Column, countries: Iterable[str]) -> Column:
    """Whether a posting's text is worth fetching: its country is asked for or unknown, or it is remote, or no country is asked for."""
    asked = list(countries)
    return F.lit(True) if not asked else country.isNull() | country.isin(asked) | F.coalesce(remote == "remote", F.lit(False))


def slug_location(path: Column) -> Column:
    """The place that a path "/job/A-B-C/title" spells, as "A, B, C"; null for other paths and for placeholders."""
    some = lambda x, mark: F.filter(F.transform(F.split(x, mark), lambda t: F.trim(t)), lambda t: t != "")
    parts = some(path, "/")
    names = some(F.get(parts, 1), "-")
    fits = (F.size(parts) >= 2) & (F.lower(F.get(parts, 0)) == "job") & (F.size(names) > 0) & ~F.lower(F.array_join(names, " ")).isin(*NO_PLACE)
    return F.when(fits, F.array_join(names, ", "))


def requisition(url: Column) -> Column:
    """struct(origin, site, requisition, slug) of a requisition's url, or null."""
    parts = F.struct(_group(url, REQUISITION, 1).alias("origin"), _group(url, REQUISITION, 2).alias("site"), _group(url, REQUISITION, 3).alias("requisition"), _group(url, SITE_SLUG).alias("slug"))
    return F.when(url.rlike(REQUISITION), parts)


def page_token(html: Column) -> Column:
    return F.coalesce(*[_group(html, p) for p in TOKENS])


def pick_description(bodies: Column, default: Column) -> Column:
    """Of a map from culture to body, the first that is prose: English, the default one, the others in order."""
    keys = F.concat(F.array(F.lit(ENGLISH), F.coalesce(default, F.lit(""))), F.array_sort(F.map_keys(bodies)))
    texts = F.transform(keys, lambda k: F.try_element_at(bodies, k))
    return P.first_description(texts)


def contract_types(flags: Column) -> Column:
    """The kinds of contract whose flag is set, of a map from kind to flag."""
    return F.map_keys(F.map_filter(flags, lambda k, on: F.coalesce(on, F.lit(False))))


def entry_level(*fields: Column) -> Column:
    return F.concat_ws(" ", *fields).rlike(ENTRY_LEVEL)


def remote_for(kind: Column, country: Column) -> Column:
    """Who may work remotely, in words: a known kind with its country, else the kind as it is."""
    kind = F.nullif(F.trim(kind), F.lit(""))
    out = F.when(F.lit(False), kind)
    for name, words in REMOTE_FOR.items():
        said = F.concat(country, F.lit(words.removeprefix("{}"))) if words.startswith("{}") else F.lit(words)
        out = out.when((F.lower(kind) == name) & said.isNotNull(), said)
    return out.otherwise(kind)


def labelled_prose(detail: dict[str, Column]) -> Column:
    """The prose fields of a posting, each under its label; null if none holds a text."""
    parts = []
    for field, label in PROSE_FIELDS:
        text = F.nullif(F.trim(detail[field]), F.lit(""))
        parts.append(F.concat(F.lit(f"{label}:\n"), text) if label else text)
    return F.nullif(F.concat_ws("\n\n", *parts), F.lit(""))


def skill_tags(skills: Column) -> Column:
    """Tags of a list with commas; "and" before the last is dropped."""
    return F.filter(F.transform(F.split(F.coalesce(skills, F.lit("")), ","), lambda x: F.trim(F.regexp_replace(F.trim(x), r"(?i)^and\s+", ""))), lambda x: x != "")


def within_budget(rows: DataFrame, site: str, order: list[Column], budget: int) -> DataFrame:
    """The rows whose details to fetch: the same share of the budget for each site, and what a site leaves goes to the others, in order of their places."""
    places = Window.partitionBy(site).orderBy(*order)
    placed = rows.withColumn("_place", F.row_number().over(places))
    return placed.filter(F.col("_place") <= budget).orderBy("_place", site).limit(budget).drop("_place")


def duplicate_key(text: Column) -> Column:
    """Letters and digits of a name, in lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def slug(text: Column) -> Column:
    return T.slug(text)
