"""Parsers of feed shapes: paged JSON, arrays with notices, search hits, dimension look-ups, multilingual maps, RSS, sitemaps, JSON-LD pages, custom elements.

Every parser takes url and payload rows and gives postings. Adapters name the shape and where its fields lie; a new
site of a known shape is one register() call.
"""

from __future__ import annotations

import html as _html
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from siftline.operators.joins import look_up
from siftline.functions import dates as D, parsers as P, places as G, text as T
from siftline.sources.connector import Adapter, path, postings, records, register


# ------------------------------------------------------------------ helpers on variants
def strings(value: Column) -> Column:
    """An array of texts out of an array of texts or of objects with name, value or label."""
    items = F.try_variant_get(value, "$", "array<variant>")
    one = lambda x: F.coalesce(F.try_variant_get(x, "$.name", "string"), F.try_variant_get(x, "$.value", "string"), F.try_variant_get(x, "$.label", "string"), F.try_variant_get(x, "$", "string"))
    return F.coalesce(F.array_distinct(F.filter(F.transform(items, one), lambda x: x.isNotNull() & (F.trim(x) != ""))), F.array().cast("array<string>"))


def first_language(value: Column, order=("fi", "en", "sv")) -> Column:
    """Text of a multilingual map by language priority, then any."""
    m = F.try_variant_get(value, "$", "map<string,string>")
    return F.coalesce(*[F.nullif(F.element_at(m, c), F.lit("")) for c in order], F.element_at(F.map_values(m), 1))


def when(value: Column) -> Column:
    """ISO texts and epochs of seconds or milliseconds, without leaving the JVM."""
    n = value.try_cast("double")
    return F.coalesce(F.when(n > 1e12, F.timestamp_seconds(n / 1000)).when(n > 1e8, F.timestamp_seconds(n)), F.try_to_timestamp(value), F.try_to_timestamp(value, F.lit("dd.MM.yyyy")), F.try_to_timestamp(value, F.lit("yyyy-MM-dd HH:mm:ss")))


def salary(low: Column, high: Column, currency: Column, period: Column | None = None) -> Column:
    """'low–high currency / period' of what is there; null without a figure."""
    number = lambda x: F.when(x > 0, F.replace(F.format_number(x, 0), F.lit(","), F.lit(" ")))
    a, b = number(low), number(high)
    span = F.when(a.isNotNull() & b.isNotNull() & (a != b), F.concat(a, F.lit("–"), b)).otherwise(F.coalesce(a, b))
    unit = F.concat(F.lit(" / "), period) if period is not None else F.lit(None)
    return F.when(span.isNotNull(), F.concat(span, F.coalesce(F.concat(F.lit(" "), currency), F.lit("")), F.coalesce(unit, F.lit(""))))


def region_country(region: Column) -> Column:
    """The country of a region text if all its parts name the same one."""
    parts = F.filter(F.split(region, r"\s*[,;/]\s*"), lambda x: x != "")
    return F.when(F.size(parts) == 1, G.guess_country(region)).otherwise(G.guess_country(F.when(F.size(F.array_distinct(parts)) == 1, F.element_at(parts, 1))))


def languages_line(value: Column, name: str = "code", level: str = "level") -> Column:
    """'Required languages: X (level), …', a sentence that the language rules read."""
    items = F.try_variant_get(value, "$", "array<variant>")
    one = lambda x: F.concat(F.try_variant_get(x, f"$.{name}", "string"), F.coalesce(F.concat(F.lit(" ("), F.try_variant_get(x, f"$.{level}", "string"), F.lit(")")), F.lit("")))
    said = F.filter(F.transform(items, one), lambda x: x.isNotNull())
    return F.when(F.size(said) > 0, F.concat(F.lit("Required languages: "), F.array_join(said, ", "), F.lit(".")))


def blocks(*parts: Column) -> Column:
    """Distinct non-empty blocks one below the other."""
    return F.nullif(F.array_join(F.array_distinct(F.filter(F.array(*parts), lambda x: x.isNotNull() & (F.trim(x) != ""))), "\n\n"), F.lit(""))


# ------------------------------------------------------------------ JSON shapes
def json_feed(name: str, at: str, *, fields: dict[str, str], tags: str | None = None, html: bool = True, remote_flag: str | None = None, keep: str | None = None):
    """Parser of JSON pages: at is the array's path, fields map posting columns to record paths."""

    def parse(pages: DataFrame) -> DataFrame:
        r = records(pages, at)
        get = {c: path(F.col("record"), p) for c, p in fields.items()}
        if "posted_at" in get:
            get["posted_at"] = when(get["posted_at"])
        if html and "description" in get:
            get["description"] = P.clean_description(get["description"])
        place = get.get("location_raw", F.lit(None).cast("string"))
        get.setdefault("country", G.guess_country(place))
        flag = path(F.col("record"), remote_flag, "boolean") if remote_flag else F.lit(None).cast("boolean")
        get.setdefault("remote", T.remote_kind(F.concat_ws(" ", get["title"], place), flag))
        if tags:
            get["tags"] = strings(F.try_variant_get("record", tags, "variant"))
        out = postings(r if keep is None else r.filter(F.expr(keep)), name, _order=F.struct("page_url", "pos"), **get)
        first = out.groupBy("source_id").agg(F.min_by(F.struct(*out.columns), "_order").alias("_row"))  # the copy on the first page, that stands first there
        return first.select("_row.*").drop("_order")

    return register(Adapter(name, parse, f"JSON records at {at}", complete_listing=True))


json_feed("paged", "$.data", fields={"source_id": "$.slug", "url": "$.url", "title": "$.title", "company": "$.company_name", "description": "$.description", "location_raw": "$.location", "posted_at": "$.created_at"}, tags="$.tags", remote_flag="$.remote")
json_feed("noticed", "$", fields={"source_id": "$.id", "url": "$.url", "title": "$.position", "company": "$.company", "description": "$.description", "location_raw": "$.location", "posted_at": "$.epoch"}, tags="$.tags", keep="try_variant_get(record, '$.id', 'string') IS NOT NULL")
json_feed("regional", "$.jobs", fields={"source_id": "$.id", "url": "$.url", "title": "$.title", "company": "$.company_name", "description": "$.description", "location_raw": "$.candidate_required_location", "salary_text": "$.salary", "posted_at": "$.publication_date"}, tags="$.tags")
json_feed("cursor", "$.jobs", fields={"source_id": "$.guid", "url": "$.applicationLink", "title": "$.title", "company": "$.companyName", "description": "$.description", "location_raw": "$.locationRestrictions[0]", "seniority_raw": "$.seniority[0]", "posted_at": "$.pubDate"})
json_feed("hits", "$.hits", fields={"source_id": "$.objectID", "url": "$.url", "title": "$.name", "company": "$.organization.name", "description": "$.summary", "location_raw": "$.offices[0].city", "remote": "$.remote"}, tags="$.sectors")
json_feed("jsonfeed", "$.items", fields={"source_id": "$.id", "url": "$.url", "title": "$.title", "description": "$.content_html", "location_raw": "$._jobposting.jobLocation[0].address.addressLocality", "posted_at": "$.date_published"})


def parse_dimension(pages: DataFrame, places: DataFrame, default_country: str = "EE") -> DataFrame:
    """Fact records whose town, county and country are ids of a dimension (kind, id, name): three look-ups."""
    r = records(pages, "$.vacancies")
    v = r.select("record", *[path(F.col("record"), f"$.{k}Id", "long").alias(k) for k in ("town", "county", "country")])
    for kind in ("town", "county", "country"):
        dim = places.filter(F.col("kind") == kind).select(F.col("id").alias(kind), F.col("name").alias(f"{kind}_name"))
        v = look_up(v, dim, kind)
    return postings(
        v, "dimension", source_id=path(F.col("record"), "$.id"), title=path(F.col("record"), "$.positionTitle"), company=path(F.col("record"), "$.employerName"), city=F.col("town_name"),
        location_raw=F.concat_ws(", ", "town_name", "county_name", "country_name"), country=F.coalesce(G.guess_country(F.col("country_name")), F.lit(default_country)),
        salary_text=salary(path(F.col("record"), "$.salaryFrom", "double"), path(F.col("record"), "$.salaryTo", "double"), F.lit("EUR")), posted_at=when(path(F.col("record"), "$.publishDate")),
    )


def parse_multilingual(pages: DataFrame) -> DataFrame:
    r = records(pages, "$.content")
    at = lambda p: F.try_variant_get("record", p, "variant")
    return postings(
        r, "multilingual", source_id=path(F.col("record"), "$.id"), title=first_language(at("$.title")), company=first_language(at("$.employer.ownerName")), city=first_language(at("$.location.municipalities[0].label")),
        location_raw=first_language(at("$.location.municipalities[0].label")), description=first_language(at("$.jobDescription")), posted_at=when(path(F.col("record"), "$.publishDate")), country=F.coalesce(path(F.col("record"), "$.location.countries[0]"), F.lit("FI")),
    )


register(Adapter("multilingual", parse_multilingual, "records of multilingual text maps"))


# ------------------------------------------------------------------ XML shapes
def rss_items(pages: DataFrame) -> DataFrame:
    """url and one row an item: pos, title, link, guid, date, region, category, description."""
    names = {"title": "title", "link": "link", "guid": "guid", "date": "pubDate", "region": "region", "category": "category", "description": "description", "skills": "skills"}
    item = F.regexp_extract_all("payload", F.lit(r"(?s)<item[\s>].*?</item>"), F.lit(0))
    items = pages.select("*", F.posexplode(item).alias("pos", "_item"))
    return items.select("url", "pos", *[F.nullif(F.expr(f"xpath_string(regexp_replace(_item, '<(/?)[a-zA-Z0-9]+:', '<$1'), 'item/{tag}')"), F.lit("")).alias(c) for c, tag in names.items()])


def split_title(title: Column) -> tuple[Column, Column]:
    """(company, title) of 'Company: Title'."""
    return F.nullif(F.regexp_extract(title, r"^([^:]+):\s+.+$", 1), F.lit("")), F.coalesce(F.nullif(F.regexp_extract(title, r"^[^:]+:\s+(.+)$", 1), F.lit("")), title)


def parse_rss(pages: DataFrame) -> DataFrame:
    i = rss_items(pages)
    company, title = split_title(F.col("title"))
    skills = F.transform(F.split(F.coalesce("skills", F.lit("")), ","), lambda s: F.regexp_replace(F.trim(s), "^and ", ""))
    out = postings(i, "rss", _order=F.struct(i["url"].alias("page_url"), "pos"), source_id=F.coalesce("guid", "link"), url=F.col("link"), title=title, company=company, description=P.clean_description(F.col("description")), location_raw=F.col("region"), remote_region=F.col("region"), remote=F.lit("remote"), tags=F.filter(skills, lambda s: s != ""), posted_at=D.parse_date(F.col("date")))
    first = out.groupBy("url").agg(F.min_by(F.struct(*out.columns), "_order").alias("_row"))  # the copy that stands first
    return first.select("_row.*").drop("_order")


register(Adapter("rss", parse_rss, "RSS items with 'Company: Title'", complete_listing=True))


def sitemap_urls(pages: DataFrame) -> DataFrame:
    """Addresses of a sitemap, in document order, without repeats."""
    locs = F.expr("xpath(regexp_replace(payload, ' xmlns=\"[^\"]*\"', ''), '//loc/text()')")
    return pages.filter(F.contains("payload", F.lit("<loc"))).select(F.posexplode(F.array_distinct(F.filter(F.transform(locs, lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("http"))))).alias("place", "url"))


# ------------------------------------------------------------------ HTML shapes
_LD = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", re.I | re.S)


def ld_nodes(page: str | None) -> list[str]:
    """JSON-LD nodes of a page as JSON texts: lists and @graph flattened, @id references resolved (inline fields win)."""
    found = []
    for m in _LD.finditer(page or ""):
        try:
            data = json.loads(_html.unescape(m[1]) if "&quot;" in m[1] else m[1], strict=False)
        except ValueError:
            continue
        stack = [data]
        while stack:
            x = stack.pop(0)
            if isinstance(x, list):
                stack = x + stack
            elif isinstance(x, dict):
                stack = list(x.get("@graph", [])) + stack
                found.append({k: v for k, v in x.items() if k != "@graph"})
    by_id = {n["@id"]: n for n in found if "@id" in n}
    tails = {i.rstrip("/").rsplit("/", 1)[-1]: n for i, n in by_id.items()}

    def resolved(v):
        if isinstance(v, dict) and "@id" in v:
            return {**(by_id.get(v["@id"]) or tails.get(v["@id"].rstrip("/").rsplit("/", 1)[-1]) or {}), **v}
        return v

    return [json.dumps({k: resolved(v) for k, v in n.items()}, ensure_ascii=False) for n in found]


@F.pandas_udf(ArrayType(StringType()))
def json_ld(pages: pd.Series) -> pd.Series:
    return pages.map(ld_nodes)


def base_salary(node: Column) -> Column:
    """schema.org baseSalary as text."""
    g = lambda p, k="string": F.try_variant_get(node, p, k)
    low = F.coalesce(g("$.baseSalary.value.minValue", "double"), g("$.baseSalary.value.value", "double"), g("$.baseSalary.value", "double"))
    return salary(low, g("$.baseSalary.value.maxValue", "double"), g("$.baseSalary.currency"), F.lower(g("$.baseSalary.value.unitText")))


def parse_json_ld(pages: DataFrame) -> DataFrame:
    n = pages.select("url", F.explode(json_ld(F.col("payload"))).alias("j")).select("url", F.try_parse_json("j").alias("n")).filter(F.try_variant_get("n", "$['@type']", "string") == "JobPosting")
    g = lambda p: F.try_variant_get("n", p, "string")
    place = F.concat_ws(", ", F.coalesce(g("$.jobLocation.address.addressLocality"), g("$.jobLocation[0].address.addressLocality")), F.coalesce(g("$.jobLocation.address.addressCountry"), g("$.jobLocation[0].address.addressCountry")))
    return postings(
        n, "jsonld", source_id=F.coalesce(g("$.identifier.value"), g("$.identifier"), F.col("url")), url=F.col("url"), title=g("$.title"), company=F.coalesce(g("$.hiringOrganization.name"), g("$.hiringOrganization")), description=P.clean_description(g("$.description")), location_raw=place,
        city=F.coalesce(g("$.jobLocation.address.addressLocality"), g("$.jobLocation[0].address.addressLocality")), country=G.guess_country(place), employment_type=g("$.employmentType"), salary_text=base_salary(F.col("n")), posted_at=D.parse_date(g("$.datePosted")), remote=F.when(g("$.jobLocationType") == "TELECOMMUTE", "remote"),
    )


register(Adapter("jsonld", parse_json_ld, "pages with a JSON-LD JobPosting"))


def cards(pages: DataFrame, element: str, attributes: dict[str, str], skip: str | None = None) -> DataFrame:
    """Custom elements as rows of their attributes; those that bear the attribute skip are left out."""
    tag = pages.select("url", F.explode(F.regexp_extract_all("payload", F.lit(rf"<{element}\b[^>]*>"), F.lit(0))).alias("_tag"))
    if skip:
        tag = tag.filter(~F.col("_tag").rlike(rf'\s{skip}(="true"|[\s>])'))
    return tag.select("url", *[F.nullif(F.regexp_extract("_tag", rf'\s{a}="([^"]*)"', 1), F.lit("")).alias(c) for c, a in attributes.items()])


def closed_page(source: Column, html: Column, status: Column) -> Column:
    """open, closed, gone or unknown: the page check of liveness, from a fetch."""
    closed = F.when(source == "linkedin", html.rlike("(?i)closed-job|no longer accepting applications")).when(source == "indeed", F.contains(html, F.lit('"isJobExpired":true'))).otherwise(html.rlike("(?i)job(Err|Error)Msg|position has been filled|no longer available"))
    return F.when(status.isin(404, 410), "gone").when(status.isNull() | (status >= 400) | T.is_challenge(html) | html.isNull(), "unknown").when(F.coalesce(closed, F.lit(False)), "closed").otherwise("open")
