"""Countries and remote regions of location texts, as columns."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession, functions as F

from siftline.functions import vocabulary as V

_SPACE = r"^\s+|\s+$"


@lru_cache(maxsize=1)
def iso_codes() -> tuple[dict[str, str], dict[str, str]]:
    """(lower-case two-letter code to code, three-letter code to two-letter code), as the JVM has them."""
    Locale = SparkSession.active()._jvm.java.util.Locale
    codes = [c for c in Locale.getISOCountries() if c not in V.RETIRED_CODES]
    return {c.lower(): c for c in codes} | V.CODE_ALIASES, {Locale("", c).getISO3Country(): c for c in codes}


def _looked_up(table: dict[str, str], key: Column) -> Column:
    """Value of the key, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), 0)


def _parts(text: Column, mark: str) -> Column:
    return F.filter(F.transform(F.split(text, mark), lambda x: F.regexp_replace(x, _SPACE, "")), lambda x: x != "")


def _named(text: Column, table: dict[str, str]) -> Column:
    """Country of the longest name of a table that stands as whole words in a lower-cased text."""
    names = "|".join("".join(c if c.isalnum() or c == " " else "\\" + c for c in n) for n in sorted(table, key=len, reverse=True))
    hits = F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{N}}_])({names})(?![\p{{L}}\p{{N}}_])"), F.lit(1))
    return _looked_up(table, F.array_max(F.transform(hits, lambda x: F.struct(F.length(x).alias("n"), x.alias("name"))))["name"])


def _by_name(segment: Column) -> Column:
    """A code in capitals that closes three parts or more and is no state, a bare code, or a name of a country or state."""
    iso2, iso3 = iso_codes()
    parts = _parts(segment, ",")
    last = F.get(parts, F.size(parts) - 1)
    closes = (F.size(parts) >= 3) & (F.upper(last) == last) & (F.lower(last) != last) & ~F.lower(last).isin(*V.US_STATES, *V.CA_PROVINCES)
    bare = F.when(F.length(segment) == 2, _looked_up(iso2, F.lower(segment)))
    return F.coalesce(F.when(closes, F.coalesce(_looked_up(iso3, last), _looked_up(iso2, F.lower(last)))), bare, _named(F.lower(segment), V.COUNTRIES | V.US_STATE_NAMES))


def _by_code(segment: Column) -> Column:
    """Codes between commas: of three parts or more the last country code decides; of two, a known city that is no namesake, then the second; else any part in turn."""
    iso2, iso3 = iso_codes()
    codes = iso2 | {c: "CA" for c in V.CA_PROVINCES} | {c: "US" for c in V.US_STATES} | V.STATE_CODES_OF_COUNTRIES
    parts = _parts(segment, ",")
    low, n = F.transform(parts, F.lower), F.size(parts)
    city = F.get(low, 0)
    later = F.slice(low, F.when(n == 2, 2).otherwise(1), F.greatest(n, F.lit(1)))
    return F.coalesce(
        F.when(n >= 3, _looked_up(iso2, F.get(low, n - 1))),
        F.when((n == 2) & ~city.isin(*V.US_NAMESAKES), _looked_up(V.CITIES, city)),
        _first(F.transform(later, lambda x: F.when(F.length(x) == 2, _looked_up(codes, x)))),
        _first(F.transform(parts, lambda x: _looked_up(iso3, x))),
    )


def guess_country(*texts: Column) -> Column:
    """Two-letter country of location texts (several in one text stand between bars): names in any of them come before codes, codes before cities."""
    segments = F.flatten(F.array(*[_parts(F.coalesce(t, F.lit("")), r"\|") for t in texts]))
    return F.coalesce(*[_first(F.transform(segments, rule)) for rule in (_by_name, _by_code, lambda s: _named(F.lower(s), V.CITIES))])


def remote_region(text: Column) -> Column:
    """us_only, europe, worldwide, country_only:CC or unknown; the wider wording comes first."""
    one = guess_country(F.regexp_extract(text, V.REMOTE_ONE, 1))
    out = F.when(text.rlike(V.REMOTE_US), "us_only").when(text.rlike(V.REMOTE_EU), "europe").when(text.rlike(V.REMOTE_WORLD), "worldwide")
    return out.when(text.rlike(V.REMOTE_ONE), F.coalesce(F.concat(F.lit("country_only:"), one), F.lit("unknown"))).otherwise("unknown")
