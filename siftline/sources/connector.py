"""Sources: a registry of adapters, a Python data source of fetch units, record isolation, payload parsing.

A source is a list of fetch units (site, query, page) and a parser of payloads. Fetching is one data source whose
partitions are the units and whose rows are url, status, payload and error; parsing is a DataFrame step over the
payload column, so it can be tested on recorded payloads and rerun without fetching.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from siftline.functions import text as T

POSTING = (
    "source string, source_id string, url string, title string, company string, description string, location_raw string, country string, city string, remote string, remote_region string, "
    "seniority_raw string, employment_type string, posting_language string, salary_text string, tags array<string>, posted_at timestamp"
)


@dataclass(frozen=True)
class Adapter:
    """name; parse: payload rows to postings; complete_listing: whether absence means taken down; needs_browser: whether plain requests fail."""

    name: str
    parse: Callable[[DataFrame], DataFrame]
    description: str = ""
    complete_listing: bool = False
    needs_browser: bool = False


_ADAPTERS: dict[str, Adapter] = {}


def register(adapter: Adapter) -> Adapter:
    _ADAPTERS[adapter.name] = adapter
    return adapter


def all_adapters() -> dict[str, Adapter]:
    from siftline.sources import feeds  # noqa: F401  registers its adapters

    return dict(sorted(_ADAPTERS.items()))


def adapter(name: str) -> Adapter:
    known = all_adapters()
    if name not in known:
        raise KeyError(f"unknown source {name!r}; known: {', '.join(known)}")
    return known[name]


def adapters_table(spark: SparkSession) -> DataFrame:
    rows = [(a.name, a.description, a.complete_listing, a.needs_browser) for a in all_adapters().values()]
    return spark.createDataFrame(rows, "name string, description string, complete_listing boolean, needs_browser boolean")


def host_of(url: str) -> str:
    return url.split("://", 1)[-1].split("/", 1)[0].split("?", 1)[0].lower()


class _Host(InputPartition):
    """A host's urls, in their order: no other task reads from it."""

    def __init__(self, urls: list[str]):
        self.urls = urls


class FetchSource(DataSource):
    """spark.read.format("fetch").option("urls", JSON list): one partition a host, whose urls are read one after the other.

    Options: root (files instead of a network), cache, delay (seconds between two reads of a host, also between attempts), retries, log (a folder in
    which a file a host tells when it was read). A host's rate is what limits a fetch, so hosts are the tasks; filters on the url, by equality or list, are pushed down.
    """

    @classmethod
    def name(cls) -> str:
        return "fetch"

    def schema(self) -> str:
        return "url string, status int, payload string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _FetchReader(self.options)


class _FetchReader(DataSourceReader):
    def __init__(self, options):
        self.urls = json.loads(options.get("urls", "[]"))
        self.root, self.cache = options.get("root"), options.get("cache")
        self.delay, self.retries, self.only = float(options.get("delay", 0)), int(options.get("retries", 2)), None
        self.log, self.read_at = options.get("log"), None

    def pushFilters(self, filters):
        """A filter on the url decides which units are fetched at all."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("url",):
                self.only = wanted if self.only is None else self.only & wanted
            else:
                yield f

    def partitions(self):
        hosts: dict[str, list[str]] = {}
        for u in self.urls:
            if self.only is None or u in self.only:
                hosts.setdefault(host_of(u), []).append(u)
        return [_Host(urls) for urls in hosts.values()]

    def read(self, partition) -> Iterator[tuple]:
        for url in partition.urls:
            yield from self._one(url)

    def _wait(self, url: str) -> None:
        """Until the host may be read again."""
        now = time.monotonic()
        if self.read_at is not None and self.read_at + self.delay > now:
            time.sleep(self.read_at + self.delay - now)
        self.read_at = time.monotonic()
        if self.log:
            with open(os.path.join(self.log, hashlib.sha1(host_of(url).encode()).hexdigest()), "a", encoding="utf-8") as f:
                f.write(f"{host_of(url)} {time.time()} {url}\n")

    def _one(self, url: str) -> Iterator[tuple]:
        kept = self.cache and os.path.join(self.cache, hashlib.sha1(url.encode()).hexdigest())
        if kept and os.path.exists(kept):
            with open(kept, encoding="utf-8") as f:
                yield (url, 200, f.read(), None)
            return
        if self.root:
            self._wait(url)
            try:
                with open(os.path.join(self.root, url.split("://", 1)[-1].replace("/", "_")), encoding="utf-8") as f:
                    yield (url, 200, f.read(), None)
            except OSError as e:
                yield (url, None, None, str(e))
            return
        status, payload, error = self._get(url)
        if kept and payload is not None:
            with open(kept, "w", encoding="utf-8") as f:
                f.write(payload)
        yield (url, status, payload, error)

    def _get(self, url: str):
        for turn in range(self.retries + 1):
            self._wait(url)
            try:
                with urllib.request.urlopen(url, timeout=30) as r:
                    return r.status, decoded(r.read()), None
            except urllib.error.HTTPError as e:
                if e.code != 429 and e.code < 500 or turn == self.retries:
                    return e.code, None, str(e)
                time.sleep(float(e.headers.get("Retry-After") or 2**turn))
            except OSError as e:
                if turn == self.retries:
                    return None, None, str(e)
        return None, None, "no attempt"


def decoded(body: bytes) -> str:
    """UTF-8, else the Western single-byte code page with replacements."""
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        return body.decode("windows-1252", "replace")


def fetch(spark: SparkSession, urls: list[str], **options: str) -> DataFrame:
    spark.dataSource.register(FetchSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("fetch").option("urls", json.dumps(urls)).options(**options).load()


def path(value: Column, where: str, kind: str = "string") -> Column:
    """A field of a variant, null where it is absent or of another kind."""
    return F.try_variant_get(value, where, kind)


def records(payloads: DataFrame, where: str = "$") -> DataFrame:
    """page_url, pos, record (variant): the array at a path of each payload, a row an element. Payloads that are no JSON give none."""
    v = payloads.select("url", F.try_parse_json("payload").alias("v")).select("url", F.try_variant_get("v", where, "variant").alias("v")).filter("v is not null")
    each = v.lateralJoin(payloads.sparkSession.tvf.variant_explode(F.col("v").outer()))
    return each.select(F.col("url").alias("page_url"), "pos", F.col("value").alias("record"))


def postings(rows: DataFrame, source: str, _order: Column | None = None, **fields: Column) -> DataFrame:
    """rows as postings: named fields, the others null; texts cleaned; rows without id or title left out. _order: kept as a column, to tell copies apart."""
    out = [] if _order is None else [_order.alias("_order")]
    for part in POSTING.split(", "):
        name, kind = part.split(" ")
        value = F.lit(source) if name == "source" else fields.get(name, F.lit(None))
        value = value.cast(kind)
        out.append((T.clean(value) if kind == "string" and name in ("title", "company", "description", "location_raw") else value).alias(name))
    df = rows.select(*out).withColumn("remote", F.coalesce("remote", F.lit("unknown")))
    return df.filter("source_id is not null and title is not null").withColumn("id", T.record_id(F.col("source"), F.col("source_id")))


def split_bad(rows: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows): a bad record goes aside and stops nothing."""
    good = F.coalesce(ok, F.lit(False))
    return rows.filter(good), rows.filter(~good)


def hydrate(light: DataFrame, detail: DataFrame, key: str, columns: list[str], keep_unknown: str | None = "remote") -> DataFrame:
    """light with every non-empty field of detail over it; an unknown never wins."""
    d = detail.select(key, *[F.nullif(F.col(c), F.lit("")).alias(f"_d_{c}") for c in columns])
    if keep_unknown in columns:
        d = d.withColumn(f"_d_{keep_unknown}", F.nullif(f"_d_{keep_unknown}", F.lit("unknown")))
    return light.join(d, key, "left").select(*[F.coalesce(f"_d_{c}", c).alias(c) if c in columns else F.col(c) for c in light.columns])


def read_labels(spark: SparkSession, where: str, schema: str) -> DataFrame:
    """JSON lines; blank and broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(where)


def read_boards(spark: SparkSession, where: str, name: str) -> DataFrame:
    """A CSV list, one row for each normalised name: the first by file order of the name wins."""
    df = spark.read.option("header", True).csv(where)
    return df.withColumn("board_key", F.regexp_replace(F.lower(name), "[^a-z0-9]", "")).groupBy("board_key").agg(F.min_by(F.struct(*df.columns), F.col(name)).alias("r")).select("board_key", "r.*")
