"""Typed tables of a run, kept as versions in any store that Spark reaches; snapshots are manifests, never copies.

A run is a folder of numbered manifests; a manifest names the data folder of each table. A write puts the new rows into
a fresh folder first and a new manifest last, so a reader sees a whole state or the one before, and a failed write
leaves nothing visible. A new run begins with the newest run's manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.operators import state

SCHEMAS = {
    "postings": "id string, source string, source_id string, url string, title string, company string, description string, location_raw string, country string, city string, remote string, remote_region string, seniority_raw string, employment_type string, posting_language string, salary_text string, tags array<string>, posted_at timestamp, raw string, first_seen timestamp, last_seen timestamp, last_run_id bigint, missed_runs int",
    "filter_results": "job_id string, status string, reasons array<string>, location_tier int, rules_version string, updated_at timestamp",
    "verdicts": "job_id string, stage string, model string, prompt_version string, profile_hash string, relevant boolean, score int, summary string, position int, criteria map<string,int>, created_at timestamp, usage struct<input:bigint,output:bigint,cache_read:bigint,cache_write:bigint,batch:boolean>",
    "facets": "job_id string, facets_version string, posting_language string, languages_required array<string>, languages_optional array<string>, stacks array<string>, web_dev boolean, evergreen boolean",
    "decisions": "job_id string, user string, status string, note string, reasons array<string>, updated_at timestamp",
    "runs": "id bigint, started_at timestamp, source string, fetched bigint, new bigint, error string",
    "run_notes": "id bigint, created_at timestamp, stage string, kind string, source string, job_id string, message string, data string",
    "liveness_checks": "id bigint, job_id string, checked_at timestamp, status string, reason string, http_status int",
    "reports": "id bigint, created_at timestamp, days int, prompt_version string, counts map<string,bigint>, path string, refine_offset double",
    "report_items": "report_id bigint, job_id string, section string, position int, score int",
    "batches": "id string, stage string, model string, prompt_version string, created_at timestamp, status string, job_ids array<string>",
    "tailorings": "job_id string, cache_key string, model string, created_at timestamp, data string",
}
KEYS = {
    "postings": ["id"], "filter_results": ["job_id"], "verdicts": ["job_id", "stage", "model", "prompt_version"], "facets": ["job_id"], "decisions": ["job_id", "user"], "batches": ["id"], "tailorings": ["job_id", "cache_key"], "reports": ["id"],
    "report_items": ["report_id", "job_id"],
}


class Tables:
    def __init__(self, spark: SparkSession, root: str, run: str | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.run = run or (self.runs() or [None])[-1]

    # -------------------------------------------------------------- runs
    def _children(self, where: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def runs(self) -> list[str]:
        """Names of the runs, oldest first: their names order them."""
        return self._children(f"{self.root}/runs")

    def new_run(self, fresh: bool = False, now: datetime | None = None) -> str:
        """A new run that begins with the newest one's tables, or with none."""
        before = {} if fresh or not self.runs() else Tables(self.spark, self.root).manifest()
        self.run = (now or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%S.%f")
        self._publish(before)
        return self.run

    def manifest(self) -> dict[str, str]:
        where = f"{self.root}/runs/{self.run}"
        done = [m for m in self._children(where) if "_SUCCESS" in self._children(f"{where}/{m}")]
        return json.loads(self.spark.read.text(f"{where}/{done[-1]}").first()[0]) if done else {}

    def _publish(self, tables: dict[str, str]) -> None:
        n = len(self._children(f"{self.root}/runs/{self.run}"))
        self.spark.createDataFrame([(json.dumps(tables),)], "value string").coalesce(1).write.text(f"{self.root}/runs/{self.run}/m={n:08d}")

    def publish(self, target: str) -> None:
        """The run's tables as they are, in a serving folder of their own."""
        other = Tables(self.spark, target)
        other.new_run(fresh=True)
        for name, where in self.manifest().items():
            other.write(name, self.spark.read.parquet(where))

    # -------------------------------------------------------------- tables
    def read(self, name: str) -> DataFrame:
        """A table, empty where it was never written; a column that an old file lacks is null."""
        where = self.manifest().get(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(where) if where else self.spark.createDataFrame([], SCHEMAS[name])

    def write(self, name: str, rows: DataFrame) -> None:
        where = f"{self.root}/data/{name}/{uuid.uuid4().hex}"
        schema = self.spark.createDataFrame([], SCHEMAS[name]).schema
        rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(where)
        self._publish(self.manifest() | {name: where})

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows added; with an id column and none given, ids go on from the greatest."""
        old = self.read(name)
        if "id" in old.columns and "id" not in rows.columns:
            start = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            # log rows are few: one batch of notes, checks or runs at a time
            rows = rows.coalesce(1).withColumn("id", F.monotonically_increasing_id() + start + 1)
        self.write(name, old.unionByName(rows.select(*[c for c in old.columns if c in rows.columns]), allowMissingColumns=True))

    def replace(self, name: str, rows: DataFrame) -> None:
        """Rows in place of those of the same key."""
        self.write(name, state.replace_by_key(self.read(name), rows.select(*self.read(name).columns), KEYS[name]))

    def delete(self, name: str, gone: DataFrame, keys: Sequence[str], stage: str | None = None) -> int:
        """Rows of the keys deleted (of one stage only, if given); how many there were."""
        old = self.read(name)
        left = state.delete_by_key(old, gone, keys, ("stage", stage) if stage else None)
        n = old.count() - left.count()
        self.write(name, left)
        return n

    # -------------------------------------------------------------- operators of single tables
    def upsert_postings(self, rows: DataFrame, now: datetime, run_id: int | None = None) -> int:
        """New postings added, known ones updated in last_seen, text, title and url (and run and misses for a real run); the number of new ones."""
        old = self.read("postings")
        n = rows.select("id", *[F.col(c).alias(f"_n_{c}") for c in rows.columns if c != "id"]).withColumn("_new", F.lit(True))
        j = old.withColumn("_old", F.lit(True)).join(n, "id", "full_outer")
        fresh, hit, stamp = F.col("_old").isNull(), F.col("_new").isNotNull(), F.lit(now).cast("timestamp")

        def value(c: str):
            if c == "first_seen":
                return F.when(fresh, stamp).otherwise(F.col(c))
            if c == "last_seen":
                return F.when(hit, stamp).otherwise(F.col(c))
            if c == "last_run_id":
                return F.when(hit & F.lit(run_id is not None), F.lit(run_id)).otherwise(F.col(c))
            if c == "missed_runs":
                return F.when(fresh | (hit & F.lit(run_id is not None)), 0).otherwise(F.col(c))
            if f"_n_{c}" not in n.columns:
                return F.col(c)
            return F.when(fresh, F.col(f"_n_{c}")).when(hit & F.lit(c in ("title", "url", "description", "raw")), F.coalesce(f"_n_{c}", c)).otherwise(F.col(c))

        merged = j.select(*[F.col("id") if c == "id" else value(c).alias(c) for c in old.columns])
        before = old.count()
        self.write("postings", merged)
        return self.read("postings").count() - before

    def mark_missing(self, source: str, run_id: int) -> None:
        self.write("postings", state.mark_missing(self.read("postings"), source, run_id))

    def verdicts(self, stage: str, versions: Sequence[str] | None = None, profile_hash: str | None = None) -> DataFrame:
        """The latest verdict of each posting, of some prompt versions and one profile if given."""
        v = self.read("verdicts").filter(F.col("stage") == stage)
        if versions:
            v = v.filter(F.col("prompt_version").isin(*versions))
        if profile_hash is not None:
            v = v.filter((F.col("profile_hash") == profile_hash) & F.lit(profile_hash != ""))
        return state.latest(v, ["job_id"], ["created_at", "model"])

    def save_report(self, header: DataFrame, items: DataFrame) -> None:
        """Items first, the header last: a report that is listed is whole. Of an item in two sections the last one stays."""
        last = items.groupBy("report_id", "job_id").agg(F.max_by(F.struct(*items.columns), F.struct("section", "position")).alias("r")).select("r.*")
        self.replace("report_items", last)
        self.replace("reports", header)

    def report_before(self, report_id: int) -> DataFrame:
        return self.read("reports").filter(F.col("id") < report_id).orderBy(F.desc("id")).limit(1)

    def pending_batches(self, stage: str | None = None) -> DataFrame:
        b = self.read("batches").filter("status = 'submitted'")
        return (b.filter(F.col("stage") == stage) if stage else b).orderBy("created_at", "id")

    def finish_batch(self, batch_id: str, status: str = "done") -> None:
        b = self.read("batches")
        self.write("batches", b.withColumn("status", F.when(F.col("id") == batch_id, status).otherwise(F.col("status"))))

    def tailoring(self, job_id: str, key: str, prefix: bool = False) -> DataFrame:
        """The stored answer of a key, or the newest whose key begins so."""
        t = self.read("tailorings").filter(F.col("job_id") == job_id)
        if not prefix:
            return t.filter(F.col("cache_key") == key)
        return state.latest(t.filter(F.startswith(F.col("cache_key"), F.lit(key))), ["job_id"], ["created_at", "cache_key"])

    def liveness(self) -> DataFrame:
        return state.latest_conclusive(self.read("liveness_checks"), ["job_id"], ["checked_at", "id"], "status", ["unknown"])

    def stats(self) -> DataFrame:
        """what, value, n: postings by source, results by status, verdicts by stage, decisions by status, reports."""
        parts = [("source", "postings", "source"), ("status", "filter_results", "status"), ("stage", "verdicts", "stage"), ("decision", "decisions", "status")]
        out = self.read("reports").agg(F.count(F.lit(1)).alias("n")).select(F.lit("reports").alias("what"), F.lit(None).cast("string").alias("value"), "n")
        for what, table, column in parts:
            out = out.unionByName(self.read(table).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "value", "n"))
        return out
