"""The batch jobs over a run's tables: ingest, filter, screen, rank, report, check pages; and a command line for them."""

from __future__ import annotations

import argparse
import json
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.functions import language as L, text as T, vocabulary as V
from siftline.operators import dedupe as D, facets as C, ordering as O, report as P, rules as R, scorer as X, state as K
from siftline.operators.tables import Tables
from siftline.sources import connector, feeds


def ingest(t: Tables, source: str, payloads: DataFrame, now: datetime, limited: bool = False) -> dict:
    """Book one source's fetch: an error is a note; else postings are merged, the run is closed, health is checked, and
    absences count only for a complete, unlimited, non-empty fetch without a sudden drop."""
    adapter = connector.adapter(source)
    run_id = (t.read("runs").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]) + 1
    failed = payloads.filter("payload is null").count()
    if failed and failed == payloads.count():
        close(t, run_id, source, now, 0, 0, "all fetches failed")
        note(t, now, "scrape", "source_error", "all fetches failed", source)
        return {"run": run_id, "error": True}
    rows = adapter.parse(payloads.filter("payload is not null"))
    fetched = rows.count()
    before = K.last_good_run(t.read("runs"), flagged(t, source), run_id).filter(F.col("source") == source).first()
    new = t.upsert_postings(rows, now, run_id)
    close(t, run_id, source, now, fetched, new, None)
    dropped = before is not None and before["fetched"] >= V.DROP_LEAST and fetched < before["fetched"] * V.DROP_RATIO
    if dropped:
        note(t, now, "scrape", "source_count_drop", f"fetched {fetched}, the previous complete run fetched {before['fetched']}", source, json.dumps({"run_id": run_id, "fetched": fetched, "previous": before["fetched"]}))
    if K.thin_descriptions(rows, "source", "description", V.SHORT_DESCRIPTION, V.THIN_SHARE, V.THIN_LEAST).count():
        note(t, now, "scrape", "empty_descriptions", "many postings came without a description", source)
    if adapter.complete_listing and not limited and fetched and not dropped:
        t.mark_missing(source, run_id)
    elif dropped:
        note(t, now, "scrape", "takedown_skipped", "no posting was counted as taken down", source)
    return {"run": run_id, "fetched": fetched, "new": new, "dropped": dropped}


def close(t: Tables, run_id: int, source: str, now: datetime, fetched: int, new: int, error: str | None) -> None:
    row = t.spark.createDataFrame([(run_id, now, source, fetched, new, error)], t.read("runs").schema)
    t.write("runs", t.read("runs").unionByName(row))


def note(t: Tables, now: datetime, stage: str, kind: str, message: str, source: str | None = None, data: str | None = None) -> None:
    t.append("run_notes", t.spark.createDataFrame([(now, stage, kind, source, None, message, data)], "created_at timestamp, stage string, kind string, source string, job_id string, message string, data string"))


def flagged(t: Tables, source: str) -> DataFrame:
    n = t.read("run_notes").filter((F.col("kind") == "source_count_drop") & (F.col("source") == source))
    return n.select(F.get_json_object("data", "$.run_id").cast("bigint").alias("run_id")).filter("run_id is not null")


def filter_postings(t: Tables, profile: R.Profile, now: datetime, days: int = 30, aliases: DataFrame | None = None) -> DataFrame:
    """Dedupe, rules and facets of the postings seen in the window; losers are drops of their own. Returns drop counts."""
    jobs = K.scan(t.read("postings"), since=("last_seen", F.lit(now - timedelta(days=days)).cast("timestamp")))
    jobs = jobs.withColumn("posting_language", F.coalesce("posting_language", L.detect(F.coalesce("description", "title"))["lang"]))
    where = D.tier(F.col("country"), F.col("remote"), [list(x) for x in profile.tiers], True)
    groups = D.dedupe(jobs, location=where, aliases=aliases).select("id", "kept", "kept_id")
    kept = jobs.join(groups.filter("kept"), "id", "left_semi")
    live = t.liveness().select(F.col("job_id").alias("id"), F.col("status").alias("live_status"), F.col("reason").alias("live_reason"), F.to_date("checked_at").cast("string").alias("live_day"))
    need = R.language_requirements(kept.select("id", F.concat_ws("\n", "title", "description").alias("text")), "id", "text")
    results = R.evaluate(kept, profile, now.date(), need, live).select(F.col("id").alias("job_id"), "status", "reasons", "location_tier")
    losers = groups.filter("not kept").select(F.col("id").alias("job_id"), F.lit("drop").alias("status"), F.array(F.concat(F.lit("duplicate of "), "kept_id")).alias("reasons"), F.lit(None).cast("int").alias("location_tier"))
    t.replace("filter_results", results.unionByName(losers).withColumn("rules_version", F.lit("1")).withColumn("updated_at", F.lit(now).cast("timestamp")))
    f = C.facets(kept.join(need, "id", "left"), F.concat_ws("\n", "title", "description"), F.col("posting_language"), F.col("required"), F.col("optional"))
    cue = T.evergreen(F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))).isNotNull()
    t.replace("facets", f.select(F.col("id").alias("job_id"), F.lit("1").alias("facets_version"), "posting_language", "languages_required", "languages_optional", "stacks", "web_dev", cue.alias("evergreen")))
    return R.drop_counts(t.read("filter_results"))


def score_stage(t: Tables, stage: str, scorer: X.Scorer, now: datetime, profile_hash: str = "") -> int:
    """Verdicts of the living postings that have none yet: all for the screen, the gate's survivors for later stages."""
    alive = t.read("filter_results").filter("status <> 'drop'").select(F.col("job_id").alias("id"))
    jobs = t.read("postings").join(alive, "id", "left_semi")
    if stage != "prefilter":
        passed = t.verdicts("prefilter").filter("relevant and score >= 30").select(F.col("job_id").alias("id"))
        jobs = jobs.join(passed, "id", "left_semi")
    todo = X.prompts(jobs, ["title", "company", "location_raw", "description"], "id").withColumnRenamed("id", "job_id")
    out = X.run_stage(todo, scorer, stage, t.read("verdicts")).withColumn("created_at", F.lit(now).cast("timestamp")).withColumn("profile_hash", F.lit(profile_hash))
    before = t.read("verdicts")
    t.write("verdicts", before.unionByName(out, allowMissingColumns=True))
    return t.read("verdicts").count() - before.count()


def make_report(t: Tables, now: datetime, days: int = 30, min_score: int = 30) -> tuple[int, str, DataFrame]:
    """A snapshot of the run: (its number, its text, its difference from the one before)."""
    results, postings = t.read("filter_results"), t.read("postings")
    number = (t.read("reports").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]) + 1
    items = P.snapshot(number, postings, results, t.verdicts("prefilter"), t.verdicts("rank"), t.verdicts("refine"), min_score)
    counts = {r["status"]: r["count"] for r in results.groupBy("status").count().collect()}
    header = t.spark.createDataFrame([(number, now, days, counts)], "id bigint, created_at timestamp, days int, counts map<string,bigint>")
    for c in ("prompt_version", "path"):
        header = header.withColumn(c, F.lit(None).cast("string"))
    t.save_report(header.withColumn("refine_offset", F.lit(0.0)), items)
    kept = t.read("report_items")
    last = t.report_before(number).first()
    mine = lambda n: kept.filter((F.col("report_id") == n) & (F.col("section") == "ranked")).select("job_id", "score")
    return number, P.markdown(f"Report {number}", kept.filter(F.col("report_id") == number), postings, counts), O.diff(mine(number), mine(last["id"] if last else -1), "job_id", "score")


def check_pages(t: Tables, pages: DataFrame, now: datetime) -> None:
    """Append page checks. pages: job_id, source, payload, status."""
    state = feeds.closed_page(F.col("source"), F.col("payload"), F.col("status"))
    t.append("liveness_checks", pages.select("job_id", F.lit(now).cast("timestamp").alias("checked_at"), state.alias("status"), F.coalesce(F.col("status").cast("string"), F.lit("no answer")).alias("reason"), F.col("status").alias("http_status")))


def list_jobs(t: Tables, report_id: int, start: int = 0, n: int = 50, **conditions) -> DataFrame:
    """A page of a report's postings under facet conditions: the filter stands below the joins' output, the page is a top-k."""
    items = t.read("report_items").filter(F.col("report_id") == report_id)
    p = t.read("postings").withColumnRenamed("id", "job_id").select("job_id", "source", "title", "company", "country", "remote")
    decided = K.latest(t.read("decisions"), ["job_id"], ["updated_at", "user"]).select("job_id", F.col("status").alias("decision"))
    j = items.join(p, "job_id").join(t.read("facets"), "job_id", "left").join(decided, "job_id", "left")
    return O.page(j.filter(C.matches(null_as={"decision": "none"}, **conditions)), [F.col("section"), F.col("position"), F.col("job_id")], start, n)


def main(argv: list[str] | None = None) -> None:
    from siftline.session import session

    a = argparse.ArgumentParser(prog="siftline")
    a.add_argument("root", help="folder of the tables")
    a.add_argument("job", choices=["runs", "stats", "sources", "filter", "report", "publish"])
    a.add_argument("--target")
    o = a.parse_args(argv)
    spark: SparkSession = session("siftline")
    t, now = Tables(spark, o.root), datetime.now()
    if o.job == "runs":
        print("\n".join(t.runs()))
    elif o.job == "stats":
        t.stats().orderBy("what", "value").show(200, False)
    elif o.job == "sources":
        connector.adapters_table(spark).show(200, False)
    elif o.job == "filter":
        filter_postings(t, R.Profile(), now).show(20, False)
    elif o.job == "report":
        print(make_report(t, now)[1])
    elif o.job == "publish":
        t.publish(o.target)


if __name__ == "__main__":
    main()
