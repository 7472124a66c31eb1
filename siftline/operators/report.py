"""Snapshots, their text, exports and run statistics."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions import text as T
from siftline.operators import ordering, scoring

REVIEW_MOST, GATE_MOST, TOP = 300, 300, 30


def snapshot(report_id: int, postings: DataFrame, results: DataFrame, screen: DataFrame, rank: DataFrame, refine: DataFrame, min_score: int) -> DataFrame:
    """report_id, section, position, job_id, score: ranked (effective score), gate (screen score), review (cut before rows outside the window go)."""
    here = postings.select(F.col("id").alias("job_id"))
    alive = results.filter("status <> 'drop'").select("job_id")
    r = rank.join(alive, "job_id", "left_semi").select("job_id", F.col("score").alias("rank"), "created_at")
    f = refine.select("job_id", F.col("score").alias("refine"), F.coalesce("position", F.lit(1_000_000)).alias("at"))
    off = scoring.offset(rank.join(alive, "job_id", "left_semi"), refine, "job_id")
    ranked = r.join(f, "job_id", "left").join(F.broadcast(off)).join(here, "job_id", "left_semi")
    ranked = ranked.withColumn("score", scoring.effective(F.col("rank"), F.col("refine"), F.col("offset"))).withColumn("at", F.coalesce("at", F.lit(1_000_000)))
    gate = screen.filter(F.col("relevant") & (F.col("score") >= min_score)).join(alive, "job_id", "left_semi").join(rank.select("job_id"), "job_id", "left_anti").join(here, "job_id", "left_semi").select("job_id", "score")
    review = results.filter("status = 'review'").orderBy("job_id").limit(REVIEW_MOST).join(here, "job_id", "left_semi").select("job_id", F.lit(None).cast("int").alias("score"))
    parts = [("ranked", ranked, [F.desc("score"), F.col("at"), F.desc("rank"), F.col("created_at"), F.col("job_id")], None), ("prefilter", gate, [F.desc("score"), F.col("job_id")], GATE_MOST), ("review", review, [F.col("job_id")], None)]
    out = ordering.sections([(n, d.select("job_id", "score", *[c for c in d.columns if c not in ("job_id", "score")]), o, m) for n, d, o, m in parts], ["job_id", "score"])
    return out.select(F.lit(report_id).cast("bigint").alias("report_id"), "section", F.col("place").alias("position"), "job_id", "score")


def shortlist(rank: DataFrame, refine: DataFrame, results: DataFrame, exclude: DataFrame, top: int, first_pass: int) -> DataFrame:
    """Rank verdicts to hold refined: by effective score with all ties at the edge; the first pass is wider."""
    pool = rank.join(results.filter("status <> 'drop'").select("job_id"), "job_id", "left_semi").join(exclude.select("job_id"), "job_id", "left_anti").select("job_id", F.col("score").alias("rank"))
    f = refine.select("job_id", F.col("score").alias("refine"), F.coalesce("position", F.lit(1_000_000)).alias("at"))
    j = pool.join(f, "job_id", "left").join(F.broadcast(scoring.offset(rank, refine, "job_id")))
    j = j.withColumn("effective", scoring.effective(F.col("rank"), F.col("refine"), F.col("offset")))
    any_refined = j.filter("refine is not null").limit(1).count() > 0
    return ordering.top_with_ties(j, F.col("effective"), [F.coalesce("at", F.lit(1_000_000)), F.desc("rank"), F.col("job_id")], top if any_refined else first_pass)


def disagreements(rank: DataFrame, refine: DataFrame, off: DataFrame, least: int) -> DataFrame:
    """Postings whose two passes differ by at least so much on one scale."""
    j = rank.select("job_id", F.col("score").alias("rank")).join(refine.select("job_id", F.col("score").alias("refine")), "job_id").join(F.broadcast(off))
    j = j.withColumn("calibrated", scoring.calibrated(F.col("refine"), F.col("offset"))).withColumn("gap", F.col("rank") - F.col("calibrated"))
    return j.filter(F.abs("gap") >= least).orderBy(F.desc(F.abs("gap")), "job_id")


def funnel(results: DataFrame, screen: DataFrame, ranked: DataFrame, min_score: int) -> DataFrame:
    """One row: statuses, drops by category, screened and passed, ranked."""
    one = results.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("keep", "review", "drop")])
    drops = results.filter("status = 'drop'").groupBy(T.reason_category(F.coalesce(F.get("reasons", F.lit(0)), F.lit(""))).alias("c")).count()
    by = drops.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", "count")))).alias("drops"))  # a row a category
    s = screen.agg(F.count(F.lit(1)).alias("screened"), F.count_if(F.col("relevant") & (F.col("score") >= min_score)).alias("passed"))
    return one.join(F.broadcast(by)).join(F.broadcast(s)).join(F.broadcast(ranked.agg(F.count(F.lit(1)).alias("ranked"))))


def export(postings: DataFrame, results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """JSON lines of postings with their result and verdict; the raw payload stays out."""
    p = postings.select(F.col("id").alias("job_id"), F.struct(*[c for c in postings.columns if c != "raw"]).alias("job"))
    r = results.select("job_id", F.struct(*[c for c in results.columns if c != "job_id"]).alias("filter"))
    v = verdicts.select("job_id", F.struct(*[c for c in verdicts.columns if c != "job_id"]).alias("verdict"))
    return p.join(r, "job_id", "left").join(v, "job_id", "left").select(F.to_json(F.struct("job", "filter", "verdict")).alias("value"))


def markdown(title: str, items: DataFrame, postings: DataFrame, counts: dict[str, int]) -> str:
    """A report's text: a section a heading, an item a line. A report is a reader's page, so its rows come to the driver."""
    rows = items.join(postings.select(F.col("id").alias("job_id"), "title", "company", "url"), "job_id", "left").orderBy("section", "position").collect()
    out = [f"# {title}", "", ", ".join(f"{k} {v}" for k, v in counts.items())]
    for section in ("ranked", "prefilter", "review"):
        mine = [r for r in rows if r["section"] == section]
        out += ["", f"## {section} ({len(mine)})", ""] + [f"{r['position']}. [{r['title'] or r['job_id']}]({r['url'] or ''}), {r['company'] or 'unknown'}" + (f": {r['score']}" if r["score"] is not None else "") for r in mine]
    return "\n".join(out) + "\n"


def prepend_section(report: str, section: str) -> str:
    """A section put above the first heading of the second level."""
    m = re.search(r"^## ", report, re.M)
    at = m.start() if m else len(report)
    return report[:at] + section.rstrip("\n") + "\n\n" + report[at:]


def table(rows: DataFrame, columns: Sequence[str], order: Sequence[str]) -> str:
    """Markdown table of a small frame, newest first as ordered."""
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in columns) + " |" for r in rows.orderBy(*order).collect()])


def closes(days: Column) -> Column:
    """'closes today', 'closes tomorrow' or 'closes in n days'."""
    return F.when(days == 0, "closes today").when(days == 1, "closes tomorrow").otherwise(F.format_string("closes in %d days", days))


def posted_line(posted: Column, first_seen: Column, now: Column) -> Column:
    """Age of a posting, with 'reposted' a week after it was first seen and 'long open' after three weeks."""
    age, known = F.date_diff(now, posted), F.date_diff(now, first_seen)
    return F.concat(F.format_string("posted %d days ago", age), F.when(F.date_diff(posted, first_seen) > 7, ", reposted").otherwise(""), F.when(known >= 21, ", long open").otherwise(""))



def sentinel_summary(samples: DataFrame, screened: DataFrame, ranked: DataFrame, min_score: int, least_rank: int) -> DataFrame:
    """For each gate: sampled, screened, passed (false drops) and finds (passed and ranked well). samples: id, gate."""
    s = screened.select(F.col("job_id").alias("id"), (F.col("relevant") & (F.col("score") >= min_score)).alias("_p"))
    r = ranked.select(F.col("job_id").alias("id"), F.col("score").alias("_r"))
    j = samples.join(s, "id", "left").join(r, "id", "left")
    return j.groupBy("gate").agg(F.count(F.lit(1)).alias("sampled"), F.count("_p").alias("screened"), F.count_if("_p").alias("passed"), F.count_if(F.col("_p") & (F.col("_r") >= least_rank)).alias("finds"))
