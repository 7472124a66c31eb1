import json
from datetime import datetime

from pyspark.sql import functions as F

from siftline.operators import report as P, rules as R, scorer as X
from siftline.operators.tables import Tables
from siftline.plans import jobs as J

NOW = datetime(2026, 9, 1, 12)
PROFILE = R.Profile(title_terms=("develop",), tiers=(("DE", "FI"), (), ()))


def payload(spark, *jobs):
    return spark.createDataFrame([("u", json.dumps({"data": list(jobs)}))], "url string, payload string")


def post(i, title="Developer", company="Acme", text="We develop software for people who develop software, and more of the same.", **k):
    return {"slug": i, "title": title, "company_name": company, "description": text, "location": "Berlin, Germany", "created_at": 1787000000, "url": f"http://j/{i}"} | k


def test_whole_run(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "db"))
    t.new_run(now=NOW)
    first = J.ingest(t, "paged", payload(spark, post("1"), post("2", company="Acme GmbH"), post("3", "Cook", text="We cook good food every day, for guests from near and far away, and more of the same."), post("4", company="Other", text="develop " * 12)), NOW)
    assert (first["fetched"], first["new"]) == (4, 4)
    again = J.ingest(t, "paged", payload(spark, post("1", title="Developer (new)"), post("2"), post("4", company="Other")), NOW)
    assert again["new"] == 0 and {r.source_id: r.missed_runs for r in t.read("postings").collect()} == {"1": 0, "2": 0, "3": 1, "4": 0}
    drops = {r.reason: r["count"] for r in J.filter_postings(t, PROFILE, NOW).collect()}
    assert drops["title not a software/IT role"] == 1
    status = {r.job_id: r.status for r in t.read("filter_results").collect()}
    assert sorted(status.values()).count("drop") >= 1 and len(status) == 4
    scorer = X.LexicalScorer(["develop"])
    assert J.score_stage(t, "prefilter", scorer, NOW) == sum(s != "drop" for s in status.values())
    assert J.score_stage(t, "prefilter", scorer, NOW) == 0
    J.score_stage(t, "rank", scorer, NOW)
    number, text, change = J.make_report(t, NOW)
    assert number == 1 and "## ranked" in text and {r.change for r in change.collect()} <= {"new"}
    _, _, change = J.make_report(t, NOW)
    assert change.count() == 0
    page = J.list_jobs(t, 1, equal={"decision": ["none"], "country": ["DE"]}).collect()
    assert page and page[0].total == len(page)
    assert {(r.what, r.n) for r in t.stats().collect()} >= {("reports", 2), ("source", 4)}
    lines = P.export(t.read("postings"), t.read("filter_results"), t.verdicts("prefilter")).collect()
    assert len(lines) == 4 and "raw" not in json.loads(lines[0].value)["job"]
    funnel = P.funnel(t.read("filter_results"), t.verdicts("prefilter"), t.verdicts("rank"), 30).first()
    assert funnel.keep + funnel.review + funnel["drop"] == 4

    # A page check closes a posting; an inconclusive one changes nothing; the next run begins where this one ended.
    job = t.read("filter_results").filter("status <> 'drop'").first().job_id
    J.check_pages(t, spark.createDataFrame([(job, "x", None, 404)], "job_id string, source string, payload string, status int"), NOW)
    J.check_pages(t, spark.createDataFrame([(job, "x", None, 503)], "job_id string, source string, payload string, status int"), NOW)
    J.filter_postings(t, PROFILE, NOW)
    assert t.read("filter_results").filter(F.col("job_id") == job).first().reasons[0].startswith("posting gone")
    old, run = t.run, t.new_run(now=datetime(2026, 9, 2))
    assert t.runs() == [old, run] and t.read("postings").count() == 4
    t.write("postings", t.read("postings").limit(1))
    assert Tables(spark, t.root, old).read("postings").count() == 4
    t.publish(str(tmp_path / "serve"))
    assert Tables(spark, str(tmp_path / "serve")).read("postings").count() == 1


def test_failed_and_shrunk_fetches(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "db"))
    t.new_run(now=NOW)
    J.ingest(t, "paged", payload(spark, *[post(str(i)) for i in range(30)]), NOW)
    assert J.ingest(t, "paged", spark.createDataFrame([("u", None)], "url string, payload string"), NOW)["error"]
    shrunk = J.ingest(t, "paged", payload(spark, *[post(str(i)) for i in range(5)]), NOW)
    assert shrunk["dropped"] and t.read("postings").agg(F.max("missed_runs")).first()[0] == 0
    assert J.ingest(t, "paged", payload(spark, *[post(str(i)) for i in range(6)]), NOW)["dropped"], "a flagged run is no baseline"
    assert {r.kind for r in t.read("run_notes").collect()} >= {"source_error", "source_count_drop", "takedown_skipped"}


def test_small_tables(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "db"))
    t.new_run(now=NOW)
    rows = [("j", "a:1", "m", NOW, "x"), ("j", "a:2", "m", datetime(2026, 9, 2), "y"), ("j", "b:1", "m", NOW, "z")]
    t.replace("tailorings", spark.createDataFrame(rows, "job_id string, cache_key string, model string, created_at timestamp, data string"))
    assert t.tailoring("j", "a:1").first().data == "x" and t.tailoring("j", "a:", prefix=True).first().data == "y"
    t.replace("batches", spark.createDataFrame([("b1", "rank", "m", "1", NOW, "submitted", ["j"])], "id string, stage string, model string, prompt_version string, created_at timestamp, status string, job_ids array<string>"))
    assert t.pending_batches("rank").count() == 1
    t.finish_batch("b1")
    assert t.pending_batches().count() == 0
    t.replace("decisions", spark.createDataFrame([("j", "u", "applied", NOW)], "job_id string, user string, status string, updated_at timestamp").withColumn("note", F.lit(None)).withColumn("reasons", F.array()))
    assert t.delete("decisions", spark.createDataFrame([("j", "u")], "job_id string, user string"), ["job_id", "user"]) == 1
    assert P.prepend_section("# t\n\n## a\n", "## new\n") == "# t\n\n## new\n\n## a\n"


def test_shortlist(spark):
    rank = spark.createDataFrame([(str(i), s) for i, s in enumerate([90, 80, 80, 70])], "job_id string, score int")
    refine = spark.createDataFrame([], "job_id string, score int, position int")
    alive = rank.select("job_id", F.lit("keep").alias("status"))
    none = spark.createDataFrame([], "job_id string")
    assert [r.job_id for r in P.shortlist(rank, refine, alive, none, 1, 2).collect()] == ["0", "1", "2"]
    one = spark.createDataFrame([("0", 50, 1)], "job_id string, score int, position int")
    assert [r.job_id for r in P.shortlist(rank, one, alive, none, 1, 3).collect()] == ["1", "2"]
