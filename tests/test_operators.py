from datetime import date, datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from siftline.operators import audit as A, dedupe as D, ordering as O, rules as R, scorer as X, scoring as S, selection as C, state as K

JOB = "id string, title string, company string, source string, country string, description string, seniority_raw string, posting_language string, remote string, remote_region string, location_raw string, posted_at timestamp"
PROFILE = R.Profile(
    title_terms=("develop", "software"), exclude_title_terms=("sales",), drop_always_terms=("thesis",), keep_level_terms=("junior",), drop_level_terms=("senior",), drop_label_terms=("mid",), languages_ok=("en",), languages_weak=("sv",),
    drop_if_written_in=("de",), tiers=(("FI",), ("EE",), ("AE",)), notes={"AE": "visa"}, max_age_days=60)
TODAY = date(2026, 9, 1)


def job(i, title="Software Developer", **k):
    base = dict(company="Acme", source="x", country="FI", description="We build things.", seniority_raw=None, posting_language="en", remote="onsite", remote_region=None, location_raw=None, posted_at=datetime(2026, 8, 20)) | k
    return (i, title, *[base[c] for c in ("company", "source", "country", "description", "seniority_raw", "posting_language", "remote", "remote_region", "location_raw", "posted_at")])


CASES = {
    "plain": (job("plain"), "keep", []),
    "sales": (job("sales", "Sales manager"), "drop", ["title looks like a non-software role: 'Sales manager'"]),
    "saved": (job("saved", "Sales software developer"), "keep", []),
    "always": (job("always", "Thesis developer"), "drop", ["title excluded by profile regardless of role/level: 'Thesis developer'"]),
    "other": (job("other", "Cook"), "drop", ["title not a software/IT role: 'Cook'"]),
    "chance": (job("chance", "Trainee", description="You develop software"), "review", ["title not obviously software, description mentions it"]),
    "senior": (job("senior", "Senior developer"), "drop", ["title level excluded by profile: 'Senior developer'"]),
    "both": (job("both", "Junior to senior developer"), "keep", []),
    "label": (job("label", seniority_raw="Mid"), "drop", ["seniority label 'Mid' excluded by profile"]),
    "label kept": (job("label kept", seniority_raw="junior/mid"), "keep", []),
    "years": (job("years", description="5 years of experience"), "drop", ["asks for 5+ years of experience"]),
    "years kept": (job("years kept", "Junior developer", description="5 years of experience"), "review", ["title matches the profile level terms but mentions 5 years"]),
    "three years": (job("three years", description="3 years of experience"), "review", ["asks for 3 years of experience"]),
    "written": (job("written", posting_language="de"), "drop", ["posting written in de"]),
    "weak": (job("weak", posting_language="sv"), "review", ["posting written in sv"]),
    "needs": (job("needs", description="Fluent Finnish required. Swedish is a must."), "drop", ["requires fi: 'Fluent Finnish required.'", "requires sv: 'Swedish is a must.'"]),
    "away": (job("away", country="US"), "drop", ["on-site in US, outside target countries"]),
    "remote": (job("remote", country="US", remote="remote", remote_region="US only"), "review", ["remote but text suggests US-only; worth checking (high pay)"]),
    "one": (job("one", remote="remote", country=None, remote_region="Israel only"), "review", ["remote but restricted to IL, outside target countries"]),
    "nowhere": (job("nowhere", country=None, remote="unknown"), "review", ["location unknown"]),
    "onsite": (job("onsite", country=None), "review", ["on-site with unknown country"]),
    "old": (job("old", posted_at=datetime(2026, 7, 2)), "drop", ["posting is 61 days old (max 60)"]),
    "edge": (job("edge", posted_at=datetime(2026, 7, 3)), "keep", []),
    "undated": (job("undated", posted_at=None), "keep", []),
    "passed": (job("passed", description="Deadline 2026-08-31"), "drop", ["application deadline passed on 2026-08-31"]),
    "today": (job("today", description="Deadline 2026-09-01"), "keep", []),
    "closed": (job("closed"), "drop", ["posting closed (checked 2026-08-30)"]),
}


def test_rule_filter(spark):
    jobs = spark.createDataFrame([c[0] for c in CASES.values()], JOB)
    live = spark.createDataFrame([("closed", "closed", "", "2026-08-30"), ("plain", "open", "", "2026-08-30")], "id string, live_status string, live_reason string, live_day string")
    need = R.language_requirements(jobs, "id", "description")
    got = {r.id: r for r in R.evaluate(jobs, PROFILE, TODAY, need, live).collect()}
    for name, (_, status, reasons) in CASES.items():
        assert (got[name].status, got[name].reasons) == (status, reasons), name
    assert got["today"].signals.closes_in_days == 0 and got["plain"].signals.age_days == 12 and got["remote"].location_tier == 0
    assert {r.reason for r in R.drop_counts(R.evaluate(jobs, PROFILE, TODAY)).collect()} >= {"title not a software/IT role"}


@pytest.mark.parametrize("text,required,optional", [
    ("Fluent English required; Finnish is a plus.", ["en"], ["fi"]), ("Fluent English and Dutch is a preference", ["en"], ["nl"]), ("Swedish is not required.", [], ["sv"]), ("We need German. German is a plus.", ["de"], []), ("environment and Go", [], []), ("written and spoken English required", ["en"], []), (None, [], [])])
def test_language_requirements(spark, text, required, optional):
    rows = R.language_requirements(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").collect()
    assert (rows[0].required, rows[0].optional) == (required, optional) if rows else not required and not optional


def test_dedupe(spark):
    rows = [job("a1", "Dev", company="Academic Work Finland Oy", source="linkedin"), job("a2", "dev!", company="Academic Work", source="thehub", country="US"), job("b1", "Dev", company="Polar"), job("b2", "Dev", company="Polar Squad"), job("c1", "Dev", company=None), job("c2", "Dev", company=""), job("d1", "Dev", company="Academic Work Nord")]
    df = spark.createDataFrame(rows, JOB)
    where = D.tier(F.col("country"), F.col("remote"), [["FI"], ["EE"], []], True)
    got = {r.id: r for r in D.dedupe(df, location=where).collect()}
    assert {i: r.kept_id for i, r in got.items()} == {"a1": "d1", "a2": "d1", "d1": "d1", "b1": "b1", "b2": "b2", "c1": "c1", "c2": "c2"} and got["a1"].group_size == 3
    kept = df.join(spark.createDataFrame([(i,) for i, r in got.items() if r.kept], "id string"), "id", "left_semi")
    assert all(r.kept for r in D.dedupe(kept, location=where).collect())
    alias = spark.createDataFrame([("VOIS", "Vodafone")], "alias string, name string")
    two = D.dedupe(spark.createDataFrame([job("v", "X", company="VOIS Oy"), job("w", "X", company="Vodafone Ltd")], JOB), aliases=alias).collect()
    assert {r.kept_id for r in two} == {"v"}


def test_state(spark):
    old = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 2, "y")], "id string, first_seen int, last_seen int, title string")
    new = spark.createDataFrame([("b", 5, 5, "z"), ("c", 5, 5, "n")], "id string, first_seen int, last_seen int, title string")
    assert sorted(map(tuple, K.upsert(old, new, "id", ["first_seen"], ["last_seen", "title"]).collect())) == [("a", 1, 1, "x"), ("b", 1, 5, "z"), ("c", 5, 5, "n")]
    runs = spark.createDataFrame([("s", 1, 30, None), ("s", 2, 25, None), ("s", 3, 9, "boom"), ("s", 4, 0, None), ("s", 5, 12, None)], "source string, id int, fetched int, error string")
    flagged = spark.createDataFrame([(2,)], "run_id int")
    assert K.last_good_run(runs, flagged, 5).first().id == 1
    st_ = spark.createDataFrame([("s", 1, 0), ("s", None, 1), ("t", 1, 1)], "source string, last_run_id int, missed_runs int")
    assert sorted(r.missed_runs for r in K.mark_missing(st_, "s", 1).collect()) == [0, 1, 2]
    assert K.gone(st_, 0).count() == 0 and K.gone(st_, 1).count() == 2


def test_scores(spark):
    a = spark.createDataFrame([("x", 80), ("y", 70), ("z", 61), ("q", 50)], "id string, score int")
    b = spark.createDataFrame([("x", 60), ("y", 51), ("z", 40), ("r", 33)], "id string, score int")
    assert S.offset(a, b, "id").first().offset == 20.0
    assert S.offset(a.limit(2), b, "id").first().offset == 0.0
    df = spark.createDataFrame([(80, 60, 20.0), (None, 33, 20.0), (50, None, 20.0), (100, 99, 20.0), (81, 60, 20.0), (None, None, 0.0)], "a int, b int, o double")
    assert [r[0] for r in df.select(S.effective(F.col("a"), F.col("b"), F.col("o"))).collect()] == [80, 33, 50, 100, 80, None]


def test_bm25_is_order_free_and_rewards_rarity(spark):
    docs = spark.createDataFrame([("a", "python python rust"), ("b", "python java"), ("c", "java java"), ("d", "")], "id string, t string")
    q = S.query_terms(spark.createDataFrame([(3.0, "python rust"), (1.0, "python java")], "weight double, text string"))
    got = {r.id: r.score for r in S.bm25(docs, q, "id", F.col("t")).collect()}
    again = {r.id: r.score for r in S.bm25(docs.repartition(3).orderBy(F.desc("id")), q, "id", F.col("t")).collect()}
    assert got.keys() == again.keys() == {"a", "b", "c"} and all(abs(got[k] - again[k]) < 1e-12 for k in got) and got["a"] > got["b"] > got["c"] > 0


def test_ordering(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([90, 80, 80, 80, 70])], "id int, s int")
    assert [r.id for r in O.top_with_ties(df, F.col("s"), [F.col("id")], 2).collect()] == [0, 1, 2, 3]
    w = spark.createDataFrame([(1, 10, 1), (2, 10, 0), (3, 10, 0), (4, 10, 2), (5, 7, 0)], "n int, ranked int, entered int")
    assert [r.miss_run for r in O.miss_runs(w, "n", "ranked", "entered").orderBy("n").collect()] == [0, 10, 20, 0, 7]
    assert O.rank_stop(w, "n", "ranked", "entered", 5, 30, 99) == "go on" and O.rank_stop(w, "n", "ranked", "entered", 5, 7, 99) == "patience" and O.rank_stop(w, "n", "ranked", "entered", 5, 30, 40) == "budget" and O.rank_stop(w, "n", "ranked", "entered", 0, 1, 1) == "queue empty"
    d = {r.id: r.change for r in O.diff(df, spark.createDataFrame([(0, 70), (1, 75), (9, 5)], "id int, s int"), "id", "s").collect()}
    assert d == {0: "moved", 2: "new", 3: "new", 4: "new", 9: "gone"}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=12))
def test_spearman(spark, pairs):
    r = A.spearman(spark.createDataFrame([(1, float(a), float(b)) for a, b in pairs], "g int, x double, y double"), "x", "y", ["g"]).first()
    if len({a for a, _ in pairs}) < 2 or len({b for _, b in pairs}) < 2:
        assert r.rho is None
    else:
        import pandas as pd

        want = pd.Series([a for a, _ in pairs]).rank().corr(pd.Series([b for _, b in pairs]).rank())
        assert abs(r.rho - want) < 1e-9


def test_scorer(spark):
    class Broken(X.LexicalScorer):
        def score(self, text):
            if "bad" in text:
                raise ValueError("no")
            return super().score(text)

    rows = spark.createDataFrame([("1", "good words"), ("2", "bad words"), ("3", None)], "job_id string, prompt string")
    got = {r.job_id: r for r in X.run_stage(rows, Broken(["words"]), "screen").collect()}
    assert got["1"].score == 10 and got["2"].score == 50 and got["2"].summary.startswith("no verdict") and not got["3"].relevant
    stored = spark.createDataFrame([("1", "screen", "lexical", "1"), ("2", "screen", "lexical", "0")], "job_id string, stage string, model string, prompt_version string")
    assert {r.job_id for r in X.run_stage(rows, Broken(["words"]), "screen", stored).collect()} == {"2", "3"}
    lines = spark.createDataFrame([('{"job_id":"1","score":5}',), ("{broken",), ('{"job_id":"2","score":500}',)], "value string")
    ok, bad = X.parse_answers(lines, "job_id string, score int")
    assert [r.job_id for r in ok.collect()] == ["1"] and bad.count() == 2


def test_selection(spark):
    parts = spark.createDataFrame([("a", "1", True, 2, "A1"), ("a", "2", True, 1, "A2"), ("b", "3", False, 1, "B3"), ("b", "4", False, 2, "B4")], "slot string, part_id string, is_default boolean, position int, text string")
    limits = spark.createDataFrame([("a", 2, 1), ("b", 1, 1), ("c", 1, 1)], "slot string, most int, least int")
    chosen = C.defaults(parts, limits)
    assert sorted((r.slot, r.part_id, r.position) for r in chosen.collect()) == [("a", "1", 2), ("a", "2", 1), ("b", "3", 1)]
    assert {r.slot: r.texts for r in C.resolved(parts, chosen).collect()}["a"] == ["A2", "A1"]
    wrong = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "9"), ("b", "3"), ("b", "4")], "slot string, part_id string")
    assert sorted((r.slot, r.problem) for r in C.violations(parts.select("slot", "part_id"), wrong, limits).collect()) == [("a", "too many"), ("a", "twice"), ("a", "unknown"), ("b", "too many"), ("c", "empty")]


def test_criteria_and_orders(spark):
    df = spark.createDataFrame([({"fit": 120, "Pay level": -5, "odd": 3},)], "m map<string,int>")
    names = {"pay": "Pay level", "fit": "Fit"}
    r = df.select(S.normalised_criteria(F.col("m"), names).alias("n"), S.unknown_criteria(F.col("m"), names).alias("u")).first()
    assert r.n == {"pay": 0, "fit": 100} and r.u == ["odd"]
    ids = spark.createDataFrame([(i,) for i in range(5)], "id int")
    assert O.entered(ids.filter("id < 2"), ids.filter("id < 4"), ids.filter("id > 2"), "id") == 1
    two = O.shuffled_twice(ids, "id", 3, 2)
    assert two.count() == 10 and two.filter("run = 1 and chunk = 0").count() == 2
