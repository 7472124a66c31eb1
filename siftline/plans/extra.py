"""Queries over fixed samples joined to the tables, and the evaluation of decisions, beside their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions import dates as DT, text as T, vocabulary as V
from siftline.operators import evaluation as E
from siftline.plans.catalog import Tables, query
from siftline.sources import boards as B

TODAY = date(2024, 9, 1)


def _values(samples: list) -> str:
    said = lambda x: "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"
    return "(VALUES " + ", ".join(f"({i}, {said(x)})" for i, x in enumerate(samples)) + ") v(i, s)"


def _over_parts(spark, sf, samples: list, **columns: Column) -> DataFrame:
    """p_partkey with columns of a sample for each part, in turn."""
    v = spark.createDataFrame(list(enumerate(samples)), "i int, s string")
    return Tables(spark, sf).part.join(F.broadcast(v), F.col("p_partkey") % len(samples) == F.col("i")).select("p_partkey", *[c.alias(n) for n, c in columns.items()])


def _of_parts(samples: list, select: str) -> str:
    return f"SELECT p_partkey, {select} FROM part JOIN {_values(samples)} ON p_partkey % {len(samples)} = i"


_PATHS = ["/job/Shanghai-Shanghai-China/Software-Engineer_R1", "/job/US-CA-San-Jose/Intern_R2", "/job/Multiple-Locations/X", "/jobs/Helsinki/Y", "job/ Oulu - Finland /Z", "/job/", None, "/JOB/Remote/A"]
_NAMES = "list_filter(list_transform(string_split({}, '{}'), lambda x: trim(x)), lambda x: x <> '')"
_PATH_PARTS = _NAMES.format("s", "/")
_PATH_NAMES = _NAMES.format(f"{_PATH_PARTS}[2]", "-")


@query(_of_parts(_PATHS, f"CASE WHEN len({_PATH_PARTS}) >= 2 AND lower({_PATH_PARTS}[1]) = 'job' AND len({_PATH_NAMES}) > 0 AND lower(array_to_string({_PATH_NAMES}, ' ')) NOT IN ({', '.join(repr(x) for x in B.NO_PLACE)}) THEN array_to_string({_PATH_NAMES}, ', ') END AS place"))
def slug_locations(spark, sf):
    return _over_parts(spark, sf, _PATHS, place=B.slug_location(F.col("s")))


_URLS = ["https://a.csod.example/ux/ats/careersite/4/job/712?c=acme&x=1", "HTTP://b.example/ux/ats/careersite/12/job/R-9.a", "https://a.example/jobs/1", None]


@query(_of_parts(_URLS, r"nullif(regexp_extract(s, '(?i)^(https?://[^/\s]+)/ux/ats/careersite/(\d+)/job/([\w.-]+)', 1), '') AS origin, nullif(regexp_extract(s, '(?i)^(https?://[^/\s]+)/ux/ats/careersite/(\d+)/job/([\w.-]+)', 3), '') AS requisition, CASE WHEN regexp_matches(s, '(?i)/ux/ats/careersite/\d+/job/') THEN nullif(regexp_extract(s, '[?&]c=([^&#]+)', 1), '') END AS slug"))
def requisition_urls(spark, sf):
    r = B.requisition(F.col("s"))
    return _over_parts(spark, sf, _URLS, origin=r["origin"], requisition=r["requisition"], slug=r["slug"])


_TITLED = ["Junior Developer", "Werkstudententätigkeit IT", "Senior Nurse", "Graduate Trainee", "Internal auditor", "IT-Praktikantin", None]


@query(_of_parts(_TITLED, r"coalesce(s, '') LIKE '%Developer%' OR coalesce(s, '') LIKE '%Trainee%' AS kept, regexp_matches(coalesce(s, ''), '(?i)\b(junior|jr|intern|internship|working student|trainee|graduate)\b|praktikant|werkstudent') AS entry_level"))
def board_titles(spark, sf):
    return _over_parts(spark, sf, _TITLED, kept=B.keeps(F.col("s"), "Developer|Trainee|Nurse", "Nurse"), entry_level=B.entry_level(F.col("s")))


_LISTS = ["Node.js, React, and Mobile Development", "and Go", "", None, " a , , AND b"]


@query(_of_parts(_LISTS, r"array_to_string(list_filter(list_transform(string_split(coalesce(s, ''), ','), lambda x: trim(regexp_replace(trim(x), '(?i)^and\s+', ''))), lambda x: x <> ''), '|') AS tags"))
def skill_tag_lists(spark, sf):
    return _over_parts(spark, sf, _LISTS, tags=F.array_join(B.skill_tags(F.col("s")), "|"))


@query("SELECT s_suppkey, CASE WHEN country IS NULL OR country IN ('FI', 'SE') OR remote = 'remote' THEN true ELSE false END AS kept, CASE WHEN kind = 'OnlyCountry' AND country IS NOT NULL THEN country || ' only' WHEN kind = 'anywhere' THEN 'Anywhere' ELSE kind END AS remote_for FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'FI' WHEN 1 THEN 'US' END AS country, CASE WHEN s_suppkey % 4 = 0 THEN 'remote' END AS remote, CASE s_suppkey % 5 WHEN 0 THEN 'OnlyCountry' WHEN 1 THEN 'anywhere' WHEN 2 THEN 'EU' END AS kind FROM supplier)")
def board_regions(spark, sf):
    k = F.col("s_suppkey")
    country = F.when(k % 3 == 0, "FI").when(k % 3 == 1, "US")
    kind = F.when(k % 5 == 0, "OnlyCountry").when(k % 5 == 1, "anywhere").when(k % 5 == 2, "EU")
    return Tables(spark, sf).supplier.select("s_suppkey", B.in_region(country, F.when(k % 4 == 0, "remote"), ["FI", "SE"]).alias("kept"), B.remote_for(kind, country).alias("remote_for"))


_WHEN = ["2024-01-02T03:04:05Z", "1704164645", "1704164645000", "Tue, 02 Jan 2024 03:04:05 +0000", "2.1.2024", "2024-01-02 03:04:05", "?", None]


@query(_of_parts(_WHEN, """CASE WHEN regexp_matches(s, '^[0-9]{9,13}$') THEN CASE WHEN length(s) > 12 THEN epoch_ms(CAST(s AS BIGINT)) ELSE epoch_ms(CAST(s AS BIGINT) * 1000) END WHEN regexp_matches(s, '^[0-9]{4}-') THEN CAST(replace(replace(s, 'T', ' '), 'Z', '') AS TIMESTAMP)
WHEN regexp_matches(s, '^[A-Z]') THEN strptime(s[6:25], '%d %b %Y %H:%M:%S') WHEN regexp_matches(s, '^[0-9]+[.]') THEN strptime(s, '%-d.%-m.%Y') END AS at"""))
def parsed_dates(spark, sf):
    return _over_parts(spark, sf, _WHEN, at=DT.parse_date(F.col("s")).cast("timestamp_ntz"))


_PT = {"hoje às 10h": 0, "Ontem": 1, "anteontem": 2, "há 3 dias": 3, "Há 2 semanas": 14, "há 1 mês": 30, "9 set": "2023-09-09", "28 de Agosto de 2024": "2024-08-28", "1 set": "2024-09-01", "31 fev": None, "2024-08-30": "2024-08-30", "em breve": None}
_AGO = {"3 days ago": 3, "Yesterday": 1, "Today": 0, "30+ days ago": 30, "2 weeks ago": 14, "5 hours ago": 0, "a month ago": 30, "soon": None}


def _expected(samples: dict) -> str:
    """SQL of the sample's day: the days back from TODAY, or the day itself."""
    days = [f"WHEN {i} THEN " + ("CAST(NULL AS DATE)" if x is None else f"DATE '{x}'" if isinstance(x, str) else f"DATE '{TODAY}' - {x}") for i, x in enumerate(samples.values())]
    return "CAST(CASE i " + " ".join(days) + " END AS VARCHAR) AS day"


@query(_of_parts(list(_PT), _expected(_PT)))
def portuguese_dates(spark, sf):
    return _over_parts(spark, sf, list(_PT), day=DT.parse_pt_date(F.col("s"), TODAY).cast("string"))


@query(_of_parts(list(_AGO), _expected(_AGO)))
def relative_dates(spark, sf):
    return _over_parts(spark, sf, list(_AGO), day=DT.relative_day(F.col("s"), TODAY).cast("string"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'remote' WHEN 1 THEN 'FI/EE' WHEN 2 THEN 'EU/EEA' WHEN 3 THEN 'extended' ELSE '?' END AS tier, CASE WHEN p_size = 1 THEN 'closes today' ELSE 'closes in ' || (p_size - 1) || ' days' END AS closes, 'screen: score ' || p_size || ', ' || p_brand AS gate, replace(lower(p_name), '_', ' ') AS label FROM part")
def report_phrases(spark, sf):
    n = F.col("p_partkey") % 5
    return Tables(spark, sf).part.select(
        "p_partkey", T.tier_label(F.when(n < 4, n)).alias("tier"), T.closes_text(F.col("p_size") - 1).alias("closes"), T.screen_gate(F.col("p_size"), F.col("p_brand")).alias("gate"), T.criterion_label(F.lower("p_name")).alias("label"))


# ------------------------------------------------------------------ decisions: documents as postings, labels as what was decided
_REASONS = ("level", "location", "language", "stack")
_STATUS = ("interested", "skipped", "applied", "closed", "skipped", "seen")


def _decisions(spark, sf) -> DataFrame:
    """Two users' decisions about labelled documents, the second one later on every third."""
    base = Tables(spark, sf).labels.select(F.col("doc_id").alias("job_id"))
    n = F.col("job_id")
    status = lambda k: F.element_at(F.array(*[F.lit(s) for s in _STATUS]), (k % len(_STATUS) + 1).cast("int"))
    reasons = F.when(n % 2 == 0, F.array(F.lit("level"))).otherwise(F.array(F.lit("stack"), F.lit("location")))
    one = base.select("job_id", F.lit("a").alias("user"), status(n).alias("status"), F.lit(1).alias("decided_at"), reasons.alias("reasons"))
    return one.unionByName(base.filter(n % 3 == 0).select("job_id", F.lit("b").alias("user"), status(n + 1).alias("status"), F.lit(2).alias("decided_at"), reasons.alias("reasons")))


_DECISIONS = f"""s AS (SELECT doc_id AS job_id, [{", ".join(f"'{s}'" for s in _STATUS)}] AS names, CASE WHEN doc_id % 2 = 0 THEN ['level'] ELSE ['stack', 'location'] END AS reasons FROM labels),
d AS (SELECT job_id, CASE WHEN job_id % 3 = 0 THEN names[(job_id + 1) % {len(_STATUS)} + 1] ELSE names[job_id % {len(_STATUS)} + 1] END AS status, reasons FROM s),
l AS (SELECT job_id, status, reasons, CASE WHEN status IN ('interested', 'applied', 'interview', 'offer', 'rejected') THEN true WHEN status = 'skipped' THEN false END AS good FROM d),
x AS (SELECT doc_id AS job_id, CASE WHEN doc_id % 4 <> 0 THEN n_chars % 100 END AS screen, doc_id % 5 <> 0 AS relevant, CASE WHEN doc_id % 7 <> 0 THEN n_chars % 97 END AS score, doc_id % 8 = 0 AS dropped FROM documents),
w AS (SELECT l.*, screen, relevant, score, dropped FROM l LEFT JOIN x USING (job_id) WHERE good IS NOT NULL)"""


def _stages(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = Tables(spark, sf).documents.select(F.col("doc_id").alias("job_id"), "n_chars")
    n = F.col("job_id")
    screen = d.filter(n % 4 != 0).select("job_id", (n % 5 != 0).alias("relevant"), (F.col("n_chars") % 100).alias("screen_score"))
    scores = d.filter(n % 7 != 0).select("job_id", (F.col("n_chars") % 97).alias("score"))
    filters = d.select("job_id", F.when(n % 8 == 0, "drop").otherwise("keep").alias("status"), F.array(F.when(n % 8 == 0, "requires fi: 'x'")).alias("reasons"))
    return filters, screen, scores


@query(f"""WITH {_DECISIONS}, n AS (SELECT (SELECT count(*) FROM labels) + (SELECT count(*) FROM labels WHERE doc_id % 3 = 0) AS read, count(*) AS decided, count(*) FILTER (status = 'closed') AS closed, count(good) AS usable, count(*) FILTER (good) AS pos FROM l),
g AS (SELECT count(screen) AS screened, count(*) FILTER (relevant AND screen >= 40) AS passed, count(screen) FILTER (good) AS pos, count(*) FILTER (relevant AND screen >= 40 AND good) AS hits, count(score) AS scored, avg(score) FILTER (good) AS mp, avg(score) FILTER (NOT good) AS mn FROM w),
k AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rx, rank() OVER (ORDER BY good) + (count(*) OVER (PARTITION BY good) - 1) / 2 AS ry, row_number() OVER (ORDER BY score DESC, job_id) AS p FROM w WHERE score IS NOT NULL),
f AS (SELECT 'counts' AS part, unnest(['decisions_read', 'jobs_decided', 'closed', 'usable', 'positives', 'negatives', 'superseded']) AS figure, unnest([read, decided, closed, usable, pos, usable - pos, read - decided]) AS value FROM n
UNION ALL SELECT 'screen', unnest(['screened', 'passed', 'positives', 'positives_passed', 'precision', 'recall']), unnest([screened, passed, pos, hits, hits / passed, hits / pos]) FROM g
UNION ALL SELECT 'unseen', CASE WHEN dropped THEN 'language_required' ELSE 'never_screened' END, count(*) FROM w WHERE good AND screen IS NULL GROUP BY 2
UNION ALL SELECT 'labelled', unnest(['scored', 'mean_positive', 'mean_negative']), unnest([scored, mp, mn]) FROM g UNION ALL SELECT 'labelled', 'rho', corr(rx, ry) FROM k
UNION ALL SELECT 'at ' || q, unnest(['k_used', 'positives', 'precision']), unnest([count(*), count(*) FILTER (good), count(*) FILTER (good) / count(*)]) FROM k, (VALUES (10), (20)) t(q) WHERE p <= q GROUP BY q)
SELECT part, figure, round(CAST(value AS DOUBLE), 6) AS value FROM f""")
def decision_eval(spark, sf):
    filters, screen, scores = _stages(spark, sf)
    return E.decision_eval(_decisions(spark, sf), filters, screen, scores, 40).select("part", "figure", F.round("value", 6).alias("value"))


@query(f"""WITH {_DECISIONS}, r AS (SELECT unnest(reasons) AS reason, score FROM w WHERE NOT good)
SELECT reason, count(*) AS n, count(score) AS scored, round(avg(score), 6) AS mean_score, CAST(CASE reason WHEN 'level' THEN 0 WHEN 'location' THEN 1 WHEN 'language' THEN 2 ELSE 3 END AS INTEGER) AS place FROM r GROUP BY reason""")
def skip_reasons(spark, sf):
    out = E.skip_reasons(_decisions(spark, sf), _stages(spark, sf)[2], _REASONS)
    return out.select("reason", "n", "scored", F.round("mean_score", 6).alias("mean_score"), "place")


_ORDERED = """o AS (SELECT doc_id AS job_id, CAST(n_chars % 97 AS DOUBLE) AS truth, CAST(n_chars % 31 AS DOUBLE) AS prior, CASE WHEN doc_id % 4 <> 0 THEN CAST(n_chars % 53 AS DOUBLE) END AS screen FROM documents WHERE lang = 'en'), t AS (SELECT job_id FROM o ORDER BY truth DESC, job_id LIMIT 20)"""


def _ordering_sql(c: str) -> str:
    return f"""SELECT '{c}' AS ordering, (SELECT count(*) FROM p_{c} WHERE job_id IN (SELECT job_id FROM t)) AS found, (SELECT count(*) FROM p_{c} WHERE p <= 20 AND job_id IN (SELECT job_id FROM t)) AS at_20, (SELECT count(*) FROM p_{c} WHERE p <= 60 AND job_id IN (SELECT job_id FROM t)) AS at_60,
(SELECT median(p) FROM p_{c} WHERE job_id IN (SELECT job_id FROM t)) AS median_place, count(*) AS compared, round(corr(rx, ry), 6) AS rho FROM (SELECT rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS rx, rank() OVER (ORDER BY truth) + (count(*) OVER (PARTITION BY truth) - 1) / 2 AS ry FROM o WHERE {c} IS NOT NULL)"""


@query("WITH " + _ORDERED + "".join(f", p_{c} AS (SELECT job_id, row_number() OVER (ORDER BY coalesce({c}, 0) DESC, coalesce(screen, 0) DESC, job_id) AS p FROM o)" for c in ("prior", "screen")) + f" {_ordering_sql('prior')} UNION ALL {_ordering_sql('screen')}")
def prior_comparison(spark, sf):
    d = Tables(spark, sf).documents.filter("lang = 'en'")
    n = F.col("n_chars")
    o = d.select(F.col("doc_id").alias("job_id"), (n % 97).cast("double").alias("truth"), (n % 31).cast("double").alias("prior"), F.when(F.col("doc_id") % 4 != 0, (n % 53).cast("double")).alias("screen"))
    top = o.orderBy(F.desc("truth"), "job_id").limit(20).select("job_id", F.lit(True).alias("top"))
    measured = o.join(F.broadcast(top), "job_id", "left")  # twenty rows
    out = E.orderings(measured, ["prior", "screen"], F.col("top"), "truth", "screen", "job_id")
    return out.select("ordering", "found", "at_20", "at_60", F.col("median_place").cast("double").alias("median_place"), "compared", F.round("rho", 6).alias("rho"))
