"""Queries over places in all rows, keyed streaming state, as-of joins, trims and claims, beside their SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftline import scratch
from siftline.functions import vocabulary as V
from siftline.operators import asof, claims, places, rounds, rules as R, selection, shortlist
from siftline.plans.catalog import Tables, query
from siftline.sources import append_log as LG
from siftline.streaming import presence as PR


# ------------------------------------------------------------------ places and ranks over all rows
@query("""SELECT l_orderkey, l_linenumber, CAST(rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS DOUBLE) AS quantity_rank,
row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem""")
def tied_ranks(spark, sf):
    """Ranks of all lines by quantity, where a value ties a fiftieth of them, and places by price."""
    rows = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    ranked = places.average_ranks(rows, "l_quantity", "quantity_rank")
    return places.placed_in_all(ranked, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]).select("l_orderkey", "l_linenumber", "quantity_rank", "place")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS place, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) - 1) // 100 AS BIGINT) AS chunk FROM orders")
def places_in_hot_groups(spark, sf):
    """Places within three groups, each of which holds a third of all orders, and their chunks of a hundred."""
    rows = Tables(spark, sf).orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    out = places.placed_within(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], ["o_orderstatus"])
    return out.select("o_orderkey", "place", F.floor((F.col("place") - 1) / 100).cast("long").alias("chunk"))


# ------------------------------------------------------------------ as-of joins
@query("""WITH m AS (SELECT user_id, ts AS missing_at FROM events WHERE event_type = 'error'), o AS (SELECT user_id, ts AS opened_at FROM events WHERE event_type = 'click'),
a AS (SELECT e.event_id, e.user_id, e.ts, m.missing_at FROM (SELECT * FROM events WHERE event_type = 'view') e ASOF LEFT JOIN m ON e.user_id = m.user_id AND e.ts >= m.missing_at),
b AS (SELECT a.*, o.opened_at FROM a ASOF LEFT JOIN o ON a.user_id = o.user_id AND a.ts >= o.opened_at)
SELECT event_id, missing_at, opened_at, missing_at IS NOT NULL AND (opened_at IS NULL OR opened_at < missing_at) AS stale FROM b""")
def freshness_as_of(spark, sf):
    """At every view: the newest miss, the newest open check, and whether the miss is the later one."""
    e = Tables(spark, sf).events
    logged = lambda kind, name: e.filter(F.col("event_type") == kind).select("user_id", F.col("ts").alias(name))
    views = e.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    missed = asof.as_of(views, logged("error", "missing_at"), "user_id", "ts", "missing_at", ["missing_at"])
    both = asof.as_of(missed, logged("click", "opened_at"), "user_id", "ts", "opened_at", ["opened_at"])
    return both.select("event_id", "missing_at", "opened_at", asof.stale(F.col("missing_at"), F.col("opened_at")).alias("stale"))


@query("""WITH n AS (SELECT user_id, max((ts, event_type)) AS n, max(ts) FILTER (event_type = 'click') AS opened_at FROM events GROUP BY user_id)
SELECT user_id, struct_extract(n, 1) AS checked_at, struct_extract(n, 2) AS status, opened_at, struct_extract(n, 2) <> 'click' AND (opened_at IS NULL OR struct_extract(n, 1) > opened_at) AS shown FROM n""")
def last_checks(spark, sf):
    return asof.last_check(Tables(spark, sf).events, "user_id", "ts", "event_type", "click")


# ------------------------------------------------------------------ keyed state of its own
MISSES = 4


@query(f"""WITH s AS (SELECT user_id || '/' || event_type AS posting, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS sightings, date_diff('day', CAST(max(ts) AS DATE), (SELECT CAST(max(ts) AS DATE) FROM events)) AS missed FROM events GROUP BY 1)
SELECT posting, first_seen, last_seen, sightings, CAST(least(missed, {MISSES}) AS BIGINT) AS missed_runs, missed >= {MISSES} AS down FROM s""")
def stream_presence(spark, sf):
    """events as a stream of three parts, each read in a run of its own that goes on from the checkpoint of the one before."""
    PR.with_rocks(spark)
    e = Tables(spark, sf).events.select(F.concat_ws("/", "user_id", "event_type").alias("posting"), "ts")
    root = scratch.fresh(spark, "presence")
    lo, hi = e.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    cuts = [lo + (hi - lo) * i / 3 for i in range(1, 3)] if lo else []
    third = sum((F.to_date("ts") > F.lit(c)).cast("int") for c in cuts) if cuts else F.lit(0)
    for i in range(3):
        e.filter(third == i).write.mode("append").parquet(f"{root}/events")
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1_000).parquet(f"{root}/events")
        stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
        PR.run_to_end(PR.presence(stream, "posting", "ts", MISSES), f"{root}/rows", f"{root}/checkpoint")
    out = PR.newest(spark, f"{root}/rows", "posting")
    return out.select("posting", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "sightings", "missed_runs", "down")


# ------------------------------------------------------------------ trims and claims
_PAGE = 20
_BUDGET = 250.0


def _selections(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Twenty parts are a selection of three slots; a quarter of the parts is named in no drop order."""
    n = F.col("p_partkey")
    slot = n % 3
    chosen = t.part.select(
        F.floor(n / _PAGE).cast("long").alias("selection"), F.concat(F.lit("s"), slot).alias("slot"), slot.cast("int").alias("slot_order"), F.lpad(n.cast("string"), 12, "0").alias("part_id"), n.alias("position"),
        F.col("p_size").cast("double").alias("height"), F.lit(3.0).alias("header"), (slot + 1).cast("int").alias("least"), F.when(n % 4 != 0, F.round(F.col("p_retailprice") * 100).cast("long")).alias("drop_order"))
    budgets = chosen.select("selection").distinct().select("selection", F.lit(_BUDGET).alias("budget"), F.when(F.col("selection") % 2 == 0, 25.0).alias("error"))
    return chosen, budgets


_CHOSEN = f"""c AS (SELECT CAST(floor(p_partkey / {_PAGE}) AS BIGINT) AS selection, CAST(p_partkey % 3 AS INTEGER) AS slot, p_partkey AS pos, CAST(p_size AS DOUBLE) AS height, CASE WHEN p_partkey % 4 <> 0 THEN CAST(round(p_retailprice * 100) AS BIGINT) END AS named FROM part)"""


@query(f"""WITH RECURSIVE {_CHOSEN},
n AS (SELECT *, row_number() OVER (PARTITION BY selection ORDER BY named IS NULL, named, CASE WHEN named IS NULL THEN -slot END, CASE WHEN named IS NULL THEN -pos END, slot, pos) AS k FROM c),
s AS (SELECT selection, sum(height) AS height, [count(*) FILTER (slot = i) - (i + 1) FOR i IN [0]] AS unused, count(*) FILTER (slot = 0) - 1 AS a, count(*) FILTER (slot = 1) - 2 AS b, count(*) FILTER (slot = 2) - 3 AS c, {_BUDGET} - CASE WHEN selection % 2 = 0 THEN 25 ELSE 0 END AS budget, count(*) AS of FROM c GROUP BY selection),
r AS (SELECT selection, 0 AS k, height, a, b, c, 0 AS dropped, '' AS gone, budget, of FROM s
UNION ALL SELECT selection, k, height - CASE WHEN goes THEN h ELSE 0 END, a - CASE WHEN goes AND slot = 0 THEN 1 ELSE 0 END, b - CASE WHEN goes AND slot = 1 THEN 1 ELSE 0 END, c - CASE WHEN goes AND slot = 2 THEN 1 ELSE 0 END,
  dropped + CASE WHEN goes THEN 1 ELSE 0 END, gone || CASE WHEN goes THEN pos || ' ' ELSE '' END, budget, of
  FROM (SELECT r.selection, n.k, r.height, r.a, r.b, r.c, r.dropped, r.gone, r.budget, r.of, n.slot, n.pos, n.height AS h, r.height > r.budget AND CASE n.slot WHEN 0 THEN r.a WHEN 1 THEN r.b ELSE r.c END > 0 AS goes FROM r JOIN n ON r.selection = n.selection AND n.k = r.k + 1))
SELECT selection, CAST(dropped AS INTEGER) AS dropped, trim(gone) AS gone, height, height <= budget AS fits FROM r WHERE k = of""".replace("[count(*) FILTER (slot = i) - (i + 1) FOR i IN [0]] AS unused, ", ""))
def trimmed_selections(spark, sf):
    chosen, budgets = _selections(Tables(spark, sf))
    out = selection.trimmed(chosen, budgets)
    gone = F.array_join(F.transform("dropped", lambda d: d["part_id"].cast("long").cast("string")), " ")
    return out.select("selection", F.size("dropped").alias("dropped"), gone.alias("gone"), "height", "fits")


@query(f"""WITH {_CHOSEN}, h AS (SELECT selection, slot, sum(height) + 3.0 AS h, count(*) AS n FROM c GROUP BY 1, 2) SELECT selection, sum(h) AS height, CAST(sum(n) AS BIGINT) AS parts FROM h GROUP BY selection""")
def selection_heights(spark, sf):
    return selection.heights(_selections(Tables(spark, sf))[0])


@query(f"""WITH {_CHOSEN}, w AS (SELECT selection, pos AS place, slot, pos - pos % 2 AS part FROM c), k AS (SELECT selection, slot, pos FROM c)
SELECT w.selection, w.place, w.slot, CASE WHEN k.pos IS NULL THEN 'unknown' WHEN row_number() OVER (PARTITION BY w.selection, w.slot, w.part ORDER BY w.place) > 1 THEN 'twice' END AS problem
FROM w LEFT JOIN k ON w.selection = k.selection AND w.slot = k.slot AND w.part = k.pos""")
def drop_orders(spark, sf):
    """Drop orders that name half of the parts, some in the wrong slot."""
    chosen = _selections(Tables(spark, sf))[0]
    wanted = chosen.select("selection", F.col("position").alias("place"), "slot", F.lpad((F.col("position") - F.col("position") % 2).cast("string"), 12, "0").alias("part_id"))
    return selection.drop_order(chosen, wanted).select("selection", "place", F.substring("slot", 2, 1).cast("int").alias("slot"), "problem")


@query()
def claimed_names(spark, sf):
    """A name for every document, from its source and language, then more of it; compared with the sequential pass in the tests."""
    d = Tables(spark, sf).documents
    names = F.array(F.concat_ws("-", "source", F.col("doc_id") % 7), F.concat_ws("-", "lang", F.col("n_chars") % 100), F.concat_ws("-", "Source", "lang", F.col("n_chars")))
    return claims.claimed(d.select(F.col("doc_id").alias("owner"), names.alias("candidates")))


# ------------------------------------------------------------------ iteration to a fixed point
_WINDOW, _TOP, _PATIENCE = 100, 12, 300
_QUEUE = """q AS (SELECT l_orderkey AS k, row_number() OVER (ORDER BY sum(l_quantity) DESC, l_orderkey) AS p, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) % 10007 AS DOUBLE) AS s FROM lineitem GROUP BY l_orderkey)"""


def _orders(t: Tables) -> DataFrame:
    """Orders with their quantity and a score that has nothing to do with it."""
    return t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), (F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) % 10_007).cast("double").alias("score"))


def _queue(t: Tables) -> DataFrame:
    return places.placed_in_all(_orders(t), [F.desc("q"), F.asc("l_orderkey")])


@query(f"""WITH RECURSIVE {_QUEUE}, w AS (SELECT (p - 1) // {_WINDOW} AS w, list({{'s': -s, 'k': k}} ORDER BY -s, k) AS of, count(*) AS n FROM q GROUP BY 1),
r AS (SELECT 0 AS w, of[:{_TOP}] AS top, 0 AS missed FROM w WHERE w = 0
UNION ALL SELECT w, merged, CASE WHEN len(list_filter(merged, lambda x: list_contains(of, x))) > 0 THEN 0 ELSE missed + n END FROM (SELECT w.w, list_sort(list_concat(r.top, w.of))[:{_TOP}] AS merged, w.of, w.n, r.missed FROM r JOIN w ON w.w = r.w + 1 WHERE r.missed < {_PATIENCE}))
SELECT k AS l_orderkey, s AS score, CAST((p - 1) // {_WINDOW} AS INTEGER) AS round FROM q WHERE (p - 1) // {_WINDOW} <= (SELECT max(w) FROM r)""")
def windowed_reading(spark, sf):
    """The orders that a reading by windows scores until its patience ends, with their rounds."""
    return rounds.read_windows(_queue(Tables(spark, sf)), lambda d: d, "l_orderkey", _WINDOW, _TOP, _PATIENCE, 1 << 40).rows


@query(f"""WITH RECURSIVE {_QUEUE}, b AS (SELECT k, s AS prior, CASE WHEN k % 3 = 0 THEN s / 2 ELSE s - 1 END AS refined FROM q),
r AS (SELECT 0 AS n, CAST([] AS BIGINT[]) AS done UNION ALL
SELECT n + 1, list_concat(done, new) FROM (SELECT r.n, r.done, (SELECT list(k) FROM (SELECT k FROM b ORDER BY CASE WHEN list_contains(r.done, k) THEN refined ELSE prior END DESC, k LIMIT {_TOP}) t WHERE NOT list_contains(r.done, k)) AS new FROM r) WHERE len(new) > 0)
SELECT k AS l_orderkey, refined FROM b WHERE list_contains((SELECT done FROM r ORDER BY n DESC LIMIT 1), k)""")
def refined_top(spark, sf):
    """Every order that was refined before the best ones all were: a third of them fall by half when they are."""
    q = _orders(Tables(spark, sf)).select("l_orderkey", F.col("score").alias("prior"))
    fall = lambda d: d.withColumn("score", F.when(F.col("l_orderkey") % 3 == 0, F.col("prior") / 2).otherwise(F.col("prior") - 1))
    return rounds.refine_top(q, fall, "l_orderkey", _TOP, 1_000).rows.select("l_orderkey", "refined")


# ------------------------------------------------------------------ dictionaries in one pass
_SAID = ["Fluent English required; Finnish is a plus.", "Swedish is not required.", "You speak German and Dutch is a preference.", "Nothing of the kind.", "Italian, French (native) or Polish. Russian would be a bonus", "You must know Danish and Norwegian"]
_NAMES = "|".join(n for x in V.LANGUAGE_NAMES.values() for n in x)
_EDGE = r"(?:^|[^\p{L}\p{M}\p{N}_])"
_SAYS = lambda x, p: f"regexp_matches({x}, '{p.replace('(?iuU)', '(?i)').replace(chr(39), chr(39) * 2)}')"
_CODES = "[" + ", ".join(f"CASE WHEN regexp_matches(c, '{_EDGE}(?:{'|'.join(n)})') THEN '{code}' END" for code, n in V.LANGUAGE_NAMES.items()) + "]"


@query(rf"""WITH v(i, said) AS (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(_SAID))}), t AS (SELECT doc_id, text || chr(10) || said AS t FROM documents JOIN v ON doc_id % {len(_SAID)} = i),
m AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(t, '([.!?•\n])\s+', '\1' || chr(1), 'g'), '\s*[•·▪▸►]\s*', chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) AS parts FROM t),
u AS (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS p FROM m), s AS (SELECT doc_id, p, trim(s, ' ') AS s, lower(trim(s, ' ')) AS low FROM u WHERE trim(s, ' ') <> '' AND length(trim(s, ' ')) <= {V.LONGEST_SENTENCE}),
f AS (SELECT *, {_SAYS("low", V.REQUIRED)} AND NOT {_SAYS("low", V.OPTIONAL)} AS sreq, {_SAYS("low", V.NOT_NEEDED)} AS sneg FROM s WHERE regexp_matches(low, '{_EDGE}(?:{_NAMES})')),
c AS (SELECT doc_id, p, s, sreq, sneg, unnest(string_split(regexp_replace(regexp_replace(low, '\s*[;,()/]\s*|\s+[-–—]\s+', chr(1), 'g'), '\s+(?:and|und|ja|och|og|e|y|et)\s+({_NAMES})', chr(1) || '\1', 'g'), chr(1))) AS c FROM f),
h AS (SELECT *, list_filter({_CODES}, lambda x: x IS NOT NULL) AS hits, {_SAYS("c", V.REQUIRED)} AS req, {_SAYS("c", V.OPTIONAL)} AS opt, {_SAYS("c", V.NOT_NEEDED)} AS neg FROM c),
e AS (SELECT doc_id, p, s, unnest(hits) AS code, CASE WHEN neg OR (NOT req AND NOT opt AND sneg) THEN false WHEN req OR opt THEN req AND NOT opt ELSE sreq END AS needs FROM h),
g AS (SELECT doc_id, code, bool_or(needs) AS needs, arg_min(s, CASE WHEN needs THEN p END) AS said FROM e GROUP BY 1, 2)
SELECT doc_id, coalesce(string_agg(code, ',' ORDER BY code) FILTER (needs), '') AS required, coalesce(string_agg(code, ',' ORDER BY code) FILTER (NOT needs), '') AS optional, coalesce(string_agg(code || '=' || left(said, 200), ' | ' ORDER BY code) FILTER (needs), '') AS evidence FROM g GROUP BY doc_id""")
def language_needs(spark, sf):
    """Required and optional languages of every document with a sentence about them, and the sentences that say so."""
    v = spark.createDataFrame(list(enumerate(_SAID)), "i int, said string")
    d = Tables(spark, sf).documents.select("doc_id", "text").join(F.broadcast(v), F.col("doc_id") % len(_SAID) == F.col("i"))  # six rows
    out = R.language_requirements(d.select("doc_id", F.concat(F.col("text"), F.lit("\n"), F.col("said")).alias("text")), "doc_id", "text")
    evidence = F.transform(F.array_sort(F.map_keys("evidence")), lambda c: F.concat(c, F.lit("="), F.col("evidence")[c]))
    return out.select("doc_id", F.array_join("required", ",").alias("required"), F.array_join("optional", ",").alias("optional"), F.array_join(evidence, " | ").alias("evidence"))


# ------------------------------------------------------------------ a log that is appended to
@query("SELECT event_type, count(*) AS notes, min(event_id) AS first_id, max(event_id) AS last_id, CAST(sum(CAST(round(value, 2) AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY event_type")
def appended_notes(spark, sf):
    """All events, appended to a log in three writes and read back."""
    e = Tables(spark, sf).events.select("event_id", "event_type", "value")
    root = scratch.fresh(spark, "log")
    for i in range(3):
        LG.append(e.filter(F.col("event_id") % 3 == i), root, "event_id")
    rows = LG.read_log(spark, root, "event_id long, event_type string, value double")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("notes"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.sum(F.round("value", 2).cast("decimal(18,2)")).cast("double").alias("total"))


# ------------------------------------------------------------------ functions of whole sets
_CALL, _ANCHORS = 30_000, 3


def placed_among(rows: pa.Table) -> pa.Table:
    """A deterministic scorer of sets: the share of a set that is not longer, in hundredths, moved by how far the anchors' scores lie from 50."""
    size = np.array([len(t or "") for t in rows.column("text").to_pylist()])
    known = rows.column("anchor").to_numpy(zero_copy_only=False).astype(float)
    shift = np.nanmean(known) - 50 if (~np.isnan(known)).any() else 0.0
    share = np.searchsorted(np.sort(size), size, side="right") / len(size)
    score = np.floor(100 * share + shift)
    new = np.isnan(known)
    return pa.table({"list": rows.column("list").filter(pa.array(new)), "split": rows.column("split").filter(pa.array(new)), "key": rows.column("key").filter(pa.array(new)), "members": pa.array(np.full(new.sum(), len(size)), pa.int64()), "score": pa.array(score[new], pa.float64())})


@query(f"""WITH k AS (SELECT doc_id, source, text, CAST(n_chars % 101 AS DOUBLE) AS anchor FROM documents WHERE doc_id % 4 = 0),
a AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY source ORDER BY anchor DESC, doc_id) <= {_ANCHORS}),
n AS (SELECT doc_id, source, text, CAST(floor(coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {_CALL}) AS INTEGER) AS split FROM documents WHERE doc_id % 4 <> 0),
b AS (SELECT source, split, doc_id, length(text) AS size, CAST(NULL AS DOUBLE) AS anchor FROM n UNION ALL SELECT s.source, s.split, a.doc_id, length(a.text), a.anchor FROM (SELECT DISTINCT source, split FROM n) s JOIN a ON s.source IS NOT DISTINCT FROM a.source),
w AS (SELECT *, count(*) OVER g AS members, count(*) OVER (PARTITION BY source, split ORDER BY size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, avg(anchor) OVER g AS mean FROM b WINDOW g AS (PARTITION BY source, split))
SELECT source AS list, split, doc_id AS key, members, floor(100 * (upto / members) + coalesce(mean - 50, 0)) AS score FROM w WHERE anchor IS NULL""")
def set_scores(spark, sf):
    """Every source's documents as a shortlist, split by what a call may hold, each split scored beside the source's best known documents."""
    d = Tables(spark, sf).documents.select("doc_id", "source", "text", "n_chars")
    known = d.filter("doc_id % 4 = 0").select("doc_id", (F.col("n_chars") % 101).alias("score"))
    new, anchors = shortlist.members(d, known, "source", "doc_id", _ANCHORS)
    parts = shortlist.split(new, "source", "doc_id", [], F.length("text"), _CALL)
    return shortlist.score_sets(parts, anchors, placed_among, "list string, split int, key long, members long, score double", "source", "doc_id", "text")
