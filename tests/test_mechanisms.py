"""Places by range, as-of joins, keyed state, trims and claims against plain Python."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftline.operators import asof, audit as A, claims, evaluation as E, ordering as O, places as P, rounds as RD, selection as C
from siftline.plans import catalog
from siftline.streaming import presence as PR

SF = "/root/testdata/sf0.001"


def test_places_over_partition_edges(spark):
    """Ties reach over the edges of many small ranges, and no range has all rows."""
    r = random.Random(1)
    rows = [(i, r.choice([None, 1.0, 2.0, 2.0, 2.0, 3.5]), i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, v double, g int")
    order = [F.col("v").desc(), F.col("id").asc()]
    placed = P.placed_in_all(df, order, parts=7)
    got = {x.id: x.place for x in placed.collect()}
    want = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert got == {x[0]: i for i, x in enumerate(want, 1)}
    ranks = {x.id: x.r for x in P.average_ranks(df, "v", "r", parts=7).collect()}
    assert ranks == dict(zip([x[0] for x in rows], pd.Series([-1.0 if x[1] is None else x[1] for x in rows]).rank()))
    within = {x.id: (x.place, x.r) for x in P.average_ranks(P.placed_within(df, order, ["g"], parts=5), "v", "r", ["g"], parts=5).collect()}
    for g in range(3):
        mine = [x for x in want if x[2] == g]
        rank = dict(zip([x[0] for x in mine], pd.Series([-1.0 if x[1] is None else x[1] for x in mine]).rank()))
        assert {x[0]: within[x[0]] for x in mine} == {x[0]: (i, rank[x[0]]) for i, x in enumerate(mine, 1)}
    assert P.placed_in_all(df.limit(0), order).count() == 0 == P.average_ranks(df.limit(0), "v", "r").count()


def test_ranks_within_groups_shuffle_the_rows_once(spark):
    """Only groups above the bound are dealt by range and joined; they get the same ranks."""
    r = random.Random(2)
    values = [None, float("nan"), -0.0, 0.0, 1.5, 2.5, 2.5]
    rows = [(i, r.choice([None, 1, 2, 2, 2, 2]), r.choice(values), float(r.randrange(9))) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g int, x double, y double").repartition(5)
    rank = lambda most: P.average_ranks(df, ["x", "y"], ["rx", "ry"], ["g"], parts=5, group_rows=most)
    plan = rank(400)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    place = lambda v: (v is not None, v != v, v or 0) if v is None or v == v else (True, True, 0)
    mean = lambda mine, v: sum(place(o) < place(v) for o in mine) + (sum(place(o) == place(v) for o in mine) + 1) / 2
    want = {i: tuple(mean([o[c] for o in rows if o[1] == g], v) for c, v in ((2, x), (3, y))) for i, g, x, y in rows}
    for most in (400, 150, 0):
        assert {a.id: (a.rx, a.ry) for a in rank(most).collect()} == want
    whole = {a.g: (a.n, a.rho) for a in A.spearman(df, "x", "y", ["g"]).collect()}
    for g in (None, 1, 2):
        mine = pd.DataFrame([want[o[0]] for o in rows if o[1] == g])
        assert whole[g][0] == len(mine) and abs(whole[g][1] - mine[0].corr(mine[1])) < 1e-9


def test_running_counts_by_range(spark):
    counts = spark.createDataFrame([(i, (i * 7) % 5) for i in range(50)], "k int, n long").repartition(6)
    got = {r.k: r.before for r in P.running_counts(counts, ["k"], "n", "before", parts=4).collect()}
    total = 0
    for k in range(50):
        assert got[k] == total
        total += (k * 7) % 5


def test_every_nth_and_rank_correlation_of_all_rows(spark):
    df = spark.createDataFrame([(i, float(i % 4), float((i * 3) % 5)) for i in range(40)], "id int, x double, y double").repartition(5)
    assert sorted(r.id for r in O.every_nth(df, [F.col("id")], 7).collect()) == list(range(0, 40, 7))
    x, y = ([float(i % 4) for i in range(40)], [float((i * 3) % 5) for i in range(40)])
    assert abs(A.spearman(df, "x", "y").first().rho - pd.Series(x).rank().corr(pd.Series(y).rank())) < 1e-9
    assert A.spearman(df.limit(1), "x", "y").first().rho is None


def test_tied_decisions_go_to_the_later_user(spark):
    d = spark.createDataFrame([("j", u, s, 5, ["level"]) for u, s in (("alex", "skipped"), ("anna", "applied"), ("adam", "closed"))], "job_id string, user string, status string, decided_at int, reasons array<string>")
    for order in ("user", "status"):
        assert [(r.user, r.good) for r in E.labels(d.orderBy(order)).collect()] == [("anna", True)]


def test_as_of_over_partition_edges(spark):
    r = random.Random(3)
    left = [(i, r.choice(["hot", "hot", "a", "b", None]), r.choice([None, *range(40)])) for i in range(200)]
    right = [(r.choice(["hot", "hot", "a", "c", None]), r.choice([None, *range(40)]), n, f"v{n}") for n in range(120)]
    schema = "key string, t int, n int, v string"
    l, rt = spark.createDataFrame(left, "id int, key string, t int"), spark.createDataFrame(right, schema)
    for parts in (1, 9):
        got = {x.id: x.v for x in asof.as_of(l, rt.withColumnRenamed("t", "rt"), "key", "t", "rt", ["v"], ["n"], parts).collect()}
        for i, k, t in left:
            met = [(x[1], x[2], x[3]) for x in right if x[0] is not None and x[0] == k and x[1] is not None and t is not None and x[1] <= t]
            assert got[i] == (max(met)[2] if met else None), (i, k, t)
    nothing = asof.as_of(l, rt.limit(0).withColumnRenamed("t", "rt"), "key", "t", "rt", ["v"])
    assert nothing.count() == 200 and nothing.filter("v is not null").count() == 0


def test_staleness(spark):
    df = spark.createDataFrame([(None, None), (None, 3), (3, None), (3, 2), (3, 3), (3, 4)], "m int, o int")
    assert [r[0] for r in df.select(asof.stale(F.col("m"), F.col("o"))).collect()] == [False, False, True, True, False, False]
    checks = spark.createDataFrame([("a", 1, "open"), ("a", 2, "closed"), ("b", 1, "closed"), ("b", 2, "open"), ("c", 1, "unknown")], "id string, at int, status string")
    got = {r.id: (r.checked_at, r.status, r.opened_at, r.shown) for r in asof.last_check(checks, "id", "at", "status").collect()}
    assert got == {"a": (2, "closed", 1, True), "b": (2, "open", 2, False), "c": (1, "unknown", None, True)}


def test_trims_equal_a_sequential_walk(spark):
    r = random.Random(5)
    rows, budgets = [], []
    for s in range(60):
        for slot in range(r.randint(1, 3)):
            least = r.choice([0, 1, 2])
            for n in range(r.randint(1, 5)):
                rows.append((f"p{s}", f"s{slot}", slot, f"{slot}-{n}", n, float(r.randint(1, 9)), 1.0, least, r.choice([None, *range(6)])))
        budgets.append((f"p{s}", float(r.randint(5, 40)), r.choice([None, 0.0, 3.0])))
    chosen = spark.createDataFrame(rows, "selection string, slot string, slot_order int, part_id string, position int, height double, header double, least int, drop_order int")
    out = C.trimmed(chosen, spark.createDataFrame(budgets, "selection string, budget double, error double"))
    got = {x.selection: ([(d.slot, d.part_id) for d in x.dropped], x.height, x.fits) for x in out.collect()}
    for s, budget, error in budgets:
        mine = [x for x in rows if x[0] == s]
        left = {x[1]: sum(y[1] == x[1] for y in mine) for x in mine}
        height, gone = sum(x[5] for x in mine), []
        named = sorted((x for x in mine if x[8] is not None), key=lambda x: (x[8], x[1], x[3]))
        rest = sorted((x for x in mine if x[8] is None), key=lambda x: (-x[2], -x[4], x[1], x[3]))
        for x in named + rest:
            if height > budget - (error or 0) and left[x[1]] > x[7]:
                gone.append((x[1], x[3]))
                left[x[1]] -= 1
                height -= x[5]
        assert got[s] == (gone, height, height <= budget - (error or 0)), s
    assert C.kept_parts(chosen, out).count() == len(rows) - sum(len(g[0]) for g in got.values())


def sequential(owners, taken):
    held = {n.lower(): o for o, n in taken.items()}
    out = dict(taken)
    for o, names in sorted(owners.items()):
        if o in taken:
            continue
        names = [n for n in names if n]
        free = next((n for n in names if n.lower() not in held), None)
        if free is not None:
            held[free.lower()] = o
        out[o] = free if free is not None else (names[-1] if names else None)
    return out


def test_claims_equal_the_sequential_pass(spark):
    for seed in range(3):
        r = random.Random(seed)
        owners = {i: [r.choice("AaBbCcDdEe") + r.choice(["", "", "1"]) for _ in range(r.randint(0, 4))] for i in range(60)}
        owners[60], owners[61] = [None, "", "x"], ["X", "y"]
        taken = {100: "a", 3: "b"}
        df = spark.createDataFrame(list(owners.items()), "owner int, candidates array<string>").repartition(4)
        held = spark.createDataFrame(list(taken.items()), "owner int, name string")
        assert {x.owner: x.name for x in claims.claimed(df, held).collect()} == sequential(owners, taken)
        got = claims.claimed(df).collect()
        assert {x.owner: x.name for x in got} == sequential(owners, {})
        won = [x.name.lower() for x in got if x.settled]
        assert len(won) == len(set(won))


def test_claimed_names_of_documents(spark):
    d = pd.read_parquet(f"{SF}/documents.parquet")
    said = lambda *x: "-".join(str(y) for y in x if y is not None)
    owners = {r.doc_id: [said(r.source, r.doc_id % 7), said(r.lang, r.n_chars % 100), said(r.source, r.lang, r.n_chars)] for r in d.itertuples()}
    assert {x.owner: x.name for x in catalog.QUERIES["claimed_names"](spark, SF).collect()} == sequential(owners, {})


def test_reading_stops_for_each_reason(spark):
    queue = spark.createDataFrame([(i, i + 1, float(100 - i)) for i in range(20)], "id int, place int, score double")
    read = lambda **more: RD.read_windows(queue, lambda d: d, "id", **{"window": 5, "top": 3, "patience": 10, "budget": 1000, **more})
    a = read()
    assert (a.why, a.rounds, a.rows.count(), [r.id for r in a.best.orderBy("id").collect()]) == ("patience", 3, 15, [0, 1, 2])
    b = read(budget=8)
    assert (b.why, b.rounds, b.rows.count()) == ("budget", 2, 10)
    c = read(patience=99)
    assert (c.why, c.rounds, c.rows.count(), {r.round for r in c.rows.collect()}) == ("queue empty", 4, 20, {0, 1, 2, 3})
    late = queue.withColumn("score", F.col("place").cast("double"))
    assert RD.read_windows(late, lambda d: d, "id", 5, 3, 5, 1000).why == "queue empty"  # somebody enters in every window
    assert RD.read_windows(queue.limit(0), lambda d: d, "id", 5, 3, 5, 1000).why == "queue empty"


def test_refining_goes_on_until_the_top_is_refined(spark):
    rows = spark.createDataFrame([(i, float(100 - i)) for i in range(12)], "id int, prior double")
    halve = lambda d: d.withColumn("score", F.when(F.col("id") < 4, F.col("prior") / 2).otherwise(F.col("prior") - 1))
    out = RD.refine_top(rows, halve, "id", 3, 9)
    # 0, 1, 2 fall, then 3 falls and 4, 5 stay, then 6
    assert out.why == "refined" and sorted(r.id for r in out.best.collect()) == [4, 5, 6] and {r.id: r.round for r in out.rows.collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 2}
    assert RD.refine_top(rows, halve, "id", 3, 1).why == "passes" and RD.refine_top(rows.limit(0), halve, "id", 3, 1).why == "nothing to refine"
    bounds = [5.0, 4.0, 4.0, 1.0]
    assert RD.until_boundary_holds(lambda n: (n, bounds[n]), 9) == (2, 3) and RD.until_boundary_holds(lambda n: (n, -n), 4) == (3, 4)


def test_refining_reads_the_queue_once(spark, monkeypatch):
    """Many passes, which outgrow the head of the queue several times: what a pass over all rows gives, from one reading."""
    monkeypatch.setattr(RD, "REACH", 2)
    r = random.Random(5)
    prior = {i: float(r.randrange(60)) for i in range(120)}
    lower = {i: p / 2 if i % 3 else p - 1 for i, p in prior.items()}
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = spark.createDataFrame(list(prior.items()), "id int, prior double").mapInPandas(counted, "id int, prior double")
    out = RD.refine_top(rows, lambda d: d.withColumn("score", F.when(F.col("id") % 3 != 0, F.col("prior") / 2).otherwise(F.col("prior") - 1)), "id", 4, 99)
    done, n = {}, 0
    while True:
        best = sorted(prior, key=lambda i: (-(lower if i in done else prior)[i], i))[:4]
        new = [i for i in best if i not in done]
        if not new:
            break
        done, n = done | dict.fromkeys(new, n), n + 1
    assert n > 4 and (out.why, out.rounds) == ("refined", n) and {x.id: x.round for x in out.rows.collect()} == done and {x.id for x in out.best.collect()} == set(best)
    assert read.value == 120


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    PR.with_rocks(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_presence_goes_on_after_a_restart(spark, tmp_path, rocks):
    """Three runs of the query: misses are counted by timers, a sighting resets them, and state is found again."""
    start = datetime(2024, 1, 1, 6)
    day = lambda n, hour=0: start + timedelta(days=n, hours=hour)
    slices = [
        [("a", day(0)), ("b", day(0)), ("a", day(1)), ("c", day(1)), ("clock", day(2))],
        [("clock", day(5)), ("c", day(5)), ("a", day(5, 1))],
        [("b", day(8)), ("clock", day(8)), (None, day(8)), ("d", None)],
    ]
    told = []
    for rows in slices:
        spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("key string, ts timestamp").parquet(f"{tmp_path}/in")
        PR.run_to_end(PR.presence(stream, "key", "ts", 3), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        told.append({r.key: (r.sightings, r.missed_runs, r.down, r.first_seen.day, r.last_seen.day) for r in PR.newest(spark, f"{tmp_path}/out", "key").collect()})
    assert told[0] == {"a": (2, 1, False, 1, 2), "b": (1, 2, False, 1, 1), "c": (1, 1, False, 2, 2), "clock": (1, 0, False, 3, 3)}
    assert told[1] == {"a": (3, 0, False, 1, 6), "b": (1, 3, True, 1, 1), "c": (2, 0, False, 2, 6), "clock": (2, 0, False, 3, 6)}
    assert told[2] == {"a": (3, 3, True, 1, 6), "b": (2, 0, False, 1, 9), "c": (2, 3, True, 2, 6), "clock": (3, 0, False, 3, 9)}


def test_presence_keeps_a_table_a_bucket(spark, tmp_path, rocks):
    """Many keys in seven buckets: seven rows of state, and what a count by hand gives."""
    r, start, period, limit = random.Random(4), datetime(2024, 1, 1), 86_400, 4
    seconds = {i: sorted(r.randrange(i * 7 * period, (i + 1) * 7 * period) for _ in range(300)) for i in range(3)}
    rows = {i: [(r.randrange(150), s) for s in of] for i, of in seconds.items()}
    for i in range(3):
        spark.createDataFrame([(k, start + timedelta(seconds=s)) for k, s in rows[i]], "key int, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("key int, ts timestamp").parquet(f"{tmp_path}/in")
        PR.run_to_end(PR.presence(stream, "key", "ts", limit, buckets=7), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert spark.read.format("statestore").load(f"{tmp_path}/checkpoint").count() == 7
    seen = {}
    for k, s in (x for i in range(3) for x in rows[i]):
        seen.setdefault(k, []).append(s)
    now = max(seconds[2]) // period
    want = {k: (len(x), start + timedelta(seconds=min(x)), start + timedelta(seconds=max(x)), min(limit, now - max(x) // period)) for k, x in seen.items()}
    got = PR.newest(spark, f"{tmp_path}/out", "key").collect()
    assert {x.key: (x.sightings, x.first_seen, x.last_seen, x.missed_runs) for x in got} == want and all(x.down == (x.missed_runs == limit) for x in got)


def test_dictionaries_find_what_single_patterns_find(spark):
    """Names that begin others, overlap, stand in words, and differ in case."""
    import re

    from siftline.functions import dictionary as W

    names = {"a": ["ab", "abc d"], "b": ["abc", "c++"], "c": ["d e", "x"], "d": ["ab"], "e": ["été", "straße"]}
    r = random.Random(2)
    texts = [None, "", "abc d e", "xabc", "ABC D E", "c++x", "é été", "STRASSE straßen", "ſx", "x_ab ab_"] + ["".join(r.choice("abcdex +é_-") for _ in range(r.randint(1, 30))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x.i: x.c for x in df.select("i", W.codes_in(F.lower("t"), names).alias("c")).collect()}
    some = {x.i for x in df.filter(F.lower("t").rlike(W.mentions(n for v in names.values() for n in v))).collect()}
    for i, t in enumerate(texts):
        want = None if t is None else sorted(c for c, n in names.items() if any(re.search(r"(?i)(?<!\w)" + re.escape(x), t.lower()) for x in n))
        assert got[i] == want, (t, got[i], want)
        assert (i in some) == bool(want)
    assert W.tree_pattern(["ab", "abc", "b"]) == "(?:ab(?:c)?|b)"


def test_appends_cost_their_own_rows_and_failed_ones_leave_nothing(spark, tmp_path):
    from siftline.sources import append_log as LG

    root = f"{tmp_path}/log"
    schema = "id long, note string"
    assert LG.next_id(spark, root) == 1 and LG.read_log(spark, root, schema).count() == 0
    LG.append(spark.createDataFrame([(1, "a"), (2, None)], schema).repartition(2), root, "id")
    files = lambda: {p.name: p.stat().st_mtime_ns for p in (tmp_path / "log/data").glob("*/*.parquet")}
    before = files()
    LG.append(spark.createDataFrame([(7, "b")], schema), root, "id")
    after = files()
    assert before.items() <= after.items() and len(after) == len(before) + 1
    assert sorted(map(tuple, LG.read_log(spark, root, schema).collect())) == [(1, "a"), (2, None), (7, "b")] and LG.next_id(spark, root) == 8
    broken = spark.range(100, 104, 1, 4).select("id", F.when(F.col("id") == 103, F.raise_error(F.lit("no"))).otherwise("x").alias("note"))
    with pytest.raises(Exception):
        LG.append(broken, root, "id")
    assert LG.read_log(spark, root, schema).count() == 3
    LG.clean(spark, root)  # of tasks that the failure overtook
    assert LG.left_over(spark, root) == [] and files().keys() == after.keys() and LG.read_log(spark, root, schema).count() == 3
    LG.append(spark.createDataFrame([], schema), root)
    assert LG.read_log(spark, root, schema).count() == 3
    with pytest.raises(Exception, match="appended"):
        spark.createDataFrame([(1, "a")], schema).write.format(LG.FORMAT).mode("overwrite").option("path", root).save()


def test_hosts_are_read_in_turn(spark, tmp_path):
    """No two reads of a host within the delay, whatever the number of tasks; other hosts do not wait; filters decide what is read."""
    from siftline.sources import connector as N

    urls = [f"http://{h}.example/{n}" for n in range(4) for h in ("a", "b", "A")]
    for u in urls:
        (tmp_path / u.split("://")[1].replace("/", "_")).write_text(u)
    for turn in ("all", "some"):
        (tmp_path / turn).mkdir()
    df = N.fetch(spark, urls, root=str(tmp_path), delay="0.2", log=str(tmp_path / "all"))
    assert df.rdd.getNumPartitions() == 2 and sorted(r.payload for r in df.collect()) == sorted(urls)
    for f in (tmp_path / "all").iterdir():
        lines = [x.split() for x in f.read_text().splitlines()]
        times = [float(t) for _, t, _ in lines]
        assert len({h for h, _, _ in lines}) == 1 and all(b - a >= 0.19 for a, b in zip(times, times[1:])) and [u for _, _, u in lines] == [u for u in urls if N.host_of(u) == lines[0][0]]
    few = N.fetch(spark, urls, root=str(tmp_path), log=str(tmp_path / "some")).filter(F.col("url").isin(urls[0], urls[4]))
    assert {r.url for r in few.collect()} == {urls[0], urls[4]}
    assert sum(len(f.read_text().splitlines()) for f in (tmp_path / "some").iterdir()) == 2


def test_shortlists_are_split_and_scored_as_sets(spark):
    import pyarrow as pa

    from siftline.operators import shortlist as SL

    rows = [(i, "hot" if i % 4 else None, "x" * (i % 5 + 1)) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, g string, t string").repartition(5)
    known = spark.createDataFrame([(i, float(i % 7)) for i in range(0, 80, 5)], "id int, score double")
    new, anchors = SL.members(df, known, "g", "id", 2)
    assert {r.id for r in new.collect()} == {i for i in range(80) if i % 5}
    for g in ("hot", None):
        mine = sorted((i for i, h, _ in rows if h == g and i % 5 == 0), key=lambda i: (-(i % 7), i))[:2]
        assert sorted(r.id for r in anchors.collect() if r.g == g) == sorted(mine)
    parts = SL.split(new, "g", "id", [], F.length("t"), 20)
    got, before = {r.id: r.split for r in parts.collect()}, {}
    for i, g, t in rows:
        if i % 5:
            assert got[i] == before.get(g, 0) // 20
            before[g] = before.get(g, 0) + len(t)

    def count(t: pa.Table) -> pa.Table:
        return pa.table({"list": t.column("list").slice(0, 1), "n": pa.array([t.num_rows], pa.int64()), "anchors": pa.array([t.num_rows - t.column("anchor").null_count], pa.int64())})

    out = [tuple(r) for r in SL.score_sets(parts, anchors, count, "list string, n long, anchors long", "g", "id", "t").collect()]
    assert len(out) == len({(g, got[i]) for i, g, _ in rows if i in got}) and all(a == 2 for _, _, a in out) and sum(n - a for _, n, a in out) == len(got)
    assert SL.members(df, known, "g", "id", 2, again=True)[1].count() == 0
