"""Keyed state across runs: scans, latest rows, upserts, misses, baselines. Pure functions of DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from siftline.operators.joins import look_up


def scan(df: DataFrame, *, source: tuple[str, str] | None = None, since: tuple[str, Column] | None = None, ids: tuple[DataFrame, str] | None = None) -> DataFrame:
    """Rows of a source, since a time, of a list of ids: predicates go down to the files, the list is a semi-join."""
    if source:
        df = df.filter(F.col(source[0]) == source[1])
    if since:
        df = df.filter(F.col(since[0]) >= since[1])
    return df.join(ids[0], ids[1], "left_semi") if ids else df


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest order columns, by max_by: a partial aggregate, no sort of whole groups."""
    row = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("_row")).select("_row.*")


def latest_conclusive(df: DataFrame, keys: Sequence[str], order: Sequence[str], status: str, inconclusive: Sequence[str]) -> DataFrame:
    return latest(df.filter(~F.col(status).isin(*inconclusive)), keys, order)


def history(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str = "history", separator: str = ">") -> DataFrame:
    """Each key's values in order, joined to one text."""
    rows = F.array_sort(F.collect_list(F.struct(*order, value.cast("string").alias("_v"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["_v"]), separator).alias(out))


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old: Sequence[str], take_new: Sequence[str]) -> DataFrame:
    """Full outer merge: keep_old columns never change once set, take_new columns follow the newer row when there is one."""
    n = new.select(F.col(key), *[F.col(c).alias(f"_n_{c}") for c in (*keep_old, *take_new)])
    both = old.select(key, *keep_old, *take_new).join(n, key, "full_outer")
    return both.select(key, *[F.coalesce(c, f"_n_{c}").alias(c) for c in keep_old], *[F.coalesce(f"_n_{c}", c).alias(c) for c in take_new])


def replace_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with new's rows in place of those of the same key."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def delete_by_key(old: DataFrame, gone: DataFrame, keys: Sequence[str], stage: tuple[str, str] | None = None) -> DataFrame:
    if stage:
        rest, old = old.filter(~F.col(stage[0]).eqNullSafe(stage[1])), old.filter(F.col(stage[0]) == stage[1])
        return rest.unionByName(old.join(gone, list(keys), "left_anti"))
    return old.join(gone, list(keys), "left_anti")


def prefixed(df: DataFrame, column: str, prefix: str, n: int = 5) -> DataFrame:
    """Values that begin with a text, the first n in order."""
    return df.select(column).filter(F.startswith(F.col(column), F.lit(prefix))).orderBy(column).limit(n)


def mark_missing(state: DataFrame, source: str, run_id: int) -> DataFrame:
    """One more miss for every row of the source that the run did not bring back."""
    missed = (F.col("source") == source) & ~F.col("last_run_id").eqNullSafe(F.lit(run_id))
    return state.withColumn("missed_runs", F.when(missed, F.col("missed_runs") + 1).otherwise(F.col("missed_runs")))


def gone(state: DataFrame, misses: int) -> DataFrame:
    """Rows missed so often; none when the number is 0 or less."""
    return state.filter(F.lit(misses > 0) & (F.col("missed_runs") >= misses))


def misses(seen: DataFrame, runs: DataFrame, key: str, run: str) -> DataFrame:
    """Runs since each key was last seen: the miss counter out of a history of complete runs."""
    last = seen.groupBy(key).agg(F.max(run).alias("last_run"))
    order = Window.orderBy(run)  # a row a run
    numbered = runs.select(run).distinct().withColumn("_n", F.row_number().over(order))
    total = numbered.agg(F.max("_n").alias("_total"))
    return look_up(last, numbered, F.col("last_run") == F.col(run), "inner").join(F.broadcast(total)).select(key, "last_run", (F.col("_total") - F.col("_n")).cast("long").alias("missed_runs"))


def last_good_run(runs: DataFrame, flagged: DataFrame, before: Column | int) -> DataFrame:
    """The newest finished, non-empty run before a number that no count-drop note names. runs: id, source, fetched, error."""
    good = runs.filter((F.col("id") < before) & F.col("error").isNull() & (F.col("fetched") > 0))
    return latest(good.join(flagged.select(F.col("run_id").alias("id")), "id", "left_anti"), ["source"], ["id"])


def count_drops(counts: DataFrame, source: str, run: str, fetched: str, least: int, ratio: float) -> DataFrame:
    """Runs that fetched under ratio of their source's previous run, where that had at least so many."""
    before = F.lag(fetched).over(Window.partitionBy(source).orderBy(run))
    return counts.withColumn("previous", before).filter((F.col("previous") >= least) & (F.col(fetched) < F.col("previous") * ratio))


def thin_descriptions(df: DataFrame, source: str, text: str, short: int, share: float, least: int) -> DataFrame:
    thin = F.count_if(F.length(F.coalesce(text, F.lit(""))) < short)
    out = df.groupBy(source).agg(F.count(F.lit(1)).alias("fetched"), thin.alias("thin"), F.count_if(F.length(F.coalesce(text, F.lit(""))) == 0).alias("missing"))
    return out.withColumn("share", F.col("thin") / F.col("fetched")).filter((F.col("fetched") >= least) & (F.col("share") >= share))


def notes_by_kind(notes: DataFrame, kind: str, order: str, examples: int = 5) -> DataFrame:
    """The first notes of each kind, how many there are, and the kinds' order of first appearance."""
    w = Window.partitionBy(kind)
    out = notes.withColumn("_r", F.row_number().over(w.orderBy(order))).withColumn("of_kind", F.count(F.lit(1)).over(w)).withColumn("first_of_kind", F.min(order).over(w))
    return out.filter(F.col("_r") <= examples).withColumnRenamed("_r", "place")


def unseen(todo: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What has no stored answer yet: the incremental cache of a scoring stage."""
    return todo.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def freshness(df: DataFrame, missing_since: str, last_open: str) -> DataFrame:
    """stale: absent since a time after which no page check found it open."""
    return df.withColumn("stale", F.col(missing_since).isNotNull() & (F.col(last_open).isNull() | (F.col(last_open) < F.col(missing_since))))
