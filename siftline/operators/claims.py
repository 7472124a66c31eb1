"""Names claimed in parallel, as one greedy pass over the owners would give them out.

An owner has candidate names in order and takes the first that is free; owners come in the order of their keys. In a round,
every owner without a name claims its first candidate that is not settled; of several claims for a name, the least owner's wins, and
the others move on to their next candidate. A name's holder gives it up to a smaller owner that comes to it later and then moves
on itself, so the outcome is that of the sequential pass (it is the stable matching in which every name prefers the smaller owner, and
that is unique). Candidates are walked at most once, so the rounds end; each round is an aggregate by name over claims.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siftline.operators.joins import look_up
from siftline.scratch import stored


def claimed(owners: DataFrame, taken: DataFrame | None = None, owner: str = "owner", candidates: str = "candidates", fold: bool = True) -> DataFrame:
    """owner, name, settled: the name of every owner; one that finds all its candidates taken shares the last one (settled: false).

    candidates: an array, at most a few names. Names are compared without regard to case if `fold`. taken: owner and name of
    earlier claims; their owners keep them, and nobody else gets them. Null and empty candidates are passed over; an owner
    without any gets a null name.
    """
    same = (lambda c: F.lower(c)) if fold else (lambda c: c)
    own = owners.select(F.col(owner).alias("owner"), F.filter(candidates, lambda c: c.isNotNull() & (c != "")).alias("names")).dropDuplicates(["owner"])
    held = None
    if taken is not None:
        held = taken.select(F.col(owner).alias("owner"), "name")
        own = own.join(held.select("owner"), "owner", "left_anti")
    places = own.select("owner", F.posexplode("names").alias("at", "name")).withColumn("folded", same(F.col("name")))
    if held is not None:
        free = look_up(places, held.select(same(F.col("name")).alias("folded")).distinct().withColumn("_taken", F.lit(True)), "folded").filter("_taken is null").drop("_taken")
    else:
        free = places
    # wanted: each owner's free candidates in order, and where it stands in them
    wanted = stored(free.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name", "folded"))), lambda r: r["folded"]).alias("folded"), F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda r: r["name"]).alias("free_names")), "wanted")
    state = wanted.withColumn("at", F.lit(0))
    while True:
        claims = state.withColumn("claim", F.get("folded", F.col("at")))
        best = claims.filter("claim is not null").groupBy("claim").agg(F.min("owner").alias("best"))
        judged = claims.join(best, "claim", "left").withColumn("lost", F.col("claim").isNotNull() & (F.col("owner") != F.col("best")))
        state = stored(judged.select("owner", "folded", "free_names", F.when(F.col("lost"), F.col("at") + 1).otherwise(F.col("at")).alias("at"), "lost"), "claims")
        if state.filter("lost").isEmpty():
            break
        state = state.drop("lost")
    got = state.select("owner", F.get("free_names", F.col("at")).alias("got"))
    out = own.join(got, "owner", "left").select("owner", F.coalesce("got", F.element_at(F.when(F.size("names") > 0, F.col("names")), -1)).alias("name"), F.col("got").isNotNull().alias("settled"))
    return out if held is None else out.unionByName(held.withColumn("settled", F.lit(True)))
