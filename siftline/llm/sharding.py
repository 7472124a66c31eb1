"""Sharding by balanced label propagation.

Documents are linked when their texts are equal, or through any other key given. Linked documents start on shards in
turn, which is balanced. In each round the shards of every key's documents are counted, and the documents of a shard
ask to move to the shard with most of their key that it does not fill; keys of over half a shard claim one each, those
with most there first. Requests are granted as swaps and longer cycles
between shards and as paths into room, in a seeded order; those left over are exchanged for whole keys of the shard
that they ask for; so no shard passes its quota of documents. Rounds end when two in a row bring nothing together; the
share of linked documents still cut is logged. Documents without links then fill the shards up to quotas that differ
by one at most (law "rows"). Documents of one key on one shard are interchangeable, so rounds run on counts (key,
shard, documents), never on pairs; a key may be larger than a shard and is then split.

Defined cases: a null text is linked with nothing, has 8 bytes and the checksum of no bytes (0); repeated rows are separate, linked documents; an
empty table gives an empty table.
"""

from __future__ import annotations

import logging
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from siftline.llm._common import dropped, keyed_hash, running, small, stored

SHARDS, SEED = 24, 7
log = logging.getLogger(__name__)


def text_key(text: Column) -> Column:
    """Key of equal texts: two hashes of 64 bits and the length; null for null."""
    return F.when(text.isNotNull(), F.concat_ws(":", F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(1), text)), F.length(text)))


def granted_flows(asked: list[list[int]], room: list[int]) -> list[list[int]]:
    """How much of what is asked from shard to shard can move at once: shortest cycles of requests (swaps first) and paths into room, until none is left."""
    left, room = [list(r) for r in asked], list(room)
    n = len(room)
    out = [[0] * n for _ in range(n)]
    for length in range(1, n + 1):
        for start in range(n):
            while path := _shortest(left, room, start, length):
                ends = path[-1] != start
                steps = list(zip(path, path[1:]))
                moved = min([left[a][b] for a, b in steps] + ([room[path[-1]]] if ends else []))
                for a, b in steps:
                    left[a][b] -= moved
                    out[a][b] += moved
                if ends:
                    room[path[-1]] -= moved
                    room[start] += moved
    return out


def _shortest(left: list[list[int]], room: list[int], start: int, most: int) -> list[int] | None:
    """A shortest path of requests, of at most so many steps, from start to a shard with room or back to start."""
    paths, seen = [[start]], set()
    for _ in range(most):
        longer = []
        for path in paths:
            for b, asked in enumerate(left[path[-1]]):
                if asked and b not in seen:
                    if b == start or room[b]:
                        return [*path, b]
                    seen.add(b)
                    longer.append([*path, b])
        paths = longer
    return None


def _of_pair(flows: list[list[int]], a: Column, b: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x).cast("long") for row in flows for x in row]), a * len(flows) + b + 1)


def _summed(moves: DataFrame, shards: int) -> list[list[int]]:
    """Documents by (from, to): a row a pair of shards."""
    out = [[0] * shards for _ in range(shards)]
    for r in moves.groupBy("shard", "goal").agg(F.sum("n").alias("n")).collect():
        out[r["shard"]][r["goal"]] = r["n"]
    return out


def _claims(state: DataFrame, least: float) -> list[tuple[str, int]]:
    """(key, shard) for keys of more documents than least, half a quota, so fewer than two a shard: the shard with most of it that no such key with more claims."""
    large = state.groupBy("k").agg(F.sum("n").alias("of_key")).filter(F.col("of_key") > max(1, least)).select("k")
    parts = sorted(state.join(F.broadcast(large), "k").collect(), key=lambda r: (-r["n"], r["k"], r["shard"]))
    claims: dict[str, int] = {}
    for r in parts:
        if r["k"] not in claims and r["shard"] not in claims.values():
            claims[r["k"]] = r["shard"]
    return list(claims.items())


def _round(state: DataFrame, quotas: list[int], room: list[int], turn: int) -> DataFrame:
    """One round: (k, shard, n) after the granted moves. room: by shard, documents that it may still take."""
    shards = len(quotas)
    tie = F.xxhash64(F.lit(turn), "k", "shard")
    open_ = F.col("n") < F.element_at(F.array(*[F.lit(q).cast("long") for q in quotas]), F.col("shard") + 1)  # a key's full shard takes no more of it
    parts = Window.partitionBy("k")
    ranked = parts.orderBy(F.desc("n"), tie)
    several = state.filter(open_).withColumn("_r", F.row_number().over(ranked))
    goal = several.filter("_r = 1").select("k", F.col("shard").alias("goal"))
    if claims := _claims(state.filter(open_), min(quotas) / 2):
        claimed = state.sparkSession.createDataFrame(claims, "k string, _claimed int")
        goal = goal.join(F.broadcast(claimed), "k", "left").select("k", F.coalesce("_claimed", "goal").alias("goal"))  # fewer than two rows a shard
    asks = stored(several.join(goal, "k").filter("shard <> goal").select("k", "shard", "n", "goal"), "asks")
    total = asks.count()
    asked = _summed(asks, shards)
    flows = granted_flows(asked, room)

    # What stays asked is exchanged for whole keys of the shard that is asked.
    over = [[asked[a][b] - flows[a][b] for b in range(shards)] for a in range(shards)]
    takers = [[a for a in range(shards) if over[a][b]] for b in range(shards)]
    back = None
    if any(takers):
        lists = F.element_at(F.array(*[F.array(*[F.lit(a) for a in t]).cast("array<int>") for t in takers]), F.col("shard") + 1)
        whole = state.withColumn("_parts", F.count(F.lit(1)).over(parts)).filter("_parts = 1").withColumn("_to", lists).filter(F.size("_to") > 0)
        offers = whole.select("k", "shard", "n", F.get("_to", F.pmod(tie, F.size("_to")).cast("int")).alias("goal"))
        offers = stored(offers.filter(F.col("n") <= _of_pair(over, F.col("goal"), F.col("shard"))), "offers")
        laid = running(offers, ["shard", "goal"], F.col("n"), tie, [F.col("k")], offers.count(), "_before")
        back = stored(laid.filter(F.col("_before") + F.col("n") <= _of_pair(over, F.col("goal"), F.col("shard"))).select("k", "shard", "goal", F.col("n").alias("moved")), "exchanged")
        given = _summed(back.withColumnRenamed("moved", "n"), shards)
        flows = [[flows[a][b] + given[b][a] for b in range(shards)] for a in range(shards)]

    laid = running(asks, ["shard", "goal"], F.col("n"), tie, [F.col("k")], total, "_before")
    moves = laid.withColumn("moved", F.greatest(F.lit(0), F.least(F.col("n"), _of_pair(flows, F.col("shard"), F.col("goal")) - F.col("_before")))).filter("moved > 0").select("k", "shard", "goal", "moved")
    moves = moves if back is None else moves.unionByName(back)
    changes = moves.select("k", "shard", (-F.col("moved")).alias("n")).unionByName(moves.select("k", F.col("goal").alias("shard"), F.col("moved").alias("n")))
    return state.unionByName(changes).groupBy("k", "shard").agg(F.sum("n").alias("n")).filter("n > 0")


def propagate(counts: DataFrame, quotas: list[int], rounds: int | None = None) -> tuple[DataFrame, list[dict]]:
    """counts(k, shard, n) after label propagation under quotas, until two rounds in a row bring nothing together (or for so many rounds).

    For each round: its loads, the documents beside their key's largest part, and the share of them that is cut: how
    often another document of the same key, or the document itself, drawn at random, is on another shard.
    """
    state, told = stored(counts, "labels"), []
    for turn in count():
        loads = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
        keys = state.groupBy("k").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum(F.col("n") * F.col("n")).alias("squares"))
        linked, apart, cut = keys.agg(F.sum("n"), F.sum(F.col("n") - F.col("most")), F.sum((F.col("n") - F.col("squares") / F.col("n")).cast("decimal(38,6)"))).first()
        told.append({"loads": loads, "apart": apart or 0, "cut": float(cut or 0) / (linked or 1)})
        log.info("round %d: %d of %d linked documents apart, cut share %.6f", turn, apart or 0, linked or 0, told[-1]["cut"])
        if turn == rounds or not apart or (turn > 1 and told[-1]["cut"] >= told[-3]["cut"]):
            break
        room = [max(0, q - loads.get(s, 0)) for s, q in enumerate(quotas)]
        after = stored(_round(state, quotas, room, turn), "labels")
        dropped(state)
        state = after
    return state, told


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None, doc_id: str = "doc_id", text: str = "text", key: Column | None = None, seed: int = SEED) -> DataFrame:
    """Every document's size, text_crc32, law, shard and slot. key: links documents of equal values (by default the text)."""
    link = text_key(F.col(text)) if key is None else key
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    base = docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), link.cast("string").alias("k"))
    base = base.withColumn("h", keyed_hash(seed, F.col("doc_id").cast("string"), "text_crc32", "size"))
    base = stored(base, "nodes")
    ties = [F.col("doc_id"), F.col("size")]
    total = base.count()
    sizes = base.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("of_key")).filter("of_key > 1")
    sizes = stored(sizes, "keys")
    n_keys = sizes.count()
    marked = base.join(small(sizes, n_keys), "k", "left")
    quotas = [total // shards + (s < total % shards) for s in range(shards)]

    # Linked documents: their number within the key, and shards in turn to begin with.
    linked = marked.filter("of_key is not null")
    n_linked = sizes.agg(F.coalesce(F.sum("of_key"), F.lit(0))).first()[0]
    linked = running(linked, ["k"], F.lit(1).cast("long"), F.col("h"), ties, n_linked, "ordinal")
    linked = stored(running(linked.withColumn("_one", F.lit(1)), ["_one"], F.lit(1).cast("long"), F.col("h"), ties, n_linked, "turn").drop("_one"), "linked")
    counts = linked.groupBy("k", F.pmod("turn", F.lit(shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    state, told = propagate(counts, quotas, rounds)
    ends = Window.partitionBy("k").orderBy("shard")
    spans = state.withColumn("end", F.sum("n").over(ends)).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("spans"))  # at most a row a shard
    placed = linked.join(small(spans, n_keys), "k").withColumn("shard", F.element_at(F.filter("spans", lambda s: s["end"] > F.col("ordinal")), 1)["shard"])

    # The others fill what is left of the quotas.
    left = [q - told[-1]["loads"].get(s, 0) for s, q in enumerate(quotas)]
    marks = [sum(left[: s + 1]) for s in range(shards)]
    free = running(marked.filter("of_key is null").withColumn("_one", F.lit(1)), ["_one"], F.lit(1).cast("long"), F.col("h"), ties, max(1, total - n_linked), "ordinal")
    free = free.withColumn("shard", F.size(F.filter(F.array(*[F.lit(m).cast("long") for m in marks]), lambda m: m <= F.col("ordinal"))).cast("int"))
    keep = ["doc_id", "size", "text_crc32", "h", "shard"]
    both = stored(placed.select(*keep).unionByName(free.select(*keep)), "placed")
    out = running(both, ["shard"], F.lit(1).cast("long"), F.col("h"), ties, total, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
