"""Exact n-gram Jaccard join that follows set relations.

A document's set is its distinct K-word shingles; two sets link when 100 |a ∩ b| >= SIMILAR |a ∪ b|. Equal sets are one
class. Two sets that link share one of the first n - least overlap + 1 shingles (the prefix) of each under any order of
all shingles. The order here puts rare shingles first, and is found in two steps. Shingles with hashes in a low range
are counted in all sets; one in more than LIST sets is frequent. Most sets have their whole prefix in rare shingles of
the low range, in the order of hashes. The others are read again: their remaining shingles are counted among them, and
their prefix goes on with rare shingles of those, then with frequent ones by their counts. So text that many documents
share is in a prefix only where a document has little else.

Index skipping. A list holds the sets of a shingle by size and place in the prefix. It is read in blocks of BLOCK sets:
a pair of blocks whose sizes or places cannot reach the threshold is skipped before any pair of sets is formed. Lists
of rare shingles have LIST sets at most and are read by themselves.

Answer skipping. Lists of frequent shingles are dealt out by their counts, and each set is read against leaders only,
in the lists of its FIRST rarest ones. Sets that are linked by then share their answer (a component). For the answers across components, the sets of a
list, component, size band and place band stand behind one of them: its distances to others, less the largest distances
of those behind it, decide whether they can have answers in common at all, and only then sets are compared one by one.
No link is lost: a pair that shares a prefix shingle and may reach the threshold is verified exactly, or is in one
component already.

Defined cases: null and wordless texts have an empty set, which links with nothing (also not with each other); a text
of fewer than K words has its whole sequence as one shingle; a null doc_id takes part, a component is named by its
smallest doc_id that is not null; repeated rows are equal sets. Hashes stand for words and shingles (64 bits) and for
sets (128 bits and the size).
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from siftline.llm import _bytes
from siftline.llm._common import bound_batches, dropped, small, stored

SHINGLE, SIMILAR = 4, 85
#: The low range of hashes, as so many times a prefix's share of all.
REACH = 1.35
#: Shingles in more sets than this are frequent; BLOCK sets of a list are skipped at once.
LIST, BLOCK = 64, 16
#: A frequent shingle's list is dealt to tasks of about so many sets, where each set is read against LEADERS leaders.
DEALT, LEADERS = 4_096, 3
#: Lists of frequent shingles that a set is read in first: the rarest of them.
FIRST = 2
#: Powers of two: bits of the parity sketch that bounds the difference of two sets from below. All have a brief one of LEAST_BITS.
LEAST_BITS, MOST_BITS = 9, 20
#: Postings that a task handles at a time, and pairs formed at once.
POSTINGS, PAIRS = 1 << 16, 1 << 20
#: Pairs of numbers (16 bytes) that may be broadcast.
NUMBERS = 500_000
#: Tasks for tables of short rows that are handled again and again, and rows of each beyond.
TASKS, TASK_ROWS = 8, 100_000
#: Bands of places in the prefix.
PLACES = 4

def doc_sets(column: pa.Array, k: int = SHINGLE):
    """(row, set as a sorted array) for every text of a column; an empty set for a text without words."""
    for lo, hi, buf, offs in _bytes.chunks(column):
        starts, ends, first = _bytes.words(buf, offs)
        h = _bytes.word_hashes(buf, starts, ends)
        s, at = _bytes.shingles(h, first, k)
        cut = np.searchsorted(at, first)
        for i in range(hi - lo):
            n = first[i + 1] - first[i]
            if n >= k:
                yield lo + i, np.unique(s[cut[i] : cut[i + 1]])
            elif n:
                yield lo + i, np.array([_bytes.whole(h[first[i] : first[i + 1]])], np.uint64)
            else:
                yield lo + i, np.zeros(0, np.uint64)


def least_overlap(n: int, similar: int) -> int:
    return -(-n * similar // 100)


def sketch(s: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the number of members in each of so many bins: two sets differ in at least as many members as sketches in bits."""
    bins = (s >> np.uint64(40)).astype(np.int64) & (bits - 1)
    return np.packbits((np.bincount(bins, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def sketch_bits(n: int) -> int:
    """Bits for the sketch of a set: the power of two at or above its size, within bounds."""
    return 1 << min(MOST_BITS, max(LEAST_BITS, (n - 1).bit_length()))


def folded(words: np.ndarray, length: int) -> np.ndarray:
    """Sketches (rows of words) as those of fewer bins: halves fall together."""
    while words.shape[1] > length:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def _low_end(similar: int) -> np.uint64:
    return np.uint64(min(1.0, REACH * (100 - similar) / 100) * ((1 << 64) - 2048))


def set_table(docs: DataFrame, k: int, similar: int) -> DataFrame:
    """The columns of docs before its text, n, c (class of equal sets, null for empty ones), c8 (64 bits of it, for lists), sketch, brief sketch, and the shingles of the low range."""
    about = [c for c in docs.columns if c != "text"]
    top = _low_end(similar)

    def run(batches):
        for b in batches:
            n, c, c8, sk, brief, low = [], [], [], [], [], []
            for _, s in doc_sets(b.column(len(about)), k):
                n.append(len(s))
                if not len(s):
                    c.append(None), c8.append(None), sk.append(None), brief.append(None), low.append(None)
                    continue
                c.append(class_of(s))
                c8.append(int(c[-1][:16], 16) - (1 << 63))
                sk.append(sketch(s, sketch_bits(len(s))))
                brief.append(folded(sk[-1][None, :], 1 << LEAST_BITS - 6)[0])
                low.append(s[: np.searchsorted(s, top)].view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(about)], pa.array(n, pa.int64()), pa.array(c, pa.string()), pa.array(c8, pa.int64()), pa.array(sk, pa.list_(pa.int64())), pa.array(brief, pa.list_(pa.int64())), pa.array(low, pa.list_(pa.int64()))], names=[*about, "n", "c", "c8", "sketch", "brief", "low"])

    schema = docs.select(*about).schema.add("n", "long").add("c", "string").add("c8", "long").add("sketch", ArrayType(LongType())).add("brief", ArrayType(LongType())).add("low", ArrayType(LongType()))
    return stored(docs.select(*about, "text").mapInArrow(run, schema), "sets")


def class_of(s: np.ndarray) -> str:
    """Name of the class of sets equal to s: 128 bits of its members in order, and its size."""
    with np.errstate(over="ignore"):
        a = np.bitwise_xor.reduce(_bytes.mix(s))
        b = np.add.reduce(_bytes.mix(s ^ np.uint64(0x5851F42D4C957F2D)))
    return f"{int(a):016x}{int(b):016x}{len(s):x}"


def _again(docs: DataFrame, need: DataFrame, k: int) -> DataFrame:
    """(c, s) of the classes in need(c, rep): their sets made again from one document each."""
    reps = need.select("rep").distinct()
    texts = docs.join(small(reps, reps.count()), docs["doc_id"].eqNullSafe(reps["rep"]), "left_semi").select("text")

    def made(batches):
        for t in batches:
            c, s = [], []
            for _, x in doc_sets(t.column(0), k):
                if len(x):
                    c.append(class_of(x)), s.append(x.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()), pa.array(s, pa.list_(pa.int64()))], names=["c", "s"])

    return texts.mapInArrow(made, "c string, s array<bigint>").join(need.select("c").distinct(), "c", "left_semi").dropDuplicates(["c"])


def _counted(lists: DataFrame, column: str, label: str) -> DataFrame:
    """lists(c8, column, ...) with hot: (freq, token) of the frequent shingles in column, counted over all of lists; and rare: the others, in their order."""
    each = lists.select("c8", F.explode(column).alias("token"))
    often = stored(each.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") > LIST), f"{label}_shingles")
    n = often.count()
    if not n:
        return lists.withColumn("hot", F.array().cast("array<struct<freq:bigint,token:bigint>>")).withColumn("rare", F.col(column))
    hot = stored(each.join(small(often, n, NUMBERS), "token").groupBy("c8").agg(F.collect_list(F.struct("freq", "token")).alias("hot")), f"{label}_of_sets")
    dropped(often)
    rows, entries = hot.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("hot")), F.lit(0))).first()
    out = lists.join(small(hot, rows + entries), "c8", "left").withColumn("hot", F.coalesce("hot", F.array().cast("array<struct<freq:bigint,token:bigint>>")))
    return out.withColumn("rare", F.when(F.size("hot") == 0, F.col(column)).otherwise(F.array_except(column, F.col("hot.token"))))


def prefixes(classes: DataFrame, docs: DataFrame, k: int, similar: int) -> tuple[DataFrame, DataFrame]:
    """Prefixes as (c8, n, prefix: array of (token, freq)), freq 0 for rare shingles: those of rare shingles of the low range alone, and the others."""
    need = (F.col("n") - F.ceil(F.col("n") * similar / 100) + 1).cast("int")
    entry = lambda tokens: F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(0).cast("long").alias("freq")))
    marked = stored(_counted(classes.select("c", "c8", "n", "rep", "low"), "low", "frequent").withColumn("done", F.size("rare") >= need).select("c", "c8", "n", "rep", "hot", "done", F.when(F.col("done"), F.slice("rare", 1, need)).otherwise(F.col("rare")).alias("rare")), "marked")
    short, open_ = marked.filter("done").select("c8", "n", entry(F.col("rare")).alias("prefix")), marked.filter("not done")
    if open_.isEmpty():
        return short, short.limit(0)
    bound = int(np.array([_low_end(similar)]).view(np.int64)[0])
    sets = _again(docs, open_.select("c", "rep"), k).select("c", F.filter("s", lambda x: _beyond(x, bound)).alias("rest"))
    sets = stored(open_.select("c", "c8", "n", F.col("rare").alias("rare_low"), F.col("hot").alias("hot_low")).join(sets, "c"), "open_sets")
    counted = _counted(sets, "rest", "open_frequent")
    late = F.transform(F.array_sort(F.concat("hot_low", "hot")), lambda x: F.struct(x["token"].alias("token"), x["freq"].alias("freq")))
    long_ = counted.select("c8", "n", F.slice(F.concat(entry(F.col("rare_low")), entry(F.col("rare")), late), 1, need).alias("prefix"))
    return short, stored(long_, "open_prefixes")


def _beyond(x: Column, bound: int) -> Column:
    """Whether a hash, unsigned but held as a signed number, is not below bound."""
    return (x >= bound) | (x < 0) if bound >= 0 else (x >= bound) & (x < 0)


def postings(prefixes: DataFrame, first: int | None = None) -> DataFrame:
    """token, salt (0: a rare shingle's list; else the part of a list that is dealt out), n, c (64 bits of the class), pos (place in the prefix). first: so many frequent shingles of each set."""
    upto = F.lit(None).cast("int") if first is None else F.size(F.filter("prefix", lambda e: e["freq"] == 0)) + first
    p = prefixes.select("n", F.col("c8").alias("c"), upto.alias("upto"), F.posexplode("prefix").alias("pos", "e")).filter("upto is null or pos < upto")
    parts = F.greatest(F.lit(1), F.ceil(F.col("e.freq") / DEALT)).cast("int")
    salt = F.when(F.col("e.freq") > 0, 1 + F.pmod(F.xxhash64("c", "e.token"), parts)).otherwise(0).cast("int")
    return p.select(F.col("e.token").alias("token"), salt.alias("salt"), "n", "c", "pos")


def _may_link(n1, p1, n2, p2, similar: int):
    """Whether sets of sizes n1, n2 that share their first shingle at places p1, p2 can reach the threshold."""
    return (100 * np.minimum(n1, n2) >= similar * np.maximum(n1, n2)) & (np.minimum(n1 - p1, n2 - p2) * (100 + similar) >= similar * (n1 + n2))


def _block_pairs(starts: np.ndarray, k: int, n: np.ndarray, p: np.ndarray, similar: int):
    """Pairs of rows of the lists of k sets that begin at starts; blocks that cannot reach the threshold are skipped."""
    at = starts[:, None] + np.arange(k)[None, :]
    blocks = [(lo, min(k, lo + BLOCK)) for lo in range(0, k, BLOCK)]
    room = [(n[at[:, lo:hi]] - p[at[:, lo:hi]]).max(1) for lo, hi in blocks]
    for x, (lo, hi) in enumerate(blocks):
        for y, (lo2, hi2) in enumerate(blocks[x:], x):
            least, most = n[at[:, lo2]], n[at[:, hi - 1]]  # lists go by size
            may = (x == y) | ((100 * most >= similar * least) & (np.minimum(room[x], room[y]) * (100 + similar) >= similar * (n[at[:, lo]] + least)))
            i, j = np.triu_indices(hi - lo, 1) if x == y else (g.reshape(-1) for g in np.meshgrid(np.arange(hi - lo), np.arange(hi2 - lo2), indexing="ij"))
            of = starts[may]
            for some in range(0, len(of), step := max(1, PAIRS // max(1, len(i)))):
                first = of[some : some + step, None]
                yield (first + (lo + i)[None, :]).reshape(-1), (first + (lo2 + j)[None, :]).reshape(-1)


def _leader_pairs(start: int, m: int):
    """Pairs of rows of one long list, by size and place: each set with the leaders of its block and its neighbours, and leaders with the next."""
    i = np.arange(m)
    for r in range(LEADERS):
        yield start + i, start + np.clip((i // LIST + r - LEADERS // 2) * LIST, 0, (m - 1) // LIST * LIST)
    lead = np.arange(0, m, LIST)
    yield start + lead[:-1], start + lead[1:]


def candidates(sorted_postings: DataFrame, similar: int) -> DataFrame:
    """Pairs a, b of classes (64 bits each): all of short lists, those with leaders of long ones."""

    def pairs(cols: list[np.ndarray], starts: np.ndarray):
        _, _, n, c, p = cols
        size, found = np.diff(starts), []

        def add(i, j):
            keep = _may_link(n[i], p[i], n[j], p[j], similar)
            i, j = i[keep], j[keep]
            x, y = np.minimum(c[i], c[j]), np.maximum(c[i], c[j])
            found.append(np.stack([x, y], 1)[x != y])

        for k in np.unique(size[size > 1]).tolist():
            of = starts[:-1][size == k]
            if k <= LIST:
                for i, j in _block_pairs(of, k, n, p, similar):
                    add(i, j)
            else:
                for start in of.tolist():
                    for i, j in _leader_pairs(start, k):
                        add(i, j)
        ab = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        if len(ab):
            ab = ab[np.lexsort((ab[:, 1], ab[:, 0]))]
            ab = ab[np.concatenate([[True], (ab[1:] != ab[:-1]).any(1)])]
        for lo in range(0, len(ab), POSTINGS):
            yield pa.RecordBatch.from_arrays([pa.array(ab[lo : lo + POSTINGS, 0]), pa.array(ab[lo : lo + POSTINGS, 1])], names=["a", "b"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append([b.column(i).to_numpy() for i in range(5)])
            size += b.num_rows
            if size >= POSTINGS:
                cols = [np.concatenate(x) for x in zip(*held)]
                starts = np.flatnonzero(np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]))
                yield from pairs(cols, starts)
                held, size = [[x[starts[-1] :] for x in cols]], 0  # the last list may go on
        if held:
            cols = [np.concatenate(x) for x in zip(*held)]
            if len(cols[0]):
                starts = np.flatnonzero(np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]))
                yield from pairs(cols, np.append(starts, len(cols[0])))

    return sorted_postings.mapInArrow(run, "a long, b long")


def bounded(pairs: DataFrame, classes: DataFrame, similar: int) -> DataFrame:
    """The pairs whose sketches do not rule the threshold out, by name, with a document of each: a, b, a_rep, b_rep."""
    spark = pairs.sparkSession
    info = classes.select("c8", "n", "sketch")
    A, B = (info.select(*[F.col(x).alias(f"{e}_{x}") for x in info.columns]) for e in "ab")
    both = pairs.join(A, F.col("a") == F.col("a_c8")).join(B, F.col("b") == F.col("b_c8")).select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch")

    def bound(batches):
        for t in batches:
            if not t.num_rows:
                continue
            n = t.column(2).to_numpy() + t.column(3).to_numpy()
            offsets = [t.column(i).offsets.to_numpy() for i in (4, 5)]
            sizes, differ = [np.diff(o) for o in offsets], np.zeros(t.num_rows, np.int64)
            for lengths in np.unique(np.stack(sizes, 1), axis=0).tolist():
                rows = np.flatnonzero((sizes[0] == lengths[0]) & (sizes[1] == lengths[1]))
                x, y = (folded(t.column(4 + i).values.to_numpy().view(np.uint64)[offsets[i][rows][:, None] + np.arange(lengths[i])[None, :]], min(lengths)) for i in (0, 1))
                differ[rows] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            yield t.select(["a", "b"]).filter(pa.array(100 * (n - differ) >= similar * (n + differ)))  # the intersection is (n - d) / 2, the union (n + d) / 2

    bound_batches(spark, POSTINGS)
    near = stored(both.mapInArrow(bound, "a long, b long"), "near")
    bound_batches(spark)
    names = classes.select("c8", "c", "rep")
    A, B = (names.select(*[F.col(x).alias(f"{e}_{x}") for x in names.columns]) for e in "ab")
    left = near.distinct().join(A, F.col("a") == F.col("a_c8")).join(B, F.col("b") == F.col("b_c8"))
    out = stored(left.select(F.col("a_c").alias("a"), F.col("b_c").alias("b"), "a_rep", "b_rep"), "pairs")
    dropped(near)
    return out


def exact(pairs: DataFrame, docs: DataFrame, k: int, similar: int) -> DataFrame:
    """The pairs (a, b) that link, by their sets, which are made again from one document each."""
    need = pairs.select(F.col("a").alias("c"), F.col("a_rep").alias("rep")).union(pairs.select("b", "b_rep"))
    sets = stored(_again(docs, need, k), "members")
    sa, sb = sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), sets.select(F.col("c").alias("b"), F.col("s").alias("sb"))

    def compared(batches):
        for t in batches:
            sizes = []
            for x, y in zip(t.column(2), t.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                sizes.append(100 * common >= similar * (len(x) + len(y) - common))
            yield t.select(["a", "b"]).filter(pa.array(sizes, pa.bool_()))

    out = pairs.select("a", "b").join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb")
    done = stored(out.mapInArrow(compared, "a string, b string"), "links")
    dropped(sets)
    return done


def resolved(pairs: DataFrame, links: DataFrame | None, comps: DataFrame | None, docs: DataFrame, k: int, similar: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(links, components) with what pairs add. Without components yet, each class is first compared with the least of its partners; then only pairs across the components that there are."""
    def across_(p: DataFrame) -> DataFrame:
        if comps is None:
            return p
        of = lambda e: comps.select(F.col("c").alias(e), F.col("label").alias(f"{e}_of"))
        return p.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("a_of", "a") != F.coalesce("b_of", "b")).select("a", "b", "a_rep", "b_rep")

    tested, n, first = None, pairs.count(), comps is None
    for turn in ("least", "all") if first else ("all",):
        left = across_(pairs if tested is None else pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"))
        if turn == "least":
            left = left.groupBy("b").agg(F.min(F.struct("a", "a_rep", "b_rep")).alias("x")).select("x.a", "b", "x.a_rep", "x.b_rep")
        left = stored(_sized(left, n), "compared")
        if not left.isEmpty():
            found = exact(left, docs, k, similar)
            links = found if links is None else links.union(found)
            comps = components(links)
        if turn == "all":
            dropped(left, tested)
        tested = left
    dropped(pairs)
    return links, comps


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """df, of about so many short rows, in as many tasks as they ask for, TASKS at least."""
    return df.coalesce(TASKS + rows // TASK_ROWS)


def components(links: DataFrame) -> DataFrame:
    """(c, label) for the ends of links(a, b) but the smallest of each component: label is that smallest name.

    Every round points each node at its least neighbour if that is smaller, and on to the end of that chain, and
    contracts the links by it; what is left of them shrinks from round to round. Rounds are written tables.
    """
    edges = stored(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    named = None
    while n := edges.count():
        jump = stored(_sized(edges.groupBy(F.col("v").alias("c")).agg(F.min("u").alias("label")), n), "labels")
        while True:  # to the end of each chain
            on = jump.select(F.col("c").alias("label"), F.col("label").alias("_next"))
            after = jump.select("c", "label").join(on, "label", "left").select("c", F.coalesce("_next", "label").alias("label"), F.col("_next").isNotNull().alias("moved"))
            after = stored(_sized(after, n), "labels")
            dropped(jump)
            jump = after
            if jump.filter("moved").isEmpty():
                break
        heads = jump.select("c", "label")
        to = lambda end: heads.select(F.col("c").alias(end), F.col("label").alias(f"{end}_to"))
        moved = edges.join(to("u"), "u", "left").join(to("v"), "v", "left").select(F.coalesce("u_to", "u").alias("u"), F.coalesce("v_to", "v").alias("v"))
        rest = stored(_sized(moved.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), n), "edges")
        if named is None:
            named = heads
        else:
            on = heads.select(F.col("c").alias("label"), F.col("label").alias("_next"))
            named = stored(_sized(named.join(on, "label", "left").select("c", F.coalesce("_next", "label").alias("label")).unionByName(heads), n), "labels")
        dropped(edges)
        edges = rest
    dropped(edges)
    return links.select(F.col("a").alias("c"), F.col("b").alias("label")).limit(0) if named is None else named


def _differ(x: Column, y: Column) -> Column:
    """Bits in which two brief sketches differ."""
    return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range((1 << LEAST_BITS) // 64)), F.lit(0))


def listed(hot: DataFrame, classes: DataFrame, similar: int) -> DataFrame:
    """The postings of frequent shingles with their sets' names and brief sketches, and bands of size and place."""
    prefix = (F.col("n") - F.ceil(F.col("n") * similar / 100) + 1).cast("int")
    p = hot.select("token", "n", F.col("c").alias("c8"), "pos", F.floor(F.log("n") / log(100 / similar)).cast("int").alias("band"), F.floor(PLACES * F.col("pos") / prefix).cast("int").alias("place"))
    return stored(p.join(classes.select("c8", "c", F.col("brief").alias("sketch")), "c8"), "long_lists")


def across(lists: DataFrame, comps: DataFrame | None, similar: int, step: str) -> DataFrame:
    """Pairs (a, b) across components from the lists of frequent shingles.

    The sets of a list, component, size band and place band are a group behind its least set, with a radius in bits of
    the sketch. The sketches' distance is a metric, so groups whose leaders are farther apart than the threshold and
    both radii allow have no link across. Of the other pairs of groups come, by step: "leaders" only; the "members" of
    groups of several with the other's leader; or "all" of two groups of several that sizes, places and sketches allow.
    Components only grow, so a set that is alone in a step was alone before, and was compared there.
    """
    p = lists.withColumn("label", F.col("c")) if comps is None else lists.join(comps, "c", "left").withColumn("label", F.coalesce("label", "c"))
    mixed = stored(p.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token"), "mixed_lists")
    p = p.join(small(mixed, mixed.count()), "token", "left_semi")
    keys = ["token", "band", "place", "label"]
    groups = stored(p.groupBy(*keys).agg(F.min(F.struct("c", "c8", "sketch", "n")).alias("lead"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.max(F.col("n") - F.col("pos")).alias("room"), F.count(F.lit(1)).alias("sets")), "leads")
    radius = p.join(groups.select(*keys, "lead"), keys).groupBy(*keys).agg(F.max(_differ(F.col("sketch"), F.col("lead.sketch"))).alias("radius"))
    groups = stored(groups.join(radius, keys), "groups")
    x = groups.select(*[F.col(c).alias(f"x_{c}") for c in groups.columns]).withColumn("y_band", F.explode(F.array(*[F.col("x_band") + i for i in (-1, 0, 1)])))
    y = groups.select(*[F.col(c).alias(f"y_{c}") for c in groups.columns]).withColumn("x_token", F.col("y_token"))
    sizes = (100 * F.col("x_n_hi") >= similar * F.col("y_n_lo")) & (100 * F.col("y_n_hi") >= similar * F.col("x_n_lo"))
    places = F.least("x_room", "y_room") * (100 + similar) >= similar * (F.col("x_n_lo") + F.col("y_n_lo"))
    reach = (_differ(F.col("x_lead.sketch"), F.col("y_lead.sketch")) - F.col("x_radius") - F.col("y_radius")) * (100 + similar) <= (100 - similar) * (F.col("x_n_hi") + F.col("y_n_hi"))
    met = x.join(y, ["x_token", "y_band"]).filter((F.col("x_label") < F.col("y_label")) & sizes & places & reach)
    met = stored(met.select("x_token", *[f"{e}_{c}" for e in "xy" for c in ("band", "place", "label")], "x_lead", "y_lead", (F.col("x_sets") > 1).alias("x_more"), (F.col("y_sets") > 1).alias("y_more")), "near_groups")
    member = lambda e: p.select(F.col("token").alias("x_token"), *[F.col(c).alias(f"{e}_{c}") for c in ("band", "place", "label", "n", "c8", "pos", "sketch")])
    xs, ys = (met.filter(f"{e}_more").join(member(e), ["x_token", f"{e}_band", f"{e}_place", f"{e}_label"]) for e in "xy")

    def near(n: Column, other: Column, x: Column, y: Column) -> Column:
        differ = _differ(x, y)
        return (100 * F.least(n, other) >= similar * F.greatest(n, other)) & (100 * (n + other - differ) >= similar * (n + other + differ))

    if step == "leaders":
        pairs = met.select(F.col("x_lead.c8").alias("x"), F.col("y_lead.c8").alias("y"))
    elif step == "members":
        beside = lambda p, e, o: p.filter(near(F.col(f"{e}_n"), F.col(f"{o}_lead.n"), F.col(f"{e}_sketch"), F.col(f"{o}_lead.sketch"))).select(F.col(f"{e}_c8").alias("x"), F.col(f"{o}_lead.c8").alias("y"))
        pairs = beside(xs, "x", "y").unionByName(beside(ys, "y", "x"))
    else:
        both = xs.filter("y_more").join(member("y"), ["x_token", "y_band", "y_place", "y_label"])
        place = F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos")) * (100 + similar) >= similar * (F.col("x_n") + F.col("y_n"))
        pairs = both.filter(place & near(F.col("x_n"), F.col("y_n"), F.col("x_sketch"), F.col("y_sketch"))).select(F.col("x_c8").alias("x"), F.col("y_c8").alias("y"))
    return stored(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "candidates")


def _joined(docs: DataFrame, k: int, similar: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets of docs, whose columns are doc_id, others and text; c, label and component_id of the classes that share their component; links)."""
    spark = docs.sparkSession
    sets = set_table(docs, k, similar)
    filled = sets.filter("c is not null")
    copies = stored(filled.groupBy("c").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("docs")).filter("docs > 1"), "copies")
    n_copies = copies.count()
    about = ["c8", "n", "sketch", "brief", "low"]
    alone = filled.join(small(copies.select("c"), n_copies), "c", "left_anti").select("c", *about, F.col("doc_id").alias("rep"), F.lit(1).cast("long").alias("docs"))
    several = filled.join(small(copies, n_copies), "c").groupBy("c").agg(*[F.first(x).alias(x) for x in (*about, "rep", "docs")])  # a row a class and task
    classes = stored(alone.unionByName(several), "classes")
    short, long_ = prefixes(classes, docs, k, similar)
    post = postings(short).unionByName(postings(long_, FIRST))
    dealt = post.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "pos")
    bound_batches(spark, POSTINGS)
    found = stored(candidates(dealt, similar), "candidates")
    bound_batches(spark)
    links, comps = resolved(bounded(found.distinct(), classes, similar), None, None, docs, k, similar)
    dropped(found)
    hot = postings(long_).filter("salt > 0")
    if not hot.isEmpty():
        lists = listed(hot, classes, similar)
        for step in ("leaders", "members", "all"):  # each on the components that the one before it left
            more = across(lists, comps, similar, step)
            if more.isEmpty():  # a later step may still find links
                dropped(more)
                continue
            links, comps = resolved(bounded(more, classes, similar), links, comps, docs, k, similar)
            dropped(more)
        dropped(lists)
    if links is None:
        links, comps = spark.createDataFrame([], "a string, b string"), spark.createDataFrame([], "c string, label string")
    named = classes.select("c", "rep", "docs").join(comps, "c", "left").withColumn("label", F.coalesce("label", "c"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"), F.sum("docs").alias("of"))
    return sets, stored(named.join(least, "label").filter("of > 1").select("c", "label", "component_id"), "named"), links


def join_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, similar: int = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, component_id for every document; the verified links a, b between classes)."""
    bound_batches(docs.sparkSession)
    sets, shared, links = _joined(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), k, similar)
    out = sets.join(small(shared.drop("label"), shared.count()), "c", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), links


def jaccard_report(docs: DataFrame, **names) -> DataFrame:
    return join_documents(docs, **names)[0]


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """docs with one row of each component: of the least doc_id, or of a null one where no row has another; ties go by hash.

    Decisions are joined back by a key of id and text: 128 bits that only rows equal in both share.
    """
    bound_batches(docs.sparkSession)
    k1, k2 = (F.xxhash64(F.lit(i), F.col(doc_id).isNull(), doc_id, F.col(text).isNull(), text) for i in (1, 2))
    rows = docs.select(F.col(doc_id).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col(text).alias("text"))
    sets, shared, _ = _joined(rows, k, similar)
    members = stored(sets.select("doc_id", "k1", "k2", "c").join(small(shared, shared.count()), "c").groupBy("label", "k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows")), "members")
    winner = stored(members.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("w")), "winners")
    judged = stored(members.join(small(winner, winner.count()), "label").select("k1", "k2", "rows", ((F.col("k1") == F.col("w.k1")) & (F.col("k2") == F.col("w.k2"))).alias("wins")), "judged")
    losers, again = judged.filter("not wins").select("k1", "k2"), judged.filter("wins and rows > 1").select("k1", "k2")
    held = docs.select(F.struct(*docs.columns).alias("_row"), k1.alias("k1"), k2.alias("k2"))
    kept = held.join(small(losers, losers.count()), ["k1", "k2"], "left_anti")
    n_again = again.count()
    if not n_again:
        return kept.select("_row.*")
    twice = kept.join(small(again, n_again), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    once = kept.join(small(again, n_again), ["k1", "k2"], "left_anti")
    return once.select("_row.*").unionByName(twice.select("_row.*"))
