"""Byte-level BPE encoding and decoding.

Texts are cut into words by the vocabulary's pattern, and each word is merged by itself: again and again the adjacent pair
of pieces whose joined bytes have the lowest rank, the leftmost of equals, until no pair has a rank; a piece's rank is its
id. A word that is a token as a whole is that token.

Merging is Spark's own: an `aggregate` folds merges over the array of a word's pieces, with ranks from a literal map. Pieces
are ids, so the map takes a pair of ids (a, b) to the rank of their joined bytes. It is two literal arrays: the pair stands
in `cells` at starts[a] + b, as a * 2^16 + rank, so that cell xor a * 2^16 is the rank if the cell is of row a, and at least
2^16 if it is not.

Only distinct words are merged. A task reads texts up to CHUNK_BYTES, numbers their distinct stretches between blanks, cuts
those into words, and hands on rows of PORTION words: the distinct words that are no token (as keys of their bytes: the ids, with the ranks of the pairs they begin), and with the last of them the texts as numbers of stretches. The fold runs over each row's words, and the next step of the same task puts ids in
the place of numbers. Both steps remember the stretches and words of a task's earlier chunks, so that a task merges a word once,
until they are REMEMBERED or more; then both forget all of them. Nothing is shuffled, counted beforehand or held for the whole corpus; memory
is bounded by a chunk and what is remembered, or by one text where that is larger.

A pair that occurs several times in a long word is merged everywhere at once, if no pair that arises meanwhile would have gone first;
this gives the same pieces in fewer rounds.

Characters' classes are those of the tokenizer's own engine: texts that hold characters of which `regex` has another opinion
(younger scripts) are cut by a pattern in which the engine's classes are spelled out.

Defined cases: null texts are encoded as empty ones (no ids); words of any length are merged whole; repeated rows and null ids give
rows like any others; an empty table gives no rows; other columns are ignored. Ids are little-endian unsigned 32-bit
integers in one binary value. Decoding gives bytes, null for null; an id outside the vocabulary is an error.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

from siftline.llm._common import bound_batches

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of text whose distinct words are merged together.
CHUNK_BYTES = 8 << 20
#: Words in a row at most.
PORTION = 1 << 14
#: Distinct stretches after which a task forgets what its chunks had.
REMEMBERED = 1 << 19
#: Ids are below this, so that a row and a rank fit a cell.
MOST_IDS = (1 << 16) - 1
#: Words of more pieces merge equal pairs together; a place below this has six bits.
LONG = 48
_NONE = MOST_IDS << 16


@lru_cache(maxsize=4)
def vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines "base64 rank" (read on the driver)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(ranks.values()) >= MOST_IDS or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"a vocabulary has every byte and ids below {MOST_IDS}")
    return ranks


def pair_ranks(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(a, b, rank of a's bytes and b's together) for every two tokens that have one."""
    return [(ranks[k[:i]], ranks[k[i:]], r) for k, r in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks]


def laid_out(pairs: list[tuple[int, int, int]], ids: int) -> tuple[list[int], list[int]]:
    """(starts, cells): the pairs (a, b) of a row a stand at starts[a] + b, as a * 2^16 + rank; rows lie one over another so that no two pairs share a cell."""
    rows: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for a, b, rank in pairs:
        rows[a].append((b, rank))
    size, rng = 4 * len(pairs) + 2 * ids + 64, np.random.default_rng(1)
    taken, cells, starts = np.zeros(size + ids + 4096, bool), np.full(size + ids + 4096, _NONE), [0] * ids
    for a in sorted(rows, key=lambda a: (-len(rows[a]), a)):  # the largest first
        b, rank = np.array(rows[a]).T
        start, base = -1, 0
        while start < 0:
            tries = base + np.arange(4096) if len(b) >= 8 else rng.integers(0, size, 64)
            bad = np.zeros(len(tries), bool)
            for x in b:
                bad |= taken[tries + x]
            start, base = (-1, base + 4096) if bad.all() else (int(tries[bad.argmin()]), base)
        starts[a], taken[start + b], cells[start + b] = start, True, (a << 16) | rank
    return starts, cells[: int(np.flatnonzero(taken).max(initial=0)) + 1].tolist()


@lru_cache(maxsize=4)
def _literals(path: str) -> tuple[str, str]:
    ranks = vocabulary(path)
    return tuple(map(json.dumps, laid_out(pair_ranks(ranks), max(ranks.values()) + 1)))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once: the end of a fold over nothing. An element of a transformed array would be copied, and its type worked out anew each time."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, then)


def _merge(acc: Column, rank: Callable[[Column, Column], Column]) -> Column:
    """acc (parts; ranks of each with the next one, null for the last) after the merge that goes first, or after several of the same rank."""
    parts, ranks = acc["parts"], acc["ranks"]
    n = F.size(parts)

    def with_low(low: Column) -> Column:
        def leftmost(p: Column) -> Column:
            """Only the ranks with the neighbours are new."""
            before = F.when(p > 1, F.concat(F.slice(ranks, F.lit(1), p - 2), F.array(rank(F.get(parts, p - 2), low)))).otherwise(F.array().cast("array<bigint>"))
            after = F.concat(F.array(rank(low, F.get(parts, p + 1))), F.slice(ranks, p + 2, n))
            return F.struct(F.concat(F.slice(parts, F.lit(1), p - 1), F.array(low), F.slice(parts, p + 2, n)).alias("parts"), F.concat(before, after).alias("ranks"))

        def everywhere(taken: Column) -> Column:
            def first(i: Column) -> Column:
                return F.coalesce(F.get(taken, i) == "1", F.lit(False))

            def lower(r: Column) -> Column:
                return F.coalesce(r < low, F.lit(False))

            early = F.exists(F.sequence(F.lit(0), n - 2), lambda i: first(i) & (lower(rank(low, F.get(parts, i + 2))) | (~first(i - 2) & lower(rank(F.get(parts, i - 1), low)))))
            merged = F.filter(F.transform(parts, lambda p, i: F.when(first(i), low).when(~first(i - 1), p)), lambda p: p.isNotNull())
            all_ranks = lambda q: F.struct(q.alias("parts"), F.transform(q, lambda a, i: rank(a, F.get(q, i + 1))).alias("ranks"))
            return F.when(early | lower(rank(low, low)), one).otherwise(_let(merged, all_ranks))

        one = _let(F.array_position(ranks, low).cast("int"), leftmost)
        # of pairs that overlap, the left one is taken: "11" in the row of flags becomes "10" from the left
        taken = F.split(F.replace(F.array_join(F.transform(ranks, lambda r: F.when(r == low, "1").otherwise("0")), ""), F.lit("11"), F.lit("10")), "")
        some = F.when(n > LONG, _let(taken, everywhere)).otherwise(one)
        return F.when(low < 1 << 16, some).otherwise(F.struct(parts.alias("parts"), F.array().cast("array<bigint>").alias("ranks")))

    return _let(F.array_min(ranks), with_low)


def _piece(key: Column) -> Column:
    return key.bitwiseAND(0xFFFF)


def _key(a: Column, b: Column, rank: Callable[[Column, Column], Column]) -> Column:
    """a and its rank with the next piece, MOST_IDS if none, in an int that is smaller where the rank is: (rank - 2^15) * 2^16 + a."""
    low = F.least(rank(a, b), F.lit(MOST_IDS).cast("bigint"))
    return F.shiftleft((low - (1 << 15)).cast("int"), 16).bitwiseOR(a)


def _short(start: Column, rank: Callable[[Column, Column], Column]) -> Column:
    """The fold over the keys of a word of LONG pieces at most.

    They get their places between rank and piece first, in longs, so that the smallest one is the merge that goes first and no two are equal. A piece keeps the place it began at.
    """
    no_rank = MOST_IDS << 22

    def placed(k: Column, i: Column) -> Column:
        return F.shiftleft(F.shiftright(k, 16).cast("bigint") + (1 << 15), 22).bitwiseOR(F.shiftleft(i, 16)).bitwiseOR(_piece(k))

    def ranked(a: Column, b: Column) -> Column:
        return F.coalesce(F.shiftleft(rank(a, b), 22), F.lit(no_rank))

    def merge(keys: Column) -> Column:
        def first(best: Column) -> Column:
            def with_low(low: Column) -> Column:
                def joined(before: Column) -> Column:
                    """before: where the piece before the left one stands."""

                    def put(k: Column, i: Column) -> Column:
                        both = ranked(low, _piece(F.get(keys, before + 3))).bitwiseOR(best.bitwiseAND(0x3F << 16)).bitwiseOR(low)
                        return F.when(k == best, both).when(i == before, ranked(_piece(k), low).bitwiseOR(k.bitwiseAND((1 << 22) - 1))).otherwise(k)

                    return _let(F.get(keys, before + 2), lambda right: F.transform(F.array_remove(keys, right), put))

                return _let((F.array_position(keys, best) - 2).cast("int"), joined)

            return F.when(best < no_rank, _let(F.shiftright(best, 22), with_low)).otherwise(keys)

        return _let(F.array_min(keys), first)

    fold = F.aggregate(F.sequence(F.lit(2), F.size(start)), F.transform(start, placed), lambda keys, _: merge(keys))
    return F.transform(fold, lambda k: _piece(k).cast("int"))


def _long(word: Column, rank: Callable[[Column, Column], Column]) -> Column:
    start = F.struct(word.alias("parts"), F.transform(word, lambda a, i: rank(a, F.get(word, i + 1))).alias("ranks"))
    fold = F.aggregate(F.sequence(F.lit(2), F.size(word)), start, lambda acc, _: F.when(F.size(acc["ranks"]) < 2, acc).otherwise(_merge(acc, rank)))
    return fold["parts"].cast("array<int>")


def _every(words: Column, path: str, ids_of: Callable[[Column, Callable[[Column, Column], Column]], Column]) -> Column:
    """ids_of(word, rank of two pieces) for each of an array of words."""
    starts, cells = (F.from_json(F.lit(text), "array<bigint>") for text in _literals(path))

    def all_words(starts: Column, cells: Column) -> Column:
        def rank(a: Column, b: Column) -> Column:
            """Null if there is no b."""
            return F.get(cells, F.get(starts, a) + b).bitwiseXOR(F.shiftleft(a.cast("bigint"), 16))

        return F.transform(words, lambda word: ids_of(word, rank))

    return _let(starts, lambda s: _let(cells, lambda c: all_words(s, c)))


def folded(keys: Column, path: str) -> Column:
    """array<array<int>>: the ids of each of an array of words, as arrays of the keys of two bytes or more; none is a token by itself."""
    return _every(keys, path, lambda word, rank: F.when(F.size(word) > LONG, _long(F.transform(word, lambda k: _piece(k).cast("bigint")), rank)).otherwise(_short(word, rank)))


def merged(words: Column, path: str) -> Column:
    """folded(), of words as arrays of the ids of their bytes."""
    return folded(_every(words, path, lambda word, rank: F.transform(word, lambda a, i: _key(a, F.get(word, i + 1), rank))), path)


def byte_keys(tokens: dict[bytes, int]) -> np.ndarray:
    """The key of every byte (row) before every other one; in the last column, at a word's end."""
    out = np.full((256, 257), MOST_IDS, np.int64)
    for pair, rank in tokens.items():
        if len(pair) == 2:
            out[pair[0], pair[1]] = rank
    return (((out - (1 << 15)) << 16) | np.array([[tokens[bytes([b])]] for b in range(256)])).astype(np.int32)


def bytewise(words: list[bytes], keys: np.ndarray) -> pa.Array:
    """Where the fold over each word begins: the keys of its bytes."""
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]).astype(np.int32)
    every = np.frombuffer(b"".join(words), np.uint8)
    following = np.append(every[1:], 0).astype(np.int16)
    following[ends[1:] - 1] = 256
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[every, following]))


@lru_cache(maxsize=4)
def splitter(pattern: str) -> tuple[str, str]:
    """(pattern that spells out the tokenizer engine's classes, characters that need it)."""
    engine = {bytes([b]): b for b in range(256)}
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    odd: set[str] = set()
    spelled = pattern
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        coder = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=engine, special_tokens={})
        theirs = set(bytes(coder.encode_ordinary(every)).decode())
        odd |= theirs ^ set(regex.findall(name, every))
        spelled = spelled.replace(name, f"[{_ranges(theirs)}]")
    spelled = spelled.replace(r"\S", f"[^{_ranges(set(bytes(tiktoken.Encoding('class', pat_str=chr(92) + 's', mergeable_ranks=engine, special_tokens={}).encode_ordinary(every)).decode()))}]")
    return f"(?V1){spelled}", "".join(sorted(odd))


def _ranges(characters: set[str]) -> str:
    points, out = sorted(map(ord, characters)), []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in out)


def _one_value(x: np.ndarray | array) -> pa.Array:
    """The bytes of x as one binary value, not copied."""
    data = pa.py_buffer(x)
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, data.size], np.int32)), data])


class Numbers(dict):
    """Strings to numbers in the order they come; -1 for what stands beside other white space than one blank."""

    def __missing__(self, x: str) -> int:
        if not x or x[0].isspace() or x[-1].isspace():
            return -1
        self[x] = n = len(self)
        return n


def _chunks(docs: DataFrame, tokens: dict[bytes, int], pattern: str, chunk_bytes: int, remembered: int = REMEMBERED) -> DataFrame:
    """Rows of a chunk: PORTION of its words that are not remembered, in each; fresh, if nothing is from here on.

    The last one has the rest too, null in the others: ids and counts (stretches) of its texts, numbers (of distinct stretches, text after text), sizes (pieces of each new stretch), pieces (a piece's id, or -1 - its place among the words remembered).

    A stretch is what lies between two single blanks: with the blank before it, it is cut like the text around it, since no piece
    goes over a blank between two other characters. Texts with other runs of white space are cut as a whole.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((tokens, pattern, *splitter(pattern)))
    id_type = docs.schema["doc_id"].dataType
    schema = spark.createDataFrame([], "counts binary, numbers binary, sizes binary, pieces binary, fresh boolean, words array<array<int>>").schema.add("ids", ArrayType(id_type))

    def run(batches):
        tokens, plain, spelled, odd = held.value
        usual, unusual, strange = regex.compile(plain), regex.compile(spelled), frozenset(odd)
        young = re.compile(f"[{min(strange, default=chr(0x10FFFF))}-\U0010ffff]")  # nothing else can hold one
        cut = lambda x: (unusual if not x.isascii() and young.search(x) and not strange.isdisjoint(x) else usual).findall(x)
        keys, kind = byte_keys(tokens), None

        def nothing():
            """Stretches after a blank and others, their places among all, and pieces; how many words those have."""
            return Numbers(), defaultdict(count().__next__), [np.zeros(0, np.int32)] * 2, {}, 0

        def fresh():
            return [], [], []

        ids, counts, numbers = fresh()
        after, own, places, seen, known = nothing()
        size = 0

        def stretches(old):
            """The pieces of every stretch that is new, and how many each has; many stretches at once."""
            new = islice(after, old[0], None)
            while some := list(islice(new, 1 << 14)):
                found = cut(" " + " ".join(some))
                first = np.flatnonzero(np.fromiter((x[0] == " " for x in found), bool, len(found)))  # no stretch has another blank
                if len(first) == len(some):
                    yield found, np.diff(first, append=len(found)).tolist()
                else:  # a pattern that leaves blanks out
                    yield from ((found, [len(found)]) for found in (cut(" " + x) for x in some))
            for x in islice(own, old[1], None):
                found = cut(x)
                yield found, [len(found)]

        def rows():
            nonlocal known
            begin, old = known, [len(x) for x in places]
            words, pieces, sizes = [], array("i"), array("i")
            for found, lengths in stretches(old):
                sizes.extend(lengths)
                for piece in found:
                    n = seen.get(piece)
                    if n is None:
                        raw = piece.encode()
                        n = tokens.get(raw)
                        if n is None:
                            n = -1 - begin - len(words)
                            words.append(raw)
                        seen[piece] = n
                    pieces.append(n)
            known += len(words)
            at = sum(old)
            for i, x in enumerate((after, own)):
                places[i] = np.concatenate([places[i], np.arange(at, at := at + len(x) - old[i], dtype=np.int32)])
            stream = np.concatenate(numbers)
            numbers.clear()
            mine = (stream & 1).astype(bool)
            stream >>= 1
            for i, of in enumerate((~mine, mine)):
                stream[of] = places[i][stream[of]]
            bodies = [_one_value(x) for x in (np.array(counts, np.int64), stream, sizes, pieces)]
            for lo in range(0, max(1, len(words)), PORTION):
                part, last = words[lo : lo + PORTION], lo + PORTION >= len(words)
                starts = bytewise(part, keys) if part else pa.array([], pa.list_(pa.int32()))
                listed = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), starts)
                rest = bodies if last else [pa.nulls(1, pa.binary())] * len(bodies)
                yield pa.RecordBatch.from_arrays([*rest, pa.array([lo == 0 and sum(old) == 0]), listed, pa.array([ids if last else None], pa.list_(kind))], names=schema.names)

        for b in batches:
            kind = b.column(0).type
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py() or ""
                if ids and size + len(text) > chunk_bytes:
                    yield from rows()
                    ids, counts, numbers = fresh()
                    size = 0
                    if len(after) + len(own) >= remembered:
                        after, own, places, seen, known = nothing()
                first, *rest = text.split(" ")
                found = np.fromiter(map(after.__getitem__, rest), np.int32, len(rest)) * 2
                if len(found) and found.min() < 0 or not first or first[-1].isspace():
                    whole = cut(text)
                    found = np.fromiter(map(own.__getitem__, whole), np.int32, len(whole)) * 2 + 1
                else:
                    found = np.concatenate([np.array([own[first] * 2 + 1], np.int32), found])
                ids.append(b.column(0)[i].as_py())
                counts.append(len(found))
                numbers.append(found)
                size += len(text)
        if ids:
            yield from rows()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, chunk_bytes: int = CHUNK_BYTES, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) of every text."""
    path = path or public_tokenizers.path(VOCABULARY)
    bound_batches(docs.sparkSession)
    chunks = _chunks(docs, vocabulary(path), pattern, chunk_bytes, remembered)
    merges = chunks.select("ids", "counts", "numbers", "sizes", "pieces", "fresh", folded(F.col("words"), path).alias("folded"))
    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("ids", "binary")

    def run(batches):
        none = np.zeros(0, np.int32)
        for b in batches:
            for i in range(b.num_rows):
                if b.column(5)[i].as_py():  # words with their ids and sizes, stretches with theirs, as far as they are remembered
                    flat, size, all_ids, n = none, none, none.astype("<u4"), none
                    new_flat, new_size = [], []
                words = b.column(6)[i].values
                if len(words):
                    new_flat.append(words.flatten().to_numpy())
                    new_size.append(words.value_lengths().to_numpy())
                if not b.column(1)[i].is_valid:
                    continue
                flat, size = np.concatenate([flat, *new_flat]), np.concatenate([size, *new_size])
                new_flat, new_size = [], []
                counts, numbers, sizes, pieces = (np.frombuffer(b.column(j)[i].as_buffer(), t) for j, t in ((1, np.int64), (2, np.int32), (3, np.int32), (4, np.int32)))
                # the ids of every distinct stretch, one behind the other: a piece has one, or those of its word
                word = np.where(pieces < 0, -1 - pieces, len(size))
                of_piece = np.append(size, np.int32(1))[word]
                begin = np.append(np.cumsum(size, dtype=np.int32) - size, np.int32(0))[word]
                piece_ends = _sums(of_piece)
                new_ids = np.repeat(np.maximum(pieces, 0), of_piece)
                inside = np.repeat(pieces < 0, of_piece)
                new_ids[inside] = flat[_runs(begin, of_piece, piece_ends)[inside]]
                all_ids = np.concatenate([all_ids, new_ids.astype("<u4")])
                n = np.concatenate([n, np.diff(piece_ends[_sums(sizes)])])
                at = np.cumsum(n, dtype=np.int32) - n
                last = np.concatenate([[0], np.cumsum(counts)])
                for lo, hi in _pieces(counts):
                    own = numbers[last[lo] : last[hi]]
                    lengths = n[own]
                    after = _sums(lengths)
                    out = all_ids[_runs(at[own], lengths, after)]
                    edges = after[last[lo : hi + 1] - last[lo]].astype(np.int64)
                    ends = pa.array(edges * 4).cast(pa.int32())  # an error beyond 2 GB
                    body = pa.Array.from_buffers(pa.binary(), hi - lo, [None, ends.buffers()[1], pa.py_buffer(out)])
                    yield pa.RecordBatch.from_arrays([b.column(0)[i].values.slice(lo, hi - lo), pa.array(np.diff(edges)), body], names=schema.names)

    return merges.mapInArrow(run, schema)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... of x, in 32 bits: of ids and words there are no more than bytes of texts."""
    out = np.zeros(len(x) + 1, np.int32)
    np.cumsum(x, out=out[1:])
    return out


def _runs(begin: np.ndarray, sizes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Places from each begin on, as many as its size, run after run."""
    out = np.repeat(begin - sums[:-1], sizes)
    out += np.arange(sums[-1], dtype=np.int32)
    return out


def _pieces(counts: np.ndarray, words: int = 1 << 20) -> list[tuple[int, int]]:
    """Texts from first up to end that have about so many words together, or one text."""
    total = np.cumsum(counts)
    out, lo = [], 0
    while lo < len(counts):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + words, "right")))
        out.append((lo, hi))
        lo = hi
    return out


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the bytes that its ids stand for: the tokens' binary pieces, one behind the other."""
    tokens = vocabulary(path or public_tokenizers.path(VOCABULARY))
    pieces: list[bytes | None] = [None] * (max(tokens.values()) + 1)
    for piece, i in tokens.items():
        pieces[i] = piece
    held = df.sparkSession.sparkContext.broadcast(np.array(pieces, object))

    @F.pandas_udf("binary")
    def bytes_of(column: pd.Series) -> pd.Series:
        every = held.value
        return pd.Series([None if x is None else b"".join(every[np.frombuffer(x, "<u4")].tolist()) for x in column], dtype=object)

    return df.withColumn(out, bytes_of(ids))
