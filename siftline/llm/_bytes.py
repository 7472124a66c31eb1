"""Words, shingles and hashes of many texts at once, as numpy operations on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of the longest word that is hashed by sums of products; longer ones get a cryptographic hash each.
LONG = 64


@dataclass(frozen=True)
class Fold:
    """Which bytes count as equal (as: what each byte stands for), and a random number for each."""

    as_: np.ndarray
    value: np.ndarray


def _fold(seed: int, as_: np.ndarray) -> Fold:
    value = (np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1))[as_]
    value[_SPACE] = 0
    return Fold(as_, value)


def _ranges(*pairs: tuple[slice, int | slice]) -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    for where, what in pairs:
        out[where] = np.arange(256, dtype=np.uint8)[what]
    return out


#: A-Z as a-z.
LOWER = _fold(11, _ranges((slice(65, 91), slice(97, 123))))
#: Kinds of bytes: capitals, small letters and bytes beyond ASCII, digits, and each mark by itself.
SHAPE = _fold(12, _ranges((slice(65, 91), 65), (slice(97, 123), 97), (slice(48, 58), 48), (slice(128, 256), 97)))
with np.errstate(over="ignore"):
    _POW = np.multiply.accumulate(np.full(LONG, np.uint64(0xD6E8FEB86659FD93), np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a string column in pieces of about CHUNK bytes; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the words of texts laid end to end; first[i]: the number of words before text i."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.empty(len(buf), bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: Fold = LOWER) -> np.ndarray:
    """64 bits for each word, equal for words of equal bytes (as the fold has them)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.zeros(len(buf), np.int64)
    at[starts] = starts
    at = np.arange(len(buf)) - np.maximum.accumulate(at)
    size = ends - starts
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(fold.value[buf] * _POW[np.minimum(at, LONG - 1)], starts)
        out = mix(sums + size.astype(np.uint64) * _ODD)
    for i in np.flatnonzero(size > LONG):
        word = fold.as_[buf[starts[i] : ends[i]]].tobytes()
        out[i] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
    return out


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of k words within a text, number of the word it starts at)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = mix(h * _ODD + hashes[j : j + n])
    last = first[1:]
    inside = np.ones(n, bool)
    for j in range(1, k):  # a run that starts within k - 1 words of its text's end leaves it
        e = last - j
        inside[e[(e >= 0) & (e < n)]] = False
    for i in np.flatnonzero(np.diff(first) < k):  # and all runs of a short text
        inside[first[i] : min(first[i + 1], n)] = False
    at = np.flatnonzero(inside)
    return h[at], at


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """One hash of every run of k words, unlike those of runs of other lengths and of shingles(): for texts shorter than a shingle."""
    n = max(0, len(hashes) - k + 1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = mix(h * _ODD + hashes[j : j + n])
        return mix(h + np.uint64(k) * np.uint64(0xA24BAED4963EE407))


def whole(hashes: np.ndarray) -> np.uint64:
    """runs() of all words at once."""
    return runs(hashes, len(hashes))[0]
