"""Words of whole texts as 64-bit hashes, computed over Arrow buffers with numpy.

A text is never turned into Python strings: a chunk of texts is one byte array, words are found by a byte class,
and a word is hashed in lanes of eight bytes, each of which goes through a bijection that isn't linear in what it
takes. Equal hashes can be confirmed on the bytes, lane by lane (:func:`same_bytes`, :func:`numbered`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are handled at once (a longer text is a chunk of its own).
CHUNK = 1 << 20

#: Lanes of a word that are hashed with numpy; what is longer goes to xxhash.
LANES = 16

_U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Byte classes of the two word definitions; bytes from 0x80 belong to non-ASCII letters and signs.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: By number of bytes that are left, the bytes of a lane that belong to a word.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_STEP = _U(0x9E3779B97F4A7C15)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on, as one number (zeros behind the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end) of ``data``."""
    size = (end - start).astype(np.int64)
    h = mix(size.astype(np.uint64) * _STEP + _U(seed * 0xD1342543DE82EF95 & (1 << 64) - 1))
    if not len(size):
        return h
    at = lanes(data)
    left, row = size, None  # row: the words that have more lanes
    for k in range(LANES):
        if row is None:
            lane = at[start] & _MASK[np.minimum(left, 8)]
            h = mix((h ^ lane) + _STEP)
        else:
            lane = at[start[row] + 8 * k] & _MASK[np.minimum(left, 8)]
            h[row] = mix((h[row] ^ lane) + _STEP)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        row, left = more if row is None else row[more], left[more] - 8
    for i in row.tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), int(h[i]))
    return h


def same_bytes(a: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Which ranges of ``a`` have the same bytes as the ranges of ``b`` beside them."""
    left = (a_end - a_start).astype(np.int64)
    ok = left == b_end - b_start
    x, y = lanes(a), lanes(b)
    row = np.flatnonzero(ok & (left > 0))
    k = 0
    while len(row):
        if k >= LANES:  # few and long
            for i in row.tolist():
                ok[i] = a[a_start[i] : a_end[i]].tobytes() == b[b_start[i] : b_end[i]].tobytes()
            break
        n = left[row] - 8 * k
        diff = (x[a_start[row] + 8 * k] ^ y[b_start[row] + 8 * k]) & _MASK[np.minimum(n, 8)]
        ok[row[diff != 0]] = False
        row = row[(diff == 0) & (n > 8)]
        k += 1
    return ok


def numbered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(first place of each distinct range, number of each range's distinct one, hash seed): distinct by bytes.

    Distinct ranges come in the order of their hashes by that seed; where two of one hash differ, another is taken.
    """
    for seed in range(64):
        which, u = pd.factorize(hashes(data, start, end, seed))
        first = np.empty(len(u), np.int64)
        first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        order = np.argsort(u)
        place = np.empty(len(u), np.int64)
        place[order] = np.arange(len(u))
        first, which = first[order], place[which]
        again = np.ones(len(which), bool)
        again[first] = False
        again = np.flatnonzero(again)
        of = first[which[again]]
        if same_bytes(data, start[again], end[again], data, start[of], end[of]).all():
            return first, which, seed
    raise AssertionError("no hash tells the ranges apart")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string or binary column without a copy; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets.astype(np.int64)


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) of runs of whole texts of about ``most`` bytes."""
    if not len(column):
        return
    data, offsets = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross a text's edge."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


class Words:
    """The words of a chunk: ``hash``, ``start``, ``end`` by word; ``first`` has where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word: np.ndarray = NOT_SPACE, lower: bool = True):
        if lower:
            data = LOWER[data]
        self.data, self.offsets = data, offsets
        self.start, self.end = spans(word[data], offsets)
        self.first = np.searchsorted(self.start, offsets)
        self.hash = hashes(data, self.start, self.end)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)
