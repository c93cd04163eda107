"""Vectorised rolling hashes of words and characters over Arrow batches of texts.

One prefix sum of ``r(c) * B^i`` modulo 2^64 over a buffer gives the hash of any
substring in constant time; ``r`` maps each symbol to random bits, ``B`` is odd.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
U64 = np.uint64
#: Bytes of text hashed at once; a longer text is hashed alone.
PIECE = 1 << 18

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(n, b, U64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


_kept: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i for i below n; those for one piece are kept, a longer text's are made for it."""
    if n > PIECE + 1:
        return _powers(n)
    if not _kept:
        _kept.append(_powers(PIECE + 1))
    return _kept[0]


class Rolling:
    """Hashes of the substrings [a, b) of a sequence of symbols."""

    def __init__(self, symbols: np.ndarray) -> None:
        up, self.down = powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, U64)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sum of r(c) B^(i-a) over the substring: hashes of parts can be added at an offset."""
        return (self.sums[b] - self.sums[a]) * self.down[a]


def text_pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``PIECE`` bytes: first row, end row, their UTF-8 bytes, each row's offsets in them."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


_symbols = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and where each row's words begin (one more than the rows)."""
    solid = ~WHITE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = solid[inner]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[inner - 1] = solid[inner - 1]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashed = mix(Rolling(_symbols[data]).raw(a, b) + (b - a).astype(U64))
    return hashed, np.searchsorted(a, offsets)


FACTORS = mix(np.arange(101, 201, dtype=U64)) | U64(1)


def shingles(word: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words, and where each row's begin; a row with fewer words has one of all its words."""
    counts = np.diff(starts)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=first[1:])
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(first[-1]) - first[row] + starts[row]
    out = np.zeros(len(at), U64)
    for j in range(k):
        inside = at + j < starts[row + 1]
        out += np.where(inside, word[np.minimum(at + j, max(len(word) - 1, 0))], U64(0)) * FACTORS[j] if len(word) else U64(0)
    return mix(out), first


def labelled(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Values told apart by their occurrence: the second equal one in a row differs from the first, and so on."""
    row = np.repeat(np.arange(len(starts) - 1, dtype=np.int64), np.diff(starts))
    keyed = values ^ mix(row.astype(U64) + U64(77))
    ordered = np.sort(keyed)
    repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(repeated):
        return values
    at = np.flatnonzero(np.isin(keyed, repeated))
    order = at[np.argsort(keyed[at], kind="stable")]
    fresh = np.ones(len(order), bool)
    fresh[1:] = keyed[order[1:]] != keyed[order[:-1]]
    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    out = values.copy()
    out[order] = np.where(nth > 0, mix(values[order] + nth.astype(U64) * U64(0xA0761D6478BD642F)), values[order])
    return out
