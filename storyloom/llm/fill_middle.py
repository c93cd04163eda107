"""Fill-in-middle transformation: each text is cut into prefix, middle and suffix at random units.

A wavelet matrix over the byte classes of many texts at once answers how often
each class occurs before a position.  Sums of these ranks are counts of unit
boundaries: code points begin at every class but the continuation byte, words
at their first byte, lines end at the line feed.  A unit's cut is where the
boundary count reaches its number, found by bisection on the ranks, for all
texts of a piece together.

Each text is cut in the stage that reads it: nothing is shuffled, and a lost
executor costs only its splits.  Memory is that of one piece (256 KB of texts,
or one longer text) and its matrix, about as much again.

Defined cases: null and empty texts have 0 units and stay plain (''); a text
with a marker in it stays plain, so the output can be cut back; a null
``doc_id`` is hashed as ''; rows are handled one by one, repeated rows alike;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import WHITE, text_pieces

MARKERS = ("<P>", "<S>", "<M>")

#: Classes of bytes.
INSIDE, NEWLINE, STOP_BLANK, BLANK, WORD_START, WORD = range(6)
LEVELS = 3

#: Classes that bound a unit, and whether the unit begins there or ends there.
UNITS = {
    "char": ((NEWLINE, STOP_BLANK, BLANK, WORD_START, WORD), True),
    "word": ((WORD_START,), True),
    "line": ((NEWLINE,), False),
    "sentence": ((NEWLINE, STOP_BLANK), False),
}


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of each byte of texts that lie one after the other."""
    white = WHITE[data]
    before = np.ones(len(data), bool)
    before[1:] = white[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    before[begins] = True
    stop = np.zeros(len(data), bool)
    stop[1:] = np.isin(data[:-1], np.frombuffer(b".!?", np.uint8))
    stop[begins] = False
    out = np.where(before, WORD_START, WORD).astype(np.uint8)
    out[white] = BLANK
    out[white & stop] = STOP_BLANK
    out[data == 10] = NEWLINE
    out[(data & 0xC0) == 0x80] = INSIDE
    return out


class Bits:
    """A bit vector with the number of ones before any position."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        packed[: (len(bits) + 7) // 8] = np.packbits(bits, bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """A sequence of classes below 2^LEVELS, with ranks of any class at any positions."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.levels: list[tuple[Bits, int]] = []
        for level in reversed(range(LEVELS)):
            one = (symbols >> level) & 1 == 1
            self.levels.append((Bits(one), len(symbols) - int(np.count_nonzero(one))))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before each position."""
        first, last = np.zeros_like(at), at
        for level, (bits, zeros) in zip(reversed(range(LEVELS)), self.levels, strict=True):
            a, b = bits.ones(first), bits.ones(last)
            first, last = (zeros + a, zeros + b) if symbol >> level & 1 else (first - a, last - b)
        return last - first

    def count(self, symbols: Sequence[int], at: np.ndarray) -> np.ndarray:
        """How many positions before each one hold one of ``symbols``; counts the others if they are fewer."""
        others = [s for s in range(WORD + 1) if s not in symbols]
        if len(others) < len(symbols):
            return at - sum((self.rank(s, at) for s in others), np.zeros_like(at))
        return sum((self.rank(s, at) for s in symbols), np.zeros_like(at))

    def reach(self, symbols: Sequence[int], wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least position in [low, high] with ``wanted`` of ``symbols`` before it, by bisection on ranks."""
        low, high = low.copy(), high.copy()
        while (low < high).any():
            middle = (low + high) >> 1
            enough = self.count(symbols, middle) >= wanted
            high = np.where(enough, middle, high)
            low = np.where(enough, low, np.minimum(middle + 1, high))
        return low


def cuts(data: np.ndarray, offsets: np.ndarray, hashes: Sequence[np.ndarray], unit: str
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units per text, the two cuts as bytes from the start of ``data``, and the code points before and between them."""
    bounds, begin = UNITS[unit]
    kind = classes(data, offsets)
    matrix = WaveletMatrix(kind)
    first, end = offsets[:-1], offsets[1:]
    seen = matrix.count(bounds, offsets)
    n = np.diff(seen)
    if not begin and len(data):  # a last unit without an end
        n = n + ((end > first) & ~np.isin(kind[np.maximum(end, 1) - 1], bounds))
    drawn = [h % (n + 1) for h in hashes]
    places = []
    for units in (np.minimum(*drawn), np.maximum(*drawn)):
        place = matrix.reach(bounds, seen[:-1] + units + begin, first, end) - begin
        places.append(np.where(units == 0, first, np.where(units == n, end, place)))
    chars = UNITS["char"][0]
    at = [matrix.count(chars, p) for p in (first, *places)]
    return n, places[0], places[1], at[1] - at[0], at[2] - at[1]


def arrange(text: bytes, cut: int, cut2: int, form: str) -> bytes:
    """The text in training order."""
    prefix, middle, suffix = text[:cut], text[cut:cut2], text[cut2:]
    if form == "psm":
        return b"<P>" + prefix + b"<S>" + suffix + b"<M>" + middle
    return b"<S>" + suffix + b"<P>" + prefix + b"<M>" + middle if form == "spm" else text


def transformed(unit: str, plain_share: int, spm_share: int):
    marks = tuple(m.encode() for m in MARKERS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            h1, h2, h3, h4 = (batch.column(f"h{k}").to_numpy(zero_copy_only=False) for k in range(1, 5))
            for lo, hi, data, offsets in text_pieces(batch.column("text")):
                n, cut, cut2, before, between = cuts(data, offsets, (h1[lo:hi], h2[lo:hi]), unit)
                forms, outputs = [], []
                for i in range(hi - lo):
                    start = int(offsets[i])
                    text = data[start:int(offsets[i + 1])].tobytes()
                    plain = not text or h3[lo + i] % 100 >= 100 - plain_share or any(m in text for m in marks)
                    forms.append("plain" if plain else "spm" if h4[lo + i] % 100 < spm_share else "psm")
                    outputs.append(arrange(text, int(cut[i]) - start, int(cut2[i]) - start, forms[-1]))
                plain = np.array([f == "plain" for f in forms])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(forms, pa.string()),
                     pa.array(before, pa.int64(), mask=plain), pa.array(between, pa.int64(), mask=plain),
                     pa.array(outputs, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def transform(docs: DataFrame, unit: str = "char", plain_share: int = 10, spm_share: int = 20, seed: str = "1") -> DataFrame:
    """One row per document: ``doc_id, n`` (units), ``form, prefix_chars, middle_chars, output``.

    The cuts and the form follow from the SHA-256 of ``seed:doc_id``, so any run
    gives the same.  ``plain_share`` percent of the texts stay as they are, and
    ``spm_share`` percent of the others have the suffix first.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    parts = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *parts).mapInArrow(
        transformed(unit, plain_share, spm_share),
        f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The original text, cut back together from a transformed one."""
    part = F.split(F.col(output), "<[PSM]>", -1)
    first, second, middle = part.getItem(1), part.getItem(2), part.getItem(3)
    return (F.when(F.col(form) == "psm", F.concat(first, middle, second))
            .when(F.col(form) == "spm", F.concat(second, middle, first)).otherwise(F.col(output)))
