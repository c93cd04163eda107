"""Language identification by unigram pieces with all segmentations summed.

Each language has probabilities of the pieces of one fixed public vocabulary.
The probability of a word is the sum over all its segmentations into pieces, by
a forward algorithm over its bytes; a text's is the product over its words.
Training is expectation maximisation over all training texts: forward and
backward sums give the expected use of each piece, starting from probabilities
that fall with a piece's rank in the vocabulary.  The language with the greatest posterior is predicted.

A word is a run of letters in lower case with a blank before it; pieces never
cross words, so the product is the sum over the segmentations of the whole text.
Runs of more than ``UNIT`` letters are scored in parts of that length.

Texts are read once per round and once to be scored; words are scored once per
task and looked up afterwards.  Only expected counts leave a training task, at
most one row per piece and language, as integers, so that sums do not depend on
their order.  The model goes to all tasks: vocabulary times ``block`` languages
numbers at most; more languages are learned and scored block by block.

Defined cases: null texts and texts without letters are ``und`` with score 0,
as is every text if nothing was learned; a null ``lang`` is not learned, an
empty one is a value like others; ties go to the language first in order;
repeated rows count each; texts of any length are read whole; other columns are
not read.
"""

from __future__ import annotations

import base64
import functools
import math
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import U64, Rolling, _symbols, mix

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
UNKNOWN = "und"
#: Letters of a word scored as one unit.
UNIT = 32
#: Bytes of words scored at once.
PIECE = 1 << 15
#: Characters of texts read at once.
SLICE = 1 << 17
#: Words a task remembers, or gathers before it counts.
WORDS = 400_000
#: Added to the expected use of every piece.
SMOOTH = 0.1
#: Bits of a place in the table of pieces.
TABLE = 20
#: Added to the logarithm of a probability for each byte, and the least sum that is taken as exact.
SCALE = 4 * math.log(2)
LEAST = 1e-250
#: Expected counts travel as integers of this many parts.
PARTS = 1 << 16

NO_LETTER = re.compile(r"[\W\d_]")


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The pieces that lower-case words can hold, by rank, and every single byte that is missing."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}
    body = re.compile(rb" ?[a-z\x80-\xff]*")
    found = [p for p in sorted(ranks, key=ranks.get) if body.fullmatch(p)]
    return found + [bytes([b]) for b in range(256) if bytes([b]) not in ranks or not body.fullmatch(bytes([b]))]


def units(word: str) -> list[bytes]:
    """What a run of letters is scored as; characters that are no letters part it."""
    runs = [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split()
    return [(b"" if at else b" ") + run[at:at + UNIT].encode() for run in runs for at in range(0, len(run), UNIT)]


def all_units(words: Iterable[str]) -> tuple[list[bytes], np.ndarray]:
    """Units of many words, and how many each word has."""
    out, sizes = [], []
    for word in words:
        if len(word) <= UNIT and word.isalpha():
            out.append(b" " + word.encode())
            sizes.append(1)
        else:
            several = units(word)
            out += several
            sizes.append(len(several))
    return out, np.array(sizes, np.int64)


@functools.cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def slices(texts: Iterable[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers of texts and the texts, or parts of them cut outside words, some ``SLICE`` characters at a time."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        text, at = (text or "").lower(), 0
        while at < len(text):
            end = at + SLICE
            if end < len(text):
                gap = NO_LETTER.search(text, end)
                end = gap.start() if gap else len(text)
            rows.append(row)
            parts.append(text[at:end])
            size, at = size + len(parts[-1]), end
            if size >= SLICE:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


class Numbers(dict):
    """Numbers keys in the order they are met."""

    def __missing__(self, key: int) -> int:
        self[key] = number = len(self)
        return number


class Words:
    """The words of texts, told apart by 64-bit hashes of their letters and numbered as they are met."""

    def __init__(self) -> None:
        self.number, self.words = Numbers(), []

    def read(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The text each word stands in, in order, and the words' numbers."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for rows, parts in slices(texts):
            joined = "\n".join(parts)
            code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            edge = np.flatnonzero(np.diff(letters()[code], prepend=False, append=False))
            begin, end = edge[::2], edge[1::2]
            if not len(begin):
                continue
            hashes = Rolling(mix(code.astype(U64) + U64(1))).raw(begin, end) + (end - begin).astype(U64)
            found, first, at = np.unique(hashes, return_index=True, return_inverse=True)
            numbers = np.array(list(map(self.number.__getitem__, found.tolist())))
            new = first[numbers >= len(self.words)]
            self.words += [joined[a:b] for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)]
            starts = np.cumsum([0] + [len(p) + 1 for p in parts])
            out.append((np.array(rows)[np.searchsorted(starts, begin, "right") - 1], numbers[at]))
        rows, numbers = zip(*out, strict=True)
        return np.concatenate(rows), np.concatenate(numbers)

    def clear(self) -> None:
        self.number.clear()
        self.words.clear()


class Vocabulary:
    """Pieces by number, found by the hash of their bytes."""

    def __init__(self, pieces: Sequence[bytes]) -> None:
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        hashes = mix(Rolling(_symbols[data]).raw(ends - sizes, ends) + sizes.astype(U64))
        self.sizes, self.lengths = sizes, sorted(set(sizes.tolist()))
        self.hashes = hashes
        self.table = np.full(1 << TABLE, len(pieces), np.int32)
        self.table[hashes >> U64(64 - TABLE)] = np.arange(len(pieces))
        # Pieces whose place in the table another one took.
        lost = np.flatnonzero(self.table[hashes >> U64(64 - TABLE)] != np.arange(len(pieces)))
        self.lost = lost[np.argsort(hashes[lost])]
        self.crowded = np.zeros(1 << TABLE, bool)
        self.crowded[hashes[lost] >> U64(64 - TABLE)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces, and the numbers of those."""
        place = h >> U64(64 - TABLE)
        number = self.table[place]
        at = np.flatnonzero(number < len(self.sizes))
        right = self.hashes[number[at]] == h[at]
        hit = np.zeros(len(h), bool)
        hit[at[right]] = True
        rest = at[~right]
        rest = rest[self.crowded[place[rest]]]
        if len(rest):
            known = self.hashes[self.lost]
            at = np.minimum(np.searchsorted(known, h[rest]), len(known) - 1)
            right = known[at] == h[rest]
            hit[rest[right]], number[rest[right]] = True, self.lost[at[right]]
        return hit, number[hit]

    def scaled(self, model: np.ndarray) -> np.ndarray:
        """Probabilities from logarithms, raised by ``SCALE`` a byte so that those of whole units stay in range."""
        return np.exp(model + SCALE * self.sizes[:, None])

    def log_probability(self, words: Sequence[bytes], model: np.ndarray) -> np.ndarray:
        """Of each unit under each column of ``model``: log-probabilities of pieces by language."""
        out = np.zeros((len(words), model.shape[1]))
        done, p = 0, self.scaled(model)
        for some in runs(words):
            lattice = Lattice(some, self)
            ways = lattice.sums(p[lattice.piece])[lattice.last]
            with np.errstate(divide="ignore"):
                found = np.log(ways) - SCALE * lattice.sizes[:, None]
            low = np.flatnonzero((ways < LEAST).any(axis=1))
            if len(low):  # too small for a double: in logarithms
                few = Lattice([some[k] for k in low], self)
                found[low] = few.sums(model[few.piece], logs=True)[few.last]
            out[done:done + len(some)] = found
            done += len(some)
        return out

    def expected(self, words: Sequence[bytes], lang: np.ndarray, weight: np.ndarray, model: np.ndarray) -> np.ndarray:
        """Expected use of each piece by each language, for units of known language and number."""
        out, p = np.zeros(model.size), self.scaled(model)

        def add(some: Sequence[bytes], of: np.ndarray, times: np.ndarray, logs: bool) -> None:
            nonlocal out
            lattice = Lattice(some, self)
            of_edge = of[lattice.word]
            edge = (model if logs else p)[lattice.piece, of_edge][:, None]
            before, after = lattice.sums(edge, logs=logs)[:, 0], lattice.sums(edge, backward=True, logs=logs)[:, 0]
            whole = before[lattice.last]
            if logs:
                use = np.exp(before[lattice.begin] + edge[:, 0] + after[lattice.end] - whole[lattice.word])
            else:
                low = np.flatnonzero(whole < LEAST)
                if len(low):
                    add([some[k] for k in low], of[low], times[low], True)
                    times, whole = times.copy(), whole.copy()
                    times[low], whole[low] = 0, 1
                use = before[lattice.begin] * edge[:, 0] * after[lattice.end] / whole[lattice.word]
            out += np.bincount(lattice.piece * model.shape[1] + of_edge, use * times[lattice.word], model.size)

        done = 0
        for some in runs(words):
            add(some, lang[done:done + len(some)], weight[done:done + len(some)], False)
            done += len(some)
        return out.reshape(model.shape)


class Lattice:
    """All occurrences of pieces in a list of units, as edges between positions."""

    def __init__(self, words: Sequence[bytes], vocabulary: Vocabulary) -> None:
        data = np.frombuffer(b"".join(words), np.uint8)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(self.sizes)
        word = np.repeat(np.arange(len(words)), self.sizes)
        left = ends[word] - np.arange(len(data))
        rolling = Rolling(_symbols[data])
        found = []
        at = np.arange(len(data))
        for length in vocabulary.lengths:
            at = at[left[at] >= length]
            if not len(at):
                break
            hit, number = vocabulary.find(mix(rolling.raw(at, at + length) + U64(length)))
            found.append((at[hit], number, np.full(len(number), length)))
        begin, piece, length = (np.concatenate(c) for c in zip(*found, strict=True))
        self.last = ends + np.arange(len(words))
        self.first = self.last - self.sizes
        self.widest = int(length.max())
        # In the order of the forward sums.
        order = self._order(begin + length - (ends - self.sizes)[word[begin]], length)
        begin, self.piece, self.length = begin[order], piece[order], length[order]
        self.word = word[begin]
        self.begin = begin + self.word          # each unit has one position more than bytes
        self.end = self.begin + self.length

    def _order(self, distance: np.ndarray, length: np.ndarray) -> np.ndarray:
        kind = distance * (self.widest + 1) + length
        return np.argsort(kind.astype(np.uint16) if int(kind.max()) < 1 << 16 else kind, kind="stable")  # by radix, if it can

    def sums(self, edge: np.ndarray, backward: bool = False, logs: bool = False) -> np.ndarray:
        """Sums over all ways to each position from its unit's start (or to its end), of products of ``edge``.

        ``edge`` holds the probability of each occurrence, or its logarithm, in one or more
        columns.  Occurrences of one length at one distance from their unit's start are of
        different units, so each such run is added at once, nearest first.
        """
        source, target, length, distance = self.begin, self.end, self.length, self.end - self.first[self.word]
        if backward:
            distance = self.last[self.word] - self.begin
            order = self._order(distance, length)
            source, target, edge, length, distance = self.end[order], self.begin[order], edge[order], length[order], distance[order]
        out = np.full((int(self.last[-1]) + 1, edge.shape[1]), -np.inf if logs else 0.0)
        out[self.last if backward else self.first] = 0.0 if logs else 1.0
        stops = np.flatnonzero((length[1:] != length[:-1]) | (distance[1:] != distance[:-1])) + 1
        for lo, hi in zip([0, *stops], [*stops, len(length)], strict=True):
            ways = out[source[lo:hi]]
            if logs:
                out[target[lo:hi]] = np.logaddexp(out[target[lo:hi]], ways + edge[lo:hi])
            else:
                ways *= edge[lo:hi]
                out[target[lo:hi]] += ways
        return out


def runs(words: Sequence[bytes]) -> Iterator[Sequence[bytes]]:
    """Consecutive units of ``PIECE`` bytes in all."""
    first = size = 0
    for k, word in enumerate(words):
        size += len(word)
        if size >= PIECE:
            yield words[first:k + 1]
            first, size = k + 1, 0
    if first < len(words):
        yield words[first:]


@dataclass
class Model:
    """Languages in order, each with log-probabilities of the pieces, and their log-shares of the training texts."""

    pieces: list[bytes]
    langs: list[str]
    log_p: np.ndarray
    prior: np.ndarray


def counter(pieces: list[bytes], langs: list[str], log_p: np.ndarray):
    """Training texts (lang, text) to the expected use of pieces, one row for each piece and language used."""
    number = {lang: k for k, lang in enumerate(langs)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(pieces)
        total = np.zeros(log_p.shape)
        words, met = Words(), []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in met]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in met]))

        def count() -> np.ndarray:
            keys, times = merged()
            word, lang = np.divmod(keys, len(langs))
            found, sizes = all_units(words.words)
            at = np.repeat(np.arange(len(word)), sizes[word])
            first = (np.cumsum(sizes) - sizes)[word]
            unit = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(sizes[word]) - sizes[word], sizes[word])
            words.clear()
            met.clear()
            return vocabulary.expected([found[u] for u in unit.tolist()], lang[at], times[at], log_p)

        for batch in batches:
            of = np.array([number[k] for k in batch.column("lang").to_pylist()], np.int64)
            row, word = words.read(batch.column("text").to_pylist())
            met.append(np.unique(word * len(langs) + of[row], return_counts=True))
            if len(words.words) >= WORDS:
                total += count()
            elif sum(len(k) for k, _ in met) > 4 * WORDS:
                met[:] = [merged()]
        if words.words:
            total += count()
        use = np.rint(total * PARTS).astype(np.int64)
        piece, lang = np.nonzero(use)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(use[piece, lang])],
                                         names=["piece", "lang", "use"])
    return run


def train(docs: DataFrame, path: str = VOCABULARY, rounds: int = 2, block: int = 64) -> list[Model]:
    """Models of the languages of ``docs`` (text, lang), ``block`` languages each; no model without training texts.

    All languages start from the same probabilities, in proportion to 1 / rank in the vocabulary.
    """
    pieces = read_vocabulary(path)
    known = (docs.select(F.col("lang").cast("string").alias("lang"), "text")
             .filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")))
    number = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(number, key=str.encode)
    models = []
    for first in range(0, len(langs), block):
        some = langs[first:first + block]
        texts = known if len(langs) <= block else known.filter(F.col("lang").isin(some))
        start = -np.log(np.arange(1, len(pieces) + 1))
        log_p = np.repeat((start - np.log(np.exp(start).sum()))[:, None], len(some), axis=1)
        for _ in range(rounds):
            rows = (texts.mapInArrow(counter(pieces, some, log_p), "piece int, lang int, use long")
                    .groupBy("piece", "lang").agg(F.sum("use").alias("use")).toArrow())
            use = np.full(log_p.shape, SMOOTH)
            use[rows["piece"].to_numpy(), rows["lang"].to_numpy()] += rows["use"].to_numpy() / PARTS
            log_p = np.log(use / use.sum(axis=0))
        models.append(Model(pieces, some, log_p, np.log([number[k] / sum(number.values()) for k in some])))
    return models


def scorer(model: Model, last: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares each text's best language so far with those of ``model``; ``total`` is the log-sum over all languages met."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model.pieces)
        words = Words()
        scores = np.zeros((0, len(model.langs)))
        for batch in batches:
            if len(words.words) >= WORDS:
                words.clear()
                scores = scores[:0]
            row, word = words.read(batch.column("text").to_pylist())
            if len(words.words) > len(scores):
                found, sizes = all_units(words.words[len(scores):])
                fresh = np.zeros((len(sizes), len(model.langs)))
                np.add.at(fresh, np.repeat(np.arange(len(sizes)), sizes), vocabulary.log_probability(found, model.log_p))
                scores = np.concatenate([scores, fresh])
            first = np.flatnonzero(np.diff(row, prepend=-1))
            each = np.add.reduceat(scores[word], first, axis=0) + model.prior if len(first) else []
            best, top, total = (batch.column(k).to_pylist() for k in ("best", "top", "total"))
            for i, score in zip(row[first].tolist(), each, strict=True):
                k = int(score.argmax())
                if top[i] is None or score[k] > top[i]:
                    best[i], top[i] = model.langs[k], float(score[k])
                total[i] = float(np.logaddexp.reduce(score if total[i] is None else [*score, total[i]]))
            kept = [] if last else [batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *kept, pa.array(best, pa.string()), pa.array(top, pa.float64()), pa.array(total, pa.float64())],
                names=["doc_id", *["text"] * len(kept), "best", "top", "total"])
    return run


def predict(docs: DataFrame, models: Sequence[Model]) -> DataFrame:
    """``doc_id, lang_pred, score`` of each row: the most probable language of its text and its posterior probability."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = "best string, top double, total double"
    rows = docs.select("doc_id", "text", F.lit(None).cast("string").alias("best"), F.lit(None).cast("double").alias("top"),
                       F.lit(None).cast("double").alias("total"))
    for k, model in enumerate(models):
        last = k == len(models) - 1
        rows = rows.mapInArrow(scorer(model, last), f"doc_id {kind}, " + ("" if last else "text string, ") + rest)
    return rows.select("doc_id", F.coalesce("best", F.lit(UNKNOWN)).alias("lang_pred"),
                       F.when(F.col("top").isNull(), 0.0).otherwise(F.least(F.exp(F.col("top") - F.col("total")), F.lit(1.0))).alias("score"))


def held_out(doc_id: str = "doc_id") -> Column:
    """One document in four by its id; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2
