"""Cross-entropy difference between matched target and background n-gram models.

Both models are interpolated bigram models with the same order, smoothing and
vocabulary; only their counts differ.  The background model counts all
documents, the target model those labelled good.  A document's score is the mean,
over its words, of the target's loss less the background's, in nats: the lower,
the closer to the target.

Words and pairs of words are counted under their own 64-bit hashes, every one of
the corpus, so the models grow with it; V, the words the models share, is the
number of distinct ones.  (With ``slots`` words and pairs are folded into that
many types each, and V is ``slots``.)

    p(w) = (c(w) + 1) / (N + V)
    p(w | v) = (c(v w) + mu p(w)) / (c(v) + mu)

Documents are dealt to chunks of bounded size.  A chunk sorts its distinct words
and pairs and sends each once, with its own counts, to the part of the hash range
it lies in; the part adds up the counts of all chunks and sends the sums back in
the order in which they were asked, without the hashes; the chunk, read again,
scores its documents.  A common word is sent once by a chunk like any other, so no
key is hot; parts and chunks grow in number with the text, not in size.

Defined cases: null texts and texts without words score null with 0 words;
documents without a label, or with a null one, are background only; a document
with several labels is good if most are; without any target document the target model
is the uniform one; repeated rows count and score each; an empty table gives no row;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import FACTORS, U64, mix, text_pieces, words

#: Bytes of text of a chunk, about, and the least number of chunks and parts.
CHUNK, LEAST = 8 << 20, 64
#: The rows of one doc_id are dealt to so many chunks, by their text.
SPREAD = 8
#: Stands before the first word of a text.
START = U64(1)


def ngrams(data: np.ndarray, offsets: np.ndarray, slots: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, or slot, of each word and of its pair with the word before (the first of a text pairs with the text's start), and where rows begin."""
    word, starts = words(data, offsets)
    before = np.zeros(len(word), U64)
    before[1:] = word[:-1]
    before[starts[:-1][np.diff(starts) > 0]] = START
    pair = mix(word * FACTORS[0] + before * FACTORS[1])
    if slots is None:
        return word, pair, starts
    return (word % U64(slots)).astype(np.int64), (pair % U64(slots)).astype(np.int64), starts


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, an order that sorts ``keys``, and where each distinct one begins in it."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(first)
    return ordered[first], order, first


def positions(order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each key its place among the distinct ones."""
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    return out


def sums(values: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values[order], first) if len(first) else np.zeros(0, np.int64)


def planes(x: np.ndarray) -> bytes:
    """Integers byte by byte, all lowest bytes first: small ones leave planes of zeros, which compress to nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


class Chunk:
    """The n-grams of a chunk's rows: each word and its context as places among ``keys[0]``, pairs among ``keys[1]``.

    The places depend on the set of rows alone, not on their order.
    """

    def __init__(self, texts: pa.Array, slots: int | None) -> None:
        found = [ngrams(data, offsets, slots) for _, _, data, offsets in text_pieces(texts)]
        word = np.concatenate([np.zeros(0, U64), *(w.astype(U64) for w, _, _ in found)])
        pair = np.concatenate([np.zeros(0, U64), *(p.astype(U64) for _, p, _ in found)])
        self.n = np.concatenate([np.zeros(0, np.int64), *(np.diff(s) for _, _, s in found)])
        begins = (np.cumsum(self.n) - self.n)[self.n > 0]
        start = START if slots is None else U64(slots)
        at = [grouped(mix(np.append(word, start))), grouped(mix(pair))]  # mix is one to one and spreads slots over all parts
        self.keys = [x[0] for x in at]
        word = positions(*at[0][1:])
        self.word, self.pair = word[:-1], positions(*at[1][1:])
        self.context = np.concatenate([word[-1:], word[:-2]])[:len(self.word)]
        self.context[begins] = word[-1]

    def counts(self, good: np.ndarray) -> list[list[np.ndarray]]:
        """Of words: as word and as context, in all rows and in good ones; of pairs: in all and in good ones."""
        chosen = np.repeat(good, self.n)

        def both(x: np.ndarray, n: int) -> list[np.ndarray]:
            return [np.bincount(x, minlength=n), np.bincount(x[chosen], minlength=n)]

        n = len(self.keys[0])
        return [both(self.word, n) + both(self.context, n), both(self.pair, len(self.keys[1]))]


def bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal parts of the hash range begins in sorted keys, and the end."""
    edges = np.arange(1, parts, dtype=U64) * U64((1 << 64) // parts)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


ASKED = "part int, chunk int, kind int, keys binary, counts binary"
TOLD = "part int, chunk int, kind int, counts binary"


def ask(parts: int, slots: int | None):
    """A chunk's rows and the good ids among them, to its keys and counts by part."""
    def run(docs: pa.Table, good: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows:
            known = good.column("doc_id").to_numpy()
            ids = docs.column("doc_id")
            marked = np.isin(ids.fill_null(0).to_numpy(), known) & ids.is_valid().to_numpy()
            chunk = Chunk(docs.column("text").combine_chunks(), slots)
            for kind, (keys, counts) in enumerate(zip(chunk.keys, chunk.counts(marked), strict=True)):
                at = bounds(keys, parts)
                for part, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    if a < b:
                        rows.append((part, docs.column("chunk")[0].as_py(), kind, planes(np.diff(keys[a:b], prepend=U64(0))),
                                     planes(np.concatenate([c[a:b] for c in counts]))))
        return table(rows, ASKED)

    return run


def add_up(asked: pa.Table) -> pa.Table:
    """The keys of one part from all chunks, to the sums for each chunk, in its order of keys."""
    rows, kinds = [], np.asarray(asked.column("kind"))
    for kind in (0, 1):
        own = asked.filter(pa.array(kinds == kind))
        keys = [np.cumsum(from_planes(x.as_py()), dtype=U64) for x in own.column("keys")]
        if not keys:
            continue
        counts = [from_planes(x.as_py()).astype(np.int64).reshape(-1, len(k)) for x, k in zip(own.column("counts"), keys, strict=True)]
        _, order, first = grouped(np.concatenate(keys))
        at = positions(order, first)
        total = [sums(np.concatenate([c[j] for c in counts]), order, first) for j in range(len(counts[0]))]
        ends = np.cumsum([len(k) for k in keys])
        for part, chunk, a, b in zip(own.column("part").to_pylist(), own.column("chunk").to_pylist(), [0, *ends[:-1]], ends, strict=True):
            rows.append((part, chunk, kind, planes(np.concatenate([t[at[a:b]] for t in total]))))
    return table(rows, TOLD)


def table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def losses(words: int, types: int, single: np.ndarray, pair: np.ndarray, context: np.ndarray, mu: float) -> np.ndarray:
    """Loss of each word under one model of ``words`` words, from the counts of word, pair and context, in nats."""
    return -np.log((pair + mu * (single + 1.0) / (words + types)) / (context + mu))


SCORED = "doc_id long, n_words long, target_loss double, background_loss double"


def tell(slots: int | None, totals: tuple[int, int], types: int, mu: float):
    """A chunk's rows and the sums told it, to losses."""
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        chunk = Chunk(docs.column("text").combine_chunks(), slots)
        sums = []
        for kind, width in ((0, 4), (1, 2)):
            own = sorted((p, c) for p, k, c in zip(*(told.column(x).to_pylist() for x in ("part", "kind", "counts")), strict=True) if k == kind)
            sums.append(np.concatenate([np.zeros((width, 0), np.int64), *(from_planes(c).astype(np.int64).reshape(width, -1) for _, c in own)], axis=1))
            if sums[kind].shape[1] != len(chunk.keys[kind]):
                raise RuntimeError("the documents changed between counting and scoring")
        ends = np.cumsum(chunk.n)
        means = []
        for m in (1, 0):
            loss = losses(totals[m], types, sums[0][m][chunk.word], sums[1][m][chunk.pair], sums[0][2 + m][chunk.context], mu)
            run = np.concatenate([[0.0], np.cumsum(loss)])
            means.append(pa.array((run[ends] - run[ends - chunk.n]) / np.maximum(chunk.n, 1), pa.float64(), mask=chunk.n == 0))
        return pa.table([docs.column("doc_id"), pa.array(chunk.n, pa.int64()), *means], names=[x.split()[0] for x in SCORED.split(", ")])

    return run


def sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to (doc_id, n)."""
    for batch in batches:
        n = [np.diff(words(data, offsets)[1]) for _, _, data, offsets in text_pieces(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate([np.zeros(0, np.int64), *n]), pa.int64())], names=["doc_id", "n"])


def word_types(docs: DataFrame, parts: int) -> int:
    """Distinct words of all documents."""
    def distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, fresh, held = np.zeros(0, U64), [], 0
        for batch in batches:
            for _, _, data, offsets in text_pieces(batch.column("text")):
                fresh.append(grouped(mix(words(data, offsets)[0]))[0])
                held += len(fresh[-1])
                if held > max(len(known), 1 << 20):
                    known, fresh, held = grouped(np.concatenate([known, *fresh]))[0], [], 0
        known = grouped(np.concatenate([known, *fresh]))[0]
        at = bounds(known, parts)
        rows = [(p, planes(np.diff(known[a:b], prepend=U64(0)))) for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]
        yield from table(rows, "part int, keys binary").to_batches()

    def number(found: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(from_planes(x.as_py()), dtype=U64) for x in found.column("keys")])
        return pa.table({"n": pa.array([len(grouped(keys)[0])], pa.int64())})

    found = docs.select("text").mapInArrow(distinct, "part int, keys binary").groupBy("part").applyInArrow(number, "n long")
    return found.agg(F.sum("n")).first()[0] or 0


def score(docs: DataFrame, good: DataFrame, slots: int | None = None, mu: float = 20.0) -> DataFrame:
    """``doc_id, n_words, target_loss, background_loss, score`` per document; ``good(doc_id)`` names the target documents."""
    # The list of good documents grows with the corpus: it is never broadcast.
    named = good.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST, -(-size // CHUNK))
    types = word_types(docs, parts) if slots is None else slots
    known = named.withColumn("_good", F.lit(True)).hint("merge")
    row = (docs.mapInArrow(sizes, "doc_id long, n long").join(known, "doc_id", "left")
           .agg(F.sum("n").alias("all"), F.sum(F.when(F.col("_good"), F.col("n"))).alias("good")).first())
    totals = (row["all"] or 0, row["good"] or 0)

    def dealt(spread: Column) -> Column:
        return F.pmod(F.xxhash64("doc_id", spread), F.lit(parts)).cast("int")

    by_text = F.xxhash64("text")
    chunk = F.when(F.col("doc_id").isNull(), F.pmod(by_text, F.lit(parts)).cast("int")).otherwise(dealt(F.pmod(by_text, F.lit(SPREAD)).cast("int")))
    docs = docs.withColumn("chunk", chunk)
    named = named.withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))).select("doc_id", dealt(F.col("_spread")).alias("chunk"))
    asked = docs.groupBy("chunk").cogroup(named.groupBy("chunk")).applyInArrow(ask(parts, slots), ASKED)
    told = asked.groupBy("part").applyInArrow(add_up, TOLD)
    scored = docs.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(tell(slots, totals, types, mu), SCORED)
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def good_documents(labels: DataFrame) -> DataFrame:
    """Ids that most of their labels call of good quality and not toxic."""
    return (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
            .agg(F.avg("quality").alias("q"), F.avg(F.coalesce("toxic", F.lit(0))).alias("t")).filter("q > 0.5 AND t < 0.5").select("doc_id"))
