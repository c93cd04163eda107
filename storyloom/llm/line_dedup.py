"""Line dedup by a deletion-neighbourhood join.

Two lines are near-equal if one edit (a character replaced, inserted or deleted)
turns one into the other.  Every line emits the variants within that bound as
hashed keys: itself, and itself less each character, once with the position
(equal keys: one character replaced there) and once without (equal to the whole
of a line one character shorter).  Equal keys join, the earliest line of a key is
the witness of the others, and the edit distance between line and witness is
verified.  A line goes if the same line, or a near-equal one, stands earlier, in
the order of document id, then line.

A text has as many variants as characters, so two sieves first find the lines
that can have a neighbour at all: cut a line into ``m`` pieces and leave one out;
lines one edit apart agree on what is left for some piece, also when one is a
character longer (both are cut for both lengths).  With 2 pieces, then 16, only
lines that agree with another on all but a sixteenth remain, and only characters
of such a piece are deleted.  The sieves lose nothing, and a key with very many
lines only takes part in pre-aggregated minima and plain joins, never in pairs.

Defined cases: blank lines and those under ``min_chars`` characters stay; lines
under ``min_near`` characters go only as exact repeats; null ids come last; null
texts have no lines; rows equal in id and text are the same document and are
treated alike; texts and lines are used whole; an empty table gives no row;
extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import materialize
from .common import fresh
from .hashing import U64, Rolling, mix

SIEVES = (2, 16)


def symbols(text: str) -> np.ndarray:
    """Random bits for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return mix((points.astype(U64) + U64(1)) * U64(0xD6E8FEB86659FD93))


def cuts(n: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Where piece j of m begins and ends in a line of n characters."""
    return j * n // m, (j + 1) * n // m


def sieve_keys(roll: Rolling, a: np.ndarray, size: np.ndarray, m: int) -> np.ndarray:
    """For lines at ``a`` of ``size`` characters, the 2m hashes of the line less one piece.

    Key j is cut for the line's own length, key m + j for a line one character
    longer, of which this line lacks a character of piece j.  An empty piece, or a
    line too short, gives key 0, which joins nothing.
    """
    out = np.zeros((len(a), 2 * m), np.int64)
    for lacks in (0, 1):
        n = size + lacks
        for j in range(m):
            s, e = cuts(n, j, m)
            rest = n - e
            head, tail = roll.raw(a, a + s), roll.raw(a + size - rest, a + size)
            key = mix(mix(head + U64(3)) + mix(tail + U64(5)) * U64(0x8CB92BA72F3D8DD7) + n.astype(U64) * U64(0x9FB21C651E98DF25) + U64(j))
            out[:, lacks * m + j] = np.where((e > s) & (key != 0), key.view(np.int64), 0)
    return out


def pieces(texts: list[str], limit: int = 1 << 18) -> Iterator[list[int]]:
    """Runs of texts of about ``limit`` characters together."""
    run, held = [], 0
    for i, t in enumerate(texts):
        if run and held + len(t) > limit:
            yield run
            run, held = [], 0
        run.append(i)
        held += len(t) + 1
    if run:
        yield run


def line_table(min_chars: int, min_near: int):
    """Rows (doc_id, content, text) to the lines that count: ``doc_id, content, line, h1, h2, keys`` (first sieve)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for part in pieces(texts):
                joined = "\n".join(texts[i] for i in part)
                roll = Rolling(symbols(joined))
                breaks = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32) == 10)
                a = np.concatenate([[0], breaks + 1])
                size = np.concatenate([breaks, [len(joined)]]) - a
                starts = np.cumsum([0] + [len(texts[i]) + 1 for i in part])
                row = np.searchsorted(starts, a, "right") - 1
                number = np.arange(len(a)) - np.searchsorted(a, starts[row])
                lines = joined.split("\n")
                counts = np.array([len(x.strip()) >= min_chars for x in lines], bool)
                a, size, row, number = a[counts], size[counts], row[counts], number[counts]
                whole = roll.raw(a, a + size)
                keys = sieve_keys(roll, a, size, SIEVES[0])
                keys[size < min_near] = 0
                at = pa.array(np.asarray(part)[row])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("content").take(at), pa.array(number, pa.int64()),
                     pa.array(mix(whole + size.astype(U64)).view(np.int64)),
                     pa.array(mix(whole ^ mix(size.astype(U64) + U64(9))).view(np.int64)),
                     pa.array(keys.tolist(), pa.list_(pa.int64()))],
                    names=["doc_id", "content", "line", "h1", "h2", "keys"])
    return run


def pick_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, ids, lines) to ``id, text`` of the named lines."""
    for batch in batches:
        ids, found = [], []
        for text, own, lines in zip(*(batch.column(c).to_pylist() for c in ("text", "ids", "lines")), strict=True):
            every = text.split("\n")
            ids += own
            found += [every[i] for i in lines]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["id", "text"])


def finer_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) of single lines to ``id, keys`` of the last sieve."""
    for batch in batches:
        texts, out = batch.column("text").to_pylist(), []
        for part in pieces(texts):
            size = np.array([len(texts[i]) for i in part], np.int64)
            a = np.concatenate([[0], np.cumsum(size)[:-1]])
            out += sieve_keys(Rolling(symbols("".join(texts[i] for i in part))), a, size, SIEVES[-1]).tolist()
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.int64()))], names=["id", "keys"])


def variants(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, hits) to the deletion neighbourhood: ``id, role, key``.

    ``hits`` are the keys of the last sieve that another line shares.  Role 0: less
    the character at a position; role 1: the same without the position; role 2: the
    whole line.  Roles 1 and 2 meet under one key.
    """
    m = SIEVES[-1]
    for batch in batches:
        ids = batch.column("id").to_pylist()
        made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, text, hits in zip(ids, batch.column("text").to_pylist(), batch.column("hits").to_pylist(), strict=True):
            n = len(text)
            length = np.array([n - 1, n], U64)
            roll = Rolling(symbols(text))
            whole = roll.raw(np.array([0]), np.array([n]))
            at = [np.arange(*(int(x) for x in cuts(np.int64(n), j, m))) for j in sorted(hits) if j < m]
            p = np.concatenate(at) if at else np.zeros(0, np.int64)
            up = roll.sums[p]
            # What follows the deleted character moves down one place.
            less = up + (roll.sums[n] - roll.sums[p + 1]) * roll.down[1]
            alone = mix(less + length[:1] * U64(0x9FB21C651E98DF25))
            keys, roles = [mix(alone + p.astype(U64) + U64(1)), alone], [np.zeros(len(p), np.int8), np.ones(len(p), np.int8)]
            if any(j >= m for j in hits):
                keys.append(mix(whole + length[1:] * U64(0x9FB21C651E98DF25)))
                roles.append(np.full(1, 2, np.int8))
            k = np.concatenate(keys)
            made.append((np.full(len(k), i, np.int64), np.concatenate(roles), k.view(np.int64)))
        cols = [np.concatenate([x[c] for x in made]) if made else np.zeros(0, np.int64) for c in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int8()), pa.array(cols[2], pa.int64())],
                                         names=["id", "role", "key"])


def shared(keyed: DataFrame) -> DataFrame:
    """The rows of (``id, slot, key``) whose key another id has too."""
    keyed = keyed.filter("key <> 0")
    many = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("key")
    return keyed.join(many, "key", "left_semi")


def place() -> Column:
    """The order of lines: null ids last, then id, then the text's hash for equal ids, then line."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "content", "line")


def witnesses(lines: DataFrame, docs: DataFrame, min_near: int) -> DataFrame:
    """``h1, h2`` of the distinct lines that have a near-equal line earlier.

    ``lines`` is the written table of distinct lines ``id, h1, h2, first, keys``.
    """
    spread = lines.select("id", F.posexplode("keys").alias("slot", "key"))
    kept = shared(spread).select("id").distinct()
    # The texts of the lines that passed, each from the document where it stands first.
    at = lines.join(kept, "id", "left_semi").select("id", "first.doc_id", "first.content", "first.line")
    wanted = at.groupBy("doc_id", "content").agg(F.collect_list("id").alias("ids"), F.collect_list("line").alias("lines")).hint("merge")  # grows with the corpus: never broadcast
    source = docs.select(F.col("doc_id").alias("d"), F.col("content").alias("c"), "text")
    texts = (source.join(wanted, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("c") == F.col("content")))
             .select("text", "ids", "lines").mapInArrow(pick_lines, "id long, text string"))
    passed = materialize(texts.distinct().join(lines.select("id", "h1", "h2", "first"), "id"), "lines-passed")
    fine = passed.select("id", "text").mapInArrow(finer_keys, "id long, keys array<long>").select("id", F.posexplode("keys").alias("slot", "key"))
    hits = shared(materialize(fine, "lines-fine")).groupBy("id").agg(F.collect_set("slot").alias("hits"))
    some = materialize(passed.join(hits, "id"), "lines-some")
    neighbours = materialize(some.select("id", "text", "hits").mapInArrow(variants, "id long, role byte, key long").distinct()
                             .join(some.select("id", "first"), "id"), "lines-variants")
    # Role 0 meets role 0; roles 1 and 2 meet each other.
    firsts = neighbours.groupBy("key").agg(
        F.min(F.when(F.col("role") == 0, F.struct("first", "id"))).alias("r0"),
        F.min(F.when(F.col("role") == 1, F.struct("first", "id"))).alias("r1"),
        F.min(F.when(F.col("role") == 2, F.struct("first", "id"))).alias("r2"))
    other = F.when(F.col("role") == 0, F.col("r0")).when(F.col("role") == 1, F.col("r2")).otherwise(F.col("r1"))
    earliest = (neighbours.join(firsts, "key").withColumn("w", other).filter(F.col("w.first") < F.col("first"))
                .groupBy("id").agg(F.min("w").alias("w")).select("id", F.col("w.id").alias("witness")))
    before = passed.select(F.col("id").alias("witness"), F.col("text").alias("before"))
    return (passed.join(earliest, "id").join(before, "witness")
            .filter(F.levenshtein("text", "before", 1).between(0, 1)).select("h1", "h2"))


def repeated_lines(docs: DataFrame, min_chars: int = 4, min_near: int = 12) -> DataFrame:
    """``doc_id, content, dropped`` (line numbers from 0, sorted) of the documents that lose lines; content is the text's md5."""
    docs = docs.select("doc_id", "text", F.md5("text").alias("content"))
    occurrences = materialize(docs.filter("text IS NOT NULL").mapInArrow(
        line_table(min_chars, min_near), "doc_id long, content string, line long, h1 long, h2 long, keys array<long>"), "lines-all")
    distinct = occurrences.groupBy("h1", "h2").agg(F.min(place()).alias("first"), F.first("keys").alias("keys"))
    distinct = materialize(distinct.withColumn("id", F.monotonically_increasing_id()), "lines-distinct")
    near = materialize(witnesses(distinct, docs, min_near), "lines-near").withColumn("near", F.lit(True))
    status = distinct.select("h1", "h2", "first").join(near, ["h1", "h2"], "left")
    gone = (occurrences.select("doc_id", "content", "line", "h1", "h2").join(status, ["h1", "h2"])
            .filter(F.col("near").isNotNull() | (place() != F.col("first"))))
    return gone.groupBy("doc_id", "content").agg(F.sort_array(F.collect_set("line")).alias("dropped"))


@F.pandas_udf(StringType())
def without(text: pd.Series, dropped: pd.Series) -> pd.Series:
    """The texts less the lines at the dropped numbers."""
    out = []
    for t, gone in zip(text, dropped, strict=True):
        if t is not None and gone is not None and len(gone):
            gone = set(gone)
            t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        out.append(t)
    return pd.Series(out, dtype=object)


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and ``dropped``, the numbers of those lines (null: none)."""
    ident, content = fresh(docs.columns, "_d"), fresh(docs.columns, "_c")
    gone = materialize(repeated_lines(docs, **options), "lines-gone").withColumnsRenamed({"doc_id": ident, "content": content})
    name = fresh(docs.columns, "dropped")
    gone = gone.withColumnRenamed("dropped", name).hint("merge")  # grows with the corpus: never broadcast
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone[ident]) & (F.md5(docs["text"]) == gone[content]), "left").drop(ident, content)
    return joined.withColumn("text", without("text", F.col(name)))
