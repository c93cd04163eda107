"""MinHash near-duplicates sensitive to order: order min-hash, then banded alignment.

A text's k-mers of five words are labelled by occurrence, so repeats differ.  For
each of ``tables`` seeds the ``per_key`` labelled k-mers with the smallest hashes
are taken and, kept in their order in the text, make one bucket key: texts agree
on a key only if they share the k-mers *and* their order.

A near pair of few k-mers could miss all tables, so a short text has sure keys
too.  Of its ``n`` k-mers at most ``f = (1 - threshold) n`` are not in common with
a near copy, so the ``per_key`` common ones of smallest hash are among its ``f +
per_key`` smallest: each choice of ``per_key`` of those, in text order, is a key.
Texts with at most ``SURE`` such choices (24 k-mers or fewer at 0.8) get them, and
two such texts are never missed.

Inside a bucket the member that shares most buckets with others leads, as the
original of a group of copies does, and each other member is aligned with it: a
bucket of copies needs one alignment each.  Buckets whose members are not all in
one component after that are settled whole: in blocks of ``BLOCK`` texts, a task
counts the k-mers that each two share by one matrix product, aligns those that
can reach the threshold and are not connected yet, and returns the links that
connect something new.  The largest component of a bucket is only compared with
the rest, never with itself.  Nothing is capped and no list of pairs is made.

The alignment is the longest common subsequence of the two k-mer sequences within
a band of diagonals, as similarity ``common / (n + n' - common)``.  Labelled
k-mers occur once per text, so it is a longest increasing run of positions.  Pairs
at ``threshold`` or above cannot leave the band, so the band loses nothing.

Equal texts collapse to one before any key is made.  Keys, leaders, pairs and
components are shuffled as 8-byte values; texts are hashed in the scan stage, and
only k-mers of texts in some pair are moved.

Defined cases: null texts and texts without words are alone in their class; texts
of one to four words link only with equal words; null ids never name a class
unless all its ids are null; repeated rows are copies of each other; texts are
used whole; an empty table gives no row; extra columns are kept or not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import with_row_id
from .components import components
from .hashing import FACTORS, U64, labelled, mix, shingles, text_pieces, words

#: Texts of a block when a bucket is settled whole.
BLOCK = 256
#: Most sure keys of a text.
SURE = 70


def least_in_order(kmers: np.ndarray, starts: np.ndarray, seed: int, per_key: int) -> np.ndarray:
    """One key per row: its ``per_key`` labelled k-mers of smallest seeded hash, in text order.

    Values below a cut that a row's smallest almost surely meet are sorted; a row
    with too few of them is cut at its full range instead.
    """
    n = np.diff(starts)
    hashed = mix(kmers + mix(np.array([seed], U64)))
    share = np.minimum(1.0, 4.0 * per_key / np.maximum(n, 1))
    cut = np.where(share < 1.0, share * 2.0**64, 2.0**64 - 2048).astype(U64)
    row = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(hashed <= cut[row])
    low = np.bincount(row[at], minlength=len(n)) < np.minimum(n, per_key)
    if low.any():
        at = np.flatnonzero((hashed <= cut[row]) | low[row])
    at = at[np.lexsort((hashed[at], row[at]))]
    first = np.searchsorted(row[at], np.arange(len(n) + 1))
    at = at[np.arange(len(at)) - first[row[at]] < per_key]
    at.sort()
    first = np.searchsorted(row[at], np.arange(len(n) + 1))
    place = np.arange(len(at)) - first[row[at]]
    terms = kmers[at] * FACTORS[place]
    sums = np.zeros(len(at) + 1, U64)
    np.cumsum(terms, out=sums[1:])
    return mix(sums[first[1:]] - sums[first[:-1]] + U64(seed))


def sure_keys(kmers: np.ndarray, starts: np.ndarray, per_key: int, threshold: float) -> dict[int, list[int]]:
    """For each short row, keys of which it shares one with any other short row at ``threshold`` or above."""
    n, out = np.diff(starts), {}
    for size in np.unique(n[n > 0]).tolist():
        apart = int((1.0 - threshold) * size + 1e-9)
        if comb(apart + per_key, per_key) > SURE:
            break
        rows = np.flatnonzero(n == size)
        own = kmers[starts[rows][:, None] + np.arange(size)]
        at = np.sort(np.argsort(mix(own), axis=1)[:, :apart + per_key], axis=1)
        own = np.take_along_axis(own, at, axis=1)
        chosen = np.array(list(combinations(range(own.shape[1]), min(per_key, size))))
        made = mix((own[:, chosen] * FACTORS[:chosen.shape[1]]).sum(axis=2, dtype=U64)).view(np.int64)
        out.update(zip(rows.tolist(), made.tolist(), strict=True))
    return out


def sketch(tables: int, per_key: int, k: int, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [], []
            for first, end, data, offsets in text_pieces(batch.column("text")):
                kmers, starts = shingles(*words(data, offsets), k)
                kmers = labelled(kmers, starts)
                n = np.diff(starts)
                made = np.stack([least_in_order(kmers, starts, t + 1, per_key) for t in range(tables)], axis=1).view(np.int64)
                sizes.append(n)
                sure = sure_keys(kmers, starts, per_key, threshold)
                keys += [x + sure.get(i, []) if m else [] for i, (x, m) in enumerate(zip(made.tolist(), n.tolist(), strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("content"), pa.array(np.concatenate(sizes) if sizes else [], pa.int64()),
                                              pa.array(keys, pa.list_(pa.int64()))], names=["row", "content", "n", "keys"])
    return run


def sequence_of(k: int):
    """Rows (row, text) to the labelled k-mers in text order, as packed 32-bit values."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for _, _, data, offsets in text_pieces(batch.column("text")):
                kmers, starts = shingles(*words(data, offsets), k)
                short = (labelled(kmers, starts) >> U64(32)).astype(np.uint32)
                packed += [short[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(packed, pa.binary())], names=["row", "kmers"])
    return run


def aligned(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Similarity of two k-mer sequences by their longest common subsequence within the band."""
    if not len(a) or not len(b):
        return 0.0
    ua, ia = np.unique(a, return_index=True)
    ub, ib = np.unique(b, return_index=True)
    _, x, y = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    i, j = ia[x], ib[y]
    band = np.abs(i - j) <= (1.0 - threshold) * max(len(a), len(b)) + 1
    i, j = i[band], j[band]
    need = threshold / (1 + threshold) * (len(a) + len(b))
    common = len(i)
    if common >= need - 1e-6:
        j = j[np.argsort(i)]
        if (np.diff(j) < 0).any():  # longest increasing subsequence
            tails: list[int] = []
            for v in j.tolist():
                at = bisect_left(tails, v)
                tails[at:at + 1] = [v]
            common = len(tails)
    return common / (len(a) + len(b) - common)


def verify(threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [aligned(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), threshold) >= threshold
                    for x, y in zip(batch.column("ka").to_pylist(), batch.column("kb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.bool_())], names=["a", "b", "near"])
    return run


def kmers_of(rows: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """``row, kmers`` of the named rows' texts.  Their number grows with the corpus, so they are never broadcast."""
    wanted = rows.select("row").distinct().hint("merge")
    return materialize(stored.select("row", "text").join(wanted, "row", "left_semi")
                       .mapInArrow(sequence_of(k), "row long, kmers binary"), "near-kmers")


def align_pairs(pairs: DataFrame, kmers: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` of the pairs that are near; pairs whose lengths alone exclude the threshold are not looked at."""
    fits = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold)
    left = kmers.select(F.col("row").alias("a"), F.col("kmers").alias("ka"))
    right = kmers.select(F.col("row").alias("b"), F.col("kmers").alias("kb"))
    tested = (pairs.filter(fits).select("a", "b").join(right, "b").join(left, "a").select("a", "b", "ka", "kb")
              .mapInArrow(verify(threshold), "a long, b long, near boolean"))
    return materialize(tested.filter("near").select("a", "b"), "near-lead-links")


def overlaps(texts: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 8192) -> np.ndarray:
    """How many values each left text shares with each right one."""
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    _, at, often = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
    shared = often[at] > 1
    _, at = np.unique(at[shared], return_inverse=True)
    owner = owner[shared]
    out = np.zeros((len(left), len(right)), np.float32)
    for lead in range(0, int(at.max(initial=-1)) + 1, width):
        here = (at >= lead) & (at < lead + width)
        held = np.zeros((len(texts), width), np.float32)
        held[owner[here], at[here] - lead] = 1
        out += held[left] @ held[right].T
    return out


def settle(threshold: float):
    """One cell: rows ``row, comp, own, kmers``; ``own`` marks the left block, null means a block with itself."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        texts = [np.frombuffer(x, np.uint32) for x in rows["kmers"]]
        n = np.array([len(t) for t in texts])
        own = rows["own"]
        alone = bool(own.isna().all())
        left = np.arange(len(texts)) if alone else np.flatnonzero(own.to_numpy(bool))
        right = left if alone else np.flatnonzero(~own.to_numpy(bool))
        common = overlaps(texts, left, right)
        alike = common / np.maximum(n[left][:, None] + n[right][None, :] - common, 1)
        x, y = np.nonzero(alike >= threshold - 1e-6)
        order = np.argsort(-alike[x, y], kind="stable")
        root = {c: c for c in rows["comp"]}

        def top(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        ids, comp, links = rows["row"].to_numpy(), rows["comp"].to_numpy(), []
        for i, j in zip(left[x[order]].tolist(), right[y[order]].tolist(), strict=True):
            p, q = top(comp[i]), top(comp[j])
            if p != q and aligned(texts[i], texts[j], threshold) >= threshold:
                root[p] = q
                links.append((ids[i], ids[j]))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")
    return run


def rest_links(ranked: DataFrame, links: DataFrame, kmers: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` that connect what is left apart in the buckets ``ranked(key, row)``, given the links so far."""
    comps = components(links)
    named = materialize(ranked.select("key", "row").join(comps, ranked["row"] == comps["node"], "left")
                        .select("key", "row", F.coalesce("component", "row").alias("comp")), "near-named")
    # The largest component of each bucket, and how many of its texts are in it and in others.  Buckets of the
    # same texts, of which near copies have many, are settled once.
    code = F.xxhash64("row")
    each = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(code).alias("x"),
                                            F.sum(code.cast("decimal(38,0)")).alias("s"))
    whole = each.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"),
                                    F.bit_xor("x").alias("x"), F.sum("s").alias("s")).filter(F.col("all") > F.col("main.n"))
    plans = (whole.groupBy("all", "x", "s").agg(F.min(F.struct("key", "main")).alias("of")).select("of.*", "all")
             .select("key", F.col("main.comp").alias("main"), F.ceil((F.col("all") - F.col("main.n")) / BLOCK).alias("others"),
                     F.ceil(F.col("main.n") / BLOCK).alias("mains")))
    placed = (named.join(plans, "key").withColumn("aside", F.col("comp") == F.col("main"))
              .withColumn("part", F.pmod(F.xxhash64("row"), F.when(F.col("aside"), F.col("mains")).otherwise(F.col("others")))
                          + F.when(F.col("aside"), F.col("others")).otherwise(0)))
    # Cell (i, j) with i <= j: blocks of other components with each other and with the main one's, which come last.
    upto = F.when(F.col("aside"), F.col("others")).otherwise(F.col("others") + F.col("mains"))
    cells = (placed.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), upto - 1)))
             .select("key", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "row", "comp",
                     F.when(F.col("part") != F.col("with"), F.col("part") < F.col("with")).alias("own")))
    cells = materialize(cells, "near-cells")
    return (cells.join(kmers, "row").groupBy("key", "i", "j").applyInPandas(settle(threshold), "a long, b long").distinct())


def links_of(members: DataFrame, stored: DataFrame, k: int, threshold: float) -> DataFrame:
    """``a, b`` of the linked texts; ``members`` has the written columns ``key, row, code, n``."""
    many = members.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    shared = materialize(members.join(many, "key"), "near-shared")
    hubs = shared.groupBy("row").agg(F.sum(F.col("held") - 1).alias("meets"))
    ranked = materialize(shared.join(hubs, "row").select("key", "row", "n", F.struct(-F.col("meets"), "code", "row", "n").alias("place")), "near-ranked")
    leaders = ranked.groupBy("key").agg(F.min("place").alias("lead")).select("key", F.col("lead.row").alias("a"), F.col("lead.n").alias("na"))
    met = materialize(ranked.join(leaders, "key").filter("a <> row").select("key", "a", "na", F.col("row").alias("b"), F.col("n").alias("nb")), "near-met")
    kmers = kmers_of(ranked, stored, k)
    links = align_pairs(met.select("a", "na", "b", "nb").distinct(), kmers, threshold)
    return links.union(materialize(rest_links(ranked, links, kmers, threshold), "near-rest-links"))


def classes(stored: DataFrame, tables: int = 16, per_key: int = 4, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """``row, class`` over a written table ``row, text, ...``: rows of one class are near copies; no row for texts without words."""
    made = (stored.select("row", "text", F.md5("text").alias("content"))
            .mapInArrow(sketch(tables, per_key, k, threshold), "row long, content string, n long, keys array<long>"))
    rows = materialize(made.filter("n > 0"), "near-sketches")
    equal = materialize(rows.groupBy("content").agg(F.min(F.struct("row", "n", "keys")).alias("of")).select("content", "of.*"), "near-distinct")
    keyed = equal.select(F.col("row"), "n", F.xxhash64("content").alias("code"), F.posexplode("keys").alias("table", "h"))
    members = materialize(keyed.select(F.xxhash64(F.least("table", F.lit(tables)), "h").alias("key"), "row", "code", "n"), "near-keys")  # the sure keys come last, as one table
    linked = components(links_of(members, stored, k, threshold))
    of = materialize(equal.select("content", "row").join(linked, equal["row"] == linked["node"], "left")
                     .select("content", F.coalesce("component", "row").alias("class")), "near-classes")
    return rows.select("row", "content").join(of, "content").select("row", "class")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, class_id, class_size, kept``; the class is named by its smallest id, which is kept."""
    stored, uid = with_row_id(docs.select("doc_id", "text"), "near-input")
    stored = stored.withColumnRenamed(uid, "row")
    of = materialize(classes(stored, **options).join(stored.select("row", "doc_id"), "row"), "near-of")
    named = of.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    full = of.join(named, "class").select("row", "class_id", "class_size")
    return (stored.select("row", "doc_id").join(full, "row", "left")
            .select("doc_id", F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))
            .withColumn("kept", F.col("class_id").eqNullSafe(F.col("doc_id"))))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without near copies: of each class exactly one row stays, the one of smallest id."""
    stored, uid = with_row_id(docs, "near-input")
    rows = stored.select(F.col(uid).alias("row"), "doc_id", "text")
    of = classes(rows, **options).join(rows.select("row", "doc_id"), "row")
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    others = materialize(of, "near-of")
    stay = others.groupBy("class").agg(F.min(first).alias("first")).select(F.col("first.row").alias("row"))
    drop = others.select("row").join(stay, "row", "left_anti").withColumnRenamed("row", uid).hint("merge")  # never broadcast
    return stored.join(drop, uid, "left_anti").select(*docs.columns)
