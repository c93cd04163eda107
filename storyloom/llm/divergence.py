"""Source divergence audit: how the word use of each source differs from its language and from its sister sources.

Groups are (lang, source).  A language's vocabulary holds the terms of at least
``min_docs`` of its documents; a group's share of a term, in parts per billion
and smoothed by one count, is p, and f = floor((p - q)^2 / q) is the term's part
of the divergence from a group or language with share q.  All of it is integer
arithmetic.

Pairs of groups are computed over a three-dimensional cube.  A task owns a cell
(group block, group block, term block); the slices of a group block are copied
to the cells of each other block, a cell holds at most a few million shares,
and its partial sums are added up along the term axis.  A cell holds only the
terms that one of its groups uses: those that neither uses differ by the same f
for each pair, which is added once, so rare terms cost nothing.  Blocks are cut
by hash and their numbers follow from the numbers of sources and terms, so
cells stay equal whichever source or term is frequent.

Terms are counted inside the scan: each task hands on one row per group and
term it met (or several, when its table reaches ``FLUSH`` entries), and one
shuffle on (lang, term) serves counts, document numbers and totals.

Defined cases: null text, lang and source are ''; a group whose texts hold no
term still has its rows in part ``pair``; a language without vocabulary has
value 0 for each pair; repeated rows count each; ties go by item; texts of any
length are counted in slices; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Bytes of terms: letters (A to Z in lower case) and all of non-ASCII characters; others part terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
SLICE = 1 << 20
FLUSH = 1_000_000
DOCUMENT = 1 << 40  # a task's entry is documents * DOCUMENT + occurrences

BILLION = 1_000_000_000
GROUPS_A_BLOCK = 16
TERMS_A_BLOCK = 1 << 15


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some MB at a time."""
    start = 0
    while start < len(text):
        end = start + SLICE
        while end < len(text) and LETTERS[text[end]] != 32:
            end += 1
        yield text[start:end].translate(LETTERS).split()
        start = end


def count_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "source", "term", "n", "docs"]
    groups: dict[tuple[str, str], dict[bytes, int]] = {}
    size = met = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in groups.items():
            packed = np.fromiter(found.values(), np.int64, len(found))
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(lang, len(found)), pa.repeat(source, len(found)),
                 pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(packed & (DOCUMENT - 1)), pa.array(packed >> 40)],
                names=names)
        groups.clear()

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in ("lang", "source")]
        for lang, source, text in zip(*columns, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            count: Counter[bytes] = Counter()
            for some in terms(text):
                count.update(some)
            found = groups.setdefault((lang, source), {})
            size -= len(found)
            for term, n in count.items():
                found[term] = found.get(term, 0) + n + DOCUMENT
            size += len(found)
            met += 1
            if size >= FLUSH or met >= FLUSH:
                yield from flush()
                size = met = 0
    yield from flush()


def share(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + size)), exact; null without vocabulary."""
    over = F.nullif((total + size).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.lit(1).cast("long") + F.call_function(
        "div", F.lit(BILLION).cast("decimal(10,0)") * (n + F.lit(1)).cast("decimal(19,0)"), over)


def part_of(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def cell(table: pa.Table) -> pa.Table:
    """Partial divergences of one cell: above those of a term that neither group uses, for each pair it owns."""
    lang, left, right = (table.column(k)[0].as_py() for k in ("lang", "left", "right"))
    bare = table.filter(pc.is_null(table.column("term")))
    used = table.filter(pc.is_valid(table.column("term")))
    sources = bare.column("source").to_pylist()
    block, rest = (bare.column(k).to_numpy() for k in ("block", "p"))
    number = pc.index_in(used.column("source"), value_set=bare.column("source").combine_chunks()).to_numpy()
    coded = used.column("term").combine_chunks().dictionary_encode()
    width = len(coded.dictionary)
    shares = np.repeat(rest[:, None], width, axis=1)
    shares[number, coded.indices.to_numpy()] = used.column("p").to_numpy()
    out: dict[str, list] = {"source": [], "item": [], "value": []}
    for j in range(len(sources)) if width else ():
        own = np.flatnonzero(block != block[j]) if left != right else np.delete(np.arange(len(sources)), j)
        if not len(own):
            continue
        gap = shares[own] - shares[j]
        gap *= gap
        gap //= shares[j]
        value = gap.sum(axis=1) - width * ((rest[own] - rest[j]) ** 2 // rest[j])
        out["source"] += [sources[i] for i in own]
        out["item"] += [sources[j]] * len(own)
        out["value"] += value.tolist()
    return pa.table({"lang": pa.array([lang] * len(out["value"]), pa.string()), "source": pa.array(out["source"], pa.string()),
                     "item": pa.array(out["item"], pa.string()), "value": pa.array(out["value"], pa.int64())})


def counted(docs: DataFrame, min_docs: int) -> DataFrame:
    """``lang, source, term, n, lang_n, head``: the kept terms of each group; ``head`` is 1 on one row of each term."""
    rows = docs.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    per = (rows.repartition("lang", "term").groupBy("lang", "source", "term")
           .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    of = Window.partitionBy("lang", "term").orderBy("source")
    whole = of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (per.select("lang", "source", "term", "n", F.sum("docs").over(whole).alias("_docs"), F.sum("n").over(whole).alias("lang_n"),
                       (F.row_number().over(of) == 1).cast("long").alias("head"))
            .filter(F.col("_docs") >= min_docs).drop("_docs"))


def ranked(df: DataFrame, part: str) -> DataFrame:
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by).cast("int").alias("rank"))


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200, groups_a_block: int = GROUPS_A_BLOCK,
          terms_a_block: int = TERMS_A_BLOCK) -> DataFrame:
    """``lang, source, part, item, value, rank``: every pair of sources of a language, and each group's ``top`` most overused terms."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = materialize(counted(docs, min_docs), "divergence-terms")

    zero = F.lit(0).cast("long")
    langs = kept.groupBy("lang").agg(F.sum("head").alias("size"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    occurring = docs.select("lang", "source").distinct()
    counts = occurring.groupBy("lang").agg(F.count("*").alias("n_sources"))
    size = F.coalesce("size", zero)
    groups = materialize(
        occurring.join(counts, "lang").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
        .withColumn("blocks", F.ceil(F.col("n_sources") / groups_a_block).cast("int"))
        .select("lang", "source", size.alias("size"), F.coalesce("lang_total", zero).alias("lang_total"), "blocks",
                F.coalesce("total", zero).alias("total"), F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"),
                F.greatest(F.ceil(size / terms_a_block), F.lit(1)).cast("int").alias("slabs"),
                share(zero, F.coalesce("total", zero), size).alias("p0")), "divergence-groups")

    known = kept.join(groups, ["lang", "source"])
    p = share(F.col("n"), F.col("total"), F.col("size"))

    q = share(F.col("lang_n"), F.col("lang_total"), F.col("size"))
    over = (known.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
            .filter(F.col("p") > F.col("q")).withColumn("value", part_of(F.col("p"), F.col("q"))))
    top_terms = ranked(over, "term").filter(F.col("rank") <= top)

    used = known.select("lang", "source", "block", "blocks", F.pmod(F.xxhash64("term"), F.col("slabs")).cast("int").alias("slab"),
                        "term", p.alias("p"))
    bare = groups.filter(F.col("size") > 0).select(
        "lang", "source", "block", "blocks", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)).alias("slab"),
        F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"))
    copies = (used.unionByName(bare).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("lang", F.least("block", "_other").alias("left"), F.greatest("block", "_other").alias("right"),
                      "slab", "source", "block", "term", "p"))
    partial = (copies.groupBy("lang", "left", "right", "slab")
               .applyInArrow(cell, "lang string, source string, item string, value long")
               .groupBy("lang", "source", "item").agg(F.sum("value").alias("part")))

    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = (groups.select("lang", "source", "size", "p0").join(others, "lang").filter(F.col("source") != F.col("item"))
             .join(partial, ["lang", "source", "item"], "left")
             .select("lang", "source", "item", (F.coalesce(F.col("size") * part_of(F.col("p0"), F.col("q0")), zero)
                                                + F.coalesce("part", zero)).alias("value")))
    return ranked(pairs, "pair").unionByName(top_terms)
