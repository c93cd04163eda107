"""Mixing sources to target weights by a low-discrepancy source schedule.

Point ``t`` of the golden-ratio sequence, ``frac(t * phi)``, falls into the
interval of one source on the line of cumulative weights, so slot ``t`` of the
mix belongs to that source, and every prefix of the mix holds the sources near
their shares.  Slots are ranked inside their source.  Each source's documents,
in a shuffled order (by md5 of seed and id), form one long stream of words cut
into blocks of equal token count; slot rank ``r`` takes block ``r`` of that
stream, and starts over when the stream is used up.

Only DataFrame functions are used.  No group is ever handled whole: ranks and
word offsets are two-level sums over chunks of bounded size, a source meets its
documents through (source, block) keys, and slots find their source through an
equi-join on cells of the unit line.

Defined cases: a null text has 0 words and is never taken; null sources form
one source, ordered last; rows equal in all columns count each on their own;
null ids shuffle together, ordered by size; an empty table, or one without any
word, gives targets of 0 and an empty mix.  Extra columns of the input are not
read.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import running_total, word_count

#: The golden ratio's inverse in units of 2^-64: point n is the fraction of n times it, exact at any n.
UNITS = Decimal(2 ** 64)
GOLDEN = Decimal(11400714819323198485)
WEIGHTS = (3.0, 1.0, 2.0)
#: Documents of a source that one task orders; slots of the schedule that one task ranks.
CHUNK_DOCS, CHUNK_SLOTS = 512, 2048
#: Cells of the unit line through which slots and source intervals meet.
CELLS = 1024


def plan_sources(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = 1.5,
                 cap: float = 2.0) -> DataFrame:
    """One row per source: ``source, src, n_rows, source_size, weight, target, want``.

    ``budget`` times all words are shared by weight (sources by code point, null
    last, take ``weights`` in turn).  No target exceeds ``cap`` times its source;
    the excess is reshared by weight.  With sources sorted by words per weight,
    those that fill up are a prefix, so running sums find the level at which the
    rest settle.  ``want`` is the target in whole words.
    """
    stats = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"),
                                        F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    by_fill = Window.orderBy("fill", "src")
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    done = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("src") % len(weights) + 1).cast("int"))
    return (stats
            .withColumn("src", (F.row_number().over(by_name) - 1).cast("long"))
            .withColumn("weight", weight)
            .withColumn("limit", F.col("source_size") * F.lit(float(cap)))
            .withColumn("fill", F.col("limit") / F.col("weight"))
            .withColumn("level", (F.sum("source_size").over(every) * F.lit(float(budget))
                                  - F.coalesce(F.sum("limit").over(done), F.lit(0.0)))
                        / F.sum("weight").over(rest))
            .withColumn("full", F.col("level") >= F.col("fill"))
            .withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(every))
            .withColumn("target", F.when(F.col("full"), F.col("limit"))
                        .otherwise(F.col("level") * F.col("weight")))
            .withColumn("want", F.floor(F.col("target") + 0.5).cast("long"))
            .select("source", "src", "n_rows", "source_size", "weight", "target", "want"))


def schedule(sources: DataFrame, block_tokens: int) -> DataFrame:
    """The slots of the mix: ``slot, src, block, first, last``.

    ``slot`` orders the mix; the slot takes words ``[first, last)`` of its source's
    stream, which lie in block ``block``.  A source needs as many slots as its
    ``want`` fills blocks, and owns that share of the unit line.  The largest gap
    among the first n points is below 2 / n, so three times as many points as
    slots give every source enough; those beyond its need are passed over.
    """
    spark = sources.sparkSession
    size, want, b = F.col("source_size"), F.col("want"), F.lit(block_tokens)
    need = (F.when(size > 0, F.floor(want / size) * F.ceil(size / b)
                   + F.ceil(F.pmod(want, size) / b)).otherwise(F.lit(0)).cast("long"))
    upto = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = sources.withColumn("need", need).filter("need > 0").withColumn("upto", F.sum("need").over(upto))
    total = owned.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
    lines = (owned.withColumn("lo", (F.col("upto") - F.col("need")) / F.lit(float(max(total, 1))))
             .withColumn("hi", F.col("upto") / F.lit(float(max(total, 1))))
             .withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS),
                                                      F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
             .select("cell", "lo", "hi", "src", "source_size", "want", "need"))
    points = (spark.range(3 * total).withColumnRenamed("id", "slot")
              .withColumn("u", F.pmod(F.col("slot").cast("decimal(18,0)") * F.lit(GOLDEN), F.lit(UNITS)).cast("double") / F.lit(float(UNITS)))
              .withColumn("cell", F.least(F.floor(F.col("u") * CELLS), F.lit(CELLS - 1))))
    slots = materialize(points.join(lines, "cell").filter("u >= lo AND u < hi")
                        .select("slot", "src", "source_size", "want", "need", F.lit(1).alias("one"),
                                F.floor(F.col("slot") / CHUNK_SLOTS).alias("chunk")), "mix-slots")
    ranked = running_total(slots, ["src"], "chunk", [F.col("slot")], "one", "rank").filter("rank < need")
    blocks = F.ceil(size / b).cast("long")
    return (ranked.withColumn("blocks", blocks)
            .withColumn("block", F.pmod(F.col("rank"), F.col("blocks")))
            .withColumn("first", F.col("block") * b)
            .withColumn("last", F.least(F.col("first") + b, size,
                                        want - F.floor(F.col("rank") / F.col("blocks")) * size).cast("long"))
            .select("slot", "src", "block", "first", "last"))


def streams(sizes: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """The documents with their place ``begin`` in the shuffled word stream of their source."""
    # Rows without an id are told apart by their number, so that they spread over all chunks like others.
    ident = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string")))
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), ident))
    key = F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long")
    placed = (sizes.join(sources.select(F.col("source").alias("_s"), "src", "n_rows", "source_size", "target"),
                         sizes["source"].eqNullSafe(F.col("_s"))).drop("_s")
              .withColumn("shuffle", key)
              .withColumn("chunk", F.floor(F.shiftright("shuffle", 28) / F.lit(float(1 << 32))
                                           * F.ceil(F.col("n_rows") / CHUNK_DOCS))))
    order = [F.col("shuffle"), F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("row")]
    return running_total(materialize(placed, "mix-docs"), ["src"], "chunk", order, "size", "begin")


def mix(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = 1.5, cap: float = 2.0,
        block_tokens: int = 1024, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """``(segments, documents)`` of the mix over a written table ``row, doc_id, source, size``.

    ``segments``: ``slot, row, doc_id, src, skip, words``: in slot order, the mix takes ``words``
    words of the row's text after its first ``skip``.  ``documents``: the rows of ``sizes`` with
    ``src, source_size, target, begin``.
    """
    sources = materialize(plan_sources(sizes, weights, budget, cap), "mix-sources")
    documents = materialize(streams(sizes, sources, seed), "mix-streams")
    slots = schedule(sources, block_tokens)
    b = F.lit(block_tokens)
    pieces = (documents.filter("size > 0")
              .withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / b),
                                                        F.floor((F.col("begin") + F.col("size") - 1) / b)))))
    start = F.greatest("first", "begin")
    words = F.least(F.col("last"), F.col("begin") + F.col("size")) - start
    segments = (pieces.join(slots, ["src", "block"])
                .withColumn("words", words).filter("words > 0")
                .select("slot", "row", "doc_id", "src", (start - F.col("begin")).alias("skip"), "words"))
    return segments, documents


def sized(docs: DataFrame) -> DataFrame:
    """A written table ``row, doc_id, source, size`` of ``docs``; ``row`` tells its rows apart."""
    return materialize(docs.select("doc_id", "source", word_count().alias("size"))
                       .withColumn("row", F.monotonically_increasing_id()), "mix-sizes")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Every document with its size, its source's size and target, and the words the mix takes of it."""
    segments, documents = mix(sized(docs), **options)
    taken = segments.groupBy("row").agg(F.sum("words").alias("taken"))
    return (documents.join(taken, "row", "left")
            .select("doc_id", "size", "source_size", "target",
                    F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix in whole documents: each row as often as the schedule takes its first word.

    Every source comes within one document of its target.  Keeps the columns of
    ``docs``; documents without a word are never taken.
    """
    from .common import fresh, with_row_id

    stored, uid = with_row_id(docs, "mix-input")
    sizes = materialize(stored.select(F.col(uid).alias("row"), "doc_id", "source", word_count().alias("size")),
                        "mix-sizes")
    segments, _ = mix(sizes, **options)
    copies = fresh(docs.columns, "_copies")
    drawn = segments.filter("skip = 0").groupBy("row").agg(F.count(F.lit(1)).cast("int").alias(copies))
    return (stored.join(drawn.withColumnRenamed("row", uid).hint("merge"), uid)  # one row per document: never broadcast
            .withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies))))
            .select(*docs.columns))
