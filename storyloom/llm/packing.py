"""Packing into optimal length buckets.

Lengths are counted in one histogram over all pieces.  Dynamic programming over
it picks the bucket boundaries that minimise padding: with pieces padded to their
bucket's boundary, the cost of one bucket over lengths (i, j] is ``j`` times its
pieces less their tokens, and the best split into ``b`` buckets extends the best
into ``b - 1``.  Inside a bucket, pieces in a shuffled order fill batches of at
most ``batch_tokens`` padded tokens.

The histogram has at most ``max_tokens`` entries whatever the corpus, since longer
documents are cut into pieces; it is all the driver sees.  Ranks inside a bucket
come from two-level sums over chunks of bounded size, so a bucket with most of
the pieces is no hot spot.

Defined cases: documents without words give no piece; repeated rows are packed
each on their own; null ids are packed; an empty table gives no row; extra
columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import running_total, word_count

#: Pieces of a bucket that one task orders.
CHUNK = 512


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The at most ``buckets`` lengths to pad to that waste least; every length is at most one of them."""
    if not lengths:
        return []
    size = np.asarray(lengths, np.float64)
    number = np.concatenate([[0.0], np.cumsum(np.asarray(counts, np.float64))])
    n = len(size)
    # Tokens are the same for every choice, so padded tokens are compared.
    best, cut = np.concatenate([[0.0], size * number[1:]]), []
    best_of = best
    for _ in range(min(buckets, n) - 1):
        new, back = best_of.copy(), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best_of[:j] + size[j - 1] * (number[j] - number[:j])
            i = int(cost.argmin())
            new[j], back[j] = cost[i], i
        cut.append(back)
        best_of = new
    chosen, j = [], n
    for back in reversed(cut):
        chosen.append(j)
        j = int(back[j])
        if j == 0:
            break
    else:
        chosen.append(j)
    return [lengths[j - 1] for j in sorted(set(chosen))]


def pieces(docs: DataFrame, max_tokens: int) -> DataFrame:
    """``row, doc_id, piece, start, length``: documents cut into runs of at most ``max_tokens`` words."""
    sized = docs.select("doc_id", "text").withColumn("words", word_count()).withColumn("row", F.monotonically_increasing_id())
    last = F.floor((F.col("words") - 1) / max_tokens)
    return (sized.filter("words > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
            .withColumn("start", F.col("piece") * max_tokens)
            .select("row", "doc_id", "piece", "start", F.least(F.lit(max_tokens), F.col("words") - F.col("start")).cast("long").alias("length")))


def pack(docs: DataFrame, buckets: int = 8, max_tokens: int = 2048, batch_tokens: int = 16384, seed: int = 3) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, bucket, padded, batch, slot``.

    ``bucket`` is numbered by boundary, ``padded`` is that boundary, ``batch`` is
    numbered inside the bucket and ``slot`` inside the batch; words
    ``[start, start + length)`` of the document's text make up the piece.
    """
    if batch_tokens < max_tokens:
        raise ValueError("a batch must hold a piece of max_tokens")
    cut = materialize(pieces(docs, max_tokens), "pack-pieces")
    histogram = sorted((r["length"], r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect())
    bounds = best_boundaries([x for x, _ in histogram], [n for _, n in histogram], buckets)
    if not bounds:
        bounds = [max_tokens]
    # Boundaries are few: the bucket is the number of them below the length.
    limits = F.array(*[F.lit(int(b)).cast("long") for b in bounds])
    held = {b: sum(n for x, n in histogram if x <= b and (i == 0 or x > bounds[i - 1])) for i, b in enumerate(bounds)}
    chunks = F.array(*[F.lit(max(1, -(-held[b] // CHUNK))).cast("long") for b in bounds])
    placed = (cut.withColumn("bucket", F.size(F.filter(limits, lambda b: b < F.col("length"))))
              .withColumn("padded", F.element_at(limits, F.col("bucket") + 1))
              # Rows without an id are told apart by their number, so that they spread over all chunks like others.
              .withColumn("shuffle", F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), F.lit("row"), "row", "piece"))
                          .otherwise(F.xxhash64(F.lit(seed), "doc_id", "piece")))
              .withColumn("chunk", F.floor(F.shiftrightunsigned("shuffle", 33) / F.lit(float(1 << 31)) * F.element_at(chunks, F.col("bucket") + 1)))
              .withColumn("one", F.lit(1)))
    order = [F.col("shuffle"), F.col("doc_id").asc_nulls_first(), F.col("piece")]
    ranked = running_total(materialize(placed, "pack-placed"), ["bucket"], "chunk", order, "one", "rank")
    rows = F.floor(F.lit(batch_tokens) / F.col("padded")).cast("long")
    return (ranked.withColumn("batch", F.floor(F.col("rank") / rows).cast("long"))
            .withColumn("slot", F.pmod(F.col("rank"), rows).cast("int"))
            .select("doc_id", "piece", "start", "length", F.col("bucket").cast("int").alias("bucket"), "padded", "batch", "slot"))
