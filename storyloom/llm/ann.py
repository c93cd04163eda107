"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by a pseudo-rotation (three rounds of random signs and a
fast Hadamard transform, padded to a power of two) and hashed to its nearest
signed axis.  Each of ``tables`` tables joins ``hashes`` such axes to a bucket.
A query probes, in each table, the ``probes`` buckets whose axes its own
rotations point to most; what lies there is reranked by exact cosine in double
precision on the original vectors.

Buckets and probes follow from the number of rows: about ``BUCKET`` rows a bucket
at most, and probes for a share of each table that falls with the cube root of
the rows (``SHARE`` at ``SHARE_ROWS``).  So the rows a query is compared with grow
with the power 2/3 of the table, also where vectors have no structure at all.
``compared`` reports their number.

Every row is indexed in every table, as one row that holds its vector and its
buckets.  Rows lie in blocks by id; a block and a part of the queries are a task,
which looks the probes up in the block's own tables, takes each row that lies in
one of them once, and returns the ``k`` best ids per query.  So vectors and
queries are moved to the tasks, candidates never are, and a bucket with a third
of all rows is spread over all blocks; no bucket is capped.  Queries for which
the probes met fewer than ``k`` rows, as on tiny tables, are then searched
against all rows, in blocks too.

Defined cases: vectors that are null, zero or hold null or non-finite components
take no part, nor do null ids; vectors are only compared with those of the same
length; rows with the query's id are its own; equal rows count once, and an id
that several rows share takes one place, with its best score; ties go to the smaller id; an empty table gives
no row; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .embed_dedup import unit, usable


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the orthonormal Hadamard matrix, by butterflies; the width is a power of two."""
    n, width, h = *x.shape, 1
    while h < width:
        x = x.reshape(n, -1, 2, h)
        x = np.concatenate([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, -1)
        h *= 2
    return x / np.sqrt(width)


def rotations(x: np.ndarray, tables: int, hashes: int, seed: int) -> Iterator[list[np.ndarray]]:
    """For each table, the ``hashes`` pseudo-rotations of the rows, each as the products with all signed axes."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, :x.shape[1]] = x
    rng = np.random.default_rng(seed)
    for _ in range(tables):
        out = []
        for _ in range(hashes):
            turned = padded
            for _ in range(3):
                turned = hadamard(turned * rng.choice((-1.0, 1.0), width))
            out.append(np.concatenate([turned, -turned], axis=1))
        yield out


def probed(axes: list[np.ndarray], probes: int) -> np.ndarray:
    """The best ``probes`` buckets of each row, best first, by the sum of its products with the buckets' axes.

    A pair of the i-th best of one list and the j-th of another has i x j pairs
    at least as good, itself among them, so only pairs with i x j <= probes are added up.
    """
    score, bucket = np.zeros((len(axes[0]), 1)), np.zeros((len(axes[0]), 1), np.int64)
    for products in axes:
        best = np.argsort(-products, axis=1, kind="stable")[:, :probes]
        values = np.take_along_axis(products, best, axis=1)
        i, j = np.nonzero(np.outer(np.arange(1, score.shape[1] + 1), np.arange(1, best.shape[1] + 1)) <= probes)
        score, bucket = score[:, i] + values[:, j], bucket[:, i] * products.shape[1] + best[:, j]
        order = np.argsort(-score, axis=1, kind="stable")[:, :probes]
        score, bucket = np.take_along_axis(score, order, axis=1), np.take_along_axis(bucket, order, axis=1)
    return bucket


#: Most rows a bucket holds on average, and the share of a table's buckets that a query probes at ``SHARE_ROWS`` rows.
BUCKET, SHARE, SHARE_ROWS = 256, 0.0061, 50_000


def shape(n: int, d: int) -> tuple[int, int]:
    """Hashes and probes for ``n`` rows of length ``d``."""
    axes = 2 << max(0, (d - 1).bit_length())
    hashes = 2
    while axes ** hashes * BUCKET < n:
        hashes += 1
    share = min(1.0, SHARE * (SHARE_ROWS / max(n, 1)) ** (1 / 3))
    return hashes, max(1, int(np.ceil(share * axes ** hashes)))


def indexed(vectors: DataFrame, tables: int, shapes: dict[int, tuple[int, int]], seed: int) -> DataFrame:
    """Adds ``buckets``: the bucket of each row in each table."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.asarray(v, np.float64) for v in batch.column("embedding").to_pylist()]
            buckets: list = [None] * len(rows)
            for d in {len(r) for r in rows}:
                at = [i for i, r in enumerate(rows) if len(r) == d]
                found = np.column_stack([probed(axes, 1)[:, 0] for axes in rotations(unit([rows[i] for i in at]), tables, shapes[d][0], seed)])
                for i, f in zip(at, found, strict=True):
                    buckets[i] = f
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(buckets, pa.list_(pa.int64()))], names=[*batch.schema.names, "buckets"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema) + ", buckets array<long>"
    return vectors.mapInArrow(add, fields)


def candidates(buckets: np.ndarray, probes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row), each once, of rows that lie in one of the query's probed buckets in some table."""
    n, found = len(buckets), []
    for table, probe in enumerate(probes):
        order = np.argsort(buckets[:, table], kind="stable")
        held = buckets[order, table]
        lo, hi = np.searchsorted(held, probe.ravel()), np.searchsorted(held, probe.ravel(), "right")
        size = hi - lo
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        found.append(np.repeat(np.repeat(np.arange(len(probe)), probe.shape[1]), size) * n + order[at])
    pairs = np.unique(np.concatenate(found))
    return np.divmod(pairs, n)


def tile(rows: pa.Table, queries: pa.Table, k: int, tables: int, shapes: dict[int, tuple[int, int]], seed: int,
         most: int = 1 << 18) -> pa.Table:
    """The k best ids of each query among its candidates in a block, by each id's best row; ``seen`` rows compared, on the first."""
    out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
    if rows.num_rows and queries.num_rows:
        x, q = (unit([np.asarray(v, np.float64) for v in t["embedding"].to_pylist()]) for t in (rows, queries))
        ids, asked = rows["vec_id"].to_numpy(), queries["query_id"].to_numpy()
        buckets = np.array(rows["buckets"].to_pylist(), np.int64)
        hashes, probes = shapes[x.shape[1]]
        step = max(1, most // (tables * max(probes, 1)))
        for start in range(0, len(q), step):
            some = q[start:start + step]
            who, row = candidates(buckets, [probed(axes, probes) for axes in rotations(some, tables, hashes, seed)])
            other = ids[row] != asked[start + who]
            who, row = who[other], row[other]
            score = np.empty(len(row))
            for at in range(0, len(row), most):
                score[at:at + most] = np.einsum("ij,ij->i", x[row[at:at + most]], some[who[at:at + most]])
            order = np.lexsort((ids[row], -score, who))
            who, near, score = who[order], ids[row[order]], score[order]
            seen = np.bincount(who, minlength=len(some))
            first = np.sort(np.unique(np.column_stack([who, near]), axis=0, return_index=True)[1])
            who, near, score = who[first], near[first], score[first]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            top_k = place < k
            out.append((asked[start + who[top_k]], near[top_k], np.clip(score[top_k], -1.0, 1.0),
                        np.where(place[top_k] == 0, seen[who[top_k]], 0)))
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score", "seen"])


def best_of(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest ids of each query, by the cosine of each id's best row, then smaller id."""
    out = []
    if len(rows) and len(queries):
        rows = rows.sort_values("vec_id", kind="stable")
        ids = rows["vec_id"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        x, q = unit([np.asarray(v) for v in rows["embedding"]]), unit([np.asarray(v) for v in queries["embedding"]])
        for start in range(0, len(q), 256):
            rough = q[start:start + 256] @ x.T
            for i, near in enumerate(rough):
                own = queries["query_id"].iloc[start + i]
                near[ids == own] = -np.inf
                best = np.maximum.reduceat(near, first)
                least = np.partition(best, -k)[-k] if len(best) > k else -2.0
                at = np.nonzero(near >= max(least, -2.0) - 1e-9)[0]
                # The products above may differ in the last bits from block to block; these do not.
                score = np.einsum("ij,j->i", x[at], q[start + i])
                order = np.lexsort((ids[at], -score))
                top = order[np.sort(np.unique(ids[at][order], return_index=True)[1])[:k]]
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids[at][top], "score": np.clip(score[top], -1.0, 1.0)}))
    found = pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    return found.astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def search_buckets(rows: DataFrame, queries: DataFrame, k: int, block: int) -> DataFrame:
    """Candidates ``query_id, vec_id, score`` from tables with the columns ``d, table, bucket``."""
    key = ["d", "table", "bucket"]
    parts = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).alias("row_parts"))
    chunks = queries.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).alias("query_parts"))
    both = materialize(parts.join(chunks, key), "ann-buckets")

    def spread(df: DataFrame, ident: str, own: str, other: str) -> DataFrame:
        """Each row in its own part, once for each part of the other side."""
        return (df.join(both, key).withColumn(own, F.pmod(F.xxhash64(ident), F.col(f"{own}s")))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1)))
                .select(*key, "row_part", "query_part", ident, "embedding"))

    group = [*key, "row_part", "query_part"]
    left = spread(rows, "vec_id", "row_part", "query_part").groupBy(group)
    right = spread(queries, "query_id", "query_part", "row_part").groupBy(group)
    return left.cogroup(right).applyInPandas(lambda r, q: best_of(r, q, k), "query_id long, vec_id long, score double")


def top(candidates: DataFrame, k: int) -> DataFrame:
    """The k best distinct ids of each query, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (candidates.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def search_tables(rows: DataFrame, queries: DataFrame, k: int, tables: int, shapes: dict[int, tuple[int, int]],
                  sizes: dict[int, int], block: int, seed: int) -> DataFrame:
    """Candidates ``query_id, vec_id, score, seen`` of ``queries`` among the indexed ``rows``, block by block."""
    per = {d: max(block, min(16 * block, n // 64)) for d, n in sizes.items()}
    row_parts = F.create_map(*[F.lit(v) for d, n in sizes.items() for v in (d, -(-n // per[d]))])[F.col("d")]
    asked = queries.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / (16 * block)).cast("int").alias("query_parts"))
    key = ["d", "row_part", "query_part"]
    left = (rows.join(asked, "d").withColumn("row_part", F.pmod(F.xxhash64("vec_id"), row_parts).cast("int"))
            .withColumn("query_part", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1))).select(*key, "vec_id", "embedding", "buckets"))
    right = (queries.join(asked, "d").withColumn("query_part", F.pmod(F.xxhash64("query_id"), F.col("query_parts")).cast("int"))
             .withColumn("row_part", F.explode(F.sequence(F.lit(0), row_parts - 1))).select(*key, "query_id", "embedding"))
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(
        lambda r, q: tile(r, q, k, tables, shapes, seed), "query_id long, vec_id long, score double, seen long")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, tables: int = 16, hashes: int | None = None, probes: int | None = None,
            block: int = 4096, seed: int = 11) -> DataFrame:
    """``query_id, rank, vec_id, score, compared``: the k nearest rows found for each row where ``is_query``.

    ``hashes`` and ``probes`` follow from the number of rows unless they are given
    (one hash if only the probes are).
    """
    rows = materialize(vectors.filter(usable("embedding") & F.col("vec_id").isNotNull())
                       .select("vec_id", "embedding", F.size("embedding").alias("d"), is_query.alias("is_query")).distinct(), "ann-rows")
    # One row for each length of vectors that occurs.
    lengths = materialize(rows.groupBy("d").agg(F.countDistinct("vec_id").alias("n"), F.count(F.lit(1)).alias("n_rows")), "ann-lengths")
    sizes = {r["d"]: r["n_rows"] for r in lengths.collect()}
    shapes = {d: shape(n, d) if probes is None else (hashes or 1, probes) for d, n in sizes.items()}
    if hashes is not None and probes is None:
        shapes = {d: (hashes, shape(sizes[d], d)[1]) for d in sizes}
    index = materialize(indexed(rows, tables, shapes, seed), "ann-index")
    asked = rows.filter("is_query").select(F.col("vec_id").alias("query_id"), "embedding", "d")
    if not sizes:
        return top(asked.select("query_id", F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score")), k).withColumn(
            "compared", F.lit(0).cast("long"))
    met = materialize(search_tables(index.drop("is_query"), asked, k, tables, shapes, sizes, block, seed), "ann-met")
    found = materialize(top(met.select("query_id", "vec_id", "score"), k), "ann-found")
    seen = met.groupBy("query_id").agg(F.sum("seen").alias("seen"))

    # Queries that met too few rows, though there are more of their length.
    got = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("met"))
    short = materialize(asked.join(lengths, "d").join(got, "query_id", "left")
                        .filter(F.coalesce("met", F.lit(0)) < F.least(F.lit(k), F.col("n") - 1))
                        .select("query_id", "embedding", "d", "n_rows"), "ann-short")
    whole = [F.lit(0).alias("table"), F.lit(0).cast("long").alias("bucket")]
    # Only lengths that occur among these queries are searched.
    rest = search_buckets(rows.select("vec_id", "embedding", "d", *whole),
                          short.select("query_id", "embedding", "d", *whole), k, block)
    compared = (seen.unionByName(short.select("query_id", F.col("n_rows").alias("seen")).distinct())
                .groupBy("query_id").agg(F.max("seen").alias("compared")))
    return top(found.select("query_id", "vec_id", "score").union(rest), k).join(compared, "query_id", "left")
