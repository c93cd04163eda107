"""Cluster quality aggregates (D1–D5, D7, E1) and the quality gate.

Inputs are a *membership* frame — one row per (cluster keys…, id) with the
row's ``source`` and ``published_date`` — and unit-norm packed vectors
``(id, vec)``.  If the vectors carry the cluster keys themselves, membership is
not joined.  Every statistic is a closed form over grouped sums, so nothing is
quadratic and nothing is collected:

* coherence = (‖Σu‖² − Σ‖u‖²) / (n(n−1))     (mean cosine over unordered pairs)
* medoid order = u·Σu descending              (least mean cosine distance)
* diversity = (log2 n − Σ c·log2 c / n) / log2 m

Vector sums are taken inside the tasks that read the vectors: a task hands on
one row per cluster, and two rounds of merging add these up, so neither entries
nor vectors are shuffled for a statistic, and no task reads every other's sums.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.vectors import as_packed, entries, is_dense
from ..session import materialize


def cluster_profile(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct sources, distinct UTC dates per cluster."""
    return members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("source").alias("n_sources"),
        F.countDistinct(F.to_date("published_date")).alias("n_days"),
    )


def source_diversity(members: DataFrame, keys: Sequence[str], source_col: str = "source") -> DataFrame:
    """Shannon entropy (base 2) of source shares ÷ log2(#sources); 0 for ≤ 1 source."""
    per_src = members.groupBy(*keys, source_col).agg(F.count(F.lit(1)).alias("c"))
    agg = per_src.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("m"),
        F.sum(F.col("c") * F.log2(F.col("c").cast("double"))).alias("clogc"))
    div = F.when(F.col("m") <= 1, F.lit(0.0)).otherwise(
        (F.log2(F.col("n").cast("double")) - F.col("clogc") / F.col("n")) / F.log2(F.col("m").cast("double")))
    return agg.select(*keys, div.alias("diversity"))


def clustered(members: DataFrame, vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, id, vec) of the member rows that have a vector; vectors that carry the keys are those of the members."""
    vectors = as_packed(vectors)
    if all(k in vectors.columns for k in keys):
        return vectors.select(*keys, "id", "vec")
    return members.select(*keys, "id").join(vectors.select("id", "vec"), "id").select(*keys, "id", "vec")


def of_clusters(vectors: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Vectors that carry their cluster's keys, of the chosen clusters only; other vectors as they are."""
    keys = list(keys)
    if not all(k in vectors.columns for k in keys):
        return vectors
    return vectors.join(chosen.select(*keys), keys, "left_semi")


#: Clusters a task adds up at once, and the shares a cluster's partial sums are first merged in.
CLUSTERS_A_TASK = 4096
MERGE_SHARES = 32


def _totals(held: dict, schema: pa.Schema, keys: Sequence[str]) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k in held], schema.field(name).type) for i, name in enumerate(keys)]
    n, q, sums = zip(*held.values(), strict=True)
    return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(q, pa.float64()),
                                       pa.array(list(sums), pa.list_(pa.float64()))], names=[*keys, "n", "q", "sum"])


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) < len(b):
        a, b = b, a
    a[:len(b)] += b
    return a


def _grouped(batch: pa.RecordBatch, keys: Sequence[str]) -> tuple[list[tuple], np.ndarray]:
    """The distinct keys of a batch, and each row's place among them."""
    code = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        coded = batch.column(k).dictionary_encode(null_encoding="encode")
        code = code * (len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False)
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    columns = [batch.column(k).take(pa.array(first)).to_pylist() for k in keys]
    return list(zip(*columns, strict=True)) if keys else [()] * len(first), group


def _sum_rows(keys: Sequence[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[int, float, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            found, group = _grouped(batch, keys)
            row, slot, value = entries(batch.column("vec"))
            dim = int(slot.max(initial=-1)) + 1
            sums = np.bincount(group[row] * dim + slot, value, len(found) * dim).reshape(len(found), dim)
            squares = np.bincount(group[row], value * value, len(found))
            for k, n, q, total in zip(found, np.bincount(group, minlength=len(found)), squares, sums, strict=True):
                old = held.get(k, (0, 0.0, np.zeros(0)))
                held[k] = old[0] + int(n), old[1] + float(q), _add(old[2], total)
            if len(held) >= CLUSTERS_A_TASK:
                yield _totals(held, batch.schema, keys)
                held = {}
            schema = batch.schema
        if held:
            yield _totals(held, schema, keys)
    return run


def _merge(keys: Sequence[str]):
    """Rows sorted by their keys, added up one key at a time."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[int, float, np.ndarray]] = {}
        for batch in batches:
            for *k, n, q, total in zip(*(batch.column(c).to_pylist() for c in (*keys, "n", "q")), batch.column("sum"), strict=True):
                total = np.array(total.values.to_numpy(zero_copy_only=False))
                k = tuple(k)
                if k not in held and len(held) >= CLUSTERS_A_TASK:
                    yield _totals(held, batch.schema, keys)
                    held = {}
                old = held.get(k, (0, 0.0, np.zeros(0)))
                held[k] = old[0] + n, old[1] + q, _add(total, old[2])
            schema = batch.schema
        if held:
            yield _totals(held, schema, keys)
    return run


def cluster_sums(members: DataFrame, vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, n, q, sum) per cluster: rows with a vector, Σ‖u‖² and Σu as an array."""
    keys = list(keys)
    rows = clustered(members, vectors, keys).select(*keys, "vec")
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("n", T.LongType()), T.StructField("q", T.DoubleType()),
                           T.StructField("sum", T.ArrayType(T.DoubleType()))])
    share = [*keys, "_share"]
    parts = rows.mapInArrow(_sum_rows(keys), schema).withColumn("_share", F.spark_partition_id() % MERGE_SHARES)
    merged = (parts.repartition(*share).sortWithinPartitions(*share).drop("_share").mapInArrow(_merge(keys), schema))
    if not keys:
        return merged.coalesce(1).mapInArrow(_merge(keys), schema)
    return merged.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge(keys), schema)


def coherence_expr(n, s2, q, singleton_value: float = 1.0):
    """Closed-form mean pairwise cosine from n, ‖Σu‖² and Σ‖u‖²."""
    return F.when(n < 2, F.lit(float(singleton_value))).otherwise(
        (F.coalesce(s2, F.lit(0.0)) - F.coalesce(q, F.lit(0.0))) / (n * (n - 1)).cast("double"))


def square_sums(members: DataFrame, vectors: DataFrame, keys: Sequence[str],
                sums: DataFrame | None = None) -> DataFrame:
    """(keys…, s2 = ‖Σu‖², q = Σ‖u‖²) per cluster."""
    sums = sums if sums is not None else cluster_sums(members, vectors, keys)
    return sums.select(*keys, F.aggregate("sum", F.lit(0.0), lambda a, x: a + x * x).alias("s2"), "q")


def coherence(members: DataFrame, vectors: DataFrame, keys: Sequence[str],
              singleton_value: float = 1.0, sums: DataFrame | None = None) -> DataFrame:
    """D3: mean pairwise cosine per cluster by the closed form; n < 2 → singleton_value.

    Zero vectors count as rows (their cosine with anything is 0), as in the reference.
    """
    tot = square_sums(members, vectors, keys, sums)
    n = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    c = coherence_expr(F.col("n"), F.col("s2"), F.col("q"), singleton_value)
    return n.join(tot, list(keys), "left").select(*keys, c.alias("coherence"))


def mean_vectors(members: DataFrame, vectors: DataFrame, keys: Sequence[str], vec_col: str = "vec") -> DataFrame:
    """Mean vector per cluster as one array; entries that a row lacks are 0."""
    return cluster_sums(members, vectors, keys).select(*keys, F.transform("sum", lambda x: x / F.col("n")).alias(vec_col))


def centroids(members: DataFrame, raw_vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D5 in long form (keys…, slot, value), an entry per slot of the clusters' mean vectors.

    ``raw_vectors`` are not normalised.  Rows without a vector count as zero vectors.
    """
    n = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    mean = cluster_sums(members, raw_vectors, keys).join(n, list(keys))
    return (mean.select(*keys, "_rows", F.posexplode("sum").alias("slot", "value"))
            .select(*keys, "slot", (F.col("value") / F.col("_rows")).alias("value")))


def dot(vec: Column, other: Column, dense: bool) -> Column:
    """Product of a packed vector with an array at least as long."""
    if dense:
        return F.aggregate(F.zip_with(vec, other, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return F.aggregate(vec, F.lit(0.0), lambda s, e: s + e["value"] * F.get(other, e["slot"]))


def medoid_scores(members: DataFrame, vectors: DataFrame, keys: Sequence[str],
                  sums: DataFrame | None = None) -> DataFrame:
    """u_i·Σu per row (rows with zero vector score 0): (keys…, id, score)."""
    keys, vectors = list(keys), as_packed(vectors)
    # Written, so that its size is known: a shuffle by cluster would put a large one's vectors in one task.
    sums = materialize(sums if sums is not None else cluster_sums(members, vectors, keys), "cluster-sums")
    scored = clustered(members, vectors, keys).join(sums.select(*keys, "sum"), keys).select(
        *keys, "id", dot(F.col("vec"), F.col("sum"), is_dense(vectors)).alias("score"))
    return members.select(*keys, "id").join(scored, [*keys, "id"], "left").select(
        *keys, "id", F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))


def medoids(members: DataFrame, vectors: DataFrame, keys: Sequence[str], k: int = 3,
            input_order: Sequence | None = None, sums: DataFrame | None = None) -> DataFrame:
    """Up to k rows with least mean cosine distance (self included).

    Clusters of ≤ k rows keep every row in input order (the reference's default
    article order, newest first); larger ones rank by u·Σu desc, then id.
    Output: (keys…, id, medoid_rank, score), written: at most k rows a cluster, which whole texts may be joined with.
    """
    if input_order is None:
        input_order = (F.col("published_date").desc(), F.col("id").asc())
    keys = list(keys)
    sizes = materialize(members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "cluster-sizes")
    # Two plain top-k's by the cluster's size, so that each cuts its rows before they are shuffled.
    m = members.join(sizes, keys)
    by_input = F.row_number().over(Window.partitionBy(*keys).orderBy(*input_order))
    small = (m.where(F.col("_n") <= k).withColumn("medoid_rank", by_input).where(F.col("medoid_rank") <= k)
             .select(*keys, "id", "medoid_rank"))
    # Rank on the score rounded to 1e-9 so exact copies tie deterministically
    # (summation order moves the last bits) and fall back to id order.
    scores = materialize(medoid_scores(members, vectors, keys, sums), "medoid-scores")
    by_score = F.row_number().over(
        Window.partitionBy(*keys).orderBy(F.round(F.col("score"), 9).desc(), F.col("id")))
    large = (scores.join(sizes.where(F.col("_n") > k), keys).withColumn("medoid_rank", by_score)
             .where(F.col("medoid_rank") <= k).select(*keys, "id", "medoid_rank", "score"))
    return materialize(small.join(scores, [*keys, "id"]).select(*keys, "id", "medoid_rank", "score").unionByName(large), "medoids")


REJECT_ROWS = "too_few_rows"
REJECT_SOURCES = "too_few_sources"
REJECT_DAYS = "too_few_days"
REJECT_COHERENCE = "low_coherence"


def quality_gate(stats: DataFrame, min_rows: int = 5, min_sources: int = 3, min_days: int = 2,
                 threshold: float = 0.5) -> DataFrame:
    """Reject reason in the order the reference tests; ``accepted`` when none applies.

    ``stats`` needs n_rows, n_sources, n_days, coherence.
    """
    reason = (F.when(F.col("n_rows") < min_rows, F.lit(REJECT_ROWS))
              .when(F.col("n_sources") < min_sources, F.lit(REJECT_SOURCES))
              .when(F.col("n_days") < min_days, F.lit(REJECT_DAYS))
              .when(F.col("coherence") < F.lit(float(threshold)), F.lit(REJECT_COHERENCE)))
    return stats.withColumn("reject_reason", reason).withColumn(
        "accepted", F.col("reject_reason").isNull())


def embed_coverage(articles: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Rows with a vector, all rows, share (null when there are no rows)."""
    return articles.agg(
        F.count(vec_col).alias("with_vector"), F.count(F.lit(1)).alias("total")).select(
        "with_vector", "total",
        F.try_divide(F.col("with_vector").cast("double"), F.col("total").cast("double")).alias("coverage"))
