"""Store writes as table transforms (A5–A9) and the listing queries.

There is no row-at-a-time ORM here: an upsert is ``unionByName`` + one
``groupBy(name)`` with ``min_by``/``max_by``; get-or-create is a ``left_anti``
on the natural key.  Ids are hashes of natural keys (stable across reruns).
Writers produce new snapshot DataFrames; persisting them to a new path
(``session.materialize``) and swapping is the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_id(*parts: Column) -> Column:
    """Stable id from a natural key: its full md5, so that no two keys meet at any size."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


METRICS = ["source_diversity_score", "support_count", "unique_sources_count", "coherence_score",
           "near_duplicate_rate", "persistence_days"]


def narrative_rows(accepted: DataFrame, name: Column, description: Column, seq: Column,
                   created_at: Column) -> DataFrame:
    """New narrative candidates from accepted clusters (one per cluster)."""
    return accepted.select(
        name.alias("name"), description.alias("description"), seq.alias("seq"),
        created_at.alias("created_at"),
        F.col("diversity").alias("source_diversity_score"),
        F.col("n_rows").cast("int").alias("support_count"),
        F.col("n_sources").cast("int").alias("unique_sources_count"),
        F.col("coherence").alias("coherence_score"),
        F.coalesce(F.col("near_dup_rate"), F.lit(0.0)).alias("near_duplicate_rate"),
        F.col("n_days").cast("int").alias("persistence_days"))


def narrative_upsert(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """A5: by name — the first description (and creation time) stays, the last metrics win.

    ``seq`` orders writes: existing rows count as earliest.  One shuffle by name.
    """
    cols = ["name", "description", "created_at", *METRICS]
    rows = new.select(*cols, F.struct(F.lit(1).alias("new"), F.col("seq")).alias("_at"))
    if existing is not None:
        no_seq = F.lit(None).cast(new.schema["seq"].dataType)
        rows = existing.select(*cols, F.struct(F.lit(0).alias("new"), no_seq.alias("seq")).alias("_at")).unionByName(rows)
    agg = rows.groupBy("name").agg(
        F.min_by("description", "_at").alias("description"),
        F.min_by("created_at", "_at").alias("created_at"),
        F.max_by(F.struct(*METRICS), "_at").alias("_m"))
    return agg.select(key_id(F.col("name")).alias("id"), "name", "description", "created_at",
                      F.lit(True).alias("is_active"), *[F.col(f"_m.{m}").alias(m) for m in METRICS])


def insert_if_absent(existing: DataFrame, new: DataFrame, keys, order=None) -> DataFrame:
    """Rows of ``new`` whose natural key is not yet in ``existing``; of several with one key the first by ``order``."""
    keys = list(keys)
    if order is None:
        first = new.dropDuplicates(keys)
    else:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        first = new.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")
    return first.join(existing.select(*keys).distinct(), keys, "left_anti")


# ---------------------------------------------------------------------------
# Listing queries
# ---------------------------------------------------------------------------

def narratives_active(narratives: DataFrame) -> DataFrame:
    """B4 + E6: active narratives with support, most supported then newest first."""
    return (narratives.where(F.col("is_active") & (F.col("support_count") > 0))
            .orderBy(F.col("support_count").desc(), F.col("created_at").desc(), F.col("id")))


def timeline(events: DataFrame, narratives: DataFrame, event_articles: DataFrame) -> DataFrame:
    """B5 + C2 + C6: events of narratives with support, with narrative name and related-article count."""
    supported = narratives.where(F.col("support_count") > 0).select(
        F.col("id").alias("narrative_id"), F.col("name").alias("narrative_name"))
    rel = event_articles.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_related"))
    return (events.join(supported, "narrative_id")
            .join(rel, events["id"] == rel["event_id"], "left")
            .select(F.col("id").alias("event_id"), "narrative_id", "narrative_name", "event_type",
                    "description", "event_date", F.col("significance_score"),
                    F.coalesce(F.col("n_related"), F.lit(0)).alias("n_related")))


def page(df: DataFrame, order, page_no: int, size: int, max_size: int = 100) -> DataFrame:
    """Page-number pagination after a total order; size clamped to ``max_size``.

    The offset/limit after a total order is a distributed top-k; the total row
    count is a scalar subquery (one aggregate), not a join.
    """
    size = max(1, min(size, max_size))
    total = df.select(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*order).offset((page_no - 1) * size).limit(size)
    return (rows.withColumn("total_count", total)
            .withColumn("has_next", F.col("total_count") > F.lit(page_no * size))
            .withColumn("page", F.lit(page_no)).withColumn("page_size", F.lit(size)))
