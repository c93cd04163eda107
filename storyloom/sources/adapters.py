"""Adapters from the driver tables to the reference's data model (FIXTURES.md §3).

Each adapter is a lazy DataFrame over the given tables, so its work grows with
them.  Fixed clock and derivation rules below are part of the test contract and
are mirrored one-to-one by the DuckDB oracle SQL in ``storyloom.oracles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# Fixed values of the test contract.
NOW = "2024-02-05 00:00:00"
EPOCH = "2024-01-01 00:00:00"
MINUTES_SPAN = 50400      # five weeks of minutes
MINUTE_STRIDE = 7919      # prime stride that spreads ids over the span
LOCAL_TZ = "Europe/Kyiv"  # zone of naive feed dates


def now_col(now: str = NOW) -> Column:
    return F.to_timestamp(F.lit(now))


def articles(spark: SparkSession, sf_dir: str, with_embedding: bool = True) -> DataFrame:
    """article ← documents ⟕ embeddings (vector, label may be null).

    ``with_embedding=False`` skips the join for plans that only use text.
    """
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    if with_embedding:
        e = read_table(spark, sf_dir, "embeddings").select(
            F.col("vec_id").alias("doc_id"), "embedding", "label")
        d = d.join(e, "doc_id", "left")
    else:
        d = (d.withColumn("embedding", F.lit(None).cast("array<float>"))
             .withColumn("label", F.lit(None).cast("int")))
    published = F.expr(
        f"timestamp'{EPOCH}' + make_interval(0,0,0,0,0,"
        f"cast(doc_id*{MINUTE_STRIDE} % {MINUTES_SPAN} as int))")
    created = published + F.expr("INTERVAL 1 HOUR")
    return d.select(
        F.col("doc_id").alias("id"),
        # First line without splitting the whole text into an array of lines.
        F.substring(F.substring_index(F.col("text"), "\n", 1), 1, 500).alias("title"),
        F.col("text").alias("content"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example/a/"),
                 F.col("doc_id").cast("string")).alias("url"),
        published.alias("published_date"),
        F.col("source"),
        F.col("lang"),
        F.col("embedding"),
        F.col("label"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )
