"""Narrative shifts (P3): the last days' clusters become narratives, clusters, links and events, each created once.

Narratives are found by name and clusters by narrative and day, as rows of the
tables given; what exists stays as it is, so a second run of the same day
creates nothing.  The job returns the new rows of each table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import quality
from ..operators import responders as rsp
from ..operators import select as sel
from ..session import materialize
from . import store

# The reference's rules and texts.
DAYS, MIN_CLUSTERS, EVENT_ABOVE, SAMPLE_TITLES = 7, 5, 5, 3


def shift_run(articles: DataFrame, now: Column, responder: rsp.Responder, cache: DataFrame,
              narratives: DataFrame | None = None, clusters: DataFrame | None = None, days: int = DAYS,
              label_col: str = "label", min_rows: int = MIN_CLUSTERS) -> dict[str, DataFrame]:
    """New ``narratives, clusters, cluster_article, events`` of the clusters by ``label_col``, ``found`` and the grown ``cache``.

    ``found`` has every cluster of the run with what was created.  With fewer than
    ``min_rows`` recent articles nothing is.  Of two clusters that get the same
    name the one with the lesser label is created.
    """
    spark = articles.sparkSession
    recent = sel.lookback(articles, now, days, need_vector="embedding").where(F.col(label_col).isNotNull()).select(
        F.col(label_col).alias("label"), "id", "title", "published_date", F.col("embedding").alias("vec"))
    enough = recent.select(F.count(F.lit(1))).scalar() >= min_rows
    recent = materialize(recent.where(enough), "shift-members")
    newest = Window.partitionBy("label").orderBy(F.col("published_date").desc(), F.col("id"))
    first = (recent.select("label", "title", F.row_number().over(newest).alias("_r")).where(F.col("_r") <= rsp.LISTED)
             .groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "title"))), lambda x: x["title"]).alias("titles")))
    sizes = recent.groupBy("label").agg(F.count(F.lit(1)).alias("n_articles"))
    asked = sizes.join(first, "label").select(
        "label", "n_articles", "titles", F.lit("naming").alias("task_type"), rsp.titles_prompt(F.col("titles")).alias("prompt")) \
        .withColumn("content_hash", F.md5("prompt"))
    answers, cache = rsp.cached_batch(asked, cache, responder, now, spark)
    fallback = F.concat(F.lit("Narrative Cluster "), F.date_format(now, "yyyyMMdd"), F.lit(" - "), F.col("label").cast("string"))
    sample = F.array_join(F.slice("titles", 1, SAMPLE_TITLES), ", ")
    named = materialize(answers.select(
        "label", "n_articles", sel.name_or_fallback(F.col("response"), fallback).alias("name"),
        F.format_string("Cluster containing %d articles. Sample: %s", F.col("n_articles"), sample).alias("description"),
        now.alias("created_at")).withColumn("narrative_id", store.key_id(F.col("name"))), "shift-named")

    if narratives is None:
        narratives = named.select(F.col("narrative_id").alias("id")).limit(0)
    if clusters is None:
        clusters = named.select("narrative_id", F.to_date("created_at").alias("cluster_date")).limit(0)
    by_label = [F.col("label")]
    new_narratives = materialize(store.insert_if_absent(
        narratives.select(F.col("id").alias("narrative_id")), named, ["narrative_id"], by_label), "shift-narratives")
    dated = named.withColumn("cluster_date", F.to_date("created_at"))
    created = materialize(store.insert_if_absent(clusters, dated, ["narrative_id", "cluster_date"], by_label), "shift-created")
    centroids = quality.mean_vectors(recent, recent.join(created.select("label"), "label", "left_semi"), ["label"], "centroid")
    cluster_id = store.key_id(F.lit("shift"), F.col("narrative_id"), F.col("cluster_date"))
    new_clusters = created.join(centroids, "label").select(
        cluster_id.alias("id"), "narrative_id", "cluster_date", "created_at", "label", "centroid")
    links = recent.select("label", F.col("id").alias("article_id")).join(created.select("label", cluster_id.alias("cluster_id")), "label") \
        .select("cluster_id", "article_id")
    events = created.where(F.col("n_articles") > EVENT_ABOVE).select(
        store.key_id(F.lit("emergence"), F.lit("shift"), F.col("narrative_id"), F.col("cluster_date")).alias("id"), "narrative_id",
        F.lit("emergence").alias("event_type"),
        F.format_string("New narrative cluster emerged with %d articles", F.col("n_articles")).alias("description"),
        F.col("created_at").alias("event_date"), (F.col("n_articles") / 10.0).alias("significance_score"))
    made = {"narrative_created": new_narratives, "cluster_created": created}
    found = named
    for flag, rows in made.items():
        found = found.join(rows.select("label", F.lit(True).alias(flag)), "label", "left").withColumn(
            flag, F.coalesce(F.col(flag), F.lit(False)))
    return {"narratives": new_narratives.select(
                F.col("narrative_id").alias("id"), "name", "description", "created_at", F.lit(True).alias("is_active"),
                *[F.lit(0.0 if m.endswith(("score", "rate")) else 0).alias(m) for m in store.METRICS]),
            "clusters": new_clusters, "cluster_article": links, "events": events, "found": found, "cache": cache}
