"""Statement narratives (P4): recent confident statements → vectors → clusters →
gate (5 rows / 3 sources / 2 days / coherence) → metrics, descriptions, events.

Statements get vectors from the same text hasher as articles (the reference
leaves statement vectors unfilled; here any text column can be embedded).
Below two statements coherence is 0.0, as in the reference's statement path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import hash_packed
from ..operators import quality
from ..operators import responders as rsp
from ..operators import select as sel
from ..operators import statements as st
from ..session import materialize
from . import store
from .weekly import score_clusters

# The reference's statement-path texts.
SAMPLE_STATEMENTS = 3
SAMPLE_CHARS = 100
RELATED_ARTICLES = 5


def confident_members(statements: DataFrame, articles: DataFrame, now: Column, days: int, label_col: str = "actor") -> DataFrame:
    """Recent confident statements as rows of clusters.  Every statement gets its vector from its text."""
    return st.recent_confident(statements, articles, now, days).select(
        F.col(label_col).alias("label"), "id", F.col("article_source").alias("source"),
        "published_date", "article_id", "full_statement", "created_at")


def statement_run(statements: DataFrame, articles: DataFrame, now: Column, responder: rsp.Responder, cache: DataFrame,
                  existing: DataFrame | None = None, days: int = 7, label_col: str = "actor", min_rows: int = 5, min_sources: int = 3,
                  min_days: int = 2, threshold: float = 0.6) -> dict[str, DataFrame]:
    """P4 with its writes: the accepted clusters of recent statements as rows of the store.

    Returns ``narratives`` (with those of ``existing``; by name, the first
    description and the last metrics stay), ``clusters`` with centroids,
    ``cluster_statement``, ``cluster_article`` (each distinct article of a cluster),
    ``events``, ``event_article`` (the first five articles by id) and the grown ``cache``.
    """
    members = materialize(confident_members(statements, articles, now, days, label_col), "statement-members")
    vectors = materialize(hash_packed(members, "id", "full_statement", keep=["label"]), "statement-vectors")
    scored = materialize(score_clusters(members, vectors, ["label"], min_rows, min_sources, min_days, threshold, singleton_value=0.0),
                         "statement-scored")
    accepted = scored.where(F.col("accepted"))
    chosen = members.join(accepted.select("label"), "label", "left_semi")
    w = Window.partitionBy("label").orderBy(F.col("created_at").desc(), F.col("id"))
    texts = (chosen.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= rsp.LISTED).groupBy("label")
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "full_statement"))), lambda x: x["full_statement"]).alias("texts")))
    asked = accepted.join(texts, "label").withColumn("prompt", rsp.statements_prompt(F.col("texts"))).withColumns(
        {"task_type": F.lit("naming"), "content_hash": F.md5("prompt")})
    answers, cache = rsp.cached_batch(asked, cache, responder, now, statements.sparkSession)
    fallback = F.concat(F.lit("Statement Cluster "), F.date_format(now, "yyyyMMdd"), F.lit(" - "), F.col("label"))
    samples = F.array_join(F.transform(F.slice("texts", 1, SAMPLE_STATEMENTS), lambda t: F.substring(t, 1, SAMPLE_CHARS)), " | ")
    named = materialize(answers.select(
        "label", "n_rows", "n_sources", "n_days", "coherence", "diversity", "near_dup_rate", "significance",
        sel.name_or_fallback(F.col("response"), fallback).alias("name"),
        F.format_string("Narrative with %d statements from %d sources. Sample statements: %s",
                        F.col("n_rows"), F.col("n_sources"), samples).alias("description")), "statement-named")

    narratives = store.narrative_upsert(existing, store.narrative_rows(
        named, F.col("name"), F.col("description"), F.col("label"), now))
    narrative_id = store.key_id(F.col("name"))
    cluster_id = store.key_id(F.lit("statements"), F.col("name"), F.col("label"), F.to_date(now))
    ids = named.select("label", narrative_id.alias("narrative_id"), cluster_id.alias("cluster_id"))
    centroids = quality.mean_vectors(chosen, quality.of_clusters(vectors, accepted, ["label"]), ["label"], "centroid")
    clusters = ids.join(centroids, "label").select(
        F.col("cluster_id").alias("id"), "narrative_id", F.to_date(now).alias("cluster_date"), now.alias("created_at"), "label", "centroid")
    linked = chosen.select("label", "id", "article_id").join(ids, "label")
    cluster_article = linked.select("cluster_id", "label", "article_id").distinct()
    event_id = store.key_id(F.lit("emergence"), F.lit("statements"), F.col("name"), F.col("label"), F.to_date(now))
    events = named.select(
        event_id.alias("id"), narrative_id.alias("narrative_id"), F.lit("emergence").alias("event_type"),
        F.format_string("Narrative detected with %d statements (coherence: %.3f, diversity: %.3f)",
                        F.col("n_rows"), F.col("coherence"), F.col("diversity")).alias("description"),
        now.alias("event_date"), F.col("significance").alias("significance_score"))
    by_id = Window.partitionBy("cluster_id").orderBy("article_id")
    related = (cluster_article.withColumn("_r", F.row_number().over(by_id)).where(F.col("_r") <= RELATED_ARTICLES)
               .join(named.select("label", event_id.alias("event_id")), "label").select("event_id", "article_id"))
    return {"narratives": narratives, "clusters": clusters, "cluster_statement": linked.select("cluster_id", F.col("id").alias("statement_id")),
            "cluster_article": cluster_article, "events": events, "event_article": related, "cache": cache}


def statement_narratives(statements: DataFrame, articles: DataFrame, now: Column, days: int = 7,
                         label_col: str = "actor", min_rows: int = 5, min_sources: int = 3,
                         min_days: int = 2, threshold: float = 0.6, dup_threshold: float = 0.95) -> DataFrame:
    members = confident_members(statements, articles, now, days, label_col)
    vectors = materialize(hash_packed(members, "id", "full_statement", keep=["label"]), "statement-vectors")
    scored = score_clusters(members, vectors, ["label"], min_rows, min_sources, min_days, threshold,
                            dup_threshold, singleton_value=0.0)
    w = Window.partitionBy("label").orderBy(F.col("created_at").desc(), F.col("id"))
    samples = (members.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= SAMPLE_STATEMENTS)
               .groupBy("label").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
                   "_r", F.substring("full_statement", 1, SAMPLE_CHARS).alias("s")))), lambda x: x["s"]), " | ")
                   .alias("_samples")))
    wa = Window.partitionBy("label").orderBy("article_id")
    related = (members.select("label", "article_id").distinct()
               .withColumn("_r", F.row_number().over(wa)).where(F.col("_r") <= RELATED_ARTICLES)
               .groupBy("label").agg(F.count(F.lit(1)).alias("n_related")))
    out = scored.join(samples, "label").join(related, "label", "left")
    return out.select(
        "label", F.col("n_rows").alias("n_statements"), "n_sources", "n_days", "coherence", "diversity",
        "near_dup_rate", "accepted", "reject_reason",
        F.format_string("Narrative with %d statements from %d sources. Sample statements: %s",
                        F.col("n_rows"), F.col("n_sources"), F.col("_samples")).alias("description"),
        F.when(F.col("accepted"), F.format_string(
            "Narrative detected with %d statements (coherence: %.3f, diversity: %.3f)",
            F.col("n_rows"), F.col("coherence"), F.col("diversity"))).alias("event_description"),
        F.col("significance"),
        F.when(F.col("accepted"), F.coalesce(F.col("n_related"), F.lit(0))).alias("n_related"))
