"""The weekly job end to end (P1) and its historical form.

members → hashed vectors → cluster metrics → gate → medoids → compression →
naming (cached-or-ask) → narratives, clusters with centroid and members,
emergence events, and the run's model cost.  All weeks are one plan, with the
week as a key; the historical run takes the forward grid instead of the
look-back and leaves out weeks that already hold an event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import forward_start, week_back_start, week_fwd
from ..functions.vectors import hash_packed
from ..operators import quality
from ..operators import responders as rsp
from ..operators import select as sel
from ..session import materialize
from ..sources.adapters import NOW, now_col
from . import compress, historical, store, weekly

KEYS = weekly.KEYS


def historical_members(articles: DataFrame, events: DataFrame | None, now: str = NOW, months: int = 2,
                       label_col: str = "lang", min_week_rows: int = 6) -> DataFrame:
    """Rows of the forward grid's weeks that have enough rows and, with ``events``, none of them yet."""
    spark = articles.sparkSession
    rows = (articles.withColumn("week", week_fwd(F.col("published_date"), now_col(now), months))
            .where(F.col("week").isNotNull()))
    todo = rows.groupBy("week").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_week_rows).select("week")
    if events is not None:
        done = historical.processed_weeks(historical.week_grid(spark, now, months), events, now, months)
        todo = todo.join(done.select(F.col("week_idx").alias("week")), "week", "left_anti")
    # The grid has at most ceil(30 * months / 7) weeks.
    return rows.join(F.broadcast(todo), "week", "left_semi").select(
        "week", F.coalesce(F.col(label_col), F.lit(weekly.NO_LABEL)).alias("label"), "id", "source",
        "published_date", "title", "content", "url")


def run(members: DataFrame, week_start: Column, responder: rsp.Responder, brief_responder: rsp.Responder,
        cache: DataFrame, now: str = NOW, threshold: float = 0.5, ranker: str = "textrank",
        existing: DataFrame | None = None) -> dict[str, DataFrame]:
    """The job over ``members(week, label, id, source, published_date, title, content, url)``.

    Returns the tables ``narratives, clusters, cluster_article, events, briefs,
    cost`` and the grown response ``cache``.  ``week_start`` is a column of the week.
    """
    spark = members.sparkSession
    nowc = now_col(now)
    vectors = materialize(hash_packed(members, keep=KEYS), "pipeline-vectors")
    # Without texts, which only hashing and the medoids read: those would be the most of all that a run writes.
    rows = materialize(members.select(*KEYS, "id", "source", "published_date"), "pipeline-members")
    scored = materialize(weekly.score_clusters(rows, vectors, KEYS, threshold=threshold), "pipeline-scored")
    accepted = scored.where(F.col("accepted")).withColumn("week_start", week_start)
    chosen = rows.join(accepted.select(*KEYS), KEYS, "left_semi")
    vectors = quality.of_clusters(vectors, accepted, KEYS)
    medoids = quality.medoids(chosen, vectors, KEYS, 3)
    texts = materialize(medoids.join(members, [*KEYS, "id"]).select(
        *KEYS, "id", F.col("medoid_rank").alias("doc_order"), "source", "title", "url", "published_date",
        F.concat(F.col("title"), F.lit(". "), F.col("content")).alias("text")), "pipeline-medoids")
    comp = materialize(compress.compress_clusters(accepted.select(*KEYS, "n_rows"), texts, KEYS, ranker=ranker), "pipeline-compressed")
    requests = materialize(comp.select(*KEYS, F.lit("naming").alias("task_type"), "content_hash", "compression_ratio",
                                       rsp.naming_prompt(compress.prompt_content(comp)).alias("prompt")), "pipeline-prompts")
    answers, cache = rsp.cached_batch(requests, cache, responder, nowc, spark)
    fallback = F.concat(F.lit("News Cluster "), F.col("label"))
    named = materialize(accepted.join(answers.select(
        *KEYS, "compression_ratio", "from_cache", F.length("prompt").alias("prompt_chars"),
        sel.name_or_fallback(F.col("response"), fallback).alias("name")), KEYS), "pipeline-named")

    description = F.format_string("Weekly narrative with %d articles from %d sources. Compression: %.1f%%",
                                  F.col("n_rows"), F.col("n_sources"), F.col("compression_ratio") * 100)
    narratives = store.narrative_upsert(existing, store.narrative_rows(
        named, F.col("name"), description, F.unix_micros("week_start"), F.col("week_start")))
    centroids = quality.mean_vectors(chosen, vectors, KEYS, "centroid").withColumn("centroid", F.transform(
        "centroid", lambda x, i: F.struct(i.alias("slot"), x.alias("value"))))
    narrative_id = store.key_id(F.col("name"))
    cluster_id = store.key_id(F.col("name"), F.col("week_start"), F.col("label"))
    clusters = named.join(centroids, KEYS).select(
        cluster_id.alias("id"), narrative_id.alias("narrative_id"), F.to_date("week_start").alias("cluster_date"), *KEYS, "centroid")
    cluster_article = chosen.join(named.select(*KEYS, cluster_id.alias("cluster_id")), KEYS).select("cluster_id", F.col("id").alias("article_id"))
    events = named.select(
        store.key_id(F.lit("emergence"), F.col("name"), F.col("week_start"), F.col("label")).alias("id"),
        narrative_id.alias("narrative_id"), F.lit("emergence").alias("event_type"),
        F.format_string("Weekly narrative: %d articles, coherence %.3f", F.col("n_rows"), F.col("coherence")).alias("description"),
        F.col("week_start").alias("event_date"), F.col("significance").alias("significance_score"))

    bullet = rsp.brief_bullet(F.col("name"), F.col("n_rows"), F.col("n_sources"), F.col("coherence"))
    weeks = named.select("week", "label", bullet.alias("bullet")).groupBy("week").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("label", "bullet"))), lambda x: x["bullet"]).alias("bullets"))
    asked = weeks.select("week", F.size("bullets").alias("n"), F.lit("brief").alias("task_type"),
                         rsp.brief_prompt(F.col("bullets"), F.size("bullets")).alias("prompt")).withColumn("content_hash", F.md5("prompt"))
    brief_answers, cache = rsp.cached_batch(asked, cache, brief_responder, nowc, spark)
    briefs = materialize(brief_answers.select("week", "n", rsp.brief_text(F.col("n"), F.col("response")).alias("brief"),
                                              "response", "from_cache", F.length("prompt").alias("prompt_chars")), "pipeline-briefs")
    return {"narratives": narratives, "clusters": clusters, "cluster_article": cluster_article, "events": events,
            "briefs": briefs.select("week", F.col("n").alias("n_narratives"), "brief"), "cost": run_cost(named, briefs), "cache": cache}


def run_cost(named: DataFrame, briefs: DataFrame) -> DataFrame:
    """One row with the run's calls and cost.  Names cost their prompt, briefs prompt and answer;
    a failed call and an answer from the cache cost nothing, as they never reach the counter."""
    price = {task: p for task, _, p in rsp.PRICES}
    names = named.agg(F.count(F.lit(1)).alias("narratives_created"), F.count_if(~F.col("from_cache")).alias("naming_calls"),
                      F.coalesce(F.sum(F.when(~F.col("from_cache"), F.col("prompt_chars"))), F.lit(0)).alias("naming_chars"))
    paid = ~F.col("from_cache") & F.col("response").isNotNull()
    brief = briefs.agg(F.count_if(paid).alias("brief_calls"),
                       F.coalesce(F.sum(F.when(paid, F.col("prompt_chars") + F.length("response"))), F.lit(0)).alias("brief_chars"))
    both = names.select("*", brief.select("brief_calls").scalar().alias("brief_calls"), brief.select("brief_chars").scalar().alias("brief_chars"))
    total = rsp.call_cost(F.col("naming_chars"), F.lit(price["naming"])) + rsp.call_cost(F.col("brief_chars"), F.lit(price["brief"]))
    return both.withColumn("total_cost_usd", total).withColumn(
        "cost_per_narrative_usd", F.try_divide(F.col("total_cost_usd"), F.col("narratives_created")))


def weekly_run(articles: DataFrame, responder: rsp.Responder, brief_responder: rsp.Responder, cache: DataFrame,
               now: str = NOW, weeks: int = weekly.WEEKS, label_col: str = "lang", **options) -> dict[str, DataFrame]:
    """P1 over the last ``weeks`` weeks."""
    members = weekly.week_members(articles, now, weeks, label_col)
    return run(members, week_back_start(F.col("week"), now_col(now)), responder, brief_responder, cache, now, **options)


def historical_run(articles: DataFrame, events: DataFrame | None, responder: rsp.Responder, brief_responder: rsp.Responder,
                   cache: DataFrame, now: str = NOW, months: int = 2, label_col: str = "lang", **options) -> dict[str, DataFrame]:
    """The forward grid of the last ``months``, without weeks that already hold an event."""
    members = historical_members(articles, events, now, months, label_col)
    first = forward_start(now_col(now), months)
    start = first + F.make_dt_interval(days=F.col("week") * 7)
    return run(members, start, responder, brief_responder, cache, now, **options)
