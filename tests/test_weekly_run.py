"""The weekly and the historical job end to end with the stub model."""

import pytest
from pyspark.sql import functions as F

from storyloom import catalog
from storyloom.operators import responders as rsp
from storyloom.plans import pipeline, weekly
from storyloom.sources import adapters
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def run(spark):
    articles = adapters.articles(spark, SF_SMALL, with_embedding=False)
    cache = spark.createDataFrame([], rsp.CACHE_SCHEMA)
    return articles, pipeline.weekly_run(articles, rsp.stub_responder, rsp.stub_brief, cache, threshold=0.2)


def test_tables_agree(spark, run):
    articles, t = run
    clusters, events = t["clusters"].collect(), t["events"].collect()
    assert clusters and len(events) == len(clusters) == len({c.id for c in clusters})
    names = {n.id: n for n in t["narratives"].collect()}
    assert {c.narrative_id for c in clusters} == set(names) == {e.narrative_id for e in events}
    assert all(n.name.startswith("Topic ") and 0 < n.support_count for n in names.values())
    members = weekly.week_members(articles).groupBy("week", "label").agg(F.count(F.lit(1)).alias("n"))
    size = {(r.week, r.label): r.n for r in members.collect()}
    held = {r.cluster_id: r.n for r in t["cluster_article"].groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(held[c.id] == size[c.week, c.label] for c in clusters)
    assert all(c.centroid and max(abs(x.value) for x in c.centroid) <= 1 for c in clusters)


def test_cost_and_cache(spark, run):
    articles, t = run
    cost, n = t["cost"].first(), t["clusters"].count()
    briefs = t["briefs"].collect()
    failed = sum(b.brief.startswith("Weekly analysis completed") for b in briefs)
    assert cost.narratives_created == n and 0 < cost.naming_calls <= n and cost.brief_calls == len(briefs) - failed
    want = cost.naming_chars / 1000 * 0.00015 + cost.brief_chars / 1000 * 0.001
    assert abs(cost.total_cost_usd - want) < 1e-12 and abs(cost.cost_per_narrative_usd - want / n) < 1e-12

    def silent(prompts):
        raise AssertionError("asked again")

    again = pipeline.weekly_run(articles, silent, rsp.stub_brief, t["cache"], threshold=0.2)
    assert again["cost"].first().naming_calls == 0
    assert sorted(r.name for r in again["narratives"].collect()) == sorted(r.name for r in t["narratives"].collect())


def test_historical_leaves_done_weeks_out(spark, run):
    articles, t = run
    members = pipeline.historical_members(articles, None)
    weeks = {r.week for r in members.select("week").distinct().collect()}
    one = t["events"].orderBy("event_date").limit(1)
    rest = {r.week for r in pipeline.historical_members(articles, one).select("week").distinct().collect()}
    assert len(weeks) - 1 == len(rest) and rest < weeks


def test_registered_runs(spark):
    rows = catalog.q_weekly_pipeline(spark, SF_SMALL).collect()
    assert rows and all(r.n_articles >= 5 for r in rows)


def test_run_writes_no_text_but_the_medoids(spark, monkeypatch):
    """Members are written without their texts, and medoids still get theirs, also where an id comes twice."""
    rows = [(i % 20, f"s{i % 4}", f"2024-02-0{1 + i % 3} 10:00:00", f"Title {i % 20}", f"Common words of all texts and number{i % 20} alone.", f"u{i}", "en")
            for i in range(21)]
    articles = spark.createDataFrame(rows, "id long, source string, day string, title string, content string, url string, lang string") \
        .withColumn("published_date", F.to_timestamp("day")).drop("day")
    written = {}
    write = pipeline.materialize
    monkeypatch.setattr(pipeline, "materialize", lambda df, name: written.setdefault(name, write(df, name)))
    t = pipeline.weekly_run(articles, rsp.stub_responder, rsp.stub_brief, spark.createDataFrame([], rsp.CACHE_SCHEMA), threshold=0.2)
    assert written["pipeline-members"].columns == ["week", "label", "id", "source", "published_date"]
    assert {n for n, df in written.items() if {"content", "text"} & set(df.columns)} == {"pipeline-medoids"}
    assert all(r.text == f"Title {r.id}. Common words of all texts and number{r.id} alone." for r in written["pipeline-medoids"].collect())
    held = sorted(r.article_id for r in t["cluster_article"].collect())
    assert held == sorted([*range(20), 0]) and t["cost"].first().narratives_created == 1
