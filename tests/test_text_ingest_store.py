"""Text operators, ingest rules, store semantics, model jobs, streaming and plan shape."""

import math
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from storyloom.functions import text as tx
from storyloom.operators import responders as rsp
from storyloom.operators import select as sel
from storyloom.operators import statements as st
from storyloom.operators import summarize as sm
from storyloom.plans import store
from storyloom.session import scratch_path
from storyloom.sources import feed as fd

from .conftest import SF_MID, SF_SMALL

UK_TEXT = ("Президент Володимир Олександрович Зеленський заявив у Києві, що Міністерство фінансів "
           "виділило ₴ 1 500 000 та грн. 12 млн на ремонт. Зустріч відбулася 15 березня 2024 у Львові "
           "з представниками від Сполучених Штатів. Національна компанія та державна служба також "
           "отримали $ 2,500.00 мільйон. Це те що і як, але не для нас. 3 квітня 2023 року Оксана Петренко "
           "приїхала до Харкова.")


def py_pattern(p):
    return p.replace("(?iU)", "(?i)").replace("(?U)", "")


@pytest.mark.parametrize("lang,text", [("uk", UK_TEXT),
                                       ("en", "John Smith met Mary Ann Lee in New York at Acme Corp on "
                                              "March 5, 2024 and paid $1,200.50 million to the Health Ministry "
                                              "from Paris.")])
def test_entities_match_python_re(spark, lang, text):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(tx.entities(F.col("t"), lang).alias("m")).collect()[0].m
    pats = tx.UK_PATTERNS if lang == "uk" else tx.EN_PATTERNS
    want = {}
    for k in tx.ENTITY_TYPES:
        found = re.findall(py_pattern(pats[k]), text)
        if found:
            want[k] = sorted(set(found))
    assert {k: list(v) for k, v in got.items()} == want
    assert len(want) >= 4


def test_keywords_uk_and_language_stats(spark):
    df = spark.createDataFrame([(1, UK_TEXT), (2, "і та що"), (3, ""), (4, "Latin only words here.")],
                               "id long, t string")
    got = {r.id: r for r in df.select("id", tx.cyrillic_words(F.col("t")).alias("w"),
                                      F.size(tx.word_runs(F.col("t"))).alias("n"),
                                      F.size(tx.sentences(F.col("t"), 10)).alias("s"),
                                      tx.has_ukrainian(F.col("t")).alias("uk")).collect()}
    for i, t in [(1, UK_TEXT), (2, "і та що"), (3, ""), (4, "Latin only words here.")]:
        words = [w for w in re.findall(r"\b[а-яіїєґА-ЯІЇЄҐ]{3,}\b", t.lower()) if w not in tx.STOP_UK_SHORT]
        assert list(got[i].w) == words
        assert got[i].n == len(re.findall(r"\b\w+\b", t))
        assert got[i].s == len([s.strip() for s in re.split(r"[.!?]+", t) if len(s.strip()) > 10])
        assert got[i].uk == bool(re.search(r"[іїєґ]", t.lower()))


def test_sentences_match_python(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("doc_id < 30")
    got = {r.doc_id: list(r.s) for r in docs.select("doc_id", tx.sentences(F.col("text")).alias("s")).collect()}
    for r in docs.collect():
        want = [s.strip() for s in re.split(r"[.!?]+", r.text) if len(s.strip()) > 20]
        assert got[r.doc_id] == want


def _py_tfidf(sentences):
    toks = [[t for t in re.findall(r"\w{2,}", s.lower()) if t not in tx.STOP_UK] for s in sentences]
    vocab = sorted({t for ts in toks for t in ts})
    idx = {t: i for i, t in enumerate(vocab)}
    n = len(sentences)
    df = Counter(t for ts in toks for t in set(ts))
    m = np.zeros((n, len(vocab)))
    for i, ts in enumerate(toks):
        for t, c in Counter(ts).items():
            m[i, idx[t]] = c * (math.log((1 + n) / (1 + df[t])) + 1)
    norms = np.linalg.norm(m, axis=1)
    norms[norms == 0] = 1
    return m / norms[:, None]


def _py_pagerank(w, alpha=0.85, tol=1e-6, max_iter=100):
    n = len(w)
    s = w.sum(axis=1)
    q = np.where(s != 0, 1.0 / np.where(s != 0, s, 1), 0)
    a = q[:, None] * w
    x = np.full(n, 1.0 / n)
    p = np.full(n, 1.0 / n)
    dangling = s == 0
    for _ in range(max_iter):
        last = x
        x = alpha * (last @ a + last[dangling].sum() * p) + (1 - alpha) * p
        if np.abs(x - last).sum() < n * tol:
            return x
    raise RuntimeError


def test_textrank_matches_dense_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("doc_id < 12")
    texts = docs.select(F.col("doc_id").alias("gid"), F.lit(0).alias("doc_order"), F.col("text"))
    sents = sm.sentence_table(texts, ["gid"])
    got = sm.textrank(sents, ["gid"], 6).collect()
    for r in docs.collect():
        ss = [s.strip() for s in re.split(r"[.!?]+", r.text) if len(s.strip()) > 20]
        mine = sorted([g for g in got if g.gid == r.doc_id], key=lambda g: g.rank)
        if len(ss) <= 6:
            assert [g.sentence for g in mine] == ss
            continue
        t = _py_tfidf(ss)
        pr = _py_pagerank(t @ t.T)
        assert pr.sum() == pytest.approx(1.0)
        want = sorted(zip(np.round(pr, 12), ss), reverse=True)[:6]
        assert [g.sentence for g in mine] == [s for _, s in want]
        assert [g.score for g in mine] == pytest.approx([p for p, _ in want], abs=1e-9)


def test_key_terms_bigrams_after_stop_words(spark):
    df = spark.createDataFrame([(1, 0, "Ціни на пальне зросли. Ціни на пальне"), (1, 1, "пальне зросли")],
                               "gid long, doc_order int, text string")
    got = sm.key_terms(df, ["gid"], 12).collect()
    joined = "Ціни на пальне зросли. Ціни на пальне пальне зросли"
    toks = [t for t in re.findall(r"\w{2,}", joined.lower()) if t not in tx.STOP_UK]
    grams = toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]
    want = sorted(Counter(grams).items(), key=lambda kv: (-kv[1], kv[0]))[:12]
    assert [(g.term, g.cnt) for g in sorted(got, key=lambda g: g.rank)] == want


def test_parse_pub_date_cases(spark):
    rows = [("2024-01-15 12:00:00",), ("2024-07-01 12:00:00",), ("2024-01-15T12:00:00Z",),
            ("2024-01-15T12:00:00+02:00",), ("not a date",), ("",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    now = F.to_timestamp(F.lit("2024-02-05 00:00:00"))
    got = [str(r.d) for r in df.select(fd.parse_pub_date(F.col("s"), now).alias("d")).collect()]
    assert got == ["2024-01-15 10:00:00", "2024-07-01 09:00:00", "2024-01-15 12:00:00",
                   "2024-01-15 10:00:00", "2024-02-05 00:00:00", "2024-02-05 00:00:00",
                   "2024-02-05 00:00:00"]


def test_normalise_and_insert_if_absent_idempotent(spark):
    feed = spark.createDataFrame([
        (1, "u1", "T1", None, "d1", None, None),
        (2, "u1", "T1 again", "c", "d", "s", None),
        (3, "", "no link", "c", "d", "s", None),
        (4, "u2", "", "c", "d", "s", None),
        (5, "u3", "x" * 600, "", "desc", "s3", "2024-01-01 00:00:00"),
    ], "seq long, link string, title string, content string, description string, source_id string, pubDate string")
    items = fd.normalise(feed)
    got = {r.url: r for r in items.collect()}
    assert set(got) == {"u1", "u3"} and len(items.collect()) == 3
    assert len(got["u3"].title) == 500 and got["u3"].content == "desc"
    existing = spark.createDataFrame([("u3",)], "url string")
    first = fd.insert_if_absent(items, existing).collect()
    assert [(r.url, r.title, r.source) for r in first] == [("u1", "T1", "unknown")]
    again = fd.insert_if_absent(items, existing.unionByName(spark.createDataFrame([("u1",)], "url string")))
    assert again.count() == 0


def test_statement_parsing_literals(spark):
    ok_item = '{"actor": "Уряд", "action": "ухвалив", "full_statement": "Уряд ухвалив", "confidence": 0.8}'
    rows = [
        (1, "[" + ok_item + "]"),
        (2, "```json\n[" + ok_item + "]\n```"),
        (3, ok_item),                                   # lone object → nothing
        (4, "I could not find anything."),              # not JSON → nothing
        (5, "[]"),
        (6, '[{"actor": "A", "full_statement": "x"}, {"actor": "B", "action": "b"}]'),  # missing action; missing confidence → 0
        (7, '[{"actor": "A", "action": "a", "confidence": "high"}]'),                   # unparseable confidence → dropped
        (8, '[{"actor": "' + "x" * 310 + '", "action": "a", "confidence": "0.4"}]'),
    ]
    df = spark.createDataFrame(rows, "article_id long, response string")
    got = sorted(st.parse_statements(df).collect(), key=lambda r: (r.article_id, r.item_pos))
    assert [(r.article_id, r.actor[:3]) for r in got] == [(1, "Уря"), (2, "Уря"), (6, "B"), (8, "xxx")]
    assert got[0].confidence == 0.8 and got[2].confidence == 0.0 and got[2].reason == ""
    assert len(got[3].actor) == 300 and got[3].confidence == 0.4


@pytest.mark.parametrize("raw,ok", [
    ('"Climate Policy Debate"', True), ("  Tech Update \n", True), ("a b c d e f", True),
    ("a b c d e f g", False), ("x" * 50, True), ("x" * 51, False), ("", True)])
def test_name_rules(spark, raw, ok):
    df = spark.createDataFrame([(raw,)], "r string")
    r = df.select(sel.valid_name(sel.clean_name(F.col("r"))).alias("ok"),
                  sel.name_or_fallback(F.col("r"), F.lit("News Cluster 1")).alias("n")).collect()[0]
    assert r.ok == ok
    want = raw.strip().replace('"', "").replace("'", "")
    assert r.n == (want if ok else "News Cluster 1")


def _narr_rows(spark, rows):
    return spark.createDataFrame(rows, "name string, description string, seq int, created_at timestamp, "
                                       "source_diversity_score double, support_count int, unique_sources_count int, "
                                       "coherence_score double, near_duplicate_rate double, persistence_days int")


def test_narrative_upsert_first_description_last_metrics_idempotent(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    new = _narr_rows(spark, [("N", "first", 0, t0, 0.5, 10, 3, 0.6, 0.0, 2),
                             ("N", "second", 1, t0, 0.7, 20, 4, 0.7, 0.1, 3),
                             ("M", "only", 0, t0, 0.1, 5, 3, 0.9, 0.0, 2)])
    out = store.narrative_upsert(None, new)
    got = {r.name: r for r in out.collect()}
    assert got["N"].description == "first" and got["N"].support_count == 20 and got["N"].coherence_score == 0.7
    again = store.narrative_upsert(out, new)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def test_pages_cover_whole_without_overlap(spark):
    df = spark.range(23).withColumn("score", (F.col("id") * 7 % 5).cast("double"))
    order = [F.col("score").desc(), F.col("id")]
    seen = []
    for p in range(1, 6):
        rows = store.page(df, order, p, 5).collect()
        if p < 5:
            assert rows[0].total_count == 23
        seen += [r.id for r in rows]
    assert sorted(seen) == list(range(23)) and len(seen) == 23


def test_cache_second_run_sends_no_prompts(spark):
    calls = spark.sparkContext.accumulator(0)

    def responder(prompts: pd.Series) -> pd.Series:
        calls.add(len(prompts))
        return rsp.stub_responder(prompts)

    req = spark.createDataFrame([(i, "naming", f"h{i % 4}", f"prompt {i % 4}") for i in range(8)],
                                "rid int, task_type string, content_hash string, prompt string")
    empty = spark.createDataFrame([], rsp.CACHE_SCHEMA)
    now = F.to_timestamp(F.lit("2024-02-05 00:00:00"))
    ans1, cache1 = rsp.cached_batch(req, empty, responder, now)
    first = ans1.collect()
    assert calls.value == 4 and not any(r.from_cache for r in first)
    ans2, _ = rsp.cached_batch(req, cache1, responder, now)
    second = ans2.collect()
    assert calls.value == 4 and all(r.from_cache for r in second)
    assert sorted((r.rid, r.response) for r in first) == sorted((r.rid, r.response) for r in second)


def test_stream_restart_adds_no_duplicates(spark):
    from storyloom.streaming import ingest
    feed = fd.feed_from_pages(spark, SF_SMALL)
    feed_dir, sink, ck = (scratch_path(spark, n) for n in ("f", "s", "c"))
    ingest.write_feed_files(feed, feed_dir)
    out1 = ingest.ingest_stream(spark, feed_dir, sink, ck).collect()
    out2 = ingest.ingest_stream(spark, feed_dir, sink, ck).collect()
    batch = fd.insert_if_absent(fd.normalise(feed), spark.createDataFrame([], "url string")).collect()
    assert len(out1) == len(out2) == len(batch)
    assert sorted(r.url for r in out1) == sorted(r.url for r in batch)


PLAN_QUERIES = ["weekly_narratives", "coherence", "key_terms", "feed_normalise", "timeline_page",
                "articles_filter", "medoids", "statements_parse", "kmeans_assign", "silhouette_exact",
                "near_dup_rate", "kmeans_lloyd"]


@pytest.mark.parametrize("name", PLAN_QUERIES)
def test_plan_shape(spark, name):
    import __spark_entry__ as entry
    df = entry.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    if name == "articles_filter":
        assert "EqualTo(source,src3)" in plan


ORACLE_SUBSET = ["weekly_narratives", "coherence", "near_dup_pairs", "key_terms", "rank_sentences",
                 "feed_normalise", "statements_parse", "week_stats", "kmeans_lloyd", "narrative_upsert",
                 "statement_narratives", "timeline_page"]


@pytest.mark.parametrize("name", ORACLE_SUBSET)
def test_oracle_subset(spark, name):
    import __spark_entry__ as entry
    sys_path = os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools")
    import sys
    sys.path.insert(0, sys_path)
    from oracle_check import TABLES, canon
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    s = entry.queries()[name](spark, SF_SMALL).toPandas()
    d = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(d.columns)
    assert canon(s) == canon(d)


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    rows = entry.entry(spark).collect()
    assert len(rows) > 0


def test_embed_stream_restart_adds_nothing(spark):
    from storyloom.sources.adapters import articles
    from storyloom.streaming import ingest
    a = articles(spark, SF_MID).select("id", "title", "content", "published_date", "embedding")
    art_dir, sink, ck = (scratch_path(spark, n) for n in ("a", "v", "k"))
    for part in (a.where(F.col("id") % 2 == 0), a.where(F.col("id") % 2 == 1)):
        part.write.mode("append").parquet(art_dir)
    first = ingest.embed_stream(spark, art_dir, a.schema, sink, ck).count()
    again = ingest.embed_stream(spark, art_dir, a.schema, sink, ck).count()
    assert first == again == a.where(F.col("embedding").isNull()).count()
