"""Literal cases: feed dates, strict answers, embedder calls, null labels, convergence, plan shapes."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from storyloom import catalog, session
from storyloom.functions.vectors import hash_embed
from storyloom.operators import embed, kmeans, quality, statements
from storyloom.plans import weekly
from storyloom.sources import adapters, feed
from storyloom.streaming import ingest
from tests.conftest import SF_SMALL

NOW = dt.datetime(2024, 2, 5)

DATES = {
    "2024-01-15 10:00:00": dt.datetime(2024, 1, 15, 8),      # Kyiv winter time
    "2024-07-15T10:00:00": dt.datetime(2024, 7, 15, 7),      # Kyiv summer time
    "2024-01-15": dt.datetime(2024, 1, 14, 22),
    "2024-01-15T10:00:00Z": dt.datetime(2024, 1, 15, 10),
    "2024-01-15T10:00:00+02:00": dt.datetime(2024, 1, 15, 8),
    "2024-01-15 10:00:00 +0200": dt.datetime(2024, 1, 15, 8),
    "2024-01-15T10:00:00-0330": dt.datetime(2024, 1, 15, 13, 30),
    "2024-01-15T10:00:00+02": dt.datetime(2024, 1, 15, 8),
    "2024-01-15T10:00:00.250Z": dt.datetime(2024, 1, 15, 10, 0, 0, 250000),
    "2024-01-15 10:00:00,5": dt.datetime(2024, 1, 15, 8, 0, 0, 500000),
    "2024-01-15 10:00": dt.datetime(2024, 1, 15, 8),
    "Mon, 15 Jan 2024 10:00:00 GMT": dt.datetime(2024, 1, 15, 10),
    "Mon, 15 Jan 2024 10:00:00 +0200": dt.datetime(2024, 1, 15, 8),
    "5 February 2024 10:00:00 UTC": dt.datetime(2024, 2, 5, 10),
    "  2024-01-15T10:00:00Z ": dt.datetime(2024, 1, 15, 10),
    # Free forms; a zone name other than UTC's says nothing, so these are Kyiv's.
    "2024-01-15 10:00:00 PST": dt.datetime(2024, 1, 15, 8),
    "January 15, 2024 10:00": dt.datetime(2024, 1, 15, 8), "Jan 15 2024 10:00 EST": dt.datetime(2024, 1, 15, 8),
    "01/15/2024": dt.datetime(2024, 1, 14, 22), "15/01/2024": dt.datetime(2024, 1, 14, 22), "15.01.2024": dt.datetime(2024, 1, 14, 22),
    "01/02/2024": dt.datetime(2024, 1, 1, 22), "1/15/24 5:06 pm": dt.datetime(2024, 1, 15, 15, 6),
    "20240115T100000Z": dt.datetime(2024, 1, 15, 10), "20240115": dt.datetime(2024, 1, 14, 22), "20240115100000": dt.datetime(2024, 1, 15, 8),
    "2024-01-15 10:00 PM": dt.datetime(2024, 1, 15, 20), "2024-01-15 12:30 am": dt.datetime(2024, 1, 14, 22, 30),
    "2024-01-15 13:00 PM": NOW, "2024/01/15 10:00": dt.datetime(2024, 1, 15, 8), "2024.01.15": dt.datetime(2024, 1, 14, 22),
    "Mon Jan 15 10:00:00 2024": dt.datetime(2024, 1, 15, 8), "15-Jan-2024": dt.datetime(2024, 1, 14, 22),
    "15th of January 2024 at 3pm": dt.datetime(2024, 1, 15, 13), "Sat, 3 Feb 2024 1:02:03 -0800": dt.datetime(2024, 2, 3, 9, 2, 3),
    "2024-01-15T10:00+0530": dt.datetime(2024, 1, 15, 4, 30), "2024-01-15 10:00:00 GMT+3": dt.datetime(2024, 1, 15, 13),
    "10:30": dt.datetime(2024, 2, 5, 8, 30), "Jan 2024": dt.datetime(2024, 1, 4, 22), "Wednesday": dt.datetime(2024, 2, 6, 22),
    "2024-02-30": NOW, "25:00 2024-01-01": NOW, "3 days ago": NOW, "hello 2024-01-15": NOW, "1 2 3 4": NOW,
    "not a date": NOW, "2024-13-45": NOW, "": NOW, "31 Foo 2024": NOW,
}


def test_feed_dates(spark):
    df = spark.createDataFrame([(s,) for s in [*DATES, None]], "s string")
    got = {r.s: r.t for r in df.select("s", feed.parse_pub_date(F.col("s"), adapters.now_col()).cast("string").alias("t")).collect()}
    for s, want in {**DATES, None: NOW}.items():
        assert dt.datetime.fromisoformat(got[s]) == want, s


ITEM = '{"actor":"a","action":"b","confidence":0.5}'
ANSWERS = [
    (f"[{ITEM}]", [0.5]), (f" ```json\n[{ITEM}]\n``` ", [0.5]), (f"[{ITEM}] and more", []), (f"[{ITEM}] ]", []), (f"[{ITEM}]],[[{ITEM}]", []),
    (ITEM, []), ("[{'actor':'a','action':'b'}]", []), ("no", []), ("", []), (None, []), ("[]", []), ("[1, null, [2]]", []),
    (f'["stray", {ITEM}, 5, {ITEM}]', [0.5, 0.5]), ('[{"actor":"a","action":"b","confidence":null}]', []),
    ('[{"actor":"a","action":"b"}]', [0.0]), ('[{"actor":"a","action":"b","confidence":"0.75"}]', [0.75]),
    ('[{"actor":"a","action":"b","confidence":true}]', [1.0]), ('[{"actor":"a","action":"b","confidence":"high"}]', []),
    ('[{"actor":"a","action":"b","confidence":[1]}]', []), ('[{"actor":5,"action":"b"}]', []), ('[{"actor":"","action":"b"}]', []),
    ('[{"actor":"a","action":null}]', []), (f"[{ITEM},]", []), (f"[{ITEM}", []),
]


def test_answers_must_be_one_json_list(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ANSWERS)], "article_id long, response string")
    got = {}
    for r in statements.parse_statements(df).collect():
        got.setdefault(r.article_id, []).append(r.confidence)
    for i, (answer, want) in enumerate(ANSWERS):
        assert sorted(got.get(i, [])) == want, answer


def test_answers_belong_to_articles(spark, tmp_path):
    spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(c, t, "user", f"says {c}") for c in range(20) for t in range(2)], "conv_id long, turn long, role string, text string") \
        .write.parquet(f"{tmp_path}/conversations.parquet")
    got = statements.statements_table(spark, str(tmp_path))
    assert got.filter("article_id < 0 OR article_id > 2").count() == 0 and got.select("conv_id").distinct().count() > 3
    joined = statements.with_article(got, adapters.articles(spark, str(tmp_path), with_embedding=False))
    assert joined.count() == got.count()


def counting(folder):
    """An embedder that leaves one file per call and row; every fourth row gets a wrong size."""
    def run(texts):
        import os
        import uuid
        for _ in texts:
            open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return pd.Series([[1.0] * (3 if len(t) % 4 == 0 else 4) for t in texts])
    return run


def articles(spark, n=40):
    rows = [(i, "t", "c" * i, dt.datetime(2024, 1, 1), [1.0] * 4 if i % 5 == 0 else None) for i in range(n)]
    return spark.createDataFrame(rows, "id long, title string, content string, published_date timestamp, embedding array<float>")


def test_the_model_is_called_once_a_row(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    updated, outcome = embed.backfill(articles(spark), counting(str(calls)), dim=4)
    bad = outcome.filter("status <> 'ok'").count()
    assert outcome.count() == 32 and 0 < bad < 32 and updated.filter("embedding IS NULL").count() == bad
    assert len(list(calls.iterdir())) == 32


def test_the_stream_calls_once_and_keeps_rejects(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    a = articles(spark)
    a.write.parquet(f"{tmp_path}/in")
    out = ingest.embed_stream(spark, f"{tmp_path}/in", a.schema, f"{tmp_path}/out", f"{tmp_path}/ckpt", counting(str(calls)), dim=4)
    rejects = spark.read.parquet(f"{tmp_path}/out-rejected")
    assert len(list(calls.iterdir())) == 32 == out.count() + rejects.count()
    assert {r.status for r in rejects.collect()} == {"bad_dim"}


def test_a_broken_sink_is_an_error(spark, tmp_path):
    (tmp_path / "sink").mkdir()
    (tmp_path / "sink" / "part-0.parquet").write_text("no parquet")
    fd = feed.feed_from_pages(spark, SF_SMALL).limit(3)
    ingest.write_feed_files(fd, f"{tmp_path}/feed")
    with pytest.raises(Exception):
        ingest.ingest_stream(spark, f"{tmp_path}/feed", f"{tmp_path}/sink", f"{tmp_path}/ckpt").collect()


def test_long_texts_are_hashed_whole(spark):
    text = "word " * 2000 + "tail" * 3
    rows = [(1, "t", text, dt.datetime(2024, 1, 1), None)]
    a = spark.createDataFrame(rows, "id long, title string, content string, published_date timestamp, embedding array<float>")
    got = embed.embed_rows(a).first()["vector"]
    whole = {r.slot: r.value for r in hash_embed(a, "id", "content").collect()}
    assert {i for i, v in enumerate(got) if v} == set(whole) and all(abs(got[i] - v) < 1e-6 for i, v in whole.items())


def test_rows_without_a_label_form_a_cluster(spark):
    rows = [(i, f"text number {i}", None if i % 2 else "en", f"s{i % 4}", dt.datetime(2024, 1, 30 + i % 2)) for i in range(24)]
    a = spark.createDataFrame(rows, "id long, content string, lang string, source string, published_date timestamp") \
        .withColumns({"title": F.lit("t"), "url": F.lit("u")})
    got = {r.label: r.n_rows for r in weekly.weekly_narratives(a).collect()}
    assert got == {"en": 12, weekly.NO_LABEL: 12}


def test_lloyd_converges_from_the_best_start(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 0.3, (40, 3)) for m in (0, 4, 8)])
    pts = spark.createDataFrame([(1, i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2, 900, [1.0, 1.0, 1.0]), (2, 901, None)],
                                "run long, id long, vec array<double>").withColumnRenamed("run", "week")
    bad, good = x[:3], x[[0, 50, 100]]
    init = spark.createDataFrame([(1, s, c, [float(v) for v in r]) for s, rows in enumerate((bad, good)) for c, r in enumerate(rows)]
                                 + [(2, 0, 0, [0.0, 0.0, 0.0])], "week long, start int, cluster int, vec array<double>")
    assigned, cents = kmeans.lloyd(pts, init, ["week"])
    rows = assigned.filter("week = 1").orderBy("id").collect()
    label = np.array([r.cluster for r in rows])
    assert [len(set(label[i:i + 40])) for i in (0, 40, 80)] == [1, 1, 1]
    centre = {r.cluster: np.array(r.vec) for r in cents.filter("week = 1").collect()}
    for c in range(3):
        assert np.allclose(centre[c], x[label == c].mean(axis=0))
    assert assigned.filter("week = 2").count() == 1


def test_medoids_cut_before_the_exchange(spark):
    m = spark.createDataFrame([(1, "a", i, dt.datetime(2024, 1, 1)) for i in range(9)], "week int, label string, id long, published_date timestamp")
    v = spark.createDataFrame([(i, i % 3, 1.0) for i in range(9)], "id long, slot int, value double")
    plan = quality.medoids(m, v, ["week", "label"])._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2
    weeks = catalog.q_weeks_unprocessed(spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "NestedLoop" not in weeks and "Cartesian" not in weeks


class Cluster:
    """What checkpoint_dir asks of a session."""

    class conf:
        @staticmethod
        def get(key, default):
            return default

    class sparkContext:
        master = "spark://driver:7077"


def test_a_cluster_must_name_a_shared_folder(monkeypatch):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Cluster)
    assert os.path.isdir(SF_SMALL)
