"""Packed sums, pairs with pruning, pages, nested lists, versioned tables, the jobs' writes, windows, bounded streams."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom import catalog
from storyloom.functions import vectors
from storyloom.operators import pairs, quality
from storyloom.operators import responders as rsp
from storyloom.plans import historical, pages, shifts, statements, store, versions, weekly
from storyloom.session import scratch_path, spread
from storyloom.sources import adapters
from storyloom.streaming import ingest
from tests.conftest import SF_MID, SF_SMALL

SPARSE = "id long, week int, vec array<struct<slot:int,value:double>>"


def sparse_rows(n=400, dim=96, seed=2, clusters=3):
    """Unit vectors with copies, near copies and zero vectors."""
    rng = np.random.default_rng(seed)
    dense = np.where(rng.random((n, dim)) < 0.2, rng.normal(size=(n, dim)), 0.0)
    for i in range(1, n):
        if i % 7 == 0:
            dense[i] = dense[i - 1]
        elif i % 11 == 0:
            dense[i] = dense[i - 1] * (1 + 0.05 * rng.normal(size=dim))
    dense[::50] = 0
    norm = np.linalg.norm(dense, axis=1, keepdims=True)
    dense = np.divide(dense, norm, out=np.zeros_like(dense), where=norm > 0)
    rows = [(i, i % clusters if i % 5 else 0, [(int(s), float(v[s])) for s in np.flatnonzero(v)]) for i, v in enumerate(dense)]
    return dense, rows


@pytest.fixture(scope="module")
def packed(spark):
    dense, rows = sparse_rows()
    return dense, rows, spark.createDataFrame(rows, SPARSE)


@pytest.mark.parametrize("flush", [1, 4096])
def test_sums_are_merged_in_rounds(spark, packed, monkeypatch, flush):
    dense, rows, df = packed
    monkeypatch.setattr(quality, "CLUSTERS_A_TASK", flush)
    got = {r.week: r for r in quality.cluster_sums(None, df.repartition(7), ["week"]).collect()}
    for week in {r[1] for r in rows}:
        x = dense[[r[0] for r in rows if r[1] == week]]
        r = got[week]
        total = np.zeros(x.shape[1])
        total[:len(r["sum"])] = r["sum"]
        assert r.n == len(x) and np.allclose(total, x.sum(axis=0)) and np.isclose(r.q, (x * x).sum())
    whole = quality.cluster_sums(None, df, []).collect()
    assert len(whole) == 1 and whole[0].n == len(rows)


def test_keys_of_any_type_and_null(spark):
    rows = [(1, None, "a", [1.0, 2.0]), (2, None, "a", [3.0, 4.0]), (3, dt.date(2024, 1, 1), None, [5.0]), (4, dt.date(2024, 1, 1), "a", [])]
    df = spark.createDataFrame(rows, "id long, day date, label string, vec array<double>")
    got = {(r.day, r.label): (r.n, r["sum"]) for r in quality.cluster_sums(None, df, ["day", "label"]).collect()}
    assert got == {(None, "a"): (2, [4.0, 6.0]), (dt.date(2024, 1, 1), None): (1, [5.0]), (dt.date(2024, 1, 1), "a"): (1, [])}


def test_statistics_take_no_entry_apart(spark, packed):
    _, _, df = packed
    m = df.select("week", "id").withColumn("published_date", F.lit("2024-01-01").cast("timestamp"))
    for plan in (quality.coherence(m, df, ["week"]), quality.medoids(m, df, ["week"], 3), quality.cluster_sums(m, df, ["week"])):
        assert "Generate" not in plan._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [25, 2000])
def test_pairs_equal_brute_force_with_few_products(spark, packed, block):
    dense, rows, df = packed
    m = df.select("week", "id")
    got = {(r.week, r.id_a, r.id_b): r.cosine for r in pairs.similar_pairs(m, df, ["week"], 0.9, block).collect()}
    want = {}
    for i, week, _ in rows:
        for j, other, _ in rows[:i]:
            if week == other and dense[i] @ dense[j] > 0.9:
                want[week, j, i] = dense[i] @ dense[j]
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    classes, _ = pairs.vector_classes(m, df, ["week"])
    sizes = [r["count"] for r in classes.groupBy("week").count().collect()]
    assert pairs.open_pairs(classes, ["week"], 0.9, block).count() * 10 <= sum(n * (n - 1) // 2 for n in sizes)


def test_a_group_of_copies_is_one_row(spark):
    rows = [(i, 0, [(0, 0.6), (5, 0.8)]) for i in range(500)] + [(500 + i, 0, [(i, 1.0)]) for i in range(5)]
    df = spark.createDataFrame(rows, SPARSE)
    classes, member = pairs.vector_classes(df.select("week", "id"), df, ["week"])
    assert classes.count() == 6 and member.count() == 505
    r = pairs.near_dup_counts(df.select("week", "id"), df, ["week"], 0.95).first()
    assert (r.n_dup, r.n_pairs) == (500 * 499 // 2, 505 * 504 // 2)


def test_weekly_pairs_need_a_tenth_of_the_products(spark):
    m = weekly.week_members(adapters.articles(spark, SF_MID, with_embedding=False))
    v = vectors.hash_packed(m, keep=weekly.KEYS)
    classes, _ = pairs.vector_classes(m, v, weekly.KEYS)
    sizes = [r["count"] for r in classes.groupBy(*weekly.KEYS).count().collect()]
    assert pairs.open_pairs(classes, weekly.KEYS, 0.95).count() * 10 <= sum(n * (n - 1) // 2 for n in sizes)


def test_small_files_are_spread_and_large_ones_are_not(spark, tmp_path, monkeypatch):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    assert "RoundRobinPartitioning" in spread(one)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr("storyloom.session.SPLIT_BYTES", 1)
    assert spread(one) is one


# --- pages and nested lists --------------------------------------------------

def test_every_page_is_a_slice_of_the_list(spark):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i * 7919 % 600)) for i in range(997)]
    df = spark.createDataFrame(rows, "id long, published_date timestamp")
    order = [F.col("published_date").desc(), F.col("id").asc()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        written = pages.write_pages(df, order, "list")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [i for i, _ in sorted(rows, key=lambda r: (-r[1].timestamp(), r[0]))]
    assert written.counts.count() > 1
    for number in (1, 2, 7, 20, 49, 50, 51):
        page = written.page(number, 20)
        got = page.orderBy("rank").collect()
        assert [r.id for r in got] == want[(number - 1) * 20:number * 20]
        assert [r["rank"] for r in got] == list(range((number - 1) * 20 + 1, (number - 1) * 20 + 1 + len(got)))
        assert all(r.total_count == 997 and r.has_next == (number * 20 < 997) for r in got)
    deep = written.page(40, 20)
    assert 1 <= len({os.path.dirname(f) for f in deep.inputFiles() if "_chunk=" in f}) <= 2
    assert len(written.page(1, 1000).collect()) == pages.MAX_PAGE


def test_pages_of_nothing(spark):
    empty = spark.createDataFrame([], "id long")
    assert pages.write_pages(empty, [F.col("id").asc()], "none").page(1, 5).collect() == []


def test_a_large_parent_comes_in_pages(spark):
    links = [("hot", i) for i in range(250)] + [("small", 3), ("small", 9)]
    arts = spark.createDataFrame([(i, f"t{i}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i * 37 % 100)) for i in range(300)],
                                 "id long, title string, published_date timestamp")
    got = pages.nested_articles(spark.createDataFrame(links, "cluster_id string, article_id long"), arts, "cluster_id", 20,
                                ("id", "title")).collect()
    when = {i: i * 37 % 100 for i in range(300)}
    for parent in ("hot", "small"):
        want = sorted((a for p, a in links if p == parent), key=lambda a: (-when[a], a))
        rows = sorted((r for r in got if r.cluster_id == parent), key=lambda r: r.page)
        assert [a.id for r in rows for a in r.articles] == want and {r.n_total for r in rows} == {len(want)}
        assert all(len(r.articles) <= 20 and r.articles[0].title == f"t{r.articles[0].id}" for r in rows)


# --- versioned tables --------------------------------------------------------

def upserted(spark, name="versions"):
    rows = [(f"n{i}", i) for i in range(40)]
    shape = spark.createDataFrame(rows, "name string, n long").schema
    table = versions.VersionedTable(spark, scratch_path(spark, name), shape, ["name"], buckets=8)

    def merge(old, new):
        return old.join(new.select("name"), "name", "left_anti").unionByName(new)

    assert table.change(spark.createDataFrame(rows, shape), merge) == 1
    return table, shape, merge


def test_a_run_rewrites_only_its_buckets(spark):
    table, shape, merge = upserted(spark)
    before = table.folders()[1]
    assert table.change(spark.createDataFrame([("n3", 100), ("new", 7)], shape), merge) == 2
    after = table.folders()[1]
    assert 1 <= sum(before.get(b) != f for b, f in after.items()) <= 2 < len(after)
    got = {r.name: r.n for r in table.read().collect()}
    assert got == {f"n{i}": i for i in range(40)} | {"n3": 100, "new": 7}
    again = table.change(spark.createDataFrame([("n3", 100), ("new", 7)], shape), merge)
    assert again == 3 and {r.name: r.n for r in table.read().collect()} == got
    assert table.change(spark.createDataFrame([], shape), merge) == 3


def test_a_failed_run_leaves_the_old_version(spark, monkeypatch):
    table, shape, merge = upserted(spark, "failing")

    def killed(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(table, "_publish", killed)
    change = spark.createDataFrame([("n1", -1)], shape)
    with pytest.raises(RuntimeError):
        table.change(change, merge)
    monkeypatch.undo()
    assert {r.name: r.n for r in table.read().collect()} == {f"n{i}": i for i in range(40)}
    assert table.change(change, merge) == 2
    assert {r.name: r.n for r in table.read().collect()} == {f"n{i}": i for i in range(40)} | {"n1": -1}


def test_first_of_a_key_is_by_order(spark):
    new = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("c", 9)], "k string, at int")
    got = store.insert_if_absent(spark.createDataFrame([("c",)], "k string"), new, ["k"], [F.col("at")]).collect()
    assert sorted((r.k, r["at"]) for r in got) == [("a", 1), ("b", 2)]


# --- the jobs' writes --------------------------------------------------------

def test_a_second_shift_run_creates_nothing(spark):
    a = adapters.articles(spark, SF_MID)
    empty = spark.createDataFrame([], rsp.CACHE_SCHEMA)
    first = shifts.shift_run(a, adapters.now_col(), rsp.stub_responder, empty, days=14)
    narratives, clusters = first["narratives"], first["clusters"]
    assert narratives.count() == clusters.count() == first["found"].count() > 3
    held = {r.cluster_id: r.n for r in first["cluster_article"].groupBy("cluster_id").agg(F.count("*").alias("n")).collect()}
    sizes = {r.label: r.n_articles for r in first["found"].collect()}
    assert sorted(held.values()) == sorted(sizes.values()) and sum(n > 5 for n in sizes.values()) == first["events"].count()
    mean = {r.label: r.centroid for r in clusters.collect()}
    label = next(iter(mean))
    rows = [r.embedding for r in a.where((F.col("label") == label) & F.col("embedding").isNotNull() & (
        F.col("published_date") >= adapters.now_col() - F.expr("interval 14 days"))).collect()]
    assert np.allclose(mean[label], np.mean(rows, axis=0))
    again = shifts.shift_run(a, adapters.now_col(), rsp.stub_responder, first["cache"], narratives, clusters, days=14)
    assert all(again[k].count() == 0 for k in ("narratives", "clusters", "cluster_article", "events"))
    # A name that exists without today's cluster gets the cluster only.
    half = shifts.shift_run(a, adapters.now_col(), rsp.stub_responder, first["cache"], narratives, None, days=14)
    assert half["narratives"].count() == 0 and half["clusters"].count() == clusters.count()
    assert shifts.shift_run(a, adapters.now_col(), rsp.stub_responder, empty, days=14, min_rows=10**6)["clusters"].count() == 0


def test_clusters_with_one_name_are_created_once(spark):
    a = adapters.articles(spark, SF_MID)
    same = lambda prompts: prompts.map(lambda _: "One Name")
    run = shifts.shift_run(a, adapters.now_col(), same, spark.createDataFrame([], rsp.CACHE_SCHEMA), days=14)
    found = run["found"].orderBy("label").collect()
    assert run["clusters"].count() == run["narratives"].count() == 1
    assert [r.cluster_created for r in found] == [True] + [False] * (len(found) - 1)


def test_statement_run_links(spark):
    t = catalog._statement_tables(spark, SF_MID)
    clusters = t["clusters"].collect()
    assert clusters and len({c.id for c in clusters}) == t["events"].count() == len(clusters)
    members = statements.confident_members(
        catalog._st.statements_table(spark, SF_MID), adapters.articles(spark, SF_MID, with_embedding=False),
        adapters.now_col(), catalog.STATEMENT_DAYS).collect()
    events = {r.narrative_id: r.id for r in t["events"].collect()}
    related = t["event_article"].collect()
    for c in clusters:
        own = [m for m in members if m.label == c.label]
        linked = {r.article_id for r in t["cluster_article"].collect() if r.cluster_id == c.id}
        said = {r.statement_id for r in t["cluster_statement"].collect() if r.cluster_id == c.id}
        assert linked == {m.article_id for m in own} and said == {m.id for m in own}
        assert sorted(r.article_id for r in related if r.event_id == events[c.narrative_id]) == sorted(linked)[:5]
        assert len(c.centroid) == vectors.HASH_DIM or max(abs(x) for x in c.centroid) <= 1


# --- windows and streams -----------------------------------------------------

def test_windows_of_any_length_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    base = dt.datetime(2024, 1, 1)
    micro = dt.timedelta(microseconds=1)
    starts = rng.integers(-10**12, 10**12, 300)
    spans = np.concatenate([2 ** rng.integers(0, 45, 280), np.zeros(10, np.int64), -np.ones(10, np.int64)])
    windows = [(i, base + int(s) * micro, base + int(s + n) * micro) for i, (s, n) in enumerate(zip(starts, spans, strict=True))]
    times = [base + int(t) * micro for t in rng.integers(-10**12, 10**12, 200)] + [windows[0][1], windows[1][2], windows[2][2] - micro, None]
    w = spark.createDataFrame(windows, "id long, start timestamp, end timestamp")
    e = spark.createDataFrame([(t,) for t in times], "ts timestamp")
    got = historical.covered(w, e)
    assert {r.id for r in got.collect()} == {i for i, s, t in windows if any(x is not None and s <= x < t for x in times)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert historical.covered(w.limit(0), e).count() == 0 and historical.covered(w, e.limit(0)).count() == 0


def feed_rows(lo, hi):
    return [(i, f"u{i % 700}", f"title {i}", "c", "d", "s", "2024-01-15") for i in range(lo, hi)]


def test_a_batch_reads_neither_the_sink_nor_the_articles(spark, tmp_path):
    """Restarts, known urls, repeated urls inside and across batches; the sink may even be out of reach."""
    known = spark.createDataFrame([(f"u{i}",) for i in range(50)], "url string")
    run = lambda: ingest.ingest_stream(spark, f"{tmp_path}/in", f"{tmp_path}/sink", f"{tmp_path}/ckpt", known)
    spark.createDataFrame(feed_rows(0, 500), ingest.FEED_SCHEMA).write.mode("append").json(f"{tmp_path}/in")
    assert sorted(r.url for r in run().collect()) == sorted(f"u{i}" for i in range(50, 500))
    os.rename(f"{tmp_path}/sink", f"{tmp_path}/away")  # what a batch needs of the past is state
    spark.createDataFrame(feed_rows(400, 1300), ingest.FEED_SCHEMA).write.mode("append").json(f"{tmp_path}/in")
    got = {r.url: r.seq for r in run().collect()}
    assert got == {f"u{i}": i for i in range(500, 700)}
    assert run().count() == 200


def test_a_batch_run_again_replaces_its_rows(spark, tmp_path):
    spark.createDataFrame(feed_rows(0, 40), ingest.FEED_SCHEMA).write.json(f"{tmp_path}/in")
    sink = f"{tmp_path}/sink"
    first = ingest.ingest_stream(spark, f"{tmp_path}/in", sink, f"{tmp_path}/ckpt").count()
    again = ingest.ingest_stream(spark, f"{tmp_path}/in", sink, f"{tmp_path}/other").count()  # batch 0 anew
    assert first == again == 40


def test_registered_lists_are_not_empty(spark):
    timeline = catalog.q_timeline_nested(spark, SF_MID).collect()
    assert any(r.n_related > 0 and r.article_ids for r in timeline) and any(r.n_related == 0 for r in timeline)
    nested = catalog.q_clusters_nested(spark, SF_MID).collect()
    assert max(r.page for r in nested) > 1 and all(len(r.article_ids.split(",")) <= 20 for r in nested)
    shift = catalog.q_shift_store(spark, SF_MID).collect()
    assert {r.narrative_created for r in shift} == {True, False} == {r.cluster_created for r in shift}


def test_texts_are_read_whole_by_the_hasher(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    df = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, "a"), (5, "ab ab")], "id long, content string")
    got = {r.id: {e.slot: e.value for e in r.vec} for r in vectors.hash_packed(df).collect()}
    assert got[2] == got[3] == got[4] == {} and len(got[5]) == 1 and len(got[1]) == vectors.HASH_DIM
    assert abs(sum(v * v for v in got[1].values()) - 1) < 1e-9


def test_small_store_still_lists(spark):
    assert catalog.q_articles_page(spark, SF_SMALL).count() == 20
