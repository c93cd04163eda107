"""TextRank over groups of any size, and the Ukrainian patterns on rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom import catalog
from storyloom.functions import text as tx
from storyloom.operators import pairs, quality
from storyloom.operators import summarize as sm
from storyloom.plans import weekly
from tests.conftest import SF_MID, SF_SMALL


@pytest.fixture(scope="module")
def sentences(spark):
    docs = catalog._doc_texts(spark, SF_SMALL).where("gid < 30")
    joined = docs.select((F.col("gid") % 4).alias("gid"), F.col("gid").alias("doc_order"), "text")
    return sm.sentence_table(joined, ["gid"])


def test_large_groups_equal_the_kernel(spark, sentences):
    by_task = sm.textrank(sentences, ["gid"], 5).collect()
    by_joins = sm.textrank(sentences, ["gid"], 5, large=0).collect()
    key = lambda r: (r.gid, r["rank"])
    assert len(by_task) == 20
    for a, b in zip(sorted(by_task, key=key), sorted(by_joins, key=key), strict=True):
        assert (a.gid, a["rank"], a.sent_pos, a.sentence) == (b.gid, b["rank"], b.sent_pos, b.sentence) and abs(a.score - b.score) < 1e-9


def test_large_pagerank_equals_dense_iteration(spark):
    rng = np.random.default_rng(3)
    n, terms = 400, 60
    t = np.where(rng.random((n, terms)) < 0.05, rng.random((n, terms)), 0.0)
    t[::40] = 0  # sentences without terms
    rows = [("g", int(i), f"t{j}", float(t[i, j])) for i, j in zip(*np.nonzero(t), strict=True)]
    rows += [("h", i, "same", 1.0) for i in range(3)]
    matrix = spark.createDataFrame(rows, "gid string, sent_pos int, term string, weight double")
    sents = spark.createDataFrame([("g", i, n) for i in range(n)] + [("h", i, 4) for i in range(4)], "gid string, sent_pos int, _n int")
    got = {(r.gid, r.sent_pos): r.score for r in sm.large_pagerank(matrix, sents, ["gid"]).collect()}
    w = t @ t.T
    out = w.sum(axis=1)
    x = np.full(n, 1 / n)
    for _ in range(100):
        last = x
        y = np.divide(last, out, out=np.zeros(n), where=out > 0)
        x = 0.85 * (w @ y + last[out <= 0].sum() / n) + 0.15 / n
        if np.abs(x - last).sum() < n * 1e-6:
            break
    assert len(got) == n + 4 and all(abs(got["g", i] - x[i]) < 1e-12 for i in range(n))
    assert len({round(got["h", i], 12) for i in range(3)}) == 1 and got["h", 3] < got["h", 0]


def test_groups_that_do_not_converge_are_left_out(spark, sentences):
    w = sm.sentence_tfidf(sentences, ["gid"])
    sized = sentences.withColumn("_n", F.count("*").over(sm.Window.partitionBy("gid")))
    assert sm.large_pagerank(w, sized, ["gid"], rounds=1).count() == 0


def test_ukrainian_rows_have_keywords_and_entities(spark):
    words = catalog.q_keywords_uk_texts(spark, SF_MID).collect()
    assert words and all(re.fullmatch("[а-яіїєґ]{3,}", r.word) for r in words)
    rows = catalog.q_entities_by_language(spark, SF_MID)
    assert {r.lang for r in rows.where("entity_type = 'PERSON'").select("lang").distinct().collect()} >= {"uk"}
    text = catalog._ukrainian_texts(spark, SF_MID).where("gid = 1").select(
        F.array_join(F.transform(F.split("text", " "), lambda w: F.initcap(w)), " ").alias("text")).first().text
    want = sorted(set(re.findall(tx.UK_PATTERNS["PERSON"].replace("(?U)", ""), text)))
    got = rows.where("id = 1 AND entity_type = 'PERSON'").first()
    assert got.n_values == len(want)


def test_tiles_receive_a_fixed_number_of_copies(spark, monkeypatch):
    """Copies of a cluster's vectors, and pairs with their rows, whatever the number of blocks; no vector travels with a pair."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 12))[rng.integers(0, 30, 240)] + rng.normal(size=(240, 12)) * 0.15
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[200:] = x[:40]  # classes of two rows
    df = spark.createDataFrame([("g", i, [(j, float(v)) for j, v in enumerate(r)]) for i, r in enumerate(x)],
                               "c string, id long, vec array<struct<slot:int,value:double>>")
    sent = []
    spread = pairs._spread
    monkeypatch.setattr(pairs, "_spread", lambda rep, keys: sent.append(rep) or spread(rep, keys))
    cosine = x @ x.T
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(cosine > 0.9, 1)), strict=True)}
    for largest in (32_768, 25):
        monkeypatch.setattr(pairs, "LARGEST_BLOCK", largest)
        got = pairs.similar_pairs(df.select("c", "id"), df, ["c"], 0.9, 4).collect()
        assert {(r.id_a, r.id_b) for r in got} == want and len(got) == len(want) > 100
        assert all(abs(r.cosine - cosine[r.id_a, r.id_b]) < 1e-12 for r in got)
        assert pairs.near_dup_counts(df.select("c", "id"), df, ["c"], 0.9, 4).first().n_dup == len(want)
        blocks = pairs.BLOCKS if largest > 240 else 8
        assert [r.count() for r in sent] == [200 * blocks] * 2
        sent.clear()


def test_key_terms_are_counted_inside_their_group(spark):
    rows = [(1, 0, "beta alpha beta. Alpha beta gamma"), (1, 1, "gamma beta"), (2, 0, None), (3, 0, ""), (None, 0, "omega")]
    got = sm.key_terms(spark.createDataFrame(rows, "gid int, doc_order int, text string"), ["gid"], 4)
    assert sorted((r.gid or 0, r["rank"], r.term, r.cnt) for r in got.collect()) == [
        (0, 1, "omega", 1), (1, 1, "beta", 4), (1, 2, "alpha", 2), (1, 3, "alpha beta", 2), (1, 4, "beta alpha", 2)]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()  # n-grams are no rows to be ranked


def test_tfidf_of_packed_groups_equals_the_plan_over_rows(spark, sentences):
    odd = spark.createDataFrame([(90, 0, "\u0431\u0435\u0437 one one two"), (90, 1, "... !"), (90, 2, "two three"), (91, 0, "??"), (None, 0, "null key")], "gid long, sent_pos int, sentence string")
    rows = sentences.unionByName(odd)
    packed, by_rows = sm.sentence_tfidf(rows, ["gid"]), sm.sentence_tfidf(rows.where("gid IS NOT NULL"), ["gid"], large=0)
    assert packed.columns == by_rows.columns and "Window" not in packed.where("gid >= 90")._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    got, want = ({(r.gid, r.sent_pos, r.term): r.weight for r in x.collect()} for x in (packed, by_rows))
    assert {k[2] for k in got if k[0] is None} == {"null", "key"}
    got = {k: v for k, v in got.items() if k[0] is not None}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_an_id_with_two_vectors_stands_for_both(spark):
    rows = [(1, [(0, 1.0)]), (1, [(0, 0.99), (1, 0.1410673598)]), (2, [(0, 1.0), (1, 1e-9)]), (3, [(2, 1.0)])]
    df = spark.createDataFrame([("g", *r) for r in rows], "c string, id long, vec array<struct<slot:int,value:double>>")
    classes, _ = pairs.vector_classes(df.select("c", "id"), df, ["c"])
    got = sorted((r.cls_a, r.cls_b, round(r.cosine, 4)) for r in pairs.similar_classes(classes, ["c"]).collect())
    # (1, 1) is open once and stands for 2 x 2 rows, (1, 2) twice for 2 x 1.
    assert got == sorted([(1, 1, 1.0)] * 2 + [(1, 1, 0.99)] * 2 + [(1, 2, 1.0)] * 2 + [(1, 2, 0.99)] * 2)


def test_an_id_with_two_vectors_and_no_other_similar_one(spark):
    rows = [(1, [(0, 1.0)]), (1, [(0, 0.99), (1, 0.1410673598)]), (2, [(3, 1.0)]), (3, [(2, 1.0)])]
    df = spark.createDataFrame([("g", *r) for r in rows], "c string, id long, vec array<struct<slot:int,value:double>>")
    classes, _ = pairs.vector_classes(df.select("c", "id"), df, ["c"])
    got = sorted((r.cls_a, r.cls_b, round(r.cosine, 4)) for r in pairs.similar_classes(classes, ["c"]).collect())
    assert got == sorted([(1, 1, 1.0)] * 2 + [(1, 1, 0.99)] * 2)


def test_only_vectors_with_an_open_pair_go_to_tiles(spark, monkeypatch):
    """Codes find the classes with an open pair; the other vectors stay, and blocks of vectors are bounded by themselves."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(160, 200))
    x[150:] = x[:10] + rng.normal(size=(10, 200)) * 0.05
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(w, i, [(j, float(v)) for j, v in enumerate(r)]) for w in ("g", "h") for i, r in enumerate(x)],
                               "c string, id long, vec array<struct<slot:int,value:double>>")
    written = {}
    write = pairs.materialize
    monkeypatch.setattr(pairs, "materialize", lambda rows, name: written.setdefault(name, write(rows, name)))
    monkeypatch.setattr(pairs, "CELLS", 300)
    for largest, vectors in [(131_072, 32_768), (60, 10)]:
        monkeypatch.setattr(pairs, "LARGEST_BLOCK", largest)
        monkeypatch.setattr(pairs, "LARGEST_VECTORS", vectors)
        written.clear()
        got = pairs.similar_pairs(df.select("c", "id"), df, ["c"], 0.95, 40).collect()
        assert sorted((r.c, r.id_a, r.id_b) for r in got) == [(w, i, i + 150) for w in ("g", "h") for i in range(10)]
        sent = written["open-classes"].collect()
        assert {(r.c, r.cls) for r in sent} == {(w, i) for w in ("g", "h") for i in [*range(10), *range(150, 160)]}
        assert len(sent) == 40 and all(r._blk in (r._lo, r._hi) for r in sent)
        written.clear()
        assert [r.n_dup for r in pairs.near_dup_counts(df.select("c", "id"), df, ["c"], 0.95, 40).collect()] == [10, 10]


def test_no_vector_is_shuffled_by_its_cluster(spark, monkeypatch):
    """A shuffle by cluster puts all vectors of a large one in one task, which sorts and spills them."""
    days = [f"2024-01-0{d}" for d in (1, 2, 3)]
    rows = [(w, "en", i, f"s{i % 4}", days[i % 3], [(0, 0.8), (1 + i, 0.6)]) for w in (0, 1) for i in range(12)]
    df = spark.createDataFrame(rows, "week int, label string, id long, source string, day string, vec array<struct<slot:int,value:double>>")
    m = df.select("week", "label", "id", "source", F.to_timestamp("day").alias("published_date"))
    plan = lambda d: d._jdf.queryExecution().sparkPlan().toString()
    scores = quality.medoid_scores(m, df.select("week", "label", "id", "vec"), weekly.KEYS)
    assert "BroadcastHashJoin [week" in plan(scores) and all(abs(r.score - (0.64 * 12 + 0.36)) < 1e-9 for r in scores.collect())
    assert {(r.week, r.id) for r in quality.medoids(m, df.select("week", "label", "id", "vec"), weekly.KEYS).collect()} == {
        (w, i) for w in (0, 1) for i in range(3)}
    given = []
    monkeypatch.setattr(weekly, "near_dup_rate", lambda members, vectors, *a, **k: given.append(vectors) or pairs.near_dup_rate(members, vectors, *a, **k))
    scored = weekly.score_clusters(m, df.select("week", "label", "id", "vec"), threshold=0.5).collect()
    assert [(r.accepted, r.near_dup_rate) for r in scored] == [(True, 0.0)] * 2
    assert "BroadcastHashJoin" in plan(given[0]) and "SortMergeJoin" not in plan(given[0])


def test_vectors_are_grouped_flat(spark, monkeypatch):
    """Sorting entry structs of a whole split by class would spill; slots and values take a third of that."""
    df = spark.createDataFrame([("g", i, [(0, 1.0 + i // 2), (3, 2.0)]) for i in range(4)], "c string, id long, vec array<struct<slot:int,value:double>>")
    grouped = []
    write = pairs.materialize
    monkeypatch.setattr(pairs, "materialize", lambda df, name: grouped.append(df) or write(df, name))
    classes, _ = pairs.vector_classes(df.select("c", "id"), df, ["c"])
    rows = grouped[0]._jdf.queryExecution().optimizedPlan().children().head().schema()
    assert "array<struct" not in rows.simpleString() and "slot:array<int>" in rows.simpleString()
    assert sorted((r.cls, r.n, r.vec.slot, r.vec.value) for r in classes.collect()) == [(0, 2, [0, 3], [1.0, 2.0]), (2, 2, [0, 3], [2.0, 2.0])]
