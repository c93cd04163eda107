"""Embedding near-duplicates and nearest neighbours against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from storyloom.llm import ann, components, embed_dedup


def brute_links(rows, threshold=0.9):
    ok = [(k, np.asarray(v, float)) for k, (_, v) in enumerate(rows)
          if v is not None and None not in v and np.isfinite(v).all() and np.any(np.asarray(v) != 0)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, x) in enumerate(ok):
        for b, y in ok[:i]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a] += 1
                links[b] += 1
                root[max(top(a), top(b))] = min(top(a), top(b))
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[top(k)] = min(ids.get(top(k), i), i)
    return sorted((str(i), links[k], str(ids.get(top(k)))) for k, (i, _) in enumerate(rows))


def vectors(rng, n, d=16):
    base = rng.normal(size=(n, d))
    x = base[rng.integers(0, n // 6, n)] + rng.normal(size=(n, d)) * rng.choice([0, 0.05, 0.35, 2.0], (n, 1))
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(rng.permutation(n), x.astype(np.float32), strict=True)]
    return rows + [(n, None), (n + 1, [0.0] * d), (n + 2, [None] + [1.0] * (d - 1)), (n + 3, [float("nan")] * d), (n + 4, [float("inf")] * d),
                   (n + 5, [1.0, 0.0]), (n + 6, [2.0, 0.1]), (n + 7, []), rows[0], (None, rows[1][1])]


SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("options", [{}, {"block": 16, "tile": 8, "n_pivots": 12}])
def test_links_match_brute_force(spark, options):
    rows = vectors(np.random.default_rng(3), 180)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("clash")).withColumn("copies", F.lit(2))
    got = embed_dedup.near_duplicates(df, **options).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute_links(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_bounds_decide_near_the_threshold():
    rng = np.random.default_rng(4)
    x = embed_dedup.unit(list(rng.normal(size=(60, 8))))
    y = embed_dedup.unit([0.9 * a + np.sqrt(1 - 0.81) * (b - (b @ a) * a) / np.linalg.norm(b - (b @ a) * a) + e
                          for a, b, e in zip(x, rng.normal(size=(60, 8)), rng.normal(size=(60, 1)) * 1e-6, strict=True)])
    got = {(int(i), int(j)) for r, c in embed_dedup.links_between(x, y, 0.9, 16) for i, j in zip(r, c, strict=True)}
    exact = np.einsum("id,jd->ij", x, y) >= 0.9
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(exact), strict=True)}


def test_no_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert embed_dedup.near_duplicates(empty).count() == 0
    assert ann.nearest(empty, F.col("vec_id") % 50 == 0).count() == 0
    nulls = spark.createDataFrame([(1, None), (1, None)], SCHEMA)
    assert [tuple(r) for r in embed_dedup.near_duplicates(nulls).collect()] == [(1, 0, 1, True)] * 2
    assert ann.nearest(nulls, F.col("vec_id") % 50 == 0).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(7, 7), (None, 3), (300, 299), (299, 300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)} | {299: 299, 300: 299}


def brute_nearest(rows, k=5):
    ok = [(i, np.asarray(v, float)) for i, v in rows
          if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.asarray(v) != 0)]
    out = {}
    for q, x in ok:
        if q % 50 == 0:
            scores = {}
            for i, y in ok:
                if i != q and len(x) == len(y):
                    s = x @ y / np.linalg.norm(x) / np.linalg.norm(y)
                    scores[i] = max(scores.get(i, -2), s)
            out[q] = sorted(scores.items(), key=lambda p: (-round(p[1], 12), p[0]))[:k]
    return out


@pytest.mark.parametrize("options", [{"probes": 64}, {"probes": 64, "block": 10}, {"hashes": 2, "probes": 1024}, {"tables": 1, "probes": 1}])
def test_probing_everything_is_exact_and_few_are_filled_up(spark, options):
    rows = [r for r in vectors(np.random.default_rng(5), 220)[:-2]]
    want = brute_nearest(rows)
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, **options).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert got.keys() == {q for q, x in want.items() if x}
    for q, ranked in got.items():
        assert sorted(ranked) == list(range(1, len(want[q]) + 1))
        if options.get("probes", 0) > 1:
            for n, (i, s) in enumerate(want[q], 1):
                assert ranked[n][0] == i and abs(ranked[n][1] - s) < 1e-12


@pytest.mark.parametrize("copies", [2, 9])
def test_one_block_lists_the_nearest_ids(copies):
    rng = np.random.default_rng(copies)
    rows = [(i, [float(v) for v in rng.normal(size=4)]) for _ in range(copies) for i in range(1, 12)] + [(0, [1.0, 0.0, 0.0, 0.0])]
    rows += rows[:20]
    got = ann.best_of(pd.DataFrame(rows, columns=["vec_id", "embedding"]), pd.DataFrame(rows[-21:-20], columns=["query_id", "embedding"]), 5)
    assert got["vec_id"].tolist() == [i for i, _ in brute_nearest(rows)[0]]


@pytest.mark.parametrize("options", [{"probes": 64}, {"probes": 64, "block": 10}, {"tables": 1, "probes": 1}])
def test_repeated_ids_take_one_place(spark, options):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(v) for v in rng.normal(size=16).astype(np.float32)]) for i in range(120)]
    rows += [r for r in rows for _ in range(1 if r[0] % 3 else 7)]  # ids twice and eight times
    rows += [(i, [float(np.float32(v + 0.001 * j)) for v in x]) for i, x in rows[:120] if i % 50 and i % 4 == 0 for j in range(1, 7)]
    want = brute_nearest(rows)
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, **options).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert got.keys() == want.keys()
    for q, ranked in got.items():
        assert sorted(ranked) == [1, 2, 3, 4, 5] and len({i for i, _ in ranked.values()}) == 5
        if options["probes"] > 1:
            assert all(ranked[n][0] == i and abs(ranked[n][1] - s) < 1e-12 for n, (i, s) in enumerate(want[q], 1))


def test_recall_on_the_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute_nearest([(r.vec_id, r.embedding) for r in df.collect()])
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & {i for i, _ in near}) for q, near in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_less_of_a_larger_table_is_compared(spark):
    """Vectors without structure: recall stays, the share of rows that a query is compared with falls."""
    rng, shares = np.random.default_rng(8), []
    for n in (2000, 16000):
        x = rng.normal(size=(n, 64)).astype(np.float32)
        df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x)}), SCHEMA)
        got = ann.nearest(df, F.col("vec_id") % (n // 40) == 0).toPandas()
        u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        hits = 0
        for q, rows in got.groupby("query_id"):
            score = u @ u[q]
            score[q] = -2
            hits += len(set(np.argsort(-score)[:5]) & set(rows["vec_id"]))
            assert sorted(rows["rank"]) == [1, 2, 3, 4, 5] and rows["compared"].nunique() == 1
        assert hits >= 0.9 * 5 * got["query_id"].nunique()
        shares.append(got["compared"].mean() / n)
    assert shares[0] < 0.35 and shares[1] < 0.2 and shares[1] < 0.7 * shares[0]


@pytest.mark.parametrize("n,d", [(10, 3), (50_000, 64), (500_000, 64), (10**9, 64), (10**7, 768)])
def test_buckets_and_probes_follow_from_the_rows(n, d):
    hashes, probes = ann.shape(n, d)
    buckets = (2 << max(0, (d - 1).bit_length())) ** hashes
    assert buckets * ann.BUCKET >= n and 1 <= probes <= buckets
    more = ann.shape(8 * n, d)
    assert more[1] / (2 << max(0, (d - 1).bit_length())) ** more[0] <= probes / buckets


def test_candidates_are_the_rows_of_the_probed_buckets():
    rng = np.random.default_rng(2)
    buckets = rng.integers(0, 20, (300, 4))
    probes = [np.stack([rng.permutation(20)[:3] for _ in range(9)]) for _ in range(4)]
    who, row = ann.candidates(buckets, probes)
    want = {(i, r) for i in range(9) for r in range(300) if any(buckets[r, t] in probes[t][i] for t in range(4))}
    assert set(zip(who.tolist(), row.tolist(), strict=True)) == want and len(who) == len(want)


@pytest.mark.parametrize("probes", [1, 5, 30, 64])
def test_probes_are_the_best_buckets(probes):
    rng = np.random.default_rng(9)
    axes = [rng.normal(size=(20, 8)) for _ in range(2)]
    got = ann.probed(axes, probes)
    whole = (axes[0][:, :, None] + axes[1][:, None, :]).reshape(20, -1)
    want = np.argsort(-whole, axis=1)[:, :probes]
    assert (got == want).all()
