"""Mutation guards (survey §5.5): changing one input row must change the result."""

from pyspark.sql import functions as F

from storyloom.functions.vectors import dense_to_sparse
from storyloom.operators import quality, summarize as sm
from storyloom.sources import feed as fd


def test_diversity_reacts_to_one_source(spark):
    base = [(0, s) for s in ["a", "a", "b", "c"]]
    mutated = [(0, s) for s in ["a", "d", "b", "c"]]
    f = lambda rows: quality.source_diversity(
        spark.createDataFrame(rows, "cluster int, source string"), ["cluster"]).collect()[0].diversity
    assert f(base) != f(mutated)


def test_coherence_reacts_to_one_vector(spark):
    rows = [(i, 0, [1.0, float(i), 0.5]) for i in range(5)]
    mutated = rows[:-1] + [(4, 0, [-1.0, 0.0, 3.0])]
    f = lambda r: quality.coherence(
        spark.createDataFrame(r, "id long, cluster int, embedding array<double>").select("cluster", "id"),
        dense_to_sparse(spark.createDataFrame(r, "id long, cluster int, embedding array<double>")),
        ["cluster"]).collect()[0].coherence
    assert f(rows) != f(mutated)


def test_key_terms_react_to_one_text(spark):
    rows = [(1, 0, "river bank river bank flood"), (1, 1, "flood warning issued")]
    mutated = [(1, 0, "river bank river bank flood"), (1, 1, "storm storm storm storm storm")]
    f = lambda r: [x.term for x in sorted(sm.key_terms(
        spark.createDataFrame(r, "gid long, doc_order int, text string"), ["gid"], 3).collect(),
        key=lambda x: x.rank)]
    assert f(rows) != f(mutated)


def test_insert_if_absent_reacts_to_existing_row(spark):
    items = spark.createDataFrame([(1, "u1", "t"), (2, "u2", "t")], "seq long, url string, title string")
    none = spark.createDataFrame([], "url string")
    one = spark.createDataFrame([("u2",)], "url string")
    assert fd.insert_if_absent(items, none).count() != fd.insert_if_absent(items, one).count()
