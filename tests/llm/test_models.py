"""The quality classifier on held-out labels, the language models against plain counting, and the pipeline."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from storyloom.llm import hashing, lm_score, mixing, quality

import corpus_pipeline
from tests.llm.test_text_dedup import brute_classes, brute_lines

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    test = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)) == 0
    scored, name = quality.score(docs, quality.train(docs, labels.filter(~test)))
    got = scored.join(labels.filter(test), "doc_id").select((F.col(name) >= 0.5).alias("kept"), "quality").collect()
    assert len(got) > 150 and sum(r.kept == (r.quality == 1) for r in got) >= 0.96 * len(got)


def test_odd_rows_are_scored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 300")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (5001, "", "en", "src1", 0), (5002, "x ### " * 40_000, "en", None, None),
                                 (5003, "word", None, "src1", -4), (5003, "word", None, "src1", -4)], docs.schema)
    both = docs.union(odd).selectExpr("*", "1 AS score", "2 AS y", "'w' AS w", "3 AS text_view")
    extra = labels.select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (5001, None), (3, 0), (3, 1)], "doc_id long, quality int"))
    scored, name = quality.score(both, quality.train(both, extra))
    assert name == "score_" and scored.columns == [*both.columns, name]
    assert scored.count() == both.count() and scored.filter(F.col(name).isNull() | F.isnan(name)).count() == 0
    one = labels.filter("quality = 1").select("doc_id", "quality")
    assert quality.train(docs, one) is None and quality.good_documents(docs, one).count() == docs.count()
    none = spark.createDataFrame([], docs.schema)
    assert quality.good_documents(none, labels).count() == 0


def test_cuts(spark):
    held = spark.createDataFrame([(float(i >= 50 or i == 10), i / 10 - 5) for i in range(100)], "y double, odds double")
    low, high = quality.cuts(held, 0.97, 20)
    assert abs(low) < 0.15 and abs(high) < 0.15  # to a bin of 0.1; 50 of 51 are right from -0.1 on
    assert quality.cuts(held.filter("odds < -4"), 0.97, 20) == (-np.inf, np.inf)


def plain_scores(rows, good, slots, mu):
    def slot_rows():
        for i, t in rows:
            for _, _, data, offsets in hashing.text_pieces(pa.array([t])):
                word, pair, starts = lm_score.ngrams(data, offsets, slots)
                yield i, list(zip(word.tolist(), pair.tolist(), [slots, *word.tolist()][:len(word)], strict=True))

    data = list(slot_rows())
    models = []
    for some in (lambda i: True, lambda i: i in good):
        c = [Counter(x[k] for i, ws in data if some(i) for x in ws) for k in range(3)]
        models.append((c, sum(c[0].values())))
    out = []
    for i, ws in data:
        loss = []
        for c, n in models:
            total = sum(-math.log((c[1][p] + mu * (c[0][w] + 1) / (n + slots)) / (c[2][v] + mu)) for w, p, v in ws)
            loss.append(total / len(ws) if ws else None)
        out.append((str(i), len(ws), *loss))
    return sorted(out, key=str)


def test_scores_match_plain_counting(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(900, None), (901, " \n"), (None, "the end"), (902, "a b " * 50_000), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS good", "2 AS score", "3 AS _good")
    good = set(range(0, 120, 2))
    got = lm_score.score(df, spark.createDataFrame([(i,) for i in [*good, 4, 4]], "doc_id long"), slots=10_007, mu=5.0).collect()
    want = plain_scores(rows, good, 10_007, 5.0)
    for g, w in zip(sorted(((str(r.doc_id), r.n_words, r.background_loss, r.target_loss) for r in got), key=str), want, strict=True):
        assert g[:2] == w[:2] and (g[2:] == w[2:] or np.allclose(g[2:], w[2:], atol=1e-4)), (g, w)
    empty = lm_score.score(df.limit(0), df.limit(0), slots=100)
    assert empty.count() == 0
    assert lm_score.score(df, df.limit(0), slots=100).filter("n_words > 0 AND score IS NULL").count() == 0


def test_every_word_and_pair_is_counted_as_itself(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 3000) % 10**9)) for i in range(300)]
    rows += [(None, "w1 w2"), (7, "w1 w1"), (7, "w1 w1"), (400, None), (401, " ")]
    good = set(range(0, 300, 3)) | {7}
    texts = [(i, (t or "").split()) for i, t in rows]
    models = []
    for some in (texts, [x for x in texts if x[0] in good]):
        single, pair, context = Counter(), Counter(), Counter()
        for _, ws in some:
            single.update(ws)
            pair.update(zip([None, *ws], ws, strict=False))
            context.update([None, *ws][:len(ws)])
        models.append((single, pair, context, single.total()))
    types = len(models[0][0])
    assert len(models[0][1]) > 1 << 17 and types > 1 << 15
    want = []
    for i, ws in texts:
        loss = [sum(-math.log((p[v, w] + 20.0 * (s[w] + 1) / (n + types)) / (c[v] + 20.0)) for v, w in zip([None, *ws], ws, strict=False)) / len(ws)
                if ws else None for s, p, c, n in models]
        want.append((str(i), len(ws), *loss))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm_score.score(df, spark.createDataFrame([(i,) for i in good], "doc_id long")).collect()
    got = sorted(((str(r.doc_id), r.n_words, r.background_loss, r.target_loss) for r in got), key=str)
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[:2] == w[:2] and (g[2:] == w[2:] or np.allclose(g[2:], w[2:], atol=1e-9)), (g, w)


def test_words_and_labels_of_hashing():
    texts = ["a  bb\ta\n", "", "é é x", " ", "bb"]
    (_, _, data, offsets), = hashing.text_pieces(pa.array([*texts, None]))
    word, starts = hashing.words(data, offsets)
    assert np.diff(starts).tolist() == [3, 0, 3, 0, 1, 0]
    assert word[0] == word[2] != word[1] == word[6] and word[3] == word[4] != word[5]
    kmers, first = hashing.shingles(word, starts, 5)
    assert np.diff(first).tolist() == [1, 0, 1, 0, 1, 0]
    many, starts = hashing.shingles(np.tile(word[:2], 10), np.array([0, 8, 20]), 5)
    assert len(set(many.tolist())) == 2 and len(set(hashing.labelled(many, starts)[:4].tolist())) == 4
    long = ["x" * (hashing.PIECE + 5) + " y", "x"]
    assert [np.diff(hashing.words(d, o)[1]).tolist() for _, _, d, o in hashing.text_pieces(pa.array(long))] == [[2], [1]]


@pytest.fixture(scope="module")
def stages(spark):
    """The result of every stage over a small table, each from the one before."""
    docs, out = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append((docs, stage(spark, docs, "/root/testdata/sf0.001").cache()))
        docs = out[-1][1]
    return out


def test_stages_keep_what_they_should(spark, stages):
    (docs, good), (_, lines), (_, single), (_, mixed), (_, packed) = stages
    assert all(x.columns == docs.columns for x in (good, lines, single, mixed))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    assert good.join(labels, "doc_id").filter("quality = 0").count() <= 1
    assert good.join(labels, "doc_id").filter("quality = 1").count() >= labels.filter("quality = 1").count() - 1

    rows = [(r.doc_id, r.text) for r in good.collect()]
    want = {}
    for (i, t), gone in brute_lines(rows).items():
        text = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        if not gone or text.strip():
            want[i] = text
    assert {r.doc_id: r.text for r in lines.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    classes = {c for _, c in brute_classes([(r.doc_id, r.text) for r in lines.collect()])}
    assert {str(r.doc_id) for r in single.collect()} == classes

    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in single.collect()}
    size = mixing.word_count()
    assert packed.agg(F.sum("length")).first()[0] == mixed.agg(F.sum(size)).first()[0]


def test_run_is_the_stages(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect())) == sorted(map(str, stages[-1][1].collect()))
