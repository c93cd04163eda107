"""Quality classifier by co-training of two views.

One logistic model sees the text (character classes, word shapes, hashed byte
trigrams), the other the page's metadata (language, source, stated length).
Both start from the labelled documents.  In each round a view labels the
documents it is sure of, among all that have no label, and the other view is
refitted on the labels and those pseudo-labels.  How sure is sure enough is
measured: on labelled documents held out by id hash, a view's cut for a class is
the lowest at which it is right in ``precision`` of the cases; a view that
reaches it nowhere passes nothing on.  At last the views' log-odds are
calibrated and combined by a logistic model on the held-out documents, so that a
view without information gets no weight, and every document is scored.

Fitting is distributed (MLlib) over a written table of features, with no sample
bound; the driver holds two weight vectors and histograms of fixed size.  The
final pass scores whole texts in the scan stage, so no text is shuffled.

Defined cases: null and empty texts have zero features and a score like any
other; null metadata hashes as a value of its own; a document with several
labels takes their mean, ties count as good; null labels are no labels; without
labels of both classes nothing can be learnt, scores are null and all documents
are kept; repeated rows count and score each; an empty table gives no row; extra
columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import fresh
from .hashing import U64, mix, text_pieces, words

CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "shout", "bar", "symbol", "punctuation", "other")
TRIGRAMS = 64
SOURCES, LANGS = 32, 8


def _classes() -> np.ndarray:
    of = np.full(256, CLASSES.index("other"), np.int64)
    for c in range(33, 127):
        of[c] = CLASSES.index("punctuation")
    for name, chars in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"),
                        ("space", " \t\r"), ("newline", "\n"), ("stop", ".,;:"), ("shout", "!"), ("bar", "|"), ("symbol", "#$%&*@^~=<>\\")):
        of[[ord(c) for c in chars]] = CLASSES.index(name)
    return of


CLASS_OF = _classes()
N_TEXT = len(CLASSES) + TRIGRAMS + 6
N_META = SOURCES + LANGS + 1


def text_features(column: pa.Array) -> np.ndarray:
    """Rows by ``N_TEXT`` numbers."""
    out = np.zeros((len(column), N_TEXT))
    for first, end, data, offsets in text_pieces(column):
        n, sizes = end - first, np.diff(offsets)
        row = np.repeat(np.arange(n), sizes)
        kinds = CLASS_OF[data]
        share = np.maximum(sizes, 1)[:, None]
        shares = np.bincount(row * len(CLASSES) + kinds, minlength=n * len(CLASSES)).reshape(n, -1) / share
        if len(data) > 2:
            x = data.astype(np.uint32)
            h = ((x[:-2] * 0x9E3779B1 + x[1:-1] * 0x85EBCA6B + x[2:] * 0xC2B2AE35) * np.uint32(0x27D4EB2F)) >> 26
            whole = row[:-2] == row[2:]
            grams = np.bincount(row[2:][whole] * TRIGRAMS + h[whole], minlength=n * TRIGRAMS).reshape(n, -1) / share
        else:
            grams = np.zeros((n, TRIGRAMS))
        word, starts = words(data, offsets)
        count = np.diff(starts)
        per = np.maximum(count, 1)
        of = np.repeat(np.arange(n), count)
        solid = (kinds != CLASSES.index("space")) & (kinds != CLASSES.index("newline"))
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        marked = np.bincount(row[last & (kinds == CLASSES.index("symbol"))], minlength=n) / per
        shouted = np.bincount(row[last & (kinds == CLASSES.index("shout"))], minlength=n) / per
        order = np.argsort(word ^ mix(of.astype(U64)), kind="stable")
        keyed = (word ^ mix(of.astype(U64)))[order]
        new = np.ones(len(keyed), bool)
        new[1:] = keyed[1:] != keyed[:-1]
        distinct = np.bincount(of[order[new]], minlength=n) / per
        out[first:end] = np.column_stack([shares, np.sqrt(grams), np.log1p(sizes), np.log1p(count), np.minimum(sizes / per, 50.0) / 10,
                                          marked, shouted, distinct])
    return out


def meta_features(batch: pa.RecordBatch) -> np.ndarray:
    """Rows by ``N_META`` numbers."""
    out = np.zeros((batch.num_rows, N_META))
    at = np.arange(batch.num_rows)
    for name, size, lead in (("source", SOURCES, 0), ("lang", LANGS, SOURCES)):
        cells = [crc32(("" if v is None else f"={v}").encode()) % size + lead for v in batch.column(name).to_pylist()]
        out[at, np.array(cells, np.int64)] = 1.0
    chars = pc.fill_null(batch.column("n_chars").cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    out[:, -1] = np.log1p(np.maximum(chars, 0.0))
    return out


def featurise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        views = [pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32())) for x in (text_features(batch.column("text")), meta_features(batch))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *views], names=["doc_id", "text_view", "meta_view"])


VIEWS = ("text_view", "meta_view")


@dataclass
class Classifier:
    """Weights and intercept of each view's log-odds, and of their combination."""

    views: list[tuple[np.ndarray, float]]
    weights: tuple[float, float]
    intercept: float


def fit(rows: DataFrame, features: str, iterations: int = 25) -> LogisticRegressionModel:
    return LogisticRegression(featuresCol=features, labelCol="y", weightCol="w", maxIter=iterations, regParam=1e-4, tol=1e-5).fit(rows)


def odds(model: LogisticRegressionModel, features: str) -> Column:
    """Log-odds of the good class, by the model's own weights."""
    weights = F.array(*[F.lit(float(x)) for x in model.coefficients.toArray()])
    dot = F.aggregate(F.zip_with(vector_to_array(features), weights, lambda x, c: x * c), F.lit(0.0), lambda s, x: s + x)
    return dot + F.lit(float(model.intercept))


def cuts(held: DataFrame, precision: float, least: int = 25, bins: int = 400) -> tuple[float, float]:
    """Log-odds below which, and above which, the held-out rows are bad, or good, with that precision."""
    cell = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("odds") + 20) * (bins / 40)).cast("int")))
    table = held.groupBy(cell.alias("cell")).agg(F.sum("y").alias("good"), F.count(F.lit(1)).alias("n")).collect()
    good, n = np.zeros(bins), np.zeros(bins)
    for r in table:
        good[r["cell"]], n[r["cell"]] = r["good"], r["n"]
    below_n, above_n = np.cumsum(n), np.cumsum(n[::-1])[::-1]
    bad_below, good_above = np.cumsum(n - good), np.cumsum(good[::-1])[::-1]
    low = np.flatnonzero((below_n >= least) & (bad_below >= precision * below_n))
    high = np.flatnonzero((above_n >= least) & (good_above >= precision * above_n))
    return (low[-1] + 1) * 40 / bins - 20 if len(low) else -np.inf, high[0] * 40 / bins - 20 if len(high) else np.inf


def train(docs: DataFrame, labels: DataFrame, rounds: int = 2, precision: float = 0.97, pseudo_weight: float = 0.25) -> Classifier | None:
    """The combined classifier, or None if the labels hold fewer than two classes."""
    marks = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
             .agg((F.avg("quality") >= 0.5).cast("double").alias("y")).hint("merge"))  # grows with the corpus: never broadcast
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", "n_chars").mapInArrow(
        featurise, "doc_id long, text_view array<float>, meta_view array<float>")
    table = materialize(made.join(marks, "doc_id", "left").withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0), "quality-features")
    rows = table.select("y", "held", *[array_to_vector(F.col(v)).alias(v) for v in VIEWS])
    classes = {(r["held"], r["y"]) for r in table.filter("y IS NOT NULL").groupBy("held", "y").count().collect()}
    if len({y for _, y in classes}) < 2:
        return None
    # Tiny label sets may lack a class on one side; then all labels serve both ends.
    split = len(classes) == 4
    labelled = rows.filter("y IS NOT NULL").withColumn("w", F.lit(1.0))
    seen, held = (labelled.filter("NOT held"), labelled.filter("held")) if split else (labelled, labelled)
    unlabelled = rows.filter("y IS NULL")
    models = [fit(seen, v) for v in VIEWS]
    for _ in range(rounds):
        passed = []
        for model, view in zip(models, VIEWS, strict=True):
            low, high = cuts(held.select("y", odds(model, view).alias("odds")), precision)
            sure = F.when(F.col("odds") >= F.lit(float(high)), F.lit(1.0)).when(F.col("odds") < F.lit(float(low)), F.lit(0.0))
            passed.append(unlabelled.withColumn("odds", odds(model, view)).withColumn("y", sure).filter("y IS NOT NULL")
                          .withColumn("w", F.lit(pseudo_weight)).select("y", "held", *VIEWS, "w"))
        models = [fit(seen.union(passed[1 - i]), v) for i, v in enumerate(VIEWS)]
    both = held.select("y", "w", array_to_vector(F.array(*[odds(m, v) for m, v in zip(models, VIEWS, strict=True)])).alias("odds"))
    top = fit(both, "odds")
    return Classifier([(m.coefficients.toArray(), float(m.intercept)) for m in models],
                      (float(top.coefficients[0]), float(top.coefficients[1])), float(top.intercept))


def score(docs: DataFrame, classifier: Classifier | None) -> tuple[DataFrame, str]:
    """``docs`` with the probability of good quality, and that column's name."""
    name = fresh(docs.columns, "score")
    if classifier is None:
        return docs.withColumn(name, F.lit(None).cast("double")), name

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = text_features(batch.column("text")), meta_features(batch)
            total = classifier.intercept + sum(w * (x @ c + b) for w, x, (c, b) in zip(classifier.weights, views, classifier.views, strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -700, 700))))],
                                             names=[*batch.schema.names, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())])), name


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """``docs`` without those scored below ``threshold``."""
    scored, name = score(docs, train(docs, labels, **options))
    return scored.filter(F.col(name).isNull() | (F.col(name) >= threshold)).select(*docs.columns)
