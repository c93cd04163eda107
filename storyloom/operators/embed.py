"""Embedding backfill (V5, A10, B8, B10, B15) and its streaming form.

Rows without a vector get one from an embedder; vectors of the wrong size are
not written and are kept with a reason.  The default embedder hashes the whole
content (the same vector as everywhere else in this library); a caller's model
runs in ``mapInPandas`` over Arrow batches of embedding-input texts, which
follow the model's declared length limit.  Vectors are written once before
anything reads them, so a model is called once per row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import HASH_DIM, hash_packed
from ..session import materialize
from . import select as sel

Embedder = Callable[[pd.Series], pd.Series]

VECTOR_SCHEMA = T.StructType([T.StructField("id", T.LongType()),
                              T.StructField("vector", T.ArrayType(T.FloatType()))])


def _caller_vectors(backlog: DataFrame, embedder: Embedder) -> DataFrame:
    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            vecs = embedder(pdf["input"].reset_index(drop=True))
            yield pd.DataFrame({"id": pdf["id"].astype("int64").to_numpy(), "vector": list(vecs)})

    inp = backlog.select("id", sel.embed_input(F.col("title"), F.col("content")).alias("input"))
    return inp.mapInPandas(run, VECTOR_SCHEMA)


def dense(packed: DataFrame, dim: int) -> DataFrame:
    """Packed sparse rows (id, vec) → (id, vector) with ``dim`` floats; a null ``vec`` is the zero vector."""
    def run(batches):
        for pdf in batches:
            out = np.zeros((len(pdf), dim), np.float32)
            for row, (slots, values) in enumerate(zip(pdf["slots"], pdf["values"])):
                if slots is not None:
                    out[row, np.asarray(slots, np.int64)] = values
            yield pd.DataFrame({"id": pdf["id"].astype("int64").to_numpy(), "vector": list(out)})

    return packed.select("id", F.col("vec.slot").alias("slots"), F.col("vec.value").alias("values")) \
        .mapInPandas(run, VECTOR_SCHEMA)


def embed_rows(rows: DataFrame, embedder: Embedder | None = None, dim: int = HASH_DIM) -> DataFrame:
    """(id, vector, n_dims, status) of every row, written once: ``ok``, or ``bad_dim`` for a vector of another size."""
    if embedder is None:
        vectors = dense(hash_packed(rows, "id", "content", dim), dim)
    else:
        vectors = _caller_vectors(rows, embedder)
    n = F.coalesce(F.size("vector"), F.lit(-1))
    return materialize(vectors.select("id", "vector", n.alias("n_dims"), F.when(n == dim, F.lit("ok"))
                                      .otherwise(F.lit("bad_dim")).alias("status")), "embedded")


def backfill(articles: DataFrame, embedder: Embedder | None = None, dim: int = HASH_DIM,
             limit: int | None = None):
    """Returns (articles with vectors filled where valid, outcome table (id, status, n_dims))."""
    made = embed_rows(sel.backlog(articles, "embedding", limit), embedder, dim)
    good = made.where(F.col("status") == "ok").select("id", F.col("vector").alias("_new"))
    updated = (articles.join(good, "id", "left")
               .withColumn("embedding", F.coalesce(F.col("embedding"), F.col("_new"))).drop("_new"))
    return updated, made.select("id", "status", "n_dims")


def coverage(articles: DataFrame) -> DataFrame:
    """D7 after a backfill."""
    return articles.agg(F.count("embedding").alias("with_vector"), F.count(F.lit(1)).alias("total"))
