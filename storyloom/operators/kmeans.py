"""k-means as DataFrame plans.

* ``assign`` (C9/V3): per run, the k centroids are packed into one array and
  joined to the points by run key, so each point computes its k distances
  locally — n rows, never n×k.  The centroid side is k·dim per run (bounded by
  the caller's k), and AQE broadcasts it only when its measured size is small.
* ``lloyd`` (V2): all runs (weeks) and starts advance together, to convergence;
  points are written once to the shared folder, a round is one pass that returns
  partial sums, and the centres, bounded by the caller's k, go to every task.
* ``fit`` (V1): MLlib ``KMeans`` per run, best of several seeds by training
  cost — the reference's "best of 10 starts" with Spark's initialiser.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .quality import MERGE_SHARES


def _sqdist(x: Column, c: Column) -> Column:
    return F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                       lambda acc, e: acc + e)


def as_double(vec: Column) -> Column:
    return F.transform(vec, lambda v: v.cast("double"))


def mean_vectors(points: DataFrame, keys: Sequence[str], vec_col: str = "vec") -> DataFrame:
    """Mean dense vector per group: (keys…, vec) — one aggregation, no pair work."""
    keys = list(keys)
    long = points.select(*keys, F.posexplode(vec_col).alias("slot", "v"))
    per_slot = long.groupBy(*keys, "slot").agg(F.avg(F.col("v").cast("double")).alias("v"))
    packed = per_slot.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("slot", "v"))).alias("e"))
    return packed.select(*keys, F.col("e.v").alias(vec_col))


def assign(points: DataFrame, centroids: DataFrame, run_keys: Sequence[str],
           vec_col: str = "vec", cluster_col: str = "cluster") -> DataFrame:
    """Nearest centroid (squared Euclidean; ties → smaller cluster id).

    points: (run_keys…, id, vec); centroids: (run_keys…, cluster, vec).
    Output: points + cluster + sqdist.
    """
    run_keys = list(run_keys)
    packed = centroids.groupBy(*run_keys).agg(
        F.collect_list(F.struct(F.col(cluster_col).alias("c"), F.col(vec_col).alias("v"))).alias("_cs"))
    if run_keys:
        j = points.join(packed, run_keys)
    else:   # one run: the k centres arrive as a scalar subquery, no join at all
        j = points.withColumn("_cs", packed.select("_cs").scalar())
    x = as_double(F.col(vec_col))
    best = F.array_min(F.transform("_cs", lambda c: F.struct(
        _sqdist(x, c["v"]).alias("d"), c["c"].alias("c"))))
    return (j.withColumn("_best", best).drop("_cs")
            .withColumn(cluster_col, F.col("_best.c")).withColumn("sqdist", F.col("_best.d"))
            .drop("_best"))


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest centre; ties go to the first."""
    d = (x * x).sum(1)[:, None] - 2.0 * (x @ centres.T) + (centres * centres).sum(1)[None, :]
    best = d.argmin(axis=1)
    return best, np.maximum(d[np.arange(len(x)), best], 0.0)


def _round(points: DataFrame, centres: dict) -> dict:
    """One pass: {(run, start): (counts, sums, cost, count of points)}; a task returns its partial sums only."""
    def run(batches):
        held: dict = {}
        for pdf in batches:
            for r, rows in pdf.groupby("_run"):
                x = np.stack(rows["vec"].to_numpy()).astype(np.float64)
                for (r2, start), c in centres.items():
                    if r2 == r:
                        best, cost = _nearest(x, c)
                        sums = np.zeros_like(c)
                        np.add.at(sums, best, x)
                        old = held.get((r, start), (0, 0, 0.0))
                        held[r, start] = (old[0] + np.bincount(best, minlength=len(c)), old[1] + sums, old[2] + cost.sum())
        yield pd.DataFrame([{"_run": r, "start": s, "n": n.tolist(), "sums": v.ravel().tolist(), "cost": float(c)}
                            for (r, s), (n, v, c) in held.items()], columns=["_run", "start", "n", "sums", "cost"])

    def add(pdf):
        return pd.DataFrame({"_run": [pdf["_run"].iloc[0]], "start": [pdf["start"].iloc[0]],
                             "n": [np.sum(np.stack(pdf["n"].to_numpy()), axis=0)],
                             "sums": [np.sum(np.stack(pdf["sums"].to_numpy()), axis=0)], "cost": [pdf["cost"].sum()]})

    schema = "_run string, start int, n array<long>, sums array<double>, cost double"
    # Added up in two rounds, so that no task gets the sums of every other.
    parts = points.select("_run", "vec").mapInPandas(run, schema).withColumn("_share", F.spark_partition_id() % MERGE_SHARES)
    shares = parts.groupBy("_run", "start", "_share").applyInPandas(add, schema)
    rows = shares.groupBy("_run", "start").applyInPandas(add, schema).collect()  # runs x starts rows, as the caller set
    return {(r["_run"], r["start"]): (np.array(r["n"]), np.array(r["sums"]), r["cost"]) for r in rows}


#: Most bytes of centres (runs x starts x k x dimensions) that are sent to every task.
MAX_CENTRE_BYTES = 256 << 20


def lloyd(points: DataFrame, init: DataFrame, run_keys: Sequence[str], iterations: int | None = None,
          vec_col: str = "vec", cluster_col: str = "cluster", tol: float = 1e-4, most: int = 300):
    """V2: Lloyd's rounds for every run, and every start of a run, at once.

    ``init`` may have a column ``start`` for several starts; per run the one of
    least cost is kept.  Without ``iterations`` a run goes on until its centres
    move by less than ``tol`` times the mean variance (``most`` rounds at most),
    like the reference's library.  Points are written once and read once a
    round; tasks return partial sums, and only the centres reach the driver.
    A cluster that loses all points keeps its centre.  Returns (assignment, centroids).
    """
    run_keys = list(run_keys)
    run = F.concat_ws("|", F.lit(""), *[F.coalesce(F.col(k).cast("string"), F.lit("?")) for k in run_keys])
    stored = materialize(points.where(F.col(vec_col).isNotNull()).withColumn("_run", run)
                         .withColumnRenamed(vec_col, "vec"), "kmeans-points")
    if "start" not in init.columns:
        init = init.withColumn("start", F.lit(0))
    rows = (init.select(run.alias("_run"), "start", *run_keys, cluster_col, as_double(F.col(vec_col)).alias("c"))
            .orderBy("_run", "start", cluster_col).collect())  # bounded by the caller's k, starts and runs
    names, centres, of = {}, {}, {}
    for r in rows:
        key = (r["_run"], r["start"])
        names.setdefault(key, []).append(r[cluster_col])
        centres.setdefault(key, []).append(r["c"])
        of[r["_run"]] = [r[k] for k in run_keys]
    centres = {k: np.array(v, np.float64) for k, v in centres.items()}
    if sum(c.nbytes for c in centres.values()) > MAX_CENTRE_BYTES:
        raise ValueError("too many centres to send to every task; run fewer weeks or starts at once")
    scale = {}
    if iterations is None:
        dim = F.posexplode("vec").alias("slot", "v")
        var = (stored.select("_run", dim).groupBy("_run", "slot").agg(F.var_pop(F.col("v").cast("double")).alias("s"))
               .groupBy("_run").agg(F.avg("s").alias("s")).collect())
        scale = {r["_run"]: r["s"] * tol for r in var}
    open_, cost = dict(centres), {}
    for _ in range(most if iterations is None else iterations):
        if not open_:
            break
        for key, (n, sums, c) in _round(stored, open_).items():
            old = centres[key]
            new = np.where(n[:, None] > 0, sums.reshape(old.shape) / np.maximum(n, 1)[:, None], old)
            cost[key], centres[key] = c, new
            if iterations is None and ((new - old) ** 2).sum() <= scale[key[0]]:
                open_.pop(key)
            else:
                open_[key] = new
        open_ = {k: v for k, v in open_.items() if k in cost}
    best = {}
    for key in sorted(centres):
        if key[0] not in best or cost.get(key, 0.0) < cost.get(best[key[0]], 0.0):
            best[key[0]] = key
    spark = points.sparkSession
    kept = [(*of[r], name, [float(x) for x in c]) for r, key in best.items()
            for name, c in zip(names[key], centres[key], strict=True)]
    fields = [init.schema[k] for k in run_keys] + [init.schema[cluster_col], T.StructField(vec_col, T.ArrayType(T.DoubleType()))]
    cents = spark.createDataFrame(kept, T.StructType(fields))
    return assign(stored.drop("_run").withColumnRenamed("vec", vec_col), cents, run_keys, vec_col, cluster_col), cents


def fit(points: DataFrame, k: int, seeds: Sequence[int] = tuple(range(42, 52)),
        vec_col: str = "vec", max_iter: int = 300):
    """V1: MLlib KMeans with several seeds; keeps the model with least training cost.

    Returns (model, assignment with ``cluster``).  Labels cannot equal another
    library's: initialisation differs.  Invariants tested instead: every point
    at its nearest centre; centre = mean of its points.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = points.withColumn("_features", array_to_vector(as_double(F.col(vec_col))))
    best = None
    for seed in seeds:
        model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_features",
                       predictionCol="cluster").fit(data)
        cost = model.summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, model)
    model = best[1]
    return model, model.transform(data).drop("_features")
