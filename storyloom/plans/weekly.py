"""Weekly narratives (P1) — slice → vectors → cluster metrics → gate → score.

All weeks are one plan: ``week`` is a grouping key computed per row, not a
driver loop.  The cluster label is a column: the language (label-clustered
variant, exact SQL oracle) or a k-means assignment (``plans.kmeans_weekly``).
Costly steps run only where they are needed: the pair kernel (near-duplicate
rate) only over clusters that passed the gate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.dates import week_back, week_back_start
from ..functions.vectors import hash_packed
from ..operators.pairs import near_dup_rate
from ..operators.quality import (cluster_profile, coherence_expr, of_clusters, quality_gate,
                                 source_diversity, square_sums)
from ..session import materialize
from ..sources.adapters import NOW, now_col

KEYS = ["week", "label"]
#: Weeks a run looks back, and the label of rows that have none.
WEEKS = 5
NO_LABEL = "unknown"


def week_members(articles: DataFrame, now: str = NOW, weeks: int = WEEKS, label_col: str = "lang",
                 min_week_rows: int = 8) -> DataFrame:
    """B11 + B13: rows of the last ``weeks`` backward weeks with their cluster label.

    Weeks with fewer than ``min_week_rows`` rows are skipped, as the reference
    skips a week with fewer vectors than clusters.  The week list has at most
    ``weeks`` rows, so it is broadcast and no text is shuffled.  Rows without a
    label form a cluster of their own.
    """
    nowc = now_col(now)
    a = (articles.withColumn("week", week_back(F.col("published_date"), nowc))
         .where((F.col("week") >= 0) & (F.col("week") < weeks)))
    label = F.col(label_col)
    if isinstance(a.schema[label_col].dataType, StringType):
        label = F.coalesce(label, F.lit(NO_LABEL))
    m = a.select("week", label.alias("label"), "id", "source", "published_date",
                 "title", "content", "url")
    big = m.groupBy("week").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_week_rows)
    return m.join(F.broadcast(big.select("week")), "week", "left_semi")


def score_clusters(members: DataFrame, vectors: DataFrame, keys=KEYS, min_rows: int = 5,
                   min_sources: int = 3, min_days: int = 2, threshold: float = 0.5,
                   dup_threshold: float = 0.95, singleton_value: float = 1.0,
                   block: int = 2000) -> DataFrame:
    """D1–D4 + B14 + A8 significance per cluster."""
    keys = list(keys)
    prof = cluster_profile(members, keys)
    stats = (prof.join(source_diversity(members, keys), keys)
             .join(square_sums(members, vectors, keys), keys, "left")
             .withColumn("coherence", coherence_expr(F.col("n_rows"), F.col("s2"), F.col("q"),
                                                     singleton_value))
             .drop("s2", "q"))
    # A row per cluster, written: its size is known, so vectors meet a short list without being shuffled by cluster.
    gated = materialize(quality_gate(stats, min_rows, min_sources, min_days, threshold), "gated-clusters")
    accepted = gated.where(F.col("accepted")).select(*keys, F.col("n_rows").alias("_n"))
    nd = near_dup_rate(members.join(accepted.select(*keys), keys, "left_semi"), of_clusters(vectors, accepted, keys),
                       keys, dup_threshold, block, sizes=accepted)
    return (gated.join(nd, keys, "left")
            .withColumn("significance",
                        F.when(F.col("accepted"), F.col("coherence") * F.col("diversity"))))


def weekly_narratives(articles: DataFrame, now: str = NOW, weeks: int = WEEKS, label_col: str = "lang",
                      min_rows: int = 5, min_sources: int = 3, min_days: int = 2,
                      threshold: float = 0.5, dup_threshold: float = 0.95,
                      min_week_rows: int = 8, block: int = 2000) -> DataFrame:
    members = week_members(articles, now, weeks, label_col, min_week_rows)
    # Hashing is the costly step and several branches read it: write it once, with the keys of the cluster.
    vectors = materialize(hash_packed(members, "id", "content", keep=KEYS), "weekly-vectors")
    scored = score_clusters(members, vectors, KEYS, min_rows, min_sources, min_days, threshold,
                            dup_threshold, 1.0, block)
    return scored.withColumn("week_start", week_back_start(F.col("week"), now_col(now)))


def weekly_kmeans(articles: DataFrame, now: str = NOW, weeks: int = WEEKS, k: int = 8,
                  iterations: int | None = None, starts: int = 10, min_rows: int = 5, min_sources: int = 3, min_days: int = 2,
                  threshold: float = 0.5, dup_threshold: float = 0.95, block: int = 2000):
    """P1 with k-means labels: every week clusters its stored vectors at once (V2).

    Initial centres: per week and start the k rows with the smallest seeded
    ``xxhash64`` of their id; all starts run to convergence together and the one
    of least cost stays (``iterations`` sets a number of rounds instead).  Weeks with fewer vectors than k are skipped (B13).
    Returns (scored clusters, assignment).
    """
    from pyspark.sql.window import Window

    from ..functions.vectors import unit_dense
    from ..operators import kmeans

    nowc = now_col(now)
    a = (articles.where(F.col("embedding").isNotNull())
         .withColumn("week", week_back(F.col("published_date"), nowc))
         .where((F.col("week") >= 0) & (F.col("week") < weeks)))
    big = a.groupBy("week").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    a = a.join(F.broadcast(big.select("week")), "week", "left_semi")
    pts = a.select("week", "id", F.col("embedding").alias("vec"))
    # Ids alone are ranked, cut before they are shuffled; vectors join the k x starts x weeks that are left.
    seeded = a.select("week", "id").withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))
    pick = Window.partitionBy("week", "start").orderBy(F.xxhash64("start", "id"), "id")
    first = seeded.withColumn("_r", F.row_number().over(pick)).where(F.col("_r") <= k)
    init = first.join(pts, ["week", "id"]).select("week", "start", (F.col("_r") - 1).alias("cluster"), "vec")
    assigned, _ = kmeans.lloyd(pts, init, ["week"], iterations)
    members = assigned.select("week", F.col("cluster").alias("label"), "id").join(
        a.select("id", "source", "published_date"), "id")
    scored = score_clusters(members, unit_dense(a, "id", "embedding"), KEYS, min_rows, min_sources,
                            min_days, threshold, dup_threshold, 1.0, block)
    return scored, assigned
