"""Historical backfill planning (P2): forward week grid, week stats, plan, cost.

The grid is ⌈30·months/7⌉ rows (a bounded parameter); the per-week statistics
are one aggregation over the article table keyed by the week index computed
per row.  The grid side of every join is that small, bounded table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import forward_start, midnight, week_fwd
from ..sources.adapters import NOW, now_col

# The reference's cost constants (USD).
NAMING_COST_PER_CLUSTER = 0.0001
BRIEF_COST_PER_WEEK = 0.001
PLAN_PREVIEW = 5


def week_grid(spark: SparkSession, now: str = NOW, months: int = 2) -> DataFrame:
    """[start + 7i, min(start + 7(i+1), midnight)) for i = 0 … ⌈30·months/7⌉ − 1."""
    n = math.ceil(30 * months / 7)
    nowc = now_col(now)
    start = forward_start(nowc, months)
    return spark.range(n).select(
        F.col("id").cast("int").alias("week_idx"),
        (start + F.make_dt_interval(days=F.col("id") * 7)).alias("week_start"),
        F.least(start + F.make_dt_interval(days=(F.col("id") + 1) * 7), midnight(nowc)).alias("week_end"))


def week_stats(spark: SparkSession, articles: DataFrame, now: str = NOW, months: int = 2) -> DataFrame:
    """Per grid week — articles, with vectors, distinct sources, coverage (0 if empty)."""
    idx = week_fwd(F.col("published_date"), now_col(now), months)
    agg = (articles.select(idx.alias("week_idx"), "embedding", "source")
           .where(F.col("week_idx").isNotNull())
           .groupBy("week_idx").agg(F.count(F.lit(1)).alias("total_articles"),
                                    F.count("embedding").alias("with_vector"),
                                    F.countDistinct("source").alias("unique_sources")))
    g = week_grid(spark, now, months)
    out = g.join(agg, "week_idx", "left").select(
        "week_idx", "week_start", "week_end",
        F.coalesce("total_articles", F.lit(0)).alias("total_articles"),
        F.coalesce("with_vector", F.lit(0)).alias("with_vector"),
        F.coalesce("unique_sources", F.lit(0)).alias("unique_sources"))
    return out.withColumn("coverage", F.when(F.col("total_articles") > 0,
                                             F.col("with_vector") / F.col("total_articles"))
                          .otherwise(F.lit(0.0)))


def processed_weeks(grid: DataFrame, events: DataFrame, now: str = NOW, months: int = 2) -> DataFrame:
    """Weeks of the forward grid holding at least one event in [start, end).

    The grid is regular, so an event's week is arithmetic on its date and the
    interval join is a semi join on the week index.
    """
    idx = week_fwd(F.col("event_date"), now_col(now), months)
    hit = events.select(idx.alias("week_idx")).where(F.col("week_idx").isNotNull()).distinct()
    return grid.join(hit, "week_idx", "left_semi")


def covered(intervals: DataFrame, events: DataFrame, id_col: str = "id", start: str = "start", end: str = "end",
            ts: str = "ts") -> DataFrame:
    """C7 for any windows: the rows of ``intervals`` that hold at least one event in [start, end).

    An interval of length n lies in at most three bins of width 2^k ≤ n < 2^(k+1)
    microseconds, and cuts each of them on one side at most.  So per width in use
    (63 at most) and bin the least and the greatest event time decide: events meet
    intervals as one row per bin, by equality of (width, bin), however the windows
    overlap and however many events fall into one.
    """
    at = intervals.select(F.col(id_col).alias("_id"), F.unix_micros(start).alias("_s"), F.unix_micros(end).alias("_e"))
    at = at.where(F.col("_e") > F.col("_s")).withColumn("_k", F.length(F.bin(F.col("_e") - F.col("_s"))) - 1)
    widths = sorted(r["_k"] for r in at.select("_k").distinct().collect())

    def bin_of(micros: str) -> Column:
        return F.call_function("shiftright", F.expr(micros), F.col("_k"))

    pieces = at.withColumn("_bin", F.explode(F.sequence(bin_of("_s"), bin_of("_e - 1"))))
    met = (events.select(F.unix_micros(ts).alias("_t")).where(F.col("_t").isNotNull())
           .withColumn("_k", F.explode(F.array(*[F.lit(k) for k in widths]).cast("array<int>")))
           .groupBy("_k", bin_of("_t").alias("_bin")).agg(F.min("_t").alias("_first"), F.max("_t").alias("_last")))
    hit = (pieces.join(met, ["_k", "_bin"]).where((F.col("_last") >= F.col("_s")) & (F.col("_first") < F.col("_e")))
           .select(F.col("_id").alias(id_col)).distinct())
    return intervals.join(hit, id_col, "left_semi")


def week_plan(stats: DataFrame, k: int = 6, done: DataFrame | None = None) -> DataFrame:
    """B13 + skip-existing: weeks with ≥ k vectors and (optionally) no event yet."""
    plan = stats.where(F.col("with_vector") >= k)
    if done is not None:
        plan = plan.join(done.select("week_idx"), "week_idx", "left_anti")
    return plan


def plan_preview(plan: DataFrame) -> DataFrame:
    """The first five planned weeks and how many more follow (plan is grid-sized)."""
    w = Window.orderBy("week_idx")
    ranked = plan.withColumn("plan_rank", F.row_number().over(w)).withColumn(
        "planned_weeks", F.count(F.lit(1)).over(Window.partitionBy()))
    return ranked.where(F.col("plan_rank") <= PLAN_PREVIEW).select(
        "plan_rank", "week_start", "week_end", "with_vector", "unique_sources",
        F.greatest(F.col("planned_weeks") - PLAN_PREVIEW, F.lit(0)).alias("more_weeks"))


def cost_estimate(plan: DataFrame, k: int = 6) -> DataFrame:
    """Weeks × k × 0.0001 + weeks × 0.001 (one aggregate row)."""
    weeks = F.count(F.lit(1))
    return plan.agg(weeks.alias("weeks")).select(
        "weeks",
        (F.col("weeks") * k).alias("estimated_clusters"),
        (F.col("weeks") * k).alias("cluster_naming_calls"),
        F.col("weeks").alias("weekly_brief_calls"),
        (F.col("weeks") * k * NAMING_COST_PER_CLUSTER).alias("cluster_naming_cost"),
        (F.col("weeks") * BRIEF_COST_PER_WEEK).alias("weekly_brief_cost"),
        (F.col("weeks") * k * NAMING_COST_PER_CLUSTER + F.col("weeks") * BRIEF_COST_PER_WEEK)
        .alias("estimated_cost_usd"))
