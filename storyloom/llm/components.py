"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round is two joins and two pre-aggregated minima over the links; nodes and
links never leave the executors.  A node with very many links is a skewed join
key, which adaptive execution splits; the minima combine before they shuffle.
Every round is written to the shared checkpoint folder, so a lost executor costs
one round at most.  The number of rounds grows with the logarithm of the longest
path; the loop ends when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], int(row[1])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every neighbour to the smallest one: the larger neighbours, or the smaller ones and the node itself."""
    both = edges if not large else edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; the component is its smallest node.

    Links may come in any direction, repeated, or from a node to itself; rows
    with a null end are ignored.  A node whose only links are to itself, or an
    empty table, gives no row.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .filter("a > b").distinct(), "links")
    seen = _fingerprint(edges)
    while True:
        # After both stars every link is (node, smallest neighbour), larger end first.
        edges = materialize(_star(_star(edges, True), False), "links")
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
