"""Pages of long lists and nested lists by ranks over ranges.

A list is range-partitioned by its order once; the rows of each range are
counted, and a range's first rank is the sum of the counts before it.  So no
task sorts or numbers the whole list, and a page reads only the ranges its ranks
fall in.  Lists nested in a parent (the articles of a cluster) are ranked the
same way inside their parent and handed out in pages, so that neither a task nor
a row ever holds all children of a large parent.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch_path

MAX_PAGE = 100


@dataclass
class Pages:
    """A list written in its order, in one folder per range, and the number of rows of each range."""

    path: str
    rows: DataFrame
    counts: DataFrame
    order: Sequence[Column]

    def page(self, number: int, size: int) -> DataFrame:
        """Rows of one page with ``rank, total_count, has_next, page, page_size``; a size above 100 is 100."""
        size = max(1, min(size, MAX_PAGE))
        first, last = (number - 1) * size, number * size
        before = F.coalesce(F.sum("n").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = self.counts.withColumn("before", before)
        # At most a page's number of ranges, with a row each.
        hit = held.where((F.col("before") < last) & (F.col("before") + F.col("n") > first)).collect()
        total = self.counts.select(F.coalesce(F.sum("n"), F.lit(0))).scalar()
        spark = self.rows.sparkSession
        folders = [f"{self.path}/_chunk={r['_chunk']}" for r in hit]
        data = (spark.read.schema(self.rows.schema).option("basePath", self.path).parquet(*folders) if folders
                else self.rows.limit(0))
        start = F.lit(0)
        for r in hit:
            start = F.when(F.col("_chunk") == r["_chunk"], r["before"]).otherwise(start)
        rank = start + F.row_number().over(Window.partitionBy("_chunk").orderBy(*self.order))
        return (data.withColumn("rank", rank.cast("long")).where((F.col("rank") > first) & (F.col("rank") <= last)).drop("_chunk")
                .withColumn("total_count", total).withColumn("has_next", F.col("total_count") > F.lit(last))
                .withColumn("page", F.lit(number)).withColumn("page_size", F.lit(size)))


def write_pages(df: DataFrame, order: Sequence[Column], name: str) -> Pages:
    """Writes ``df`` in ``order``, which must not leave ties."""
    path = scratch_path(df.sparkSession, name)
    ranges = df.repartitionByRange(*order).withColumn("_chunk", F.spark_partition_id())
    ranges.sortWithinPartitions(*order).write.partitionBy("_chunk").parquet(path)
    rows = df.sparkSession.read.schema(ranges.schema).parquet(path)
    counts = materialize(rows.groupBy("_chunk").agg(F.count(F.lit(1)).alias("n")), f"{name}-counts")
    return Pages(path, rows, counts, order)


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, out: str = "rank") -> DataFrame:
    """Adds the rank (from 1) inside each group by ``order``; a large group spans many ranges."""
    group = list(group)
    rows = materialize(df.repartitionByRange(*group, *order).withColumn("_chunk", F.spark_partition_id()), name)
    keys = [*group, "_chunk"]
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_inside", inside).join(starts, keys).withColumn(
        out, (F.col("_before") + F.col("_inside")).cast("long")).drop("_chunk", "_inside", "_before")


#: Fields of an article inside a list.
ARTICLE = ("id", "title", "content", "url", "published_date", "source", "created_at")


def nested_articles(links: DataFrame, articles: DataFrame, parent: str, size: int, fields: Sequence[str] = ARTICLE) -> DataFrame:
    """``parent, page, n_total, articles``: the linked articles of each parent, newest first, ``size`` a row.

    ``links`` holds (parent, article_id), each pair once.  Ids and dates alone are
    ranked; the other fields join the ranked ids.
    """
    dates = articles.select(F.col("id").alias("article_id"), "published_date")
    order = [F.col("published_date").desc(), F.col("article_id").asc()]
    placed = ranked(links.select(parent, "article_id").join(dates, "article_id"), [parent], order, f"ranked-{parent}")
    total = placed.groupBy(parent).agg(F.count(F.lit(1)).alias("n_total"))
    item = F.struct(*[F.col(f) for f in fields]).alias("_item")
    items = placed.drop("published_date").join(articles.select(F.col("id").alias("article_id"), item), "article_id")
    page = F.ceil(F.col("rank") / size).cast("int")
    lists = items.withColumn("page", page).groupBy(parent, "page").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "_item"))), lambda x: x["_item"]).alias("articles"))
    return lists.join(total, parent).select(parent, "page", "n_total", "articles")
