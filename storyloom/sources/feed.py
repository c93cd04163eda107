"""Feed ingest (A1–A3) and the feed adapter over ``pages``.

``normalise`` turns raw feed items into article rows; ``insert_if_absent``
keeps the first item per url in feed order and drops urls the article table
already holds.  Both are column expressions plus one window and one anti join,
so a daily feed of any size is one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import freedates
from .adapters import LOCAL_TZ, NOW, now_col
from .tables import read_table

# The reference's title cut and source default.
TITLE_MAX = 500
DEFAULT_SOURCE = "unknown"


def parse_pub_date(s: Column, now: Column, local_tz: str = LOCAL_TZ) -> Column:
    """Feed dates as instants; missing or unreadable ones become ``now``.

    Dates without a zone, and those with a zone name that is not UTC, are in ``local_tz``.
    """
    return F.coalesce(freedates.parse(s, now, local_tz), now)


def normalise(feed: DataFrame, now: str = NOW) -> DataFrame:
    """A1: drop items without title or link; title cut; content fallback; source default."""
    nowc = now_col(now)
    ok = (F.coalesce(F.length("title"), F.lit(0)) > 0) & (F.coalesce(F.length("link"), F.lit(0)) > 0)
    return feed.where(ok).select(
        "seq",
        F.col("link").alias("url"),
        F.substring("title", 1, TITLE_MAX).alias("title"),
        F.coalesce(F.when(F.length("content") > 0, F.col("content")), F.col("description")).alias("content"),
        F.coalesce(F.col("source_id"), F.lit(DEFAULT_SOURCE)).alias("source"),
        parse_pub_date(F.col("pubDate"), nowc).alias("published_date"),
    )


def read_limit(feed: DataFrame, limit: int | None) -> DataFrame:
    """A3: the first ``limit`` items in feed order (paging itself is not built)."""
    return feed.orderBy("seq").limit(limit) if limit else feed


def insert_if_absent(items: DataFrame, existing: DataFrame) -> DataFrame:
    """A2: first item per url in feed order, minus urls already stored (existing wins)."""
    w = Window.partitionBy("url").orderBy("seq")
    first = items.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    return first.join(existing.select("url"), "url", "left_anti")


# ---------------------------------------------------------------------------
# Feed adapter over the driver's ``pages`` table (FIXTURES.md §3, "feed").
# Fixed values of the test contract: the row rules below.
# ---------------------------------------------------------------------------

FEED_EPOCH = "2024-01-01 00:00:00"


def feed_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    # Every 9th link points at the stored article of the same number, if there is
    # one, so insert-if-absent meets urls that already exist.
    d = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("_doc"), F.col("source").alias("_dsrc"))
    pid = F.col("page_id")
    title = F.regexp_extract("html", r"<title>(.*?)</title>", 1)
    local = F.expr(f"timestamp'{FEED_EPOCH}' + make_interval(0,0,0,0,0,cast(page_id*37 % 50400 as int))")
    fmt = F.date_format(local, "yyyy-MM-dd HH:mm:ss")
    iso = F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss")
    pub = (F.when(pid % 8 == 0, fmt)
           .when(pid % 8 == 1, F.concat(iso, F.lit("Z")))
           .when(pid % 8 == 2, F.concat(iso, F.lit("+02:00")))
           .when(pid % 24 == 3, F.lit("not a date"))
           .when(pid % 24 == 11, F.date_format(local, "MMMM d, yyyy h:mm a"))
           .when(pid % 24 == 19, F.date_format(local, "EEE MMM dd HH:mm:ss yyyy"))
           .when(pid % 24 == 4, F.date_format(local, "yyyy-MM-dd"))
           .when(pid % 24 == 12, F.date_format(local, "MM/dd/yyyy"))
           .when(pid % 24 == 20, F.date_format(local, "dd.MM.yyyy HH:mm 'GMT'"))
           .when(pid % 8 == 5, F.date_format(local, "EEE, dd MMM yyyy HH:mm:ss '+0200'"))
           .when(pid % 8 == 6, F.concat(iso, F.lit(".250000Z")))
           .otherwise(F.concat(fmt, F.lit(" -0330"))))
    doc_url = F.concat(F.lit("https://"), F.col("_dsrc"), F.lit(".example/a/"), F.col("_doc").cast("string"))
    base = p.join(d, pid == F.col("_doc"), "left").select(
        (pid * 2).alias("seq"),
        F.when(pid % 13 == 0, F.lit(None).cast("string"))
        .when((pid % 9 == 0) & F.col("_doc").isNotNull(), doc_url).otherwise(F.col("url")).alias("link"),
        F.when(pid % 11 == 0, F.lit("")).otherwise(title).alias("title"),
        F.when(pid % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("html")).alias("content"),
        F.col("url").alias("description"),
        F.when(pid % 7 == 0, F.lit(None).cast("string"))
        .otherwise(F.regexp_extract("url", r"://([^/]+)", 1)).alias("source_id"),
        pub.alias("pubDate"), pid.alias("_pid"))
    repeats = base.where(F.col("_pid") % 5 == 0).select(
        (F.col("seq") + 1).alias("seq"), "link",
        F.concat(F.lit("[update] "), F.col("title")).alias("title"),
        "content", "description", "source_id", "pubDate", "_pid")
    return base.unionByName(repeats).drop("_pid")
