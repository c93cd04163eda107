"""Incremental ingest with url de-duplication (S1) and incremental embedding.

Structured Streaming file sources.  Which urls (or article ids) have been met is
keyed state in the state store: a micro-batch looks up its own keys only, so
what it reads does not grow with the sink or with the article table.  A batch
writes its rows to a folder of its own, ``batch=<number>``, and replaces it if it
is run again after a failure, so nothing is appended twice.

Urls of an article table that exists before the stream are written next to the
checkpoint once, and enter the state with the first batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import feed as fd

FEED_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("link", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("source_id", T.StringType()),
    T.StructField("pubDate", T.StringType()),
])

SINK_SCHEMA = "seq long, url string, title string, content string, source string, published_date timestamp"

#: State on local disk with a log of its changes, so that a batch saves what it changed, not the whole state.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _open_sink(spark: SparkSession, sink: str, schema: str) -> None:
    """Creates an empty table where none is, so that a failing read is always an error, never an empty sink.

    Rows lie in the folders of their batches only; files beside them are not this table's.
    """
    try:
        spark.read.format("binaryFile").load(f"{sink}/*.parquet")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        raise ValueError(f"{sink} holds files that no stream has written")
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{sink}/batch=-1")


def _read_sink(spark: SparkSession, sink: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch long").parquet(sink).drop("batch")


def _first_met(order: str):
    """The first row by ``order`` of a key that has not been met; rows without ``order`` only say that it has."""
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, seen = None, state.exists
        for rows in parts:
            if seen or rows[order].isna().any():
                seen = True
                continue
            row = rows.loc[[rows[order].idxmin()]]
            if first is None or row[order].iloc[0] < first[order].iloc[0]:
                first = row
        if not state.exists:
            state.update((True,))
        if first is not None and not seen:
            yield first
    return run


def _new_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    for name, value in STATE.items():
        rows.sparkSession.conf.set(name, value)
    return rows.groupBy(key).applyInPandasWithState(
        _first_met(order), rows.schema, "met boolean", "append", GroupStateTimeout.NoTimeout)


def _run(rows: DataFrame, write, checkpoint: str) -> None:
    q = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def ingest_stream(spark: SparkSession, feed_dir: str, sink: str, checkpoint: str,
                  existing: DataFrame | None = None, files_per_batch: int = 64):
    """Run the feed stream until the files present now are consumed (availableNow).

    Urls of ``existing`` are known from the first start on; later ones come in by the stream itself.
    """
    _open_sink(spark, sink, SINK_SCHEMA)
    feed = (spark.readStream.schema(FEED_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(feed_dir))
    items = fd.normalise(feed).select("seq", "url", "title", "content", "source", "published_date")
    if existing is not None:
        known = f"{checkpoint}-known"
        existing.select("url").distinct().write.mode("ignore").parquet(known)
        urls = spark.readStream.schema("url string").parquet(known).select(
            *[F.col("url") if f.name == "url" else F.lit(None).cast(f.dataType).alias(f.name) for f in items.schema])
        items = urls.unionByName(items)

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    _run(_new_rows(items, "url", "seq"), write, checkpoint)
    return _read_sink(spark, sink, SINK_SCHEMA)


def write_feed_files(feed: DataFrame, feed_dir: str, parts: int = 3) -> None:
    """Land the feed as JSON files, ``parts`` ranges of ``seq`` of about equal size, oldest first."""
    cuts = feed.approxQuantile("seq", [i / parts for i in range(1, parts)], 0.01)
    bounds = [None, *sorted(set(cuts)), None]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        part = feed
        if lo is not None:
            part = part.where(F.col("seq") >= lo)
        if hi is not None:
            part = part.where(F.col("seq") < hi)
        part.write.mode("append").json(feed_dir)


EMBED_SINK_SCHEMA = "id long, vector array<float>"


REJECTS_SCHEMA = "id long, n_dims int, status string"


def embed_stream(spark: SparkSession, article_dir: str, article_schema, sink: str, checkpoint: str,
                 embedder=None, dim: int = 768, files_per_batch: int = 64, rejects: str | None = None) -> DataFrame:
    """Vectors for articles as they land (the daily embedding job as a stream).

    Each micro-batch embeds its rows that have no vector and whose id has not been
    met, each once, writes the valid vectors, and records the others in
    ``rejects`` (by default next to the sink).
    """
    from ..operators import embed

    rejects = rejects or f"{sink}-rejected"
    _open_sink(spark, sink, EMBED_SINK_SCHEMA)
    _open_sink(spark, rejects, REJECTS_SCHEMA)
    landed = (spark.readStream.schema(article_schema).option("maxFilesPerTrigger", files_per_batch).parquet(article_dir))
    # Of an id that lands twice in one batch the earliest stays.
    todo = landed.where(F.col("embedding").isNull()).drop("embedding").withColumn(
        "_at", F.coalesce(F.unix_micros("published_date"), F.lit(0)).cast("double"))

    def write(df: DataFrame, batch: int) -> None:
        made = embed.embed_rows(df.drop("_at"), embedder, dim)
        made.where(F.col("status") != "ok").select("id", "n_dims", "status").write.mode("overwrite").parquet(f"{rejects}/batch={batch}")
        made.where(F.col("status") == "ok").select("id", "vector").write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    _run(_new_rows(todo, "id", "_at"), write, checkpoint)
    return _read_sink(spark, sink, EMBED_SINK_SCHEMA)
