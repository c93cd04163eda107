"""Store tables that are changed by runs (A5, A6): rows in folders by key hash, and a list of versions.

A run reads and rewrites only the buckets its keys fall in, into a folder of its
own.  The last thing it does is to add one small file that names the folder of
every bucket: the new version.  Readers take the newest version whose file is
there, so a run that fails leaves the table as it was, and its folder is never
read.  One run at a time changes a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSIONS = "version long, bucket int, folder string"


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = 64) -> None:
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, list(keys), buckets
        spark.createDataFrame([], VERSIONS).write.mode("ignore").parquet(f"{path}/versions")

    def folders(self) -> tuple[int, dict[int, str]]:
        """The newest version and its folder of each bucket that has rows (at most ``buckets``)."""
        listed = self.spark.read.schema(VERSIONS).parquet(f"{self.path}/versions")
        newest = listed.agg(F.max("version")).first()[0]
        rows = [] if newest is None else listed.where(F.col("version") == newest).collect()
        return newest or 0, {r["bucket"]: r["folder"] for r in rows}

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        held = self.folders()[1]
        chosen = [f for b, f in held.items() if buckets is None or b in buckets]
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*chosen)

    def change(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Rows of the touched buckets become ``merge(rows, changes)``; returns the new version's number.

        ``merge`` gets every stored row that could share a key with ``changes`` and
        returns all rows to keep.
        """
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in changes.select(bucket).distinct().collect()]
        version, held = self.folders()
        if not touched:
            return version
        folder = f"{self.path}/rows/{uuid.uuid4().hex}"
        merged = merge(self.read(touched), changes).select(*self.schema.fieldNames())
        merged.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        written = self.spark.read.parquet(folder).select("_bucket").distinct().collect()
        held = {b: f for b, f in held.items() if b not in touched} | {r[0]: f"{folder}/_bucket={r[0]}" for r in written}
        self._publish(version + 1, held)
        return version + 1

    def _publish(self, version: int, held: dict[int, str]) -> None:
        rows = self.spark.createDataFrame([(version, b, f) for b, f in held.items()], VERSIONS)
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
