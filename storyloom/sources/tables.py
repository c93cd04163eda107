"""Table scans (A4).

Plain ``spark.read.parquet``: Catalyst prunes columns and pushes filters into
the scan, so callers only ``select``/``filter`` what they need.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "documents", "embeddings", "pages", "conversations", "events", "labels",
    "benchmark",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
