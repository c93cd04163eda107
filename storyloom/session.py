"""Spark session settings shared by jobs, tests and the bench.

Everything that matters for correctness is set here once: UTC session time
(all day boundaries in the reference are UTC), adaptive execution with skew
handling, Arrow for the few pandas kernels.  The checkpoint folder is read
from the session (``spark.checkpoint.dir``); a scratch folder is only chosen
in local mode, and a cluster that names none is an error.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's default size of a split.
SPLIT_BYTES = 128 << 20

BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "storyloom", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if master and master.startswith("local"):
        # Local mode: the driver JVM is the only executor; size it at start.
        builder = builder.config("spark.driver.memory", os.environ.get("STORYLOOM_DRIVER_MEM", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to an existing session (driver-made sessions)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    # Batches handed to Python are bounded in bytes too: rows may be whole texts.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def spread(df: DataFrame) -> DataFrame:
    """``df`` with its rows over all task slots, if its files give splits for less than half of them.

    Costly per-row work would otherwise run in as many tasks as a small table has
    files.  Less than half a split per slot is moved; larger inputs are left alone.
    """
    spark, files = df.sparkSession, df.inputFiles()
    slots = spark.sparkContext.defaultParallelism
    if not files or 2 * len(files) >= slots:
        return df
    splits = spark.read.format("binaryFile").load(files).agg(F.sum(F.ceil(F.col("length") / SPLIT_BYTES))).first()[0]
    return df.repartition(slots) if 2 * splits < slots else df


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and snapshot tables.

    On a cluster this must be the shared path named by ``spark.checkpoint.dir``:
    a folder of the driver's own machine would lose what executors write.  Only
    in local mode, where driver and executor are one process, do we pick one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        path = tempfile.mkdtemp(prefix="storyloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh table location under the shared checkpoint folder."""
    import uuid

    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def materialize(df, name: str):
    """Write ``df`` once as a parquet table in the shared checkpoint folder and read it back.

    Used where several branches of a plan read one costly intermediate (hashed
    vectors): it is computed once, survives executor loss (the files are on the
    shared folder, not on an executor) and cuts the lineage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    # The schema is known: pass it so reading back needs no footer inference.
    return spark.read.schema(df.schema).parquet(path)
