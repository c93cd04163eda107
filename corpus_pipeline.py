"""The corpus pipeline: raw documents in, a plan of padded training batches out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and reread as the next stage's ``docs``.  All but the last return the
columns they were given.

* quality: documents that the co-trained classifier rejects go.
* lines: repeated and near-equal lines go, the earliest stays; ``n_chars``
  follows the text; documents whose every line stands earlier go.
* copies: of each group of near copies one document stays.
* mix: documents are repeated or left out so that sources reach their weights.
* pack: the pieces of the mix with their bucket, batch and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import line_dedup, mixing, near_dedup, packing, quality
from storyloom.llm.common import bounded_batches, fresh
from storyloom.session import configure, materialize
from storyloom.sources.tables import read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(configure(spark))
    return quality.good_documents(docs, read_table(spark, sf_dir, "labels"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(configure(spark))
    gone = fresh(docs.columns, "dropped")
    kept = line_dedup.dedup_lines(docs).filter(F.col(gone).isNull() | F.col("text").rlike(r"\S"))
    return kept.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text"))
                           .cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(configure(spark))
    return near_dedup.one_of_each(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return mixing.mixed_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("lines", lines_stage), ("copies", copies_stage), ("mix", mix_stage), ("pack", pack_stage)]

#: Training, order min-hash and the schedule's hashes are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole ``documents`` table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
