"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> SparkSession:
    """Keeps Arrow batches of whole texts small, so that workers hold a few MB (or one longer text) at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return spark


def fresh(taken: Iterable[str], base: str) -> str:
    """``base``, with underscores added until no column in ``taken`` has that name (case-blind)."""
    names = {n.lower() for n in taken}
    while base.lower() in names:
        base += "_"
    return base


def word_count(text: str = "text") -> Column:
    """Words of a text column as long; null and empty texts have 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def with_row_id(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written once with a row number column, and that column's name.

    The number only tells rows of this written copy apart, also rows equal in
    every column; it carries no order and never reaches a result.
    """
    uid = fresh(df.columns, "_row")
    return materialize(df.withColumn(uid, F.monotonically_increasing_id()), name), uid


def running_total(df: DataFrame, group: Sequence[str], chunk: str, order: Sequence[Column],
                  value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group that come earlier.

    The order inside a group is (``chunk``, ``order``).  Only the rows of one
    (group, chunk) meet in a task; chunk totals, a small table, carry the sums
    across chunks.  So a group with a third of all rows is no hot spot, given
    chunks of bounded size.  ``df`` is read twice: pass a written table.
    """
    keys = [*group, chunk]
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = (df.groupBy(*keys).agg(F.sum(value).alias("_total"))
              .withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))
              .select(*keys, "_before"))
    return (df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(totals, keys)
            .withColumn(out, F.col("_before") + F.col("_inside"))
            .drop("_before", "_inside"))
