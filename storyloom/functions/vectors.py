"""Vector helpers.

A vector is one row, ``(id, vec)``, in one of two packed shapes:

* dense ``array<float|double>`` (the stored ``embedding`` column), and
* sparse ``array<struct<slot int, value double>>``, sorted by slot, which is what
  the text hasher produces.

Long form ``(id, slot, value)``, a row per entry, is accepted wherever vectors
are read (``as_packed``) and is the shape of results that list entries.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

# Token rule and hashing rule of the text embedder.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
HASH_DIM = 768


def tokens(text: Column) -> Column:
    """Lower-cased words of two or more word characters, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)


def _slots(tokens_: list[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot and sign of each token, from its MD5."""
    digests = [hashlib.md5(t.encode("utf-8")).digest() for t in tokens_]
    raw = np.frombuffer(b"".join(digests), np.uint8).reshape(len(digests), 16)
    first = np.ascontiguousarray(raw[:, :4]).view(">u4")[:, 0].astype(np.int64)
    return first % dim, np.where(raw[:, 4] & 0x10, -1.0, 1.0)


#: Tokens a task remembers with their slots; beyond that they are hashed anew.
KNOWN_TOKENS = 500_000


def _hashed(dim: int):
    """Arrow batches with a text column ``_txt`` to the same rows with ``vec``: the unit vector's entries sorted by slot."""
    words = re.compile(r"\w{2,}")  # word characters here are letters, numbers and the underscore, as in TOKEN_PATTERN

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        slot, sign = _slots([], dim)
        for batch in batches:
            if len(number) >= KNOWN_TOKENS:
                number.clear()
                slot, sign = slot[:0], sign[:0]
            before, n = len(number), batch.num_rows
            each, flat = [], []
            for text in batch.column("_txt").to_pylist():
                found = words.findall((text or "").lower())
                each.append(len(found))
                flat += [number.setdefault(w, len(number)) for w in found]
            if len(number) > before:
                new_slot, new_sign = _slots(list(itertools.islice(number, before, None)), dim)
                slot, sign = np.concatenate([slot, new_slot]), np.concatenate([sign, new_sign])
            size = max(len(number), 1)
            pairs, tf = np.unique(np.repeat(np.arange(n), each) * size + np.array(flat, np.int64), return_counts=True)
            row, tok = np.divmod(pairs, size)
            cells, at = np.unique(row * dim + slot[tok], return_inverse=True)
            raw = np.bincount(at, sign[tok] * (1.0 + np.log(tf)), len(cells))
            row = cells // dim
            norm = np.sqrt(np.bincount(row, raw * raw, n))
            kept = norm[row] > 0
            cells, row, raw = cells[kept], row[kept], raw[kept]
            entries = pa.StructArray.from_arrays(
                [pa.array(cells % dim, pa.int32()), pa.array(raw / norm[row], pa.float64())], ["slot", "value"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
            names = [c for c in batch.schema.names if c != "_txt"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)], [*names, "vec"])
    return run


SPARSE = T.ArrayType(T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("value", T.DoubleType())]))


def hash_packed(df: DataFrame, id_col: str = "id", text_col: str = "content", dim: int = HASH_DIM,
                keep: Sequence[str] = ()) -> DataFrame:
    """Signed feature hashing of whole texts → ``(id, keep…, vec)``, one row per text.

    vec(slot) = Σ sign(tok)·(1 + ln tf(tok)) over the distinct tokens hashed to
    the slot, divided by the L2 norm; no tokens, or a norm of 0, → no entries.

    A text is one row, so it is hashed in the stage that reads it: no exchange
    carries text, unless the input is so small that its files give fewer splits
    than there are task slots (``spread``).  What leaves the stage is the vector
    and the columns to keep.
    """
    x = spread(df.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("_txt")))
    schema = T.StructType([*(x.schema[c] for c in ("id", *keep)), T.StructField("vec", SPARSE)])
    return x.mapInArrow(_hashed(dim), schema)


def hash_embed(df: DataFrame, id_col: str = "id", text_col: str = "content",
               dim: int = HASH_DIM) -> DataFrame:
    """``hash_packed`` in unit-norm long form ``(id, slot, value)``; texts without tokens have no rows."""
    return hash_packed(df, id_col, text_col, dim).select("id", F.explode("vec").alias("_e")).select("id", "_e.*")


def pack(vectors: DataFrame) -> DataFrame:
    """Long form → one row per id: ``vec`` = sorted array<struct<slot,value>> (≤ dim entries)."""
    return vectors.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("slot", "value"))).alias("vec"))


def as_packed(vectors: DataFrame) -> DataFrame:
    return vectors if "vec" in vectors.columns else pack(vectors)


def is_dense(vectors: DataFrame) -> bool:
    return not isinstance(vectors.schema["vec"].dataType.elementType, T.StructType)


def unit_dense(df: DataFrame, id_col: str = "id", vec_col: str = "embedding", keep: Sequence[str] = ()) -> DataFrame:
    """Stored dense vector → ``(id, keep…, vec)`` of length 1 in doubles; null vectors are dropped, zero vectors stay zero."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, e: acc + e * e))
    x = (df.where(F.col(vec_col).isNotNull())
         .select(F.col(id_col).alias("id"), *keep, F.transform(vec_col, lambda v: v.cast("double")).alias("v")).withColumn("norm", norm))
    return x.select("id", *keep, F.when(F.col("norm") > 0, F.transform("v", lambda v: v / F.col("norm"))).otherwise(F.col("v")).alias("vec"))


def entries(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and value of each entry of a packed column, dense, sparse, or sparse as a struct of slots and values."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_struct(lists.type):
        row, _, slot = entries(lists.field("slot"))
        return row, slot.astype(np.int64), lists.field("value").flatten().to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row, flat = np.repeat(np.arange(len(sizes)), sizes), lists.flatten()
    if pa.types.is_struct(flat.type):
        return row, flat.field("slot").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("value").to_numpy(zero_copy_only=False)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes), flat.to_numpy(zero_copy_only=False).astype(np.float64)


def dense_to_sparse(df: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Stored dense vector → unit-norm long form ``(id, slot, value)``.

    Zero vectors give no rows (cosine with them is 0, as in the reference's
    library); null vectors are dropped.
    """
    x = df.where(F.col(vec_col).isNotNull()).select(
        F.col(id_col).alias("id"),
        F.transform(F.col(vec_col), lambda v: v.cast("double")).alias("v"))
    x = x.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, e: acc + e * e)))
    return (x.where(F.col("norm") > 0)
            .select("id", F.posexplode("v").alias("slot", "raw"), "norm")
            .where(F.col("raw") != 0)
            .select("id", F.col("slot").cast("int").alias("slot"),
                    (F.col("raw") / F.col("norm")).alias("value")))


def raw_dense_to_long(df: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Dense vector → long form without normalising (for Euclidean work)."""
    return (df.where(F.col(vec_col).isNotNull())
            .select(F.col(id_col).alias("id"), F.posexplode(vec_col).alias("slot", "raw"))
            .select("id", F.col("slot").cast("int").alias("slot"),
                    F.col("raw").cast("double").alias("value")))
