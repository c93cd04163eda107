"""Exact pairs of similar vectors inside clusters (C8, D4, V4 pairs) and exact distance sums.

Similar pairs.  Whole vectors never meet in a product unless their cosine may
reach the threshold:

* Equal vectors are one *class* with a number of rows; their pairs are counted,
  not compared.  So a group of copies of any size is one row.
* A class has a *code*: its coordinates in an orthonormal basis of
  ``CODE`` directions, and the length of what is left over.  For unit vectors
  u·v ≤ Pu·Pv + ‖u − Pu‖·‖v − Pv‖, whatever the basis, so pairs whose bound stays
  below the threshold are out without error.  The basis holds the principal
  directions of a bounded sample of classes; the sample decides the speed only.
* Codes, in half precision, go to the tiles of a cluster's blocks, one matrix product
  a tile.  A tile hands on the classes that have an *open* pair, and no pair.
* These classes' vectors go to smaller tiles.  There the open pairs are found again and
  checked exactly in double precision on the spot.  So no vector travels with a pair, a
  vector without a similar one hardly travels at all, and where only the number of pairs
  is asked, no pair leaves its tile.

A cluster has a fixed number of blocks (``BLOCKS``) until they reach
``LARGEST_BLOCK`` rows, so what is shuffled grows with the rows, and a tile's
memory is bounded.  A cluster holding a third of all rows has more tiles, spread
over all executors.  What is quadratic is the product of codes alone, and, beyond
``BLOCKS * LARGEST_BLOCK`` rows in one cluster, the copies of codes.

Distance sums need every pair by their definition.  Rows are sent once to each
tile of their run; a tile returns sums per row and cluster.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import as_packed, entries, is_dense
from ..session import materialize
from .quality import clustered

DEFAULT_BLOCK = 2000
#: Blocks of a cluster's classes, unless one would have more than this number of rows; rows of a block of vectors at most.
BLOCKS = 4
LARGEST_BLOCK = 131_072
LARGEST_VECTORS = 32_768
#: Directions of a code, and classes the basis is fitted on at most.
CODE = 128
BASIS_SAMPLE = 2048
#: Codes are taken in single precision and sent in half precision; their products of unit vectors err by less.
SLACK, SENT_SLACK = 1e-4, 1.5e-3
#: Products of codes that a task holds at once.
CELLS = 1 << 24


def _blocks(rows: DataFrame, keys: Sequence[str], of: str, number: Column) -> DataFrame:
    """Adds ``_blk`` and copies each row to the tiles ``(_lo, _hi)`` of its cluster, which has ``number`` blocks."""
    nb = F.greatest(F.lit(1), number).cast("int")
    rows = rows.withColumn("_nb", nb).withColumn("_blk", F.pmod(F.xxhash64(of), F.col("_nb")).cast("int"))
    return (rows.withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
            .withColumn("_lo", F.least("_blk", "_p")).withColumn("_hi", F.greatest("_blk", "_p")).drop("_nb", "_p"))


def _slots(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _spread(rep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash-partition tiles over at least the cluster's task slots.

    Tiles are few and CPU-heavy (a matrix product each), while their shuffle is
    small, so AQE would coalesce them into one task.  An explicit partition count
    is kept by AQE, and the following groupBy on the same keys needs no further
    exchange.
    """
    return rep.repartition(_slots(rep.sparkSession), *keys, "_lo", "_hi")


def vector_classes(members: DataFrame, vectors: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Equal vectors of a cluster as one row: (keys…, cls, n, vec), and membership (keys…, id, cls).

    The classes are written.  A sparse ``vec`` is a struct of its slots and its values, a third of the size of
    an array of entries.  Vectors are equal if two 64-bit hashes of all their entries are.  Zero
    vectors, whose cosine with anything is 0, belong to no class.
    """
    keys = list(keys)
    rows = clustered(members, vectors, keys)
    dense = is_dense(rows)
    value = (lambda e: e) if dense else (lambda e: e["value"])
    flat = F.col("vec") if dense else F.struct(F.col("vec.slot").alias("slot"), F.col("vec.value").alias("value"))
    rows = rows.where(F.exists("vec", lambda e: value(e) != 0)).withColumns(
        {"_h1": F.xxhash64("vec"), "_h2": F.xxhash64(F.lit(7), "vec")})
    same = [*keys, "_h1", "_h2"]
    # Flat before they are grouped: that sorts them in the tasks that read them, and entries would not fit in memory there.
    classes = rows.select(*same, "id", flat.alias("vec")).groupBy(*same).agg(
        F.min("id").alias("cls"), F.count(F.lit(1)).alias("n"), F.min_by("vec", "id").alias("vec"))
    classes = materialize(classes, "vector-classes")
    many = classes.where(F.col("n") > 1).select(*same, "cls")
    member = rows.select(*same, "id").join(many, same, "left").select(*keys, "id", F.coalesce("cls", "id").alias("cls"))
    return classes.drop("_h1", "_h2"), member


def _matrix(column, dim: int) -> np.ndarray:
    row, slot, value = entries(column)
    out = np.zeros((len(column), dim))
    out[row, slot] = value
    return out


def _basis(classes: DataFrame) -> np.ndarray:
    """Orthonormal directions (dim × up to CODE): the principal ones of a bounded sample of classes, chosen by hash."""
    sample = classes.orderBy(F.xxhash64("cls"), "cls").select("vec").limit(BASIS_SAMPLE).toArrow()["vec"]
    _, slot, _ = entries(sample)
    if not len(slot):
        return np.zeros((0, 0))
    x = _matrix(sample, int(slot.max()) + 1)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :CODE]


def _codes(basis: np.ndarray, start: np.ndarray, slot: np.ndarray, value: np.ndarray, rows: int = 2048) -> np.ndarray:
    """A row per vector: its coordinates in the basis and the length of the rest."""
    out = np.zeros((len(start) - 1, basis.shape[1] + 1), np.float32)
    for at in range(0, len(out), rows):
        end = min(at + rows, len(out))
        part = slice(start[at], start[end])
        row, to, val = np.repeat(np.arange(end - at), np.diff(start[at:end + 1])), slot[part], value[part]
        seen = to < len(basis)  # a slot that the sample lacks lies outside the basis
        x = np.zeros((end - at, len(basis)))
        x[row[seen], to[seen]] = val[seen]
        code = x @ basis
        whole = np.bincount(row, val * val, end - at)
        out[at:end, :-1] = code
        out[at:end, -1] = np.sqrt(np.maximum(whole - (code * code).sum(axis=1), 0.0))
    return out


def _coded(keys: Sequence[str], basis: np.ndarray):
    """Rows (keys…, cls, vec) to rows (keys…, cls, _code)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, slot, value = entries(batch.column("vec"))
            start = np.searchsorted(row, np.arange(batch.num_rows + 1))
            code = _codes(basis, start, slot, value).astype(np.float16)
            names = [*keys, "cls"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([c.tobytes() for c in code], pa.binary())], [*names, "_code"])
    return run


def _open_rows(keys: Sequence[str], threshold: float, width: int):
    """The classes of a tile of codes that have a pair whose bound exceeds the threshold: (keys…, _lo, _hi, _blk, cls), for each
    pair of smaller blocks (``_fine``) with such a pair."""
    def run(table: pa.Table) -> pa.Table:
        lo, hi = table["_lo"][0].as_py(), table["_hi"][0].as_py()
        blk, fine = table["_blk"].to_numpy(), table["_fine"].to_numpy().astype(np.int64)
        code = np.frombuffer(b"".join(table["_code"].to_pylist()), np.float16).reshape(-1, width).astype(np.float32)
        order = np.argsort(fine, kind="stable")
        left, right = order[blk[order] == lo], order[blk[order] == hi]
        across, found = code[right].T, []
        parts, first = np.unique(fine[right], return_index=True)
        rows = max(1, CELLS // max(len(right), 1))
        for part, begin, size in zip(*np.unique(fine[left], return_index=True, return_counts=True), strict=True):
            met = np.zeros(len(right), bool)
            for at in range(begin, begin + size if len(right) else begin, rows):
                end = min(at + rows, begin + size)
                hit = code[left[at:end]] @ across > threshold - SENT_SLACK
                if lo == hi:
                    hit[np.arange(end - at), np.arange(at, end)] = False
                met |= hit.any(axis=0)
                i, p = np.nonzero(np.logical_or.reduceat(hit, first, axis=1))
                found.append((left[at:end][i], np.full(len(i), part), parts[p]))
            found.append((right[met], np.full(int(met.sum()), part), fine[right[met]]))
        row, a, b = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (left[:0],) * 3
        # A name stands for all its classes, so it is handed on once.
        names = table["cls"].combine_chunks().dictionary_encode(null_encoding="encode")
        _, once = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), names.indices.to_numpy()[row]]), axis=1, return_index=True)
        row, a, b = row[once], a[once], b[once]
        return pa.table([*(pa.repeat(table[k][0], len(row)) for k in keys), *(pa.array(x.astype(np.int32)) for x in (
            np.minimum(a, b), np.maximum(a, b), fine[row])), table["cls"].take(pa.array(row))], names=[*keys, "_lo", "_hi", "_blk", "cls"])
    return run


def _products(start: np.ndarray, slot: np.ndarray, value: np.ndarray, dim: int, a: np.ndarray, b: np.ndarray, pairs: int = 8192) -> np.ndarray:
    """Products of the vectors ``a`` and ``b``, pair by pair; ``a`` is sorted."""
    out = np.zeros(len(a))
    sizes = np.diff(start)
    for at in range(0, len(a), pairs):
        i, j = a[at:at + pairs], b[at:at + pairs]
        rows, place = np.unique(i, return_inverse=True)
        left = np.zeros((len(rows), dim))
        for k, r in enumerate(rows):
            left[k, slot[start[r]:start[r + 1]]] = value[start[r]:start[r + 1]]
        size = sizes[j]
        pair = np.repeat(np.arange(len(j)), size)
        entry = np.arange(len(pair)) + np.repeat(start[j] - (np.cumsum(size) - size), size)
        out[at:at + pairs] = np.bincount(pair, left[place[pair], slot[entry]] * value[entry], len(j))
    return out


def _named(cls: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows whose classes bear the names of ``i`` and ``j``, smaller name first, sorted by the first.

    Only ids that come twice with unequal vectors give classes of one name, which lie in one block.  A pair then
    stands for all their rows, as it would if pairs were joined with the classes by name.
    """
    swap = cls[i] > cls[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    order = np.argsort(cls, kind="stable")
    named = cls[order]
    if (named[1:] == named[:-1]).any():
        first, many = zip(*((np.searchsorted(named, cls[x]), np.searchsorted(named, cls[x], "right")) for x in (i, j)), strict=True)
        n = [m - f for f, m in zip(first, many, strict=True)]
        pair = np.repeat(np.arange(len(i)), n[0] * n[1])
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(n[0] * n[1]) - n[0] * n[1], n[0] * n[1])
        i, j = order[first[0][pair] + nth // n[1][pair]], order[first[1][pair] + nth % n[1][pair]]
    at = np.argsort(i, kind="stable")
    return i[at], j[at]


def _tile(keys: Sequence[str], threshold: float, basis: np.ndarray, give: str, rows: int = 256):
    """Of the pairs of classes of a tile: ``open`` the pairs whose bound exceeds the threshold, ``similar`` those whose
    cosine does, with rows and cosine, ``count`` their number of pairs of rows."""
    def run(table: pa.Table) -> pa.Table:
        lo, hi = table["_lo"][0].as_py(), table["_hi"][0].as_py()
        cls, blk, n = (table[c].to_numpy() for c in ("cls", "_blk", "n"))
        row, slot, value = entries(table["vec"])
        start = np.searchsorted(row, np.arange(len(cls) + 1))
        del row
        slot, dim = slot.astype(np.int32), int(slot.max(initial=0)) + 1
        code = _codes(basis, start, slot, value)
        left, right = np.flatnonzero(blk == lo), np.flatnonzero(blk == hi)
        across = code[right].T
        total, found = 0, []
        for at in range(0, len(left), rows):
            some = left[at:at + rows]
            i, j = np.nonzero(code[some] @ across > threshold - SLACK)
            i, j = some[i], right[j]
            if lo == hi:
                i, j = i[i < j], j[i < j]
            cosine = np.zeros(0)
            if give != "open":
                i, j = _named(cls, i, j)
                cosine = _products(start, slot, value, dim, i, j)
                above = cosine > threshold
                i, j, cosine = i[above], j[above], cosine[above]
            if give == "count":
                total += int((n[i] * n[j]).sum())
            elif len(i):
                found.append((i, j, cosine))
        if give == "count":
            return pa.table([*(table[k].slice(0, 1) for k in keys), pa.array([total], pa.int64())], names=[*keys, "d"])
        i, j, cosine = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (left[:0], left[:0], np.zeros(0))
        swap = cls[i] > cls[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        fixed = [pa.repeat(table[k][0], len(i)) for k in keys]
        ids = [pa.array(cls[x], table["cls"].type) for x in (i, j)]
        if give == "open":
            return pa.table([*fixed, *ids], names=[*keys, "cls_a", "cls_b"])
        return pa.table([*fixed, ids[0], pa.array(n[i]), ids[1], pa.array(n[j]), pa.array(cosine)],
                        names=[*keys, "cls_a", "n_a", "cls_b", "n_b", "cosine"])
    return run


def _with_codes(sized: DataFrame, keys: Sequence[str], basis: np.ndarray, number: Column, fine: Column) -> DataFrame:
    """Codes of the classes, copied to the tiles of their cluster's ``number`` blocks; ``_fine``, of ``fine`` blocks, divides ``_blk``."""
    of = [*keys, "_n"]
    schema = T.StructType([*(sized.schema[c] for c in of), sized.schema["cls"], T.StructField("_code", T.BinaryType())])
    codes = sized.select(*of, "cls", "vec").mapInArrow(_coded(of, basis), schema)
    codes = codes.withColumn("_fine", F.pmod(F.xxhash64("cls"), fine).cast("int"))
    return _blocks(codes, keys, "cls", number).drop("_n")


def _tiles(classes: DataFrame, keys: Sequence[str], threshold: float, block: int, give: str, columns: Sequence[tuple[str, T.DataType]]) -> DataFrame:
    """What ``_tile`` gives for all tiles: (keys…, columns…)."""
    keys = list(keys)
    basis = _basis(classes)
    if keys:    # a row per cluster: broadcast, as a shuffle by cluster would put a large one's vectors in one task
        sized = classes.join(F.broadcast(classes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))), keys)
    else:   # one group: its size is a scalar subquery, no join
        sized = classes.withColumn("_n", classes.select(F.count(F.lit(1))).scalar())
    # From block / (2 * BLOCKS) rows on there are BLOCKS copies of a code, so that these grow with the rows.
    number = F.greatest(F.least(F.ceil(F.col("_n") * (2 * BLOCKS) / F.lit(block)), F.lit(BLOCKS)), F.ceil(F.col("_n") / F.lit(LARGEST_BLOCK)))
    fine = number * F.ceil(F.col("_n") / (number * LARGEST_VECTORS))
    coded = _with_codes(sized, keys, basis, number, fine)
    placed = [T.StructField(c, T.IntegerType()) for c in ("_lo", "_hi", "_blk")]
    of = [classes.schema[k] for k in keys]
    some = materialize(_spread(coded, keys).groupBy(*keys, "_lo", "_hi").applyInArrow(
        _open_rows(keys, float(threshold), basis.shape[1] + 1), T.StructType([*of, *placed, classes.schema["cls"]])), "open-classes")
    some = some.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_lo", "_hi", "_blk", F.col("cls").alias("_cls"))
    same = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    tiles = classes.join(some, [*same, F.col("cls").eqNullSafe(F.col("_cls"))]).select(*classes.columns, "_lo", "_hi", "_blk")
    schema = T.StructType([*of, *(T.StructField(c, t) for c, t in columns)])
    return (tiles.repartition(_slots(classes.sparkSession), *keys, "_lo", "_hi").groupBy(*keys, "_lo", "_hi")
            .applyInArrow(_tile(keys, float(threshold), basis, give), schema))


def open_pairs(classes: DataFrame, keys: Sequence[str], threshold: float, block: int = DEFAULT_BLOCK) -> DataFrame:
    """(keys…, cls_a < cls_b): the pairs of classes of a cluster that the bound leaves open, a superset of the similar ones."""
    of = classes.schema["cls"].dataType
    return _tiles(classes, keys, threshold, block, "open", [("cls_a", of), ("cls_b", of)])


def similar_classes(classes: DataFrame, keys: Sequence[str], threshold: float = 0.95, block: int = DEFAULT_BLOCK) -> DataFrame:
    """(keys…, cls_a, n_a, cls_b, n_b, cosine): pairs of different vectors with cosine strictly above ``threshold``."""
    of, n = classes.schema["cls"].dataType, T.LongType()
    return _tiles(classes, keys, threshold, block, "similar",
                  [("cls_a", of), ("n_a", n), ("cls_b", of), ("n_b", n), ("cosine", T.DoubleType())])


def near_dup_counts(members: DataFrame, vectors: DataFrame, keys: Sequence[str],
                    threshold: float = 0.95, block: int = DEFAULT_BLOCK,
                    sizes: DataFrame | None = None) -> DataFrame:
    """Pairs with cosine strictly above ``threshold`` ≥ 0 per cluster: (keys…, n_dup, n_pairs).

    ``vectors`` must be of unit norm, so the product is the cosine.
    ``sizes`` (keys…, _n) may be passed when the caller already has row counts.
    """
    keys = list(keys)
    if sizes is None:
        sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    classes, _ = vector_classes(members, vectors, keys)
    equal = (F.col("n") * (F.col("n") - 1) / 2).cast("long") if threshold < 1 else F.lit(0).cast("long")
    dup = (classes.select(*keys, equal.alias("d"))
           .unionByName(_tiles(classes, keys, threshold, block, "count", [("d", T.LongType())]))
           .groupBy(*keys).agg(F.sum("d").alias("n_dup")))
    return sizes.join(dup, keys, "left").select(
        *keys, F.coalesce("n_dup", F.lit(0)).alias("n_dup"), (F.col("_n") * (F.col("_n") - 1) / 2).cast("long").alias("n_pairs"))


def near_dup_rate(members: DataFrame, vectors: DataFrame, keys: Sequence[str],
                  threshold: float = 0.95, block: int = DEFAULT_BLOCK,
                  sizes: DataFrame | None = None) -> DataFrame:
    """Share of unordered pairs above the threshold; 0 below two rows."""
    counts = near_dup_counts(members, vectors, keys, threshold, block, sizes)
    rate = F.when(F.col("n_pairs") < 1, F.lit(0.0)).otherwise(F.col("n_dup").cast("double") / F.col("n_pairs"))
    return counts.select(*keys, rate.alias("near_dup_rate"))


def similar_pairs(members: DataFrame, vectors: DataFrame, keys: Sequence[str],
                  threshold: float = 0.95, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Pairs (id_a < id_b) inside a cluster with cosine strictly above ``threshold`` ≥ 0.

    The classes' pairs spelled out; ``similar_classes`` gives the same links without that.
    """
    keys = list(keys)
    classes, member = vector_classes(members, vectors, keys)
    member = materialize(member, "class-members")
    ids = {s: member.select(*keys, F.col("cls").alias(f"cls_{s}"), F.col("id").alias(f"_{s}")) for s in "ab"}
    across = (similar_classes(classes, keys, threshold, block).join(ids["a"], [*keys, "cls_a"]).join(ids["b"], [*keys, "cls_b"])
              .select(*keys, F.least("_a", "_b").alias("id_a"), F.greatest("_a", "_b").alias("id_b"), "cosine"))
    if threshold >= 1:
        return across
    copies = classes.where(F.col("n") > 1).select(*keys, "cls")
    equal = (copies.join(ids["a"].withColumnRenamed("cls_a", "cls"), [*keys, "cls"])
             .join(ids["b"].withColumnRenamed("cls_b", "cls"), [*keys, "cls"]).where(F.col("_a") < F.col("_b"))
             .select(*keys, F.col("_a").alias("id_a"), F.col("_b").alias("id_b"), F.lit(1.0).alias("cosine")))
    return across.unionByName(equal)


def _replicated(members: DataFrame, vectors: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """Member rows with their vectors, copied to the tiles of their run; a row without a vector is a zero vector."""
    if keys:
        rows = members.join(members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), list(keys))
    else:   # one group: its size is a scalar subquery, no join
        rows = members.withColumn("_n", members.select(F.count(F.lit(1))).scalar())
    return _blocks(rows.join(vectors.select("id", "vec"), "id", "left"), keys, "id", F.ceil(F.col("_n") / F.lit(block))).drop("_n")


def distance_sums(members: DataFrame, raw_vectors: DataFrame, run_keys: Sequence[str],
                  label_col: str = "cluster", block: int = DEFAULT_BLOCK) -> DataFrame:
    """Per row: Σ Euclidean distance to the rows of each cluster of the same run.

    Output (run_keys…, id, other, dist_sum, cnt) — the input of the exact
    silhouette (D12).  ``raw_vectors`` are not normalised.
    """
    keys = list(run_keys)
    lab = members.select(*keys, "id", F.col(label_col).alias("_lab"))
    rep = _replicated(lab, as_packed(raw_vectors), keys, block)
    schema = T.StructType([*(rep.schema[k] for k in keys), rep.schema["id"], T.StructField("other", rep.schema["_lab"].dataType),
                           T.StructField("dist_sum", T.DoubleType()), T.StructField("cnt", T.LongType())])

    def kernel(table: pa.Table) -> pa.Table:
        lo, hi = table["_lo"][0].as_py(), table["_hi"][0].as_py()
        vec = table["vec"].combine_chunks()
        x = _matrix(vec, int(entries(vec)[1].max(initial=0)) + 1)
        square = (x * x).sum(axis=1)
        labels = table["_lab"].combine_chunks().dictionary_encode()
        member = np.eye(len(labels.dictionary))[labels.indices.to_numpy()]
        ids, blk = table["id"].combine_chunks(), table["_blk"].to_numpy()
        left, right = np.flatnonzero(blk == lo), np.flatnonzero(blk == hi)
        out = []
        for rows, others in [(left, right)] if lo == hi else [(left, right), (right, left)]:
            d = np.sqrt(np.maximum(square[rows][:, None] + square[others] - 2.0 * (x[rows] @ x[others].T), 0.0))
            if lo == hi:
                np.fill_diagonal(d, 0.0)
            count = member[others].sum(axis=0).astype(np.int64)
            sums = d @ member[others]
            row, label = np.nonzero(np.broadcast_to(count > 0, sums.shape))
            out.append(pa.table([*(pa.repeat(table[k][0], len(row)) for k in keys), ids.take(pa.array(rows[row])),
                                 labels.dictionary.take(pa.array(label)), pa.array(sums[row, label]), pa.array(count[label])],
                                names=[*keys, "id", "other", "dist_sum", "cnt"]))
        return pa.concat_tables(out)

    per_block = _spread(rep, keys).groupBy(*keys, "_lo", "_hi").applyInArrow(kernel, schema)
    return per_block.groupBy(*keys, "id", "other").agg(
        F.sum("dist_sum").alias("dist_sum"), F.sum("cnt").alias("cnt"))


def silhouette(members: DataFrame, raw_vectors: DataFrame, run_keys: Sequence[str],
               label_col: str = "cluster", block: int = DEFAULT_BLOCK) -> DataFrame:
    """D12 exact: mean silhouette per run with Euclidean distance (library definition).

    s(i) = (b − a) / max(a, b); a = mean distance to own cluster without self,
    b = least mean distance to another cluster; s = 0 for rows alone in their cluster.
    """
    keys = list(run_keys)
    ds = distance_sums(members, raw_vectors, keys, label_col, block)
    own = members.select(*keys, "id", F.col(label_col).alias("own"))
    j = ds.join(own, [*keys, "id"])
    a = (j.where(F.col("other") == F.col("own"))
         .select(*keys, "id", F.col("cnt").alias("own_n"),
                 F.when(F.col("cnt") > 1, F.col("dist_sum") / (F.col("cnt") - 1)).alias("a")))
    b = (j.where(F.col("other") != F.col("own"))
         .groupBy(*keys, "id").agg(F.min(F.col("dist_sum") / F.col("cnt")).alias("b")))
    s = a.join(b, [*keys, "id"], "left").select(
        *keys, "id",
        F.when((F.col("own_n") <= 1) | F.col("b").isNull(), F.lit(0.0))
        .when(F.greatest("a", "b") == 0, F.lit(0.0))
        .otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("s"))
    return s.groupBy(*keys).agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("n_rows"))
