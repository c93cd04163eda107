"""Embedding near-duplicates: int8 tile products with rigorous error bounds.

A unit vector ``x`` is stored as int8 codes ``q`` and a scale ``s``; ``e`` bounds
the length of ``x - s q``.  For two vectors the exact cosine then differs from
``s s' (q . q')`` by at most ``e |s' q'| + e' |s q| + e e'``.  Tiles of codes are
multiplied with integers held in float32 (exact below 2^24); only codes go to
the tiles.  Pairs whose bound decides about the threshold are settled there, and
only the open ones are joined with the original vectors and recomputed in double
precision.

Whole work, no quadratic output: equal vectors collapse to one before any
product.  Distinct vectors fall into the cell of their nearest pivot (a bounded
sample), and cells of more rows are cut into blocks; two cells whose caps on the
sphere lie further apart than the threshold are never multiplied.  A pair of blocks is one small task, which
returns a link count per vector and a spanning forest of the links it found, so
that a large group of near copies yields rows in proportion to its size.

Defined cases: null, zero, non-finite vectors and vectors with null components
link with nothing; vectors of different length never link; an empty table gives
no row; a null id is linked but never names a component; repeated rows are other
vectors of the same id, each with its own result row; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import components

#: Slack for rounding in double precision, well above its error for any vector of under 10^5 components.
EPS = 1e-9


def usable(vector: str) -> Column:
    """Whether the vector takes part: no null or non-finite component, and not zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(rows: list[np.ndarray]) -> np.ndarray:
    x = np.stack(rows).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # before squaring, so that extreme lengths neither vanish nor overflow
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scales, lengths of the decoded vectors, and error lengths, the last two rounded up."""
    s = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / s[:, None])
    decoded = q * s[:, None]
    lengths = np.sqrt(np.einsum("ij,ij->i", decoded, decoded)) + EPS
    errors = np.sqrt(np.einsum("ij,ij->i", x - decoded, x - decoded)) + EPS
    return q.astype(np.int8), s, lengths, errors


class Codes:
    """Quantised unit vectors: int8 codes, and per vector scale, decoded length and error."""

    def __init__(self, codes: np.ndarray, scale: np.ndarray, length: np.ndarray, error: np.ndarray) -> None:
        # Integers held in floats: sums of code products must stay exact.
        self.q = codes.astype(np.float64 if codes.shape[1] * 127 * 127 >= 1 << 24 else np.float32)
        self.s, self.l, self.e = scale, length, error

    def __getitem__(self, rows: slice | np.ndarray) -> Codes:
        return Codes(self.q[rows], self.s[rows], self.l[rows], self.e[rows])


def bounded_pairs(x: Codes, y: Codes, threshold: float, tile: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Index pairs by tile, ``(i, j, i2, j2)``: those whose bound proves cosine >= threshold, and those it leaves open."""
    for a in range(0, len(x.q), tile):
        i = slice(a, a + tile)
        for b in range(0, len(y.q), tile):
            j = slice(b, b + tile)
            dots = x.q[i] @ y.q[j].T
            # One cut for the tile, by its largest bounds, then the pair's own bound on what is left.
            bound = x.e[i].max() * y.l[j].max() + y.e[j].max() * x.l[i].max() + x.e[i].max() * y.e[j].max() + EPS
            r, c = np.nonzero(dots >= np.float32((threshold - bound) / (x.s[i].max() * y.s[j].max()) * (1 - 1e-6)) if threshold > bound
                              else np.ones_like(dots, bool))
            if not len(r):
                continue
            r, c = r + a, c + b
            near = x.s[r] * y.s[c] * dots[r - a, c - b].astype(np.float64)
            slack = x.e[r] * y.l[c] + y.e[c] * x.l[r] + x.e[r] * y.e[c] + EPS
            sure, maybe = near - slack >= threshold, np.abs(near - threshold) <= slack
            yield r[sure], c[sure], r[maybe & ~sure], c[maybe & ~sure]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y)


def links_between(x: np.ndarray, y: np.ndarray, threshold: float, tile: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with cosine >= threshold, tile by tile, of vectors at hand."""
    for r, c, open_r, open_c in bounded_pairs(Codes(*quantise(x)), Codes(*quantise(y)), threshold, tile):
        keep = np.zeros(len(open_r), bool)
        for k in range(0, len(open_r), 65536):
            part = slice(k, k + 65536)
            keep[part] = cosines(x[open_r[part]], y[open_c[part]]) >= threshold
        yield np.concatenate([r, open_r[keep]]), np.concatenate([c, open_c[keep]])


def forest(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Root of each of n nodes, and the weight of its links; ``pairs`` are consumed as they come."""
    root, degree = np.arange(n), np.zeros(n, np.int64)
    for r, c in pairs:
        degree += np.bincount(r, weights=weight[c], minlength=n).astype(np.int64)
        degree += np.bincount(c, weights=weight[r], minlength=n).astype(np.int64)
        while len(r):
            low, high = np.minimum(root[r], root[c]), np.maximum(root[r], root[c])
            differ = low != high
            if not differ.any():
                break
            np.minimum.at(root, high[differ], low[differ])
            while not np.array_equal(flat := root[root], root):
                root = flat
            r, c = r[differ], c[differ]
    return root, degree


def node_key() -> Column:
    """md5 of the components; -0.0 and 0.0 are equal."""
    return F.md5(F.concat_ws(",", F.transform("embedding", lambda x: (x.cast("double") + F.lit(0.0)).cast("string"))))


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """Equal usable vectors as one row: ``node, vec_id`` (the smallest), ``copies, embedding``.

    The node is the md5 of the components, so it is the same in every run.
    """
    return vectors.filter(usable("embedding")).groupBy(node_key().alias("node")).agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"),
                                                                            F.min("embedding").alias("embedding"))


def pivots(nodes: DataFrame, block: int, most: int) -> np.ndarray:
    """Unit vectors of the most frequent length, one per block of rows and ``most`` at most: a bounded sample by node key."""
    size = nodes.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if size is None:
        return np.zeros((0, 0))
    rows = (nodes.filter(F.size("embedding") == size["d"]).orderBy("node").select("embedding")
            .limit(min(most, -(-size["n"] // block))).collect())
    return unit([np.array(r[0]) for r in rows])


CODED = ("codes", "scale", "length", "error")


def celled(nodes: DataFrame, centres: np.ndarray) -> DataFrame:
    """``node, copies``, the nearest pivot as ``cell``, the angle to it, and the vector's codes; vectors of another length d get cell -d."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(v, np.float64) for v in batch.column("embedding").to_pylist()]
            cell, angle = np.array([-len(v) for v in vectors], np.int64), np.full(len(vectors), math.pi)
            fits = [i for i, v in enumerate(vectors) if len(v) == centres.shape[1]]
            if fits:
                dots = unit([vectors[i] for i in fits]) @ centres.T
                cell[fits] = dots.argmax(axis=1)
                angle[fits] = np.arccos(np.clip(dots.max(axis=1), -1, 1))
            codes, numbers = [b""] * len(vectors), np.zeros((3, len(vectors)))
            for d in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == d]
                q, *rest = quantise(unit([vectors[i] for i in at]))
                numbers[:, at] = rest
                for i, row in zip(at, q, strict=True):
                    codes[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), pa.array(cell), pa.array(angle), pa.array(codes, pa.binary()),
                                              *map(pa.array, numbers)], names=["node", "copies", "cell", "angle", *CODED])

    return nodes.select("node", "copies", "embedding").mapInArrow(
        nearest, "node string, copies long, cell long, angle double, codes binary, scale double, length double, error double")


def near_cells(cells: list, centres: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of cells that can hold linked vectors: pivots at most the threshold's angle and both cells' own apart."""
    reach = math.acos(min(1.0, threshold)) + 1e-6
    main = sorted((r["cell"], r["angle"]) for r in cells if r["cell"] >= 0)
    out = [(r["cell"], r["cell"]) for r in cells if r["cell"] < 0]
    for i, (a, angle) in enumerate(main):
        rest = np.array([b for b, _ in main[i:]])
        apart = np.arccos(np.clip(centres[rest] @ centres[a], -1, 1))
        close = apart <= angle + np.array([x for _, x in main[i:]]) + reach
        close[0] = True
        out += [(a, int(b)) for b in rest[close]]
    return out


def checked(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """``node, root, links`` of the open pairs (node, root) that reach the threshold in double precision, from both ends."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.asarray(v, np.float64) for v in batch.column(c).to_pylist()] for c in ("x", "y"))
            keep = np.zeros(len(x), bool)
            for d in {len(v) for v in x}:
                at = [i for i, v in enumerate(x) if len(v) == d]
                keep[at] = cosines(unit([x[i] for i in at]), unit([y[i] for i in at])) >= threshold
            yield batch.select(["node", "root", "node_copies", "root_copies"]).filter(pa.array(keep))

    sides = [nodes.select(F.col("node").alias(end), F.col("copies").alias(f"{end}_copies"), F.col("embedding").alias(v))
             for end, v in (("node", "x"), ("root", "y"))]
    kept = pairs.select("node", "root").join(sides[0], "node").join(sides[1], "root").mapInArrow(
        exact, "node string, root string, node_copies long, root_copies long")
    ends = F.explode(F.array(F.struct("node", "root", F.col("root_copies").alias("links")),
                             F.struct(F.col("root").alias("node"), F.col("node").alias("root"), F.col("node_copies").alias("links"))))
    return kept.select(ends.alias("end")).select("end.*")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, block: int = 2048, tile: int = 1024,
                    n_pivots: int = 1024) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    ``n_links`` counts the other vectors at cosine ``threshold`` or above, copies
    included; ``component_id`` is the smallest id reachable by links.  What the
    driver sees is bounded by ``n_pivots``: pivots, cell sizes, pairs of cells.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "embedding")
    nodes = materialize(distinct_vectors(vectors), "embed-nodes")
    centres = pivots(nodes, block, n_pivots)
    placed = materialize(celled(nodes, centres), "embed-cells")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle")).collect()
    parts = {r["cell"]: -(-r["n"] // block) for r in cells}
    near = [(a, b, parts[a], parts[b]) for a, b in near_cells(cells, centres, threshold)]
    # Block i of a cell holds the vectors whose node hash leaves i; a pair of blocks is one task.
    pairs = (spark.createDataFrame(near, "ca long, cb long, na long, nb long")
             .withColumn("ia", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
             .withColumn("ib", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
             .filter("ca < cb OR ia <= ib")
             .select(F.struct("ca", "ia").alias("left"), F.struct("cb", "ib").alias("right")))
    sides = pairs.select("left", "right", F.explode(F.array_distinct(F.array(
        F.struct(F.col("left.ca").alias("cell"), F.col("left.ia").alias("part")),
        F.struct(F.col("right.cb").alias("cell"), F.col("right.ib").alias("part"))))).alias("side")).select("left", "right", "side.*")
    sizes = spark.createDataFrame([(int(c), int(n)) for c, n in parts.items()], "cell long, parts long")
    blocks = placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    # The codes of each vector, a quarter of it, go to the tasks of its block's pairs; the vector itself stays.
    tasks = (blocks.join(sides, ["cell", "part"])
             .select("left", "right", ((F.col("cell") == F.col("left.ca")) & (F.col("part") == F.col("left.ia"))).alias("first"),
                     F.unhex("node").alias("node"), "copies", *CODED))

    def multiply(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["first"].to_numpy()
        rows = pd.concat([rows[own], rows[~own]], ignore_index=True)
        n, split = len(rows), int(own.sum())
        x = Codes(np.stack([np.frombuffer(c, np.int8) for c in rows["codes"]]), *(rows[c].to_numpy() for c in CODED[1:]))
        open_pairs: list[tuple[np.ndarray, np.ndarray]] = []

        def sure() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for r, c, open_r, open_c in bounded_pairs(x[:split], x if split == n else x[split:], threshold, tile):
                if split == n:
                    up, open_up = r < c, open_r < open_c
                    r, c, open_r, open_c = r[up], c[up], open_r[open_up], open_c[open_up]
                else:
                    c, open_c = c + split, open_c + split
                open_pairs.append((open_r, open_c))
                yield r, c

        root, degree = forest(n, sure(), rows["copies"].to_numpy())
        touched = degree > 0
        node = rows["node"].to_numpy()
        linked = pd.DataFrame({"node": node[touched], "other": node[root[touched]], "links": degree[touched], "open": False})
        r, c = (np.concatenate(p) for p in zip(*open_pairs, strict=True)) if open_pairs else (np.zeros(0, int), np.zeros(0, int))
        return pd.concat([linked, pd.DataFrame({"node": node[r], "other": node[c], "links": 0, "open": True})], ignore_index=True)

    tiles = materialize(tasks.groupBy("left", "right").applyInPandas(multiply, "node binary, other binary, links long, open boolean")
                        .select(F.lower(F.hex("node")).alias("node"), F.lower(F.hex("other")).alias("root"), "links", "open"), "embed-tiles")
    found = materialize(tiles.filter("NOT open").drop("open").unionByName(checked(tiles.filter("open"), nodes, threshold)), "embed-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = (nodes.select("node", "vec_id", "copies").join(linked, "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    first = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    per_node = (named.join(first, "component").join(counts, "node", "left")
                .select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), "component_id"))
    return (vectors.select("vec_id", F.when(usable("embedding"), node_key()).alias("node"))
            .join(per_node, "node", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
