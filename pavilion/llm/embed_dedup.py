"""Near-duplicate vectors by int8 tile products with per-vector error bounds.

A unit vector u is s*q + e: q of int8, s its own scale, |e| known exactly. For two vectors
|u.v - s*t*(q.r)| <= |s*q||f| + |t*r||e| + |e||f|, so a product of two int8 tiles shows which pairs can
reach the threshold at all; only those are computed again in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import components

#: Rows of a block; a task holds two, and a product of SUB x SUB at a time.
BLOCK_ROWS, SUB = 4096, 1024
#: Scaling products in 32 bits and summing unit vectors in 64 is right to less than this; pairs this close below the bound are computed again too.
SLACK = 1e-6
#: Stands for a null vec_id.
LAST = (1 << 63) - 1


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q, s, |s*q|, |e|) of unit rows. q is held as float32: sums of int8 products are exact there below 2**24."""
    scale = np.maximum(np.abs(unit).max(axis=1, initial=0.0), 1e-300) / 127
    q = np.rint(unit / scale[:, None])
    near = q * scale[:, None]
    return q.astype(np.float32), scale, np.linalg.norm(near, axis=1), np.linalg.norm(unit - near, axis=1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows; wide vectors in parts of 1024 components (127 * 127 * 1024 < 2**24)."""
    out = a[:, :1024] @ b[:, :1024].T
    if a.shape[1] > 1024:
        out = out.astype(np.float64)
        for d in range(1024, a.shape[1], 1024):
            out += a[:, d:d + 1024] @ b[:, d:d + 1024].T
    return out


def links(left: np.ndarray, right: np.ndarray, at_least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i of left, j of right) of unit rows with cosine at least ``at_least``; i < j if both are the ``same`` block."""
    ql, qr = quantise(left), quantise(right) if not same else None
    qr = qr or ql
    for i in range(0, len(left), SUB):
        for j in range(i if same else 0, len(right), SUB):
            a, b = slice(i, i + SUB), slice(j, j + SUB)
            near = _product(ql[0][a], qr[0][b])
            near *= ql[1][a, None].astype(near.dtype)
            near *= qr[1][None, b].astype(near.dtype)
            # the block's largest bound first, then each pair's own
            most = ql[2][a].max() * qr[3][b].max() + ql[3][a].max() * qr[2][b].max() + ql[3][a].max() * qr[3][b].max()
            at, to = np.nonzero(near >= at_least - SLACK - most)
            x, y = at + i, to + j
            bound = ql[2][x] * qr[3][y] + ql[3][x] * qr[2][y] + ql[3][x] * qr[3][y]
            keep = near[at, to] + bound >= at_least - SLACK
            if same and i == j:
                keep &= at < to
            at, to = at[keep], to[keep]
            for k in range(0, len(at), 1 << 16):
                x, y = at[k:k + (1 << 16)] + i, to[k:k + (1 << 16)] + j
                hit = np.einsum("ij,ij->i", left[x], right[y]) >= at_least
                if hit.any():
                    yield x[hit], y[hit]


def forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest row that each of n rows reaches over pairs."""
    root = np.arange(n)
    while pairs:
        before = root.copy()
        for x, y in pairs:
            low = np.minimum(root[x], root[y])
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def tile(ids: np.ndarray, copies: np.ndarray, blocks: np.ndarray, unit: np.ndarray, at_least: float, same: bool) -> pa.RecordBatch:
    """A tile's links, summed up: for every linked row its number of partners here and the smallest id it reaches here.

    ``same``: the tile is one block against itself. A tile of two blocks of which one has no rows has no links.
    """
    order = np.lexsort((ids, blocks))
    ids, copies, blocks, unit = ids[order], copies[order], blocks[order], unit[order]
    split = int(np.searchsorted(blocks, blocks[0], side="right"))
    if not same and split == len(blocks):
        split, ids, copies, unit = 0, ids[:0], copies[:0], unit[:0]
    count, pairs = np.zeros(len(ids), dtype=np.int64), []
    offset = 0 if same else split
    for x, y in links(unit[:split], unit if same else unit[split:], at_least, same):
        y = y + offset
        np.add.at(count, x, copies[y])
        np.add.at(count, y, copies[x])
        pairs.append((x, y))
    # forest() gives the smallest row; rows must be in the order of ids for the smallest id
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    by_id = np.sort(ids, kind="stable")
    root = forest(len(ids), [(rank[x], rank[y]) for x, y in pairs])
    at = np.flatnonzero(count)
    return pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(count[at], pa.int64()), pa.array(by_id[root[rank[at]]], pa.int64())],
                                      names=["a", "n", "b"])


def link_vectors(vectors: DataFrame, at_least: float = 0.95, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    Links: all pairs with cosine >= ``at_least`` in double precision, whatever else their rows say. Vectors that are null, empty, zero or
    hold null, NaN or infinite components link with nothing. Vectors of different lengths don't link. Equal vectors are one class,
    compared once and counted as often as they occur, so any number of copies costs one row. A null vec_id sorts after all others and is
    reported as null; rows that repeat a vec_id are one name, so with different vectors they share their links. Empty table: no rows.

    Every block meets every block once, as tiles; a tile returns a row a linked vector, never its pairs. Squares of scaled components
    keep norms finite for the largest doubles.
    """
    # floats travel as floats and are widened where they are compared
    kind = "float" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "double"
    wide = F.transform(F.col("embedding"), lambda x: x.cast(kind))
    bad = F.exists("wide", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("wide", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("wide"))
    rows = rows.withColumn("wide", F.when(~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)), F.col("wide")))
    rows = materialise(rows.withColumn("wide", F.transform("wide", lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x))), "vectors")
    name = F.coalesce("vec_id", F.lit(LAST))
    classes = materialise(rows.where("wide IS NOT NULL").groupBy("wide").agg(F.min(name).alias("rep"), F.count("*").alias("copies")), "classes")
    n_blocks = -(-classes.count() // block_rows) or 1
    block = F.pmod(F.xxhash64("wide"), F.lit(n_blocks)).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("other")
    tiles = classes.select("rep", "copies", "wide", block.alias("block"), others)
    tiles = tiles.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.size("wide").alias("width"),
                         "rep", "copies", "block", "wide")

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        values = table.column("wide").combine_chunks()
        ids = table.column("rep").to_numpy()
        unit = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        unit = unit / np.abs(unit).max(axis=1, keepdims=True)
        unit = unit / np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
        return pa.Table.from_batches([tile(ids, table.column("copies").to_numpy(), table.column("block").to_numpy(), unit, at_least,
                                           key[0].as_py() == key[1].as_py())])

    found = tiles.groupBy("low", "high", "width").applyInArrow(compare, "a long, n long, b long")
    found = materialise(found, "links")
    labels = components(found.select("a", "b")).select(F.col("node").alias("a"), "component")
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    classes = classes.join(counts, classes["rep"] == counts["a"], "left").drop("a")
    classes = classes.join(labels, classes["rep"] == labels["a"], "left").drop("a")
    classes = classes.select(F.col("wide").alias("of"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                             F.coalesce("component", "rep").alias("component"))
    out = rows.join(classes, rows["wide"] == classes["of"], "left")
    component = F.coalesce("component", name)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.when(component != LAST, component).alias("component_id"), (name == component).alias("kept"))
