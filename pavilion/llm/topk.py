"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are postings: component d of value w is the posting (row, w) of term d. For a block of queries
a dense score array, queries by rows of a cell, is filled one term at a time: the queries that have
the term scatter weight times posting into it. Each cell returns its best k a query by partition
selection, and the cells' lists are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise

#: Rows of a cell and queries of a block that meet in one task; of these, STEP queries are scored at a time (8 MB of 32 bits).
CELL_ROWS, BLOCK_ROWS, STEP = 8192, 4096, 256
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, vec): floor(scale * x) of every component; rows without a usable vector or without an id are left out.

    Unusable: null, or with a null, NaN or infinite component. An empty vector is usable and scores 0.
    """
    wide = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("wide")).where(
        F.col("vec_id").isNotNull() & F.col("wide").isNotNull() & ~bad)
    # a double holds every floor exactly, also those too large for a long
    return rows.select("vec_id", F.transform("wide", lambda x: F.when(F.abs(x) < 1e15, F.floor(x * F.lit(float(scale))).cast("double"))
                                             .otherwise(x * F.lit(float(scale)))).alias("vec"))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _postings(matrix: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For every term that occurs: (term, rows, weights)."""
    rows = ((d, np.flatnonzero(matrix[:, d])) for d in range(matrix.shape[1]))
    return [(d, at, matrix[at, d]) for d, at in rows if len(at)]


def accumulate(queries: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Scores (queries x rows) of two integer-valued matrices, a term at a time.

    Accumulates in the narrowest type that holds every sum: 32 bits, 64 bits, else Python integers.
    """
    width = min(queries.shape[1], cell.shape[1])
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(cell).max(initial=0)) * max(width, 1)
    if most < 2**31:
        queries, cell = queries.astype(np.int32), cell.astype(np.int32)
    elif most < 2**62:
        queries, cell = queries.astype(np.int64), cell.astype(np.int64)
    else:
        queries, cell = (np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (queries, cell))
    scores = np.zeros((len(queries), len(cell)), dtype=queries.dtype)
    for d, rows, weights in _postings(cell[:, :width]):
        asks = np.flatnonzero(queries[:, d])
        if len(asks) == len(queries) and len(rows) == len(cell):
            scores += queries[:, d, None] * weights[None, :]
        elif len(asks):
            scores[np.ix_(asks, rows)] += queries[asks, d, None] * weights[None, :]
    return scores


def best(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best (id, score) of a score row, ties to the smaller id, without the query itself."""
    valid = np.flatnonzero(ids != own)
    row = scores[valid]
    if len(row) > k:
        least = np.partition(row, len(row) - k)[len(row) - k]
        valid, row = valid[row >= least], row[row >= least]
    order = sorted(range(len(row)), key=lambda i: (-int(row[i]), int(ids[valid[i]])))[:k]
    return [(int(ids[valid[i]]), min(max(int(row[i]), LONG_MIN), LONG_MAX)) for i in order]


def search(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``, the ``k`` other rows of highest integer inner product.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; fewer than k rows give fewer. Rows that
    repeat a vec_id are one name: a query never finds its own name, and a repeated query is answered once, for
    its largest vector in array order. Vectors of different lengths are padded with zeros. Scores beyond a long are its ends. Empty table: no rows.

    The rows are dealt to cells of about ``CELL_ROWS`` and the stated query set to blocks of about ``BLOCK_ROWS``. Each block
    meets each cell in a task of its own, which returns k rows a query. Nothing is broadcast.
    """
    rows = materialise(quantised(vectors, scale), "vectors")
    asks = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("vec").alias("vec"))
    n_cells, n_blocks = max(1, -(-rows.count() // CELL_ROWS)), max(1, -(-asks.count() // BLOCK_ROWS))

    def deal(n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    cells = rows.select(deal(n_cells).alias("cell"), each(n_blocks).alias("block"), "vec_id", "vec", F.lit(False).alias("asks"))
    asks = asks.select(each(n_cells).alias("cell"), deal(n_blocks).alias("block"), "vec_id", "vec", F.lit(True).alias("asks"))

    def score(part: pd.DataFrame) -> pd.DataFrame:
        cell, queries = part[~part["asks"]].sort_values("vec_id"), part[part["asks"]]
        width = int(part["vec"].map(len).max())
        ids, matrix = cell["vec_id"].to_numpy(), _matrix(cell["vec"], width)
        ids, first = np.unique(ids, return_index=True)
        found = []
        for start in range(0, len(queries) if len(ids) else 0, STEP):
            block = queries.iloc[start:start + STEP]
            scores = accumulate(_matrix(block["vec"], width), matrix)
            if len(ids) < len(matrix):  # rows that repeat a vec_id count once, by the better
                scores = np.maximum.reduceat(scores, first, axis=1)
            found += [(q, *hit) for q, row in zip(block["vec_id"], scores) for hit in best(ids, row, q, k)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    found = cells.unionByName(asks).groupBy("cell", "block").applyInPandas(score, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
