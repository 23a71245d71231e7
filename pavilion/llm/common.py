"""Helpers that several operators share: table reading, batch slicing, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

#: What ``[^\x20\x09-\x0D]+`` leaves out: the only characters that separate words here.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of an Arrow batch. Texts differ much in length; few of them a batch bound what a Python worker and its JVM hold.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends Python at most BATCH_ROWS rows at a time from now on."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``most`` bytes in ``column`` (one row at least)."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): rows (node, component) with the smallest node reachable.

    Large-star and small-star rounds until every node points to one other that points nowhere; a round joins edges with per-node
    minima and is written to the shared folder, so nothing comes to the driver but a count. Nodes
    without a link to another node are left out; loops and repeated edges change nothing.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        pairs = materialise(pairs, "edges")
        roles = pairs.select(F.col("u").alias("node"), F.lit(1).alias("points"), F.lit(0).alias("root")).unionByName(
            pairs.select(F.col("v").alias("node"), F.lit(0).alias("points"), F.lit(1).alias("root")))
        roles = roles.groupBy("node").agg(F.sum("points").alias("points"), F.max("root").alias("root"))
        if not roles.where("points > 1 OR points = 1 AND root = 1").count():
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = least.select("u", F.col("m").alias("v")).unionByName(small).distinct()
