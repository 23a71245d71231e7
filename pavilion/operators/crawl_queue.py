"""Work-queue checks: missing ids, coverage, ranges, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank
from .joins import missing_artifacts, only_new
from .maintenance import transition


def missing_ids(spark: SparkSession, lo: int, hi: int, known: DataFrame, key: str = "ca_match_id") -> DataFrame:
    """Ids from ``lo`` to ``hi`` that are not known yet, as pending rows."""
    every = spark.range(lo, hi + 1).select(F.col("id").cast("string").alias(key))
    return only_new(every, known, key).withColumn("status", F.lit("PENDING"))


def missing_below(bounds: DataFrame, known: DataFrame, key: str = "ca_match_id", block: int = 10_000) -> DataFrame:
    """The same for bounds (lo, hi) that a table tells, one row a range; nothing runs while the plan is built.

    A range is cut into blocks first, so no row holds more than ``block`` ids.
    """
    first = F.explode(F.sequence(F.col("lo"), F.col("hi"), F.lit(block).cast("bigint"))).alias("first")
    blocks = bounds.select(F.col("lo").cast("bigint"), F.col("hi").cast("bigint")).filter("lo <= hi").select("hi", first)
    ids = F.explode(F.sequence(F.col("first"), F.least("hi", F.col("first") + block - 1))).alias("id")
    every = blocks.repartition("first").select(ids).select(F.col("id").cast("string").alias(key))
    return only_new(every, known, key).withColumn("status", F.lit("PENDING"))


def requeue_missing(queue: DataFrame, files: DataFrame, file_id: str = "doc_id") -> DataFrame:
    """M5: fetched rows without a file go back to pending."""
    lost = missing_artifacts(queue, files, file_id=file_id).select("ca_match_id").distinct()
    marked = queue.join(lost.withColumn("_lost", F.lit(True)), "ca_match_id", "left")
    due = F.coalesce("_lost", F.lit(False)) & (F.col("status") == "SUCCESS")
    return transition(marked, due, "PENDING").select(queue.columns)


def id_coverage(df: DataFrame, cols: list[str]) -> DataFrame:
    """How many rows have a value, for each id column."""
    return df.agg(*[F.count_if(~is_blank(F.col(c).cast("string"))).alias(c) for c in cols])


def id_range(df: DataFrame, col: str = "ca_match_id", as_text: bool = False) -> DataFrame:
    """Least and greatest id per status; as text, '999' is greater than '1000'."""
    value = F.col(col) if as_text else F.col(col).try_cast("bigint")
    return df.groupBy("status").agg(F.min(value).alias("min_id"), F.max(value).alias("max_id"))


def id_histogram(df: DataFrame, width: int = 10_000, col: str = "ca_match_id", status: str = "PENDING") -> DataFrame:
    """Pending ids per bucket; ids that are not numbers count as 0."""
    number = F.coalesce(F.col(col).try_cast("bigint"), F.lit(0))
    bucket = number - number % width
    return df.filter(F.col("status") == status).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("cnt"))


def counts_by(df: DataFrame, col: str = "status") -> DataFrame:
    """Rows per value."""
    return df.groupBy(col).agg(F.count("*").alias("cnt"))
