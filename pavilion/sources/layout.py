"""Tables laid out for what is asked of them: by bucket for joins on a key, by hash of a key for changes, by date for ranges."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import as_col
from ..operators.dedup import pick_one
from ..session import materialise

#: Folders of a table that is laid out by a hash of its key. A part should stay within some hundred megabytes, so a large table takes more.
PARTS = 64


# ---------------------------------------------------------------- joins on one key


def lay_out(df: DataFrame, name: str, path: str, key: str = "match_id", buckets: int | None = None) -> None:
    """Write ``df`` as catalog table ``name`` in ``path``, bucketed by ``key``.

    Tables with the same key and number of buckets (the session's shuffle partitions unless given) join without an exchange. Rows are dealt
    to the buckets once, so there is one file a bucket. They are not sorted in it: a join sorts the columns it needs in any case, as Spark does not
    rely on the order of bucketed files, and a bucketed write works out the bucket again at every comparison of its sort.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).mode("overwrite").saveAsTable(name)


def co_partitioned(spark: SparkSession) -> SparkSession:
    """A session over the same catalog in which tables bucketed by a match also join on the match and more.

    By default Spark exchanges both sides of a join on (match, innings) that lie by match alone, to be safe from skew; rows of a match are few.
    """
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.checkpoint.dir"):
        if (value := spark.conf.get(key, None)) and session.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return session


# ---------------------------------------------------------------- changes by key


def part_of(key: str | Sequence[str], parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(*([key] if isinstance(key, str) else key)), F.lit(parts)).cast("int")


def write_parts(df: DataFrame, path: str, key: str | Sequence[str], parts: int = PARTS, spread: str | None = None, files: int = 16) -> None:
    """Write ``df`` with a folder ``part=`` for each remainder of a hash of ``key``.

    Where single keys have a large share of all rows, ``spread`` names a column whose hash deals a part to up to ``files`` tasks.
    """
    rows = df.withColumn("part", part_of(key, parts))
    rows = rows.repartition(parts * files, "part", part_of(spread, files)) if spread else rows.repartition(parts, "part")
    rows.write.partitionBy("part").mode("overwrite").parquet(path)


def read_parts(spark: SparkSession, path: str, schema: str, some: Sequence[int] | None = None) -> DataFrame:
    """The table, or the parts ``some`` of it, of which only the folders are read; with its column ``part``."""
    rows = spark.read.schema(f"{schema}, part int").parquet(path)
    return rows if some is None else rows.where(F.col("part").isin(list(some)))


def touched(rows: DataFrame) -> list[int]:
    """The parts that have a row in ``rows``: as many numbers as a table has parts at most."""
    return sorted(r["part"] for r in rows.select("part").distinct().collect())


def by_part(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """Rows with ``part``, one task a part. A grouping by a key and its ``part`` moves nothing after this."""
    return rows.repartitionById(parts, "part")


def put_parts(rows: DataFrame, path: str) -> None:
    """Write rows that lie by part in the place of their parts; other parts stay as they are.

    ``rows`` must not read the table itself. A run that is stopped on the way may leave some parts new and some old, each whole; the same run
    again finishes it.
    """
    rows.write.option("partitionOverwriteMode", "dynamic").partitionBy("part").mode("overwrite").parquet(path)


def replace_parts(rows: DataFrame, path: str, parts: int = PARTS) -> None:
    """``put_parts`` for rows (with ``part``) that lie anywhere and may read the table itself: they are written elsewhere first."""
    put_parts(by_part(materialise(rows, "parts"), parts), path)


def merge_parts(path: str, schema: str, src: DataFrame, key: str, change: Callable[[DataFrame, DataFrame], DataFrame], parts: int = PARTS) -> list[int]:
    """Change the parts of a table that ``src`` has keys of; returns which.

    ``change`` takes the stored rows of those parts and ``src`` and returns the new content of the parts (``maintenance`` has such functions). Nothing else
    is read or written, so a small batch costs its parts.
    """
    spark = src.sparkSession
    src = materialise(src.withColumn("part", part_of(key, parts)), "changes")
    some = touched(src)
    if some:
        replace_parts(change(read_parts(spark, path, schema, some), src), path, parts)
    return some


def upsert_parts(path: str, schema: str, src: DataFrame, key: str, order: Column | str, parts: int = PARTS) -> list[int]:
    """M2: rows of ``src`` replace the stored ones of the same key, the last one of each key."""
    def change(stored: DataFrame, rows: DataFrame) -> DataFrame:
        latest = pick_one(rows, [key], order, last=True).select(stored.columns)
        return stored.join(latest.select(key), key, "left_anti").select(latest.columns).unionByName(latest)

    return merge_parts(path, schema, src, key, change, parts)


# ---------------------------------------------------------------- ranges


def write_clustered(df: DataFrame, path: str, *by: str) -> None:
    """Write ``df`` in ranges of ``by``, sorted, so that a filter on them skips files and row groups by their minima and maxima."""
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def between(df: DataFrame, col: str, low=None, high=None) -> DataFrame:
    """Rows with ``low <= col <= high``; a bound that is None is none. A range never holds a NULL."""
    tests = [as_col(col) >= F.lit(low)] * (low is not None) + [as_col(col) <= F.lit(high)] * (high is not None)
    for test in tests or [as_col(col).isNotNull()]:
        df = df.where(test)
    return df
