"""Session settings and the shared folder that intermediate tables go to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on. Everything here is a stock Spark option.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Pages differ a lot in size, so a Python batch is bounded in bytes, not only in rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


def build_session(app: str = "pavilion", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared directory the cluster names.

    ``spark.checkpoint.dir`` is read from the session, and in a local session without that setting the session's
    warehouse. A cluster session without it is an error, because the default warehouse is a folder on one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/pavilion-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table", row_group: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage of a table with many consumers, each of which reads its own columns, and survives lost executors.
    ``row_group``: bytes of a row group; rows that hold whole pages want small ones, since a reader takes up to a group at a time. Such rows are
    thousands of numbers, which take longer to look up in dictionaries than to write, and zstd makes them smaller than dictionaries do.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}"
    writer = df.write
    if row_group:
        writer = writer.options(**{"parquet.block.size": row_group, "parquet.enable.dictionary": "false", "compression": "zstd"})
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
