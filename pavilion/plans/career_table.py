"""The career table kept up to date: partial totals a load, merged for the players that a load touches.

``partials/load_id=/part=`` holds the totals that a load's scorecard lines add to each player and format; ``careers/part=`` holds the career
table. Sums add up and best figures are maxima, so the table follows from the partials of the loads that count, and rates are worked out
last. A day's load reads and writes the parts of the players it names, not the history of scorecards.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import careers
from ..sources import commits, layout

#: Folders by hash of the player.
PARTS = 32


def create(spark: SparkSession, root: str) -> None:
    """An empty career table at ``root``."""
    commits.create(spark, root)
    spark.createDataFrame([], f"{careers.PARTIALS}, part int").write.mode("overwrite").parquet(f"{root}/partials/load_id=none/part=0")
    empty = spark.createDataFrame([], f"{schemas.CAREER}, part int")
    empty.write.mode("overwrite").parquet(f"{root}/careers/part=0")


def _partials(spark: SparkSession, root: str, parts: list[int] | None = None) -> DataFrame:
    rows = commits.stored(spark, root, "partials", f"{careers.PARTIALS}, part int")
    return rows if parts is None else rows.where(F.col("part").isin(parts))


def _merged(spark: SparkSession, root: str, some: list[int] | None, parts: int) -> DataFrame:
    """The partials as one row per player and format, which lie by part."""
    return careers.merge_totals(layout.by_part(_partials(spark, root, some).drop("load_id"), parts), "part")


def add(root: str, load_id: str, facts: DataFrame, innings: DataFrame, matches: DataFrame, parts: int = PARTS) -> list[int]:
    """Add the scorecard lines of a load (``careers.career_facts``) and bring the touched parts of the career table up to date; returns these.

    A load that stopped can be run again at any point: its folder is replaced, and the touched parts follow anew from the partials that count. A
    committed load adds nothing.
    """
    spark = facts.sparkSession
    path = f"{root}/partials/load_id={load_id}"
    if not commits.is_known(spark, root, load_id):
        layout.write_parts(careers.partial_totals(facts, innings, matches), path, "player_id", parts)
        commits.commit(spark, root, load_id)
    if load_id not in commits.current(spark, root):
        return []  # merged into another since, which brought all parts up to date
    touched = layout.touched(spark.read.schema(f"{careers.PARTIALS}, part int").parquet(path))
    refresh(spark, root, touched, parts)
    return touched


def refresh(spark: SparkSession, root: str, touched: list[int] | None = None, parts: int = PARTS) -> None:
    """Work out the given parts of the career table (all by default) from the partials, which move once, to their part."""
    if touched == []:
        return
    totals = _merged(spark, root, touched, parts)
    layout.put_parts(careers.with_rates(careers.with_best(totals)).select(*careers.CAREER_COLUMNS, "part"), f"{root}/careers")


def read(spark: SparkSession, root: str) -> DataFrame:
    """The career table as the last load left it."""
    return layout.read_parts(spark, f"{root}/careers", schemas.CAREER).drop("part")


def merge(spark: SparkSession, root: str, parts: int = PARTS) -> str | None:
    """Replace the partials of all loads by one folder; returns its id, None if there is nothing to merge.

    The career table is worked out once more from the merged partials, so that a load that stopped before its parts followed is in it.
    """
    loads = commits.current(spark, root)
    if len(loads) < 2:
        return None
    load_id = "merged-" + hashlib.md5(" ".join(sorted(loads)).encode()).hexdigest()
    _merged(spark, root, None, parts).write.partitionBy("part").mode("overwrite").parquet(f"{root}/partials/load_id={load_id}")
    commits.commit(spark, root, load_id, max(loads.values()), sorted(loads))
    refresh(spark, root, None, parts)
    return load_id
