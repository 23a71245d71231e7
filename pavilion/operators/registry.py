"""Match registry: the same game seen by several sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.cricket import match_signature, team_name


def touched(registry: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of a registry that a batch can change: those with the signature of one of its sightings."""
    sign = match_signature(F.col("team1"), F.col("team2"), F.col("date"), F.col("format")).alias("universal_match_id")
    return registry.join(batch.select(sign).distinct(), "universal_match_id", "left_semi")


def register(registry: DataFrame, batch: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """M4: register a batch; returns the new registry and the batch with ``is_new``.

    ``batch`` has team1, team2, date, format, source, source_id and a unique ``order``. A
    signature not yet known makes a row from its first sighting. Every sighting sets the id
    of its own source, the last one wins; other sources change nothing.
    """
    sources = fixed.REGISTRY_SOURCES
    src = F.lower("source")
    at = F.struct(F.lit(1).alias("batch"), F.col(order).alias("order"))
    seen = batch.select(
        match_signature(F.col("team1"), F.col("team2"), F.col("date"), F.col("format")).alias("universal_match_id"),
        team_name("team1").alias("team1"), team_name("team2").alias("team2"),
        F.col("date").cast("string").alias("match_date"), "format", at.alias("_at"),
        *[F.when(src == s, F.col("source_id")).alias(f"{s}_id") for s in sources],
        *[F.when(src == s, at).alias(f"_{s}_at") for s in sources])
    before = F.struct(F.lit(0).alias("batch"), F.lit(None).cast(batch.schema[order].dataType).alias("order"))
    known = registry.withColumns({"_at": before, **{f"_{s}_at": before for s in sources}})
    head = F.struct("team1", "team2", "match_date", "format")
    merged = seen.unionByName(known).groupBy("universal_match_id").agg(
        F.min_by(head, "_at").alias("head"), F.min("_at").alias("_first"),
        *[F.max_by(f"{s}_id", f"_{s}_at").alias(f"{s}_id") for s in sources])
    updated = merged.select("universal_match_id", "head.*", *[f"{s}_id" for s in sources])
    # joined back on the unique order, not on the signature, so copies of one game cause no skew
    new = merged.filter(F.col("_first.batch") == 1).select(F.col("_first.order").alias(order),
                                                           F.lit(True).alias("is_new"))
    return updated, batch.join(new, order, "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))
