"""One row per key, by aggregation.

Every rule is a ``min_by`` or ``max_by``: partial results are combined before the shuffle,
so a key that holds a third of all rows sends one candidate per task, not its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.text import as_col, is_blank


def pick_one(df: DataFrame, keys: list[str], order: Column | str, last: bool = False) -> DataFrame:
    """The first (or last) row of each key in the given order."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), as_col(order))
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c)
                                                            for c in df.columns])


def last_wins(df: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """The last row of each key."""
    return pick_one(df, keys, order, last=True)


def unique_players(df: DataFrame, order: str = "seen", key: str = "id") -> DataFrame:
    """The first row of each player, but the first one with a date of birth if there is any."""
    known = df.filter(~is_blank(key))
    return pick_one(known, [key], F.struct(is_blank("dob").alias("_none"), F.col(order).alias("_at")))


def dedup_log(df: DataFrame, line: str = "line_no", id_cols: tuple[str, ...] = ("match_id", "id"),
              source: str | None = None) -> DataFrame:
    """One record per (source, id) of an append-only log.

    The first line stands unless a later one has a strictly longer title that is not a live
    headline. So the result is the longest title among the first line and the lines without
    a live headline, the earliest one on equal length. Only an absent source takes the
    default; one that is there but blank stays blank.

    Lines are picked by their number and length alone; whole records are looked up afterwards.
    """
    ident = F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in id_cols])
    records = df.withColumns({"_id": ident, "_source": F.coalesce("source", F.lit(source))})
    records = records.filter(F.col("_id").isNotNull())
    title = F.coalesce("title", F.lit(""))
    length = F.length(title)
    settled = ~title.contains(fixed.LIVE_TITLE_MARK)
    narrow = records.select("_source", "_id", F.col(line).alias("_line"), length.alias("_len"), settled.alias("_settled"))
    best = narrow.groupBy("_source", "_id").agg(
        F.min_by("_len", "_line").alias("_first_len"), F.min("_line").alias("_first"),
        F.max(F.when(F.col("_settled"), F.col("_len"))).alias("_best_len"),
        F.min(F.when(F.col("_settled"), F.struct((-F.col("_len")).alias("l"), F.col("_line").alias("at")))).alias("_best"))
    picked = F.when(F.col("_best_len") > F.col("_first_len"), F.col("_best.at")).otherwise(F.col("_first"))
    lines = best.select(picked.alias("_line"))
    kept = records.join(lines, records[line] == lines["_line"], "left_semi")
    return kept.select(*[F.col("_source").alias(c) if c == "source" else F.col(c) for c in df.columns], F.col("_id").alias("log_id"))


def prefer_sources(dfs: list[DataFrame], key: str | None = None) -> DataFrame:
    """The first source that has rows, overall or for each key."""
    tagged = [df.withColumn("_rank", F.lit(n)) for n, df in enumerate(dfs)]
    rows = tagged[0]
    for df in tagged[1:]:
        rows = rows.unionByName(df, allowMissingColumns=True)
    if key is None:
        best = rows.select(F.min("_rank")).scalar()
        return rows.filter(F.col("_rank") == best).drop("_rank")
    best = rows.groupBy(key).agg(F.min("_rank").alias("_rank"))
    return rows.join(best, [key, "_rank"], "left_semi").drop("_rank")
