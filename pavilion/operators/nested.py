"""Ball-by-ball documents: match info and deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import row_key


def explode_match_info(matches: DataFrame) -> DataFrame:
    """One row per match, defaults where the document is silent."""
    info = lambda path, default: F.coalesce(F.col(f"info.{path}"), F.lit(default))
    nth = lambda path, n: F.coalesce(F.try_element_at(F.col(f"info.{path}"), F.lit(n)), F.lit("Unknown"))
    return matches.select(
        "match_id", nth("dates", 1).alias("date"), info("venue", "Unknown").alias("venue"),
        info("city", "Unknown").alias("city"), info("match_type", "Unknown").alias("format"),
        nth("teams", 1).alias("team1"), nth("teams", 2).alias("team2"), F.col("info.outcome.winner").alias("winner"),
        info("outcome.by.runs", 0).alias("win_margin_runs"), info("outcome.by.wickets", 0).alias("win_margin_wickets"))


def explode_deliveries(matches: DataFrame) -> DataFrame:
    """One row per ball.

    The ball number counts every ball of the over, wides and no-balls included; only the
    first wicket of a ball is told. The key is the ball's place in the document.
    """
    inns = matches.select("match_id", F.posexplode("innings").alias("_inn", "i"))
    overs = inns.select("match_id", "_inn", F.posexplode("i.overs").alias("_at", "o"))
    balls = overs.select("match_id", "_inn", "_at", F.col("o.over").alias("_over"),
                         F.posexplode("o.deliveries").alias("_ball", "d"))
    wicket = F.try_element_at("d.wickets", F.lit(1))
    text = lambda c: F.coalesce(c, F.lit(""))
    runs = lambda name: F.coalesce(F.col(f"d.runs.{name}"), F.lit(0))
    fell = F.coalesce(F.size("d.wickets") > 0, F.lit(False))
    return balls.select(
        row_key("match_id", "_inn", "_at", "_ball").alias("delivery_id"), "match_id",
        (F.col("_inn") + 1).alias("innings"), F.coalesce("_over", F.lit(0)).alias("over"),
        (F.col("_ball") + 1).alias("ball"), text(F.col("d.batter")).alias("batter"),
        text(F.col("d.bowler")).alias("bowler"), text(F.col("d.non_striker")).alias("non_striker"),
        runs("batter").alias("runs_batter"), runs("extras").alias("runs_extras"), runs("total").alias("runs_total"),
        fell.cast("int").alias("is_wicket"), text(wicket.kind).alias("dismissal_kind"),
        text(wicket.player_out).alias("player_dismissed"))
