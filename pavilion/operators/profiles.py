"""Player profiles across formats, squads, playing elevens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cricket
from ..functions import fixed_values as fixed
from ..functions.text import as_col, literal_lookup, lookup, round2, slug
from .grouping import PARTS, collect_parts

BAT = ["span", "matches", "innings", "runs", "batting_avg", "batting_sr"]
BOWL = ["span", "matches", "innings", "wickets", "bowling_avg", "bowling_sr", "economy"]


def merge_disciplines(bat: DataFrame, bowl: DataFrame, order: str = "seq") -> DataFrame:
    """Batting and bowling records side by side per (player, team, format).

    Within a discipline the last record of a player counts. Both sides are stacked and
    grouped once, which equals the full outer join of the two without joining anything.
    """
    keys = ["name", "team", "format"]

    def side(df: DataFrame, name: str, fields: list[str], other: str) -> DataFrame:
        return df.select(*keys, F.col(order).alias("_at"), F.struct(*fields).alias(name))

    rows = side(bat, "bat", BAT, "bowl").unionByName(side(bowl, "bowl", BOWL, "bat"), allowMissingColumns=True)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c)
    return rows.groupBy(*keys).agg(last("bat"), last("bowl"))


def weighted_profile(merged: DataFrame) -> DataFrame:
    """Averages over formats weighted by innings, with totals and the latest span."""
    num = lambda path: F.coalesce(as_col(path).cast("double"), F.lit(0.0))
    whole = lambda path: F.coalesce(as_col(path).cast("bigint"), F.lit(0))
    bi, bo = whole("bat.innings"), whole("bowl.innings")
    span = F.greatest(F.coalesce("bat.span", F.lit("")), F.coalesce("bowl.span", F.lit("")))
    totals = merged.groupBy("name", "team").agg(
        F.sum(bi).alias("bat_innings"), F.sum(bo).alias("bowl_innings"),
        F.sum(F.greatest(whole("bat.matches"), whole("bowl.matches"))).alias("experience"),
        F.sum(whole("bat.runs")).alias("total_runs"), F.sum(whole("bowl.wickets")).alias("total_wickets"),
        *[F.sum(num(f"bat.{m}") * bi).alias(f"_{m}") for m in ("batting_avg", "batting_sr")],
        *[F.sum(num(f"bowl.{m}") * bo).alias(f"_{m}") for m in ("bowling_avg", "bowling_sr", "economy")],
        F.max(span).alias("span"))

    def mean(metric: str, innings: str, default: float) -> Column:
        return F.when(F.col(innings) > 0, round2(F.col(f"_{metric}") / F.col(innings))).otherwise(
            F.lit(default)).alias(metric)

    return totals.select(
        "name", "team", "span", "bat_innings", "bowl_innings", "experience", "total_runs", "total_wickets",
        mean("batting_avg", "bat_innings", 0.0), mean("batting_sr", "bat_innings", 0.0),
        mean("bowling_avg", "bowl_innings", 99.0), mean("bowling_sr", "bowl_innings", 0.0),
        mean("economy", "bowl_innings", 6.0))


def drop_unknown_teams(df: DataFrame, team: str = "team") -> DataFrame:
    """rows of a real team."""
    return df.filter(~F.coalesce(F.col(team), F.lit("")).isin("UNK", "UNKNOWN", ""))


def player_profiles(bat: DataFrame, bowl: DataFrame, order: str = "seq", active_since: int = 2023) -> DataFrame:
    """One profile per player and team."""
    p = drop_unknown_teams(weighted_profile(merge_disciplines(bat, bowl, order)))
    c = F.col
    keeper = cricket.known_name("name", "team", fixed.WICKETKEEPERS)
    role = cricket.player_role(c("batting_avg"), c("bowling_avg"), c("bat_innings"), c("bowl_innings"))
    form = cricket.form_score(cricket.is_active("span", active_since), c("batting_avg"), c("bowling_avg"),
                              c("bowl_innings"))
    return p.select(
        slug("name", "team").alias("player_id"), "name", "team",
        F.when(keeper, F.lit("Wicketkeeper")).otherwise(role).alias("role"), "batting_avg", "batting_sr",
        "bowling_avg", "bowling_sr", "economy", form.alias("recent_form"), "experience",
        cricket.known_name("name", "team", fixed.CAPTAINS).alias("is_captain"), keeper.alias("is_wicketkeeper"))


def team_heads(players: DataFrame) -> DataFrame:
    """The teams of a player table with display name and home advantage."""
    return players.select("team").distinct().select(*_team_columns())


def _team_columns() -> list[Column]:
    name = F.coalesce(literal_lookup(cricket.CODE_NAMES, "team"), F.col("team"))
    return [F.col("team").alias("team_id"), name.alias("name"), name.alias("country"),
            F.create_map().cast("map<string,int>").alias("format_rankings"),
            lookup(fixed.HOME_ADVANTAGE, "team", fixed.DEFAULT_HOME_ADVANTAGE).alias("home_advantage")]


def team_rows(players: DataFrame) -> DataFrame:
    """A13, flat: every player with the columns of the team in front; nothing is collected or moved."""
    return players.select(*_team_columns(), *[F.col(c).alias(f"player_{c}" if c in ("name", "team") else c) for c in players.columns])


def team_rollup(players: DataFrame, parts: int = PARTS) -> DataFrame:
    """Teams with their squads as arrays, in a fixed number of parts by a hash of player_id; ``parts=1``: whole squads.

    An array holds a squad's size divided by ``parts``: choose it so that the largest one stays within some thousand players, or
    take team_rows(), which collects nothing.

    Players without a team are a squad of their own, without a team_id.
    """
    squads = collect_parts(players, ["team"], F.struct(*players.columns), "player_id", "players", parts)
    return squads.select(*_team_columns(), "part", "players")


def squad_sizes(players: DataFrame, n: int = 30, team: str = "team") -> DataFrame:
    """The teams with most players."""
    sizes = players.groupBy(team).agg(F.count("*").alias("players"))
    return sizes.orderBy(F.desc("players"), team).limit(n)


def squad_total(players: DataFrame, team: str = "team") -> DataFrame:
    """Number of teams and of players."""
    sizes = players.groupBy(team).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("teams"), F.sum("n").alias("players"))


def playing_xi(players: DataFrame, n: int = 11, order: str = "player_id") -> DataFrame:
    """The ``n`` players of each team in best form.

    Spark turns the rank filter into a limit per team on the map side, so a large squad
    sends no more than ``n`` rows per task.
    """
    best = Window.partitionBy("team").orderBy(F.desc("recent_form"), order)
    return players.withColumn("pick", F.row_number().over(best)).filter(F.col("pick") <= n)


def batters(players: DataFrame) -> DataFrame:
    """players who bat."""
    return players.filter(F.col("role").isin("Batsman", "Allrounder", "Wicketkeeper"))


def bowlers(players: DataFrame) -> DataFrame:
    """players who bowl."""
    return players.filter(F.col("role").isin("Bowler", "Allrounder"))


def conform_players(players: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Players with defaults filled in, and the records that must be rejected."""
    needed = ["player_id", "name", "team"]
    fits = F.coalesce(F.col("role").isin(*fixed.PLAYER_ROLES), F.lit(False))
    for c in needed:
        fits = fits & F.col(c).isNotNull()
    present = {k: v for k, v in fixed.PLAYER_DEFAULTS.items() if k in players.columns}
    absent = {k: F.lit(v) for k, v in fixed.PLAYER_DEFAULTS.items() if k not in players.columns}
    valid = players.filter(fits).fillna(present).withColumns(absent) if absent else players.filter(fits).fillna(present)
    return valid, players.filter(~fits)


def valid_formats(df: DataFrame, col: str = "format") -> DataFrame:
    """Rows whose format is one of the domain."""
    return df.filter(F.col(col).isin(*fixed.MATCH_FORMATS))


def conform_teams(teams: DataFrame) -> DataFrame:
    """Teams with home advantage 0 where none is given."""
    return teams.fillna({"home_advantage": 0.0})
