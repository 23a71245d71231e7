"""Career statistics and ranked player queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cricket
from ..functions.text import as_col, is_blank, round2

CAREER_COLUMNS = [
    "player_id", "format", "matches", "bat_innings", "bat_runs", "bat_avg", "bat_sr", "highest_score",
    "highest_score_not_out", "fifties", "hundreds", "fours", "sixes", "not_outs", "bowl_innings", "bowl_overs",
    "bowl_maidens", "bowl_runs", "bowl_wickets", "bowl_avg", "bowl_econ", "bowl_sr", "five_wickets",
    "best_bowling_runs", "best_bowling_wickets"]

_NUMBERS = ["runs", "balls", "fours", "sixes", "maidens", "wickets"]


def with_format(card: DataFrame, innings: DataFrame, matches: DataFrame) -> DataFrame:
    """Scorecard rows with the format of their match.

    The two dimension tables are joined first, on two columns each, so the scorecard rows
    move once, and not at all while the dimension fits a broadcast. Rows that know their match meet it directly, and where
    both are bucketed by match (``layout.lay_out``) nothing moves.
    """
    if "match_id" in card.columns:
        return card.join(matches.select("match_id", "format"), "match_id")
    formats = (innings.select(F.col("id").alias("innings_id"), "match_id")
               .join(matches.select("match_id", "format"), "match_id").select("innings_id", "format"))
    return card.join(formats, "innings_id")


def _facts(card: DataFrame, kind: str, **numbers: Column | str) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    given = {n: F.coalesce(as_col(numbers[n]).cast("bigint"), zero) if n in numbers else zero for n in _NUMBERS}
    dismissal = F.coalesce("dismissal_text", F.lit("")) if kind == "bat" else F.lit("")
    place = [c for c in ("innings_id", "match_id") if c in card.columns]
    return card.filter(~is_blank("player_id")).select(
        *place, "player_id", F.lit(kind == "bat").alias("bats"),
        (F.lit(kind == "bat") & (dismissal != "did not bat")).alias("batted"),
        F.lower(dismissal).contains("not out").alias("not_out"), *[v.alias(n) for n, v in given.items()])


def batting_facts(batting: DataFrame) -> DataFrame:
    """batting lines; whoever did not bat took part without an innings."""
    return _facts(batting, "bat", runs="runs", balls="balls", fours="fours", sixes="sixes")


def bowling_facts(bowling: DataFrame) -> DataFrame:
    """Bowling lines with overs as balls."""
    is_double = dict(bowling.dtypes)["overs"] == "double"
    return _facts(bowling, "bowl", runs="runs", balls=cricket.overs_to_balls("overs", is_double),
                  maidens="maidens", wickets="wickets")


#: Totals of a player in a format that add up, and those of which the highest counts.
SUMS = ["matches", "bat_innings", "bat_runs", "bat_balls", "fours", "sixes", "not_outs", "hundreds", "fifties", "bowl_innings", "bowl_balls",
        "bowl_maidens", "bowl_runs", "bowl_wickets", "five_wickets"]
TOPS = ["top_score", "best_bowling"]
PARTIALS = ", ".join(["player_id string, format string", *[f"{c} bigint" for c in [*SUMS, *TOPS]]])


def partial_totals(facts: DataFrame, innings: DataFrame, matches: DataFrame) -> DataFrame:
    """A1–A5 in one aggregation, combined on the map side: totals that merge_totals() can add to others.

    "Best" figures are ordered inside one number, which keeps the aggregation in hashed
    fixed-width buffers: the score doubled, plus one when not out; the wickets in the high
    half of a long, the runs given away subtracted in the low half.
    """
    return _sum_up(with_format(facts, innings, matches.filter(~is_blank("format"))))


def _sum_up(rows: DataFrame) -> DataFrame:
    """``partial_totals`` of facts with their format."""
    bowls, batted = ~F.col("bats"), F.col("batted")
    runs, wickets = F.col("runs"), F.col("wickets")

    def total(value: Column | str, when: Column) -> Column:
        return F.sum(F.when(when, as_col(value)).otherwise(F.lit(0)))

    return rows.groupBy("player_id", "format").agg(
        F.count_if("bats").alias("matches"), F.count_if(batted).alias("bat_innings"),
        total("runs", batted).alias("bat_runs"), total("balls", batted).alias("bat_balls"),
        total("fours", batted).alias("fours"), total("sixes", batted).alias("sixes"),
        F.count_if(batted & F.col("not_out")).alias("not_outs"),
        F.count_if(batted & (runs >= 100)).alias("hundreds"),
        F.count_if(batted & (runs >= 50) & (runs < 100)).alias("fifties"),
        F.count_if(bowls).alias("bowl_innings"), total("balls", bowls).alias("bowl_balls"),
        total("maidens", bowls).alias("bowl_maidens"), total("runs", bowls).alias("bowl_runs"),
        total("wickets", bowls).alias("bowl_wickets"), F.count_if(bowls & (wickets >= 5)).alias("five_wickets"),
        F.max(F.when(batted, runs * 2 + F.col("not_out").cast("int"))).alias("top_score"),
        F.max(F.when(bowls, F.shiftleft(wickets, 32) + (F.lit(2**31 - 1) - runs))).alias("best_bowling"))


def merge_totals(partials: DataFrame, *keep: str) -> DataFrame:
    """Partial totals of several loads as one row per player and format; ``keep`` are columns that follow from these two."""
    return partials.groupBy("player_id", "format", *keep).agg(*[F.sum(c).alias(c) for c in SUMS], *[F.max(c).alias(c) for c in TOPS])


def with_best(totals: DataFrame) -> DataFrame:
    """The best figures taken apart again."""
    top = F.coalesce(F.col("top_score"), F.lit(0))
    return totals.select(
        "*", F.shiftright(top, 1).alias("highest_score"), (top % 2 == 1).alias("highest_score_not_out"),
        F.shiftright("best_bowling", 32).alias("best_bowling_wickets"),
        (F.lit(2**31 - 1) - F.col("best_bowling").bitwiseAND(F.lit(2**32 - 1))).alias("best_bowling_runs"))


def _totals(facts: DataFrame, innings: DataFrame, matches: DataFrame) -> DataFrame:
    return with_best(partial_totals(facts, innings, matches))


def career_facts(batting: DataFrame, bowling: DataFrame) -> DataFrame:
    """Both disciplines stacked."""
    return batting_facts(batting).unionByName(bowling_facts(bowling))


def with_rates(totals: DataFrame) -> DataFrame:
    """Averages, strike rates, economy and overs of career totals.

    Rounding names its value several times, so the quotients are columns of their own first: worked out once, and the code that
    Spark generates for a row stays below the 8,000 bytes up to which the JVM compiles a method.
    """
    c = F.col
    quotients = {
        "bat_avg": cricket.runs_per_out(c("bat_runs"), c("bat_innings"), c("not_outs")),
        "bat_sr": cricket.quotient(c("bat_runs") * F.lit(100.0), c("bat_balls")),
        "bowl_avg": cricket.quotient(c("bowl_runs"), c("bowl_wickets")),
        "bowl_econ": cricket.quotient(c("bowl_runs") * F.lit(6.0), c("bowl_balls")),
        "bowl_sr": cricket.quotient(c("bowl_balls"), c("bowl_wickets"))}
    return totals.withColumns(quotients).withColumns({
        **{name: round2(name) for name in quotients}, "bowl_overs": cricket.balls_to_overs("bowl_balls")})


def career_stats(batting: DataFrame, bowling: DataFrame, innings: DataFrame, matches: DataFrame) -> DataFrame:
    """The career table, one row per player and format.

    Both disciplines are stacked and aggregated together, so there is one join to the
    formats, one shuffle for the totals, and no outer join of two results.
    """
    return with_rates(_totals(career_facts(batting, bowling), innings, matches)).select(CAREER_COLUMNS)


def career_stats_by_match(batting: DataFrame, bowling: DataFrame, matches: DataFrame) -> DataFrame:
    """A6 for scorecard rows that carry their match_id. Of tables bucketed by match only the totals move, once, to their player.

    Each discipline meets the matches on its own, since a union forgets how its parts lie; both are added up together.
    """
    known = matches.filter(~is_blank("format"))
    rows = [with_format(facts, None, known) for facts in (batting_facts(batting), bowling_facts(bowling))]
    return with_rates(with_best(_sum_up(rows[0].unionByName(rows[1])))).select(CAREER_COLUMNS)


def batting_career(batting: DataFrame, innings: DataFrame, matches: DataFrame) -> DataFrame:
    """A1, A3, A5: batting totals, one row per player and format."""
    return _totals(batting_facts(batting), innings, matches).select(
        "player_id", "format", "matches", "bat_innings", "bat_runs", "bat_balls", "fours", "sixes", "not_outs",
        "hundreds", "fifties", "highest_score", "highest_score_not_out")


def bowling_career(bowling: DataFrame, innings: DataFrame, matches: DataFrame) -> DataFrame:
    """A2, A4: bowling totals, one row per player and format."""
    return _totals(bowling_facts(bowling), innings, matches).select(
        "player_id", "format", "bowl_innings", "bowl_balls", "bowl_maidens", "bowl_runs", "bowl_wickets",
        "five_wickets", "best_bowling_wickets", "best_bowling_runs")


def top_by_sum(df: DataFrame, key: str, value: str, total: str, n: int = 10) -> DataFrame:
    """The ``n`` keys with the largest sums; equal sums in key order."""
    sums = df.groupBy(key).agg(F.sum(value).alias(total))
    return sums.orderBy(F.desc_nulls_last(total), key).limit(n)


FILTERS = ("player", "team", "opponent", "venue", "format", "season_from", "season_to", "min_innings")


def player_query(batting: DataFrame, bowling: DataFrame, innings: DataFrame, matches: DataFrame,
                 mode: str, filters: dict | None = None, n: int | None = None) -> DataFrame:
    """A10: players ranked by total runs or wickets under optional filters.

    ``mode`` is "batting" or "bowling"; ``filters`` takes the keys of ``FILTERS``. Filters on
    matches and innings are applied to those tables before any join.
    """
    filters = dict(filters or {})
    unknown = set(filters) - set(FILTERS)
    if mode not in ("batting", "bowling") or unknown:
        raise ValueError(f"unknown mode or filters: {mode}, {sorted(unknown)}")
    own, other = ("batting_team_id", "bowling_team_id") if mode == "batting" else ("bowling_team_id", "batting_team_id")
    tests = {"venue": ("m", lambda v: F.col("venue") == v), "format": ("m", lambda v: F.col("format") == v),
             "season_from": ("m", lambda v: F.col("season") >= v), "season_to": ("m", lambda v: F.col("season") <= v),
             "team": ("i", lambda v: F.col(own) == v), "opponent": ("i", lambda v: F.col(other) == v),
             "player": ("c", lambda v: F.col("player_id") == v)}
    tables = {"m": matches, "i": innings, "c": batting if mode == "batting" else bowling}
    for key, value in filters.items():
        if key in tests:
            which, test = tests[key]
            tables[which] = tables[which].filter(test(value))
    facts = batting_facts(tables["c"]) if mode == "batting" else bowling_facts(tables["c"])
    in_scope = tables["i"].select(F.col("id").alias("innings_id"), "match_id").join(
        tables["m"].select("match_id"), "match_id", "left_semi").select("innings_id")
    rows = facts.join(in_scope, "innings_id", "left_semi").groupBy("player_id")
    c = F.col
    if mode == "batting":
        batted = F.col("batted")
        totals = rows.agg(F.count_if(batted).alias("innings"), F.count_if(batted & c("not_out")).alias("_no"),
                          F.sum(F.when(batted, c("runs")).otherwise(F.lit(0))).alias("total_runs"))
        out = totals.select("player_id", "innings", "total_runs",
                            cricket.batting_average(c("total_runs"), c("innings"), c("_no")).alias("average"))
        rank = "total_runs"
    else:
        totals = rows.agg(F.count("*").alias("innings"), F.sum("wickets").alias("total_wickets"),
                          F.sum("runs").alias("_runs"))
        out = totals.select("player_id", "innings", "total_wickets",
                            cricket.ratio(c("_runs"), c("total_wickets")).alias("bowling_average"))
        rank = "total_wickets"
    out = out.filter(F.col("innings") >= filters.get("min_innings", 0)).orderBy(F.desc(rank), "player_id")
    return out.limit(n) if n else out
