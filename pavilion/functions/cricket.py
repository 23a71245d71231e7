"""Column functions that know the game: overs, rates, formats, teams, roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed
from .text import (as_col, blank_default, contains_any, first_group, is_blank, literal_lookup,
                   round2, sql_text, strip)

# ---------------------------------------------------------------- overs and rates


def overs_to_balls(overs: Column | str, is_double: bool = False) -> Column:
    """Balls in an O.B figure; NULL or unreadable gives 0.

    Balls after the dot count modulo six. A figure held as a double with one decimal, the
    usual case, is read arithmetically; its text is looked at only when it is something else.
    """
    overs = as_col(overs)
    if is_double:
        digits = overs.cast("string")
        whole, odd = F.split_part(digits, F.lit("."), F.lit(1)), F.split_part(digits, F.lit("."), F.lit(2))
    else:
        parts = F.split(strip(overs), r"\.")
        whole, odd = F.try_element_at(parts, F.lit(1)), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("0"))
    balls = whole.try_cast("bigint") * 6 + odd.try_cast("bigint") % 6
    if is_double:
        tenths = F.floor(overs * 10 + 0.5)
        plain = F.floor(tenths / 10) * 6 + tenths % 10 % 6
        balls = F.when((overs >= 0) & (overs < 1e12) & (tenths / 10 == overs), plain).otherwise(balls)
    return F.coalesce(balls, F.lit(0)).cast("bigint")


def balls_to_overs(balls: Column | str) -> Column:
    """Balls in O.B notation."""
    balls = as_col(balls)
    return (F.floor(balls / 6) * 10 + balls % 6) / F.lit(10.0)


def quotient(top: Column, bottom: Column) -> Column:
    """``ratio`` before it is rounded."""
    return F.when(bottom > 0, top.cast("double") / bottom)


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient with two decimals, NULL when nothing is divided by."""
    return F.when(bottom > 0, round2(top.cast("double") / bottom))


def runs_per_out(runs: Column, innings: Column, not_outs: Column) -> Column:
    """``batting_average`` before it is rounded."""
    outs = innings - not_outs
    return F.when(innings > 0, F.when(outs > 0, runs.cast("double") / outs).otherwise(runs.cast("double")))


def batting_average(runs: Column, innings: Column, not_outs: Column) -> Column:
    """Runs per dismissal; the runs themselves for a player never out."""
    outs = innings - not_outs
    return F.when(innings > 0, F.when(outs > 0, round2(runs.cast("double") / outs))
                  .otherwise(runs.cast("double")))


# ---------------------------------------------------------------- match texts


def _by_words(value: Column, rules: list[tuple[str, list[str]]], other: Column) -> Column:
    chain = F
    for label, words in rules:
        chain = chain.when(contains_any(value, words), F.lit(label))
    return chain.otherwise(other)


def classify_format(venue: Column | str, tournament: Column | str) -> Column:
    """P5: format from the venue line, from the tournament name if that says nothing."""
    by_tournament = _by_words(F.coalesce(as_col(tournament), F.lit("")), fixed.TOURNAMENT_FORMATS, F.lit("Other"))
    return _by_words(F.coalesce(as_col(venue), F.lit("")), fixed.VENUE_FORMATS, by_tournament)


def detect_format(name: Column | str) -> Column:
    """Format from an event name, in any case."""
    return _by_words(F.lower(F.coalesce(as_col(name), F.lit(""))), fixed.EVENT_FORMATS, F.lit("Unknown"))


def extract_date(text: Column | str) -> Column:
    """Date phrase of a venue line, NULL when there is none."""
    return strip(first_group(text, fixed.VENUE_DATE))


def ordinal_date(series: Column | str, venue: Column | str) -> Column:
    """Day-month-year phrase from the series, else from the venue."""
    pattern = fixed.ORDINAL_DATE
    return F.coalesce(first_group(series, pattern), first_group(venue, pattern), F.lit("Date Unknown"))


def parse_date(text: Column | str) -> Column:
    """The day that a date text names, NULL where it names none.

    Ordinal suffixes, commas and further white space don't count, nor does a day of the week in front. Of several days
    ("26th, 27th July 2025", "26-29 July 2025") the first one is meant. Years have four digits.
    """
    plain = strip(F.regexp_replace(F.regexp_replace(as_col(text), fixed.ORDINAL_SUFFIX, "$1"), r"[\s,.]+", " "))
    plain = F.regexp_replace(plain, r"(?i)^(?:mon|tues|wednes|thurs|fri|satur|sun)day ", "")
    plain = F.initcap(plain)
    # several days of one month: the first, with the month and year that follow
    days = r"^(\d{1,2})(?:(?: |-| - | & | And )\d{1,2})+ ([A-Za-z]+ \d{4})$"
    plain = F.regexp_replace(plain, days, "$1 $2")
    spans = r"^(\d{1,2}) ([A-Za-z]+)(?: - | To | & | And )\d{1,2} [A-Za-z]+ (\d{4})$"
    plain = F.regexp_replace(plain, spans, "$1 $2 $3")
    return F.coalesce(*[F.try_to_date(plain, form) for form in fixed.DATE_FORMS])


def toss_decision(text: Column | str) -> Column:
    """Bat before field, NULL if neither is named."""
    low = F.lower(as_col(text))
    return F.when(low.contains("bat"), F.lit("bat")).when(low.contains("field"), F.lit("field"))


def toss_winner(text: Column | str, name1: Column | str, name2: Column | str,
                id1: Column | str, id2: Column | str) -> Column:
    """The first side whose name occurs in the toss line."""
    low = F.lower(as_col(text))

    def named(name):
        return ~is_blank(name) & low.contains(F.lower(as_col(name)))

    return F.when(named(name1), as_col(id1)).when(named(name2), as_col(id2))


def margin_runs(result: Column | str) -> Column:
    """Winning margin in runs."""
    return F.coalesce(first_group(result, fixed.WON_BY_RUNS).try_cast("int"), F.lit(0))


def margin_wickets(result: Column | str) -> Column:
    """Winning margin in wickets, counted only when no runs margin is given."""
    wickets = F.coalesce(first_group(result, fixed.WON_BY_WICKETS).try_cast("int"), F.lit(0))
    return F.when(as_col(result).rlike(fixed.WON_BY_RUNS), F.lit(0)).otherwise(wickets)


def margin_text(result: Column | str) -> Column:
    """Margin as words."""
    runs, wickets = (first_group(result, rf"won by (\d+) {u}") for u in ("run", "wicket"))
    return F.coalesce(F.concat(runs, F.lit(" runs")), F.concat(wickets, F.lit(" wickets")))


def winner_name(result: Column | str, series: Column | str) -> Column:
    """P10: side named before "won"; empty when nobody won."""
    text = blank_default(result, series, F.lit(""))
    return F.when(F.lower(text).contains("won"), strip(F.split_part(text, F.lit("won"), F.lit(1)))) \
        .otherwise(F.lit(""))


def pending_result(result: Column | str, series: Column | str) -> Column:
    """Result text of an archive match, taken from the series when it tells one."""
    low = F.lower(F.coalesce(as_col(series), F.lit("")))
    told = F.when(low.contains("won") | low.contains("draw"), as_col(series)).otherwise(F.lit("Result Pending"))
    return blank_default(result, told)


def season_year(venue: Column | str, series: Column | str) -> Column:
    """First year from 1700 to 2099 in the venue, else in the series."""
    pattern = fixed.SEASON_YEAR
    return F.coalesce(first_group(venue, pattern, 0), first_group(series, pattern, 0))


def dob(tooltip: Column | str) -> Column:
    """Date of birth in a tooltip."""
    return strip(F.replace(first_group(tooltip, fixed.DATE_OF_BIRTH), F.lit("<br>"), F.lit("")))


# ---------------------------------------------------------------- teams and registry


def team_name(value: Column | str) -> Column:
    """Full team name of a short code."""
    text = strip(value)
    return F.when(is_blank(value), F.lit("Unknown")) \
        .otherwise(F.coalesce(literal_lookup(fixed.REGISTRY_TEAMS, text), text))


def match_signature(team1: Column, team2: Column, date: Column, fmt: Column) -> Column:
    """Same key for the same match, whichever side is named first."""
    pair = F.array_sort(F.array(F.lower(team_name(team1)), F.lower(team_name(team2))))
    rest = [F.coalesce(as_col(c).cast("string"), F.lit("None")) for c in (date, fmt)]
    return F.md5(F.concat(F.array_join(pair, "_"), F.lit("_"), rest[0], F.lit("_"), rest[1]))


_TITLED = {k.lower(): v for k, v in fixed.TEAM_CODES.items() if k == k.title()}
_UPPER = {k: v for k, v in fixed.TEAM_CODES.items() if k == k.upper()}

#: code -> display name: the first listed name of more than three letters
CODE_NAMES: dict[str, str] = {}
for _name, _code in fixed.TEAM_CODES.items():
    if len(_name) > 3:
        CODE_NAMES.setdefault(_code, _name)


def team_code(value: Column | str) -> Column:
    """Code of a team name in any usual case; unlisted long names are abbreviated."""
    value = as_col(value)
    code = F.coalesce(literal_lookup(fixed.TEAM_CODES, value), literal_lookup(_TITLED, F.lower(value)),
                      literal_lookup(_UPPER, F.upper(value)), value)
    words = F.filter(F.split(strip(code), r"(?U)\s+"), lambda w: w != "")
    initials = F.array_join(F.transform(F.slice(words, 1, 3), lambda w: F.upper(F.substring(w, 1, 1))), "")
    short = F.when(F.size(words) >= 2, initials).otherwise(F.upper(F.substring(code, 1, 3)))
    return F.when(F.length(code) > 5, short).otherwise(code)




def player_name(label: Column | str) -> Column:
    """Player name of a leaderboard label, marks and team removed."""
    bare = strip(F.regexp_replace(as_col(label), "[†‡*#]", ""))
    return F.when(bare.rlike(fixed.PLAYER_LABEL), strip(F.regexp_extract(bare, fixed.PLAYER_LABEL, 1))).otherwise(bare)


def player_team(label: Column | str, country: Column | str) -> Column:
    """Team of a leaderboard label, else the country column, else UNK."""
    bare = strip(F.regexp_replace(as_col(label), "[†‡*#]", ""))
    land = strip(as_col(country).cast("string"))
    land = F.when(~F.lower(land).isin("nan", "", "none"), land)
    return F.when(bare.rlike(fixed.PLAYER_LABEL), strip(F.regexp_extract(bare, fixed.PLAYER_LABEL, 2))) \
        .otherwise(F.coalesce(land, F.lit("UNK")))


# ---------------------------------------------------------------- player profiles


def player_role(bat_avg: Column, bowl_avg: Column, bat_inns: Column, bowl_inns: Column) -> Column:
    """Role from averages; a discipline counts from three innings on."""
    bats = (bat_inns >= 3) & (bat_avg > 0)
    bowls = (bowl_inns >= 3) & (bowl_avg > 0) & (bowl_avg < 90)
    return (F.when(~bowls, F.lit("Batsman"))
            .when(~bats, F.lit("Bowler"))
            .when((bat_avg >= 25) & (bowl_avg <= 38), F.lit("Allrounder"))
            .when(bat_avg >= 28, F.lit("Batsman"))
            .when(bowl_avg <= 40, F.lit("Bowler"))
            .otherwise(F.lit("Allrounder")))


def is_active(span: Column | str, since: int = 2023) -> Column:
    """Does the last year of a career span reach ``since``?"""
    last = F.element_at(F.split(F.coalesce(as_col(span), F.lit("")), "-"), -1)
    return F.coalesce(first_group(last, r"(\d{4})").try_cast("int") >= since, F.lit(False))


def form_score(active: Column, bat_avg: Column, bowl_avg: Column, bowl_inns: Column) -> Column:
    """Recent form between 0 and 1."""
    base = F.when(active, F.lit(0.55)).otherwise(F.lit(0.25))
    bat = F.when(bat_avg > 45, F.lit(0.20)).when(bat_avg > 35, F.lit(0.12)) \
        .when(bat_avg > 25, F.lit(0.05)).otherwise(F.lit(0.0))
    bowl = F.when((bowl_inns > 10) & (bowl_avg > 0) & (bowl_avg < 25), F.lit(0.10)).otherwise(F.lit(0.0))
    one = F.lit(1.0)
    return round2(F.least(one, F.least(one, base + bat) + bowl))


def known_name(name: Column | str, team: Column | str, names: dict[str, list[str]]) -> Column:
    """J9 for a fixed list: equal to a listed name, or same initial and surname."""
    name = as_col(name)
    listed = F.try_element_at(F.expr(sql_text(names)), as_col(team))

    def fits(known: Column) -> Column:
        surname = F.regexp_extract(known, r"(\S+)$", 1)
        return (name == known) | ((surname != known) & F.endswith(name, surname)
                                  & (F.substring(name, 1, 1) == F.substring(known, 1, 1)))

    return F.coalesce(F.exists(listed, fits), F.lit(False))
