"""Table contracts: explicit types for everything that is read or written."""

from __future__ import annotations

from pyspark.sql import types as T


def table(**columns: str) -> str:
    """DDL text of a table, as every reader takes it."""
    return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())


def _strings(*names: str) -> dict[str, str]:
    return {name: "string" for name in names}


TEAMS = table(**_strings("team_id", "name", "url"))
PLAYERS = table(**_strings("player_id", "name", "dob", "url"))
TOURNAMENTS = table(**_strings("tournament_id", "name", "url"))

MATCHES = table(
    **_strings("match_id", "title", "tournament_id", "date", "venue", "ground_id", "format", "team1_id",
               "team2_id", "toss_winner_id", "toss_decision", "result"),
    win_margin_runs="int", win_margin_wickets="int",
    **_strings("win_margin_text", "umpire1_id", "umpire2_id", "tv_umpire_id", "referee_id",
               "reserve_umpire_id", "player_of_match_id", "points"))

INNINGS = table(id="string", match_id="string", innings_number="int", batting_team_id="string",
                bowling_team_id="string", runs="int", wickets="int", overs="string", extras_b="int",
                extras_lb="int", extras_nb="int", extras_wd="int", extras_total="int")

BATTING = table(id="string", innings_id="string", player_id="string", dismissal_text="string", runs="int",
                balls="int", mins="int", fours="int", sixes="int", dots="int", strike_rate="double")

BOWLING = table(id="string", innings_id="string", player_id="string", overs="double", maidens="int",
                runs="int", wickets="int", wides="int", no_balls="int", dots="int", fours="int",
                sixes="int", econ="double")

FALL_OF_WICKETS = table(id="string", innings_id="string", wicket_num="int", score="int",
                        player_out_id="string", overs="double")

MATCH_NOTES = table(**_strings("id", "match_id", "note_text"))

DELIVERIES = table(delivery_id="string", match_id="string", innings="int", over="int", ball="int",
                   batter="string", bowler="string", non_striker="string", runs_batter="int",
                   runs_extras="int", runs_total="int", is_wicket="int", dismissal_kind="string",
                   player_dismissed="string")

BALL_BY_BALL = table(id="bigint", match_id="string", innings="int", over="int", ball="int", batter="string",
                     bowler="string", non_striker="string", runs_batter="int", runs_extras="int",
                     is_wicket="int", dismissal_kind="string", player_dismissed="string")

MATCH_INFO = table(**_strings("match_id", "date", "venue", "city", "format", "team1", "team2", "winner"),
                   win_margin_runs="int", win_margin_wickets="int")

REGISTRY = table(**_strings("universal_match_id", "team1", "team2", "match_date", "format", "ca_id",
                            "cricbuzz_id", "espn_id"))

CRAWL_QUEUE = table(ca_match_id="string", status="string", discovered_at="timestamp")

#: The career table, as careers.CAREER_COLUMNS lists it.
CAREER = table(
    **_strings("player_id", "format"), matches="bigint", bat_innings="bigint", bat_runs="bigint", bat_avg="double", bat_sr="double",
    highest_score="bigint", highest_score_not_out="boolean", fifties="bigint", hundreds="bigint", fours="bigint", sixes="bigint",
    not_outs="bigint", bowl_innings="bigint", bowl_overs="double", bowl_maidens="bigint", bowl_runs="bigint", bowl_wickets="bigint",
    bowl_avg="double", bowl_econ="double", bowl_sr="double", five_wickets="bigint", best_bowling_runs="bigint", best_bowling_wickets="bigint")

HISTORY = table(source="string", match_id="string", id="string", title="string", url="string", status="string")

# --- nested inputs ------------------------------------------------------------------------

_DELIVERY = ("struct<batter:string,bowler:string,non_striker:string,"
             "runs:struct<batter:int,extras:int,total:int>,"
             "wickets:array<struct<kind:string,player_out:string>>>")

MATCH_JSON = table(
    info="struct<match_type:string,teams:array<string>,dates:array<string>,venue:string,city:string,"
         "outcome:struct<winner:string,by:struct<runs:int,wickets:int>>>",
    innings=f"array<struct<team:string,overs:array<struct<over:int,deliveries:array<{_DELIVERY}>>>>>")

PLAYER = ("struct<player_id:string,name:string,team:string,role:string,batting_avg:double,batting_sr:double,"
          "bowling_avg:double,bowling_sr:double,economy:double,recent_form:double,experience:int,"
          "is_captain:boolean,is_wicketkeeper:boolean>")

TEAM_HEAD = "team_id:string,name:string,country:string,format_rankings:map<string,int>,home_advantage:double"
TEAM_LIST_DOC = f"map<string,struct<{TEAM_HEAD},players:array<{PLAYER}>>>"
TEAM_MAP_DOC = f"map<string,struct<{TEAM_HEAD},players:map<string,{PLAYER}>>>"

# --- pages --------------------------------------------------------------------------------


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT, _INT = T.StringType(), T.IntegerType()
#: pieces and links of an element, from and to
_SPAN = {"p0": _INT, "p1": _INT, "l0": _INT, "l1": _INT}

#: what the markup pass returns for a page: every element once, with what is below it as ranges. ``data`` are the cells that are no headings.
#: A text is NULL where an element holds another of its kind, which its ranges tell as well; a header is the text of a table's first row.
PAGE = _struct(
    doc_id=_TEXT, title=_TEXT, script_title=_TEXT, notes=T.ArrayType(_TEXT), n_tables=_INT, pieces=T.ArrayType(_TEXT),
    links=T.ArrayType(_struct(href=_TEXT, p0=_INT, p1=_INT, text=_TEXT)), centers=T.ArrayType(_struct(**_SPAN, text=_TEXT)),
    cells=T.ArrayType(_struct(**_SPAN, m0=_INT, m1=_INT, tag=_TEXT, tooltip=_TEXT)),
    data=T.ArrayType(_struct(**_SPAN, m0=_INT, m1=_INT, text=_TEXT, tooltip=_TEXT)),
    rows=T.ArrayType(_struct(**_SPAN, c0=_INT, c1=_INT, d0=_INT, d1=_INT, deep=T.BooleanType())),
    tables=T.ArrayType(_struct(**_SPAN, r0=_INT, r1=_INT, header=_TEXT)))
