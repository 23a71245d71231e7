"""Pages and JSON documents that Spark derives from the given tables, one per row.

A template is text with ``[[expression]]`` holes; every row of a table fills one, so the
markup and JSON operators get as many documents as the table has rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import prefix_id
from ..schemas import MATCH_JSON
from .adapters import read


def fill(template: str) -> Column:
    """Column that fills the holes of a template with SQL expressions."""
    pieces = re.split(r"\[\[(.*?)\]\]", template, flags=re.S)
    return F.concat(*[F.expr(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(pieces) if p])


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows that are narrow here and become whole documents, always dealt to all shuffle partitions.

    The number is given, or Spark would merge the partitions by what the narrow rows weigh.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


# ---------------------------------------------------------------- scorecard pages from orders

#: what the pages are made of, in SQL that both engines read
CARD_SOURCE = """
    SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, substr(o_orderpriority, 1, 1) AS pr,
           CAST(year(o_orderdate) AS INT) AS yr, CAST(floor(o_totalprice / 1000) AS INT) AS a
    FROM {orders}"""

_META = """<table>
<tr><td></td><td><center><a href="/Events/[[c]]/Cup.html">Cup [[c]][[case when pr = '5' then ' T20' when pr = '4' then ' Shield' else '' end]]</a></center></td></tr>
<tr><td>Match</td><td><center><b><a href="/Teams/1/[[c]]/[[c]].html">Side [[c]]</a> v <a href="/Teams/1/[[c + 1]].html">Side&nbsp;[[c + 1]]</a></b></center></td></tr>
<tr><td>Venue<td><a href="/Grounds/3/[[c]].html"> Ground [[c]] </a> on 3rd May [[yr]] ([[case pr when '1' then '20-over' when '2' then '50-over' when '3' then 'four-day' else 'friendly' end]] match)
<tr><td>Toss</td><td>[[case when st = 'F' then 'SIDE ' || c || ' won the toss and decided to bat' when st = 'O' then 'Uncontested, sides to field' else 'No toss' end]]</td></tr>
<tr><td>Result</td><td>[[case when st = 'F' then 'Side ' || c || ' won by ' || a || ' runs' when st = 'O' then 'Side won by 1 wicket' else 'Match drawn' end]]</td></tr>
<tr><td>Umpires</td><td><a href="/Players/9/[[c]]/[[c]]80.html">U [[c]]</a>[[case when st = 'F' then ', <a href="/Players/9/' || c || '81.html">V</a>' else '' end]]</td></tr>
<tr><td>Points</td><td>[[a]]-2</td></tr></table>"""

_FOW_LIST = """1-[[a]] (<a href="/Players/1/[[c]]0{n}.html">Bat</a>, 5.5 ov), 2-[[a + 10]] (<a href="/Players/1/[[c]]9{n}.html">Tail</a>, 9.1 ov)"""

_INNINGS = """<table><tr><th colspan="9"><a href="/Teams/1/[[c + {side}]]/[[c + {side}]].html">Side [[c + {side}]]</a> innings</th></tr>
<tr><td onmouseover="tip('dob: 1 May [[yr]]<br>')"><a href="/Players/1/[[c]]/[[c]]0{n}.html">Bat [[c]]-{n}</a></td><td> c X b&nbsp;Y</td>
<td>[[case when st = 'F' then '1,' || lpad(a, 3, '0') else string(a) end]]</td><td>[[a * 2]]</td><td>[[case when st = 'F' then '-' else string(a) end]]</td><td>{n}</td><td>[[c % 5]]<td>7<td>55.25</td></tr>
<tr><td><a href="/Players/1/[[c]]9{n}.html">Tail {n}</a><td>did not bat
<tr><td>Extras</td><td>(2 b, {n} lb, 1 nb, 3 w)</td><td>[[6 + {n}]]</td></tr>
<tr><td>Total</td><td>([[case when st = 'F' then 'all out, 18.4 overs' else '{n} wickets, innings closed, 20 overs' end]])</td><td>[[a + 100]]</td></tr>
<tr><td>Fall of wickets:[[case when st = 'O' then '</td></tr><tr><td>' else ' ' end]]""" + _FOW_LIST + """[[case when st = 'P' then ', bye), 4-' || (a + 30) else '' end]]</td></tr></table>"""

_BOWLING = """<table><tr><th><a href="/Teams/1/[[c + {side}]].html">Side [[c + {side}]]</a> bowling</th></tr>
<tr><td><a href="/Players/1/[[c]]7{n}.html">Bowl {n}</a></td><td>4.3</td><td>1</td><td>[[a]]</td><td>{n}</td><td>-</td><td>2</td><td>9</td><td>{n}</td><td>0</td><td>[[case when st = 'F' then '6.25' else '12.5</td><td>4.65' end]]</td></tr></table>"""

_NOTES = """<b>Notes</b><br>--> Match [[k]] note<br><i>--> Side <a href="x">[[c]]</a> rested</i><br>not a note<hr>--> too late"""


def _side(n: int) -> dict:
    bat = 0 if n in (1, 3) else 1
    return {"bat": bat, "bowl": 1 - bat}


_PAGE = ("""<html><head>[[case when st = 'P' then '<title>The Home of CricketArchive</title><script>document.title = "Match ' || k || '";</script>' else '<title> Card ' || k || ' </title>' end]]</head><body>"""
         + _META + "".join(_INNINGS.replace("{side}", str(_side(n)["bat"])).replace("{n}", str(n))
                           + _BOWLING.replace("{side}", str(_side(n)["bowl"])).replace("{n}", str(n)) for n in (1, 2)))
_THIRD = (_INNINGS.replace("{side}", "0") + _BOWLING.replace("{side}", "1")).replace("{n}", "3")


def _cards(spark, sf_dir) -> DataFrame:
    return dealt(spark.sql(CARD_SOURCE, orders=read(spark, sf_dir, "orders")), "k")


def scorecard_pages(spark, sf_dir) -> DataFrame:
    """A scorecard page per order; drawn matches have a third innings."""
    src = _cards(spark, sf_dir)
    third = F.when(F.col("st") == "P", fill(_THIRD)).otherwise(F.lit(""))
    html = F.concat(fill(_PAGE), third, fill(_NOTES), F.lit("</body></html>"))
    return src.select(F.col("k").cast("string").alias("doc_id"), html.alias("content"))


def card_oracle(select: str) -> str:
    """SQL over the facts the pages were made of; ``inns`` has one row per innings."""
    cards = CARD_SOURCE.replace("{orders}", "orders").strip()
    inns = """SELECT *, 1 AS n, c AS bat, c + 1 AS bowl FROM cards UNION ALL SELECT *, 2, c + 1, c FROM cards
              UNION ALL SELECT *, 3, c, c + 1 FROM cards WHERE st = 'P'"""
    return f"WITH cards AS ({cards}), inns AS ({inns}){' ' if select.strip()[0] != ',' else ''}{select.strip()}"


# ---------------------------------------------------------------- leaderboard pages from customers

_BAT_BOARD = """<table><tr><th>A</th><th>B</th><th>C</th><th>D</th><th>Mat</th></tr><tr><td>1</td><td>2</td><td>3</td><td>4</td><td>5</td></tr></table>
<table><thead><tr><th>Player</th><th>Span</th><th>MAT</th><th>Inns</th><th>NO</th><th>Runs</th><th>HS</th><th>Ave</th><th>SR</th><th>100</th><th>4s</th></tr></thead><tbody>
<tr><td>[[c_name]]&dagger; ([[case when c_nationkey % 2 = 0 then 'India' else 'Long Land Name' end]])</td><td>2001-[[2000 + c_nationkey]]</td><td>[[c_nationkey]]</td><td>[[c_custkey]]</td><td>-</td><td>[[c_custkey * 3]]*</td><td>[[c_nationkey]]*</td><td>[[c_nationkey]].5</td><td>DNB</td><td>TDNB</td><td></td></tr>
<tr><td>Total</td><td></td><td>9</td></tr><tr><td>X</td><td>short</td></tr></tbody></table>"""

_BOWL_BOARD = """<table><tr><th>Player</th><th>Country</th><th>Span</th><th>Mat</th><th>Inns</th><th>Balls</th><th>Mdns</th><th>Runs</th><th>Wkts</th><th>BBI</th><th>Ave</th><th>Econ</th><th>SR</th><th>5w</th></tr>
<tr><td>[[c_name]]#</td><td>[[case when c_nationkey % 2 = 0 then 'sri lanka' else 'nan' end]]</td><td>[[2000 + c_nationkey]]</td><td>[[c_nationkey]]</td><td>[[c_custkey]]</td><td>12.3</td><td>1</td><td>[[c_custkey]]</td><td>[[c_nationkey]]</td><td>3/[[c_custkey]]</td><td>nan</td><td>4.25</td><td>-</td><td>2</td></tr>
<tr><td>Overall</td></tr></table>"""


def leaderboard_pages(spark, sf_dir, kind: str) -> DataFrame:
    """A leaderboard page per customer."""
    board = fill(_BAT_BOARD if kind == "batting" else _BOWL_BOARD)
    return dealt(read(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").cast("string").alias("doc_id"),
                                                  board.alias("content"))


# ---------------------------------------------------------------- JSON documents

_MATCH_JSON = """{"info": {"match_type": "T20", "teams": ["T[[c]]"[[case when st = 'F' then ', "T' || (c + 1) || '"' else '' end]]], "dates": ["[[yr]]-01-01", "x"],
[[case when st = 'F' then '"outcome": {"winner": "T' || c || '", "by": {"runs": ' || a || '}},' when st = 'O' then '"outcome": {"result": "tie"},' else '' end]] "city": "C[[c]]"}[[case when st = 'P' then '' else
', "innings": [{"team": "A", "overs": [{"over": 0, "deliveries": [{"batter": "b' || c || '", "bowler": "w", "non_striker": "n", "runs": {"batter": ' || a || ', "extras": 1, "total": ' || (a + 1) || '}},
{"batter": "b2", "runs": {"batter": 0}, "wickets": [{"kind": "bowled", "player_out": "p' || c || '"}, {"kind": "run out", "player_out": "q"}]}]}, {"deliveries": [{}]}]}, {"team": "B"}]' end]]}"""


def match_documents(spark, sf_dir) -> DataFrame:
    """A ball-by-ball document per order, read with the schema of the file scan."""
    src = _cards(spark, sf_dir)
    return src.select(prefix_id("cricsheet_", "k").alias("match_id"),
                      F.from_json(fill(_MATCH_JSON), MATCH_JSON).alias("m")).select("match_id", "m.*")


_EVENT_JSON = """{"id": [[k]], "name": "[[case pr when '1' then 'Greatest Cup' when '2' then 'IPL ' || c when '3' then 'One Day Cup' else 'League' end]]", "date": "[[yr]]-05-01", "season": {"name": "S[[yr]]"},
"competitions": [{"status": {"type": {"state": "[[case when st = 'F' then 'post' else 'in' end]]", "detail": "[[case when st = 'O' then '' else 'Day ' || pr end]]", "description": "Desc"}},
[[case when st = 'P' then '"situation": {"over": 12.3, "lastBattingTeam": {"displayName": "T' || c || '"}},' when st = 'O' and pr = '1' then '"situation": {"odds": 1.5},' else '' end]]
"competitors": [{"team": {"displayName": "T[[c]]", "abbreviation": "A[[c]]"}, "score": "[[a]]", "linescores": [{"runs": [[a]], "wickets": 3, "overs": 20.0}, {"runs": 7}]}[[case when pr = '5' then '' else ', {"team": {"displayName": "U"}, "linescores": [{"wickets": 1}]}' end]]]}]}"""

_SUMMARY_JSON = """{"header": {"competitions": [{"status": {"type": {"detail": "D[[pr]]"}}, "venue": {"fullName": "V[[c]]"}}]},
"rosters": [{"team": {"displayName": "T[[c]]"}, "roster": [{"athlete": {"displayName": "P[[k]]"}, "statistics": [{"type": "batting", "stats": [{"name": "runs", "displayValue": "[[a]]"}, {"name": "runs", "displayValue": "[[a + 1]]"}, {"name": "balls", "displayValue": "9"}]}[[case when st = 'F' then ', {"type": "bowling", "stats": [{"name": "wickets", "displayValue": "' || pr || '"}]}' else '' end]]]}, {"athlete": {"displayName": "Q"}}]}]}"""

_EMBEDDED = """<html><script>no data</script><script [[case when st = 'F' then 'id="__NEXT_DATA__" type="application/json"' else 'type="application/json" nonce="x" id="__NEXT_DATA__"' end]]>{"props": {"pageProps": {"data": {"matches": [{"objectId": [[k]], "title": "M[[k]]", "state": "LIVE", "team1": {"name": "T[[c]]"}}], "events": {"not": "a list"}},
"appData": {"liveMatches": [{"id": "x[[k]]", "name": "N", "status": "done", "statusDetail": "by [[a]]", "ground": {"name": "G[[c]]"}, "format": "ODI"}], "commentary": [{"over": [[pr]], "text": "<b>Four</b> to [[c]]", "runs": 4}, {"text": ""}],
"recentBalls": [{"over": "1.2", "html": "<i>Out</i> [[a]]", "isWicket": true}]}, "content": {"matches": [{"id": 5}]}}}}</script></html>"""


_BOARD = """[[case when st = 'F' then '{"day": 1, "events": [{"id": "e' || k || '"}, {"id": "f' || c || '"}]}' when st = 'O' then '{"events": {"id": "no list"}}' else '{"leagues": [{"id": 1}]}' end]]"""
_ANSWER = """{"[[case when pr = '1' then '{first}' else '{second}' end]]": [{"text": "t[[k]]", "runs": 1}, {"text": "u[[c]]"}][[case when pr = '2' then ', "{first}": []' else '' end]]}"""
ANSWERS = {"board": _BOARD, "answer_a": _ANSWER.replace("{first}", "commentary").replace("{second}", "items"),
           "answer_b": _ANSWER.replace("{first}", "commentaryList").replace("{second}", "comments")}


def order_documents(spark, sf_dir, kind: str) -> DataFrame:
    """A live-feed document per order: event, match summary, a feed's answer, or a page that embeds JSON."""
    template = {"event": _EVENT_JSON, "summary": _SUMMARY_JSON, "embedded": _EMBEDDED, **ANSWERS}[kind]
    src = _cards(spark, sf_dir)
    return src.select(F.col("k").cast("string").alias("doc_id"), fill(template).alias("value"))


_FEED_A = """{"over": {"number": [[user_id]], "ball": 2}, "scoreValue": [[case when event_type = 'view' then 0 else 2 end]], "batsman": {"athlete": {"displayName": "B[[user_id]]"}}, [[case when event_type = 'error' then '"dismissal": {"text": "bowled"}, "isSix": true,' when event_type = 'click' then '"isSix": true,' when event_type = 'signup' then '"isBoundary": true,' else '' end]]
[[case when event_type = 'purchase' then '"shortText": "s' || event_id || '"' else '"text": "t' || event_id || '"' end]]}"""
_FEED_B = """{"overNumber": [[user_id]], "ballNumber": 3, "totalRuns": 1, "bowlerStriker": {"name": "W[[user_id]]"}, [[case when event_type = 'error' then '"isWicket": true, "dismissalText": "lbw", "isBoundary": true,' when event_type = 'click' then '"isBoundary": true,' else '' end]]
[[case when event_type = 'purchase' then '"commentTextItems": [], "text": "t' || event_id || '"' else '"commentTextItems": [{"html": "<p>h' || event_id || '</p>"}, {"html": "no"}]' end]]}"""


def commentary_items(spark, sf_dir, feed: str) -> DataFrame:
    """A commentary item of either feed per event."""
    return read(spark, sf_dir, "events").select("event_id", fill(_FEED_A if feed == "a" else _FEED_B).alias("value"))

