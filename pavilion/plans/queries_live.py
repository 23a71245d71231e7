"""Ball-by-ball documents, live feeds and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import live, nested
from ..session import work_dir
from ..sources import scans
from ..streaming import streams
from . import derived
from .adapters import adapt, oracle, read
from .derived import card_oracle


def _matches(s, d):
    return derived.match_documents(s, d)


def _docs(s, d, kind):
    return derived.order_documents(s, d, kind)


def _events(s, d):
    e = live.flatten_events(_docs(s, d, "event"))
    return e.select("match_id", "name", "short_name", "status", "status_detail", F.col("team1.name").alias("team1"),
                    F.col("team1.score").alias("score1"), F.col("team2.name").alias("team2"),
                    F.col("team2.abbreviation").alias("abbr2"), "venue", "series", "start_time", "format",
                    F.col("situation.current_over").alias("over"), F.col("situation.current_batsman").alias("batsman"),
                    F.col("situation.note").alias("note"))


def _rosters(s, d):
    rows = live.roster_stats(_docs(s, d, "summary"), "value", "doc_id")
    return rows.select("doc_id", "name", "team", F.col("batting")["runs"].alias("runs"), F.col("batting")["balls"].alias("balls"),
                       F.col("bowling")["wickets"].alias("wickets"))


def _commentary(feed):
    return lambda s, d: live.normalize_commentary(derived.commentary_items(s, d, feed), feed, "value", "event_id")


def _board(s, d):
    items = live.score_board(_docs(s, d, "board"), "value", "doc_id")
    return items.select("doc_id", "item_no", F.get_json_object("value", "$.id").alias("id"))


def _answer(feed):
    def run(s, d):
        items = live.commentary_answer(_docs(s, d, f"answer_{feed}"), feed, "value", "doc_id")
        return live.normalize_commentary(items, feed, "value", "doc_id", "item_no").select("doc_id", "item_no", "text", "type")

    return run


def _answer_sql(kind):
    return card_oracle(f"""SELECT CAST(k AS VARCHAR) AS doc_id, i AS item_no, CASE i WHEN 0 THEN 't' || k ELSE 'u' || c END AS text,
        '{kind}' AS type FROM cards, (VALUES (0), (1)) v(i) WHERE pr <> '2'""")


def _event_stream(s, d):
    """The events table as a stream of commentary."""
    schema = read(s, d, "events").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return stream.select(F.col("user_id").alias("match_id"), F.when(F.col("event_type") != "error", F.concat(
        "event_type", F.lit(" "), "props")).otherwise(F.lit("")).alias("text"), "value", "event_id",
        F.col("ts").cast("timestamp").alias("ts"))


def _new_commentary(s, d):
    folder = work_dir(s)
    streams.use_disk_state(s)
    rows = streams.new_commentary(_event_stream(s, d), salts=1).select("match_id", "text")
    query = streams.start_append(rows, f"{folder}/rows", f"{folder}/state", availableNow=True)
    query.awaitTermination()
    return s.read.schema(rows.schema).parquet(f"{folder}/rows")


def _latest_scores(s, d):
    folder = work_dir(s)
    streams.use_disk_state(s)
    rows = streams.latest_scores(_event_stream(s, d), ["value", "event_id"], F.struct("ts", "event_id"))
    query = streams.start_changelog(rows, f"{folder}/log", f"{folder}/state", availableNow=True)
    query.awaitTermination()
    return streams.read_changelog(s, f"{folder}/log").select("match_id", "value", "event_id")


_FEED_SQL = """SELECT event_id, CAST(user_id AS VARCHAR) AS over, '{ball}' AS ball, {runs} AS runs, {batsman} AS batsman,
  {bowler} AS bowler, {text} AS text, event_type = 'error' AS is_wicket, {boundary} AS is_boundary,
  CASE WHEN event_type = 'error' THEN '{out}' ELSE '' END AS dismissal, {kind} AS type FROM events"""

ENTRIES = {
    "match_info": (
        lambda s, d: nested.explode_match_info(_matches(s, d)),
        card_oracle("""SELECT 'cricsheet_' || k AS match_id, yr || '-01-01' AS date, 'Unknown' AS venue, 'C' || c AS city,
            'T20' AS format, 'T' || c AS team1, CASE WHEN st = 'F' THEN 'T' || (c + 1) ELSE 'Unknown' END AS team2,
            CASE WHEN st = 'F' THEN 'T' || c END AS winner, CASE WHEN st = 'F' THEN a ELSE 0 END AS win_margin_runs,
            0 AS win_margin_wickets FROM cards""")),
    "explode_deliveries": (
        lambda s, d: nested.explode_deliveries(_matches(s, d)),
        card_oracle("""SELECT sha256('cricsheet_' || k || chr(31) || '0' || chr(31) || o || chr(31) || (ball - 1)) AS delivery_id,
            'cricsheet_' || k AS match_id, 1 AS innings, 0 AS over, ball,
            CASE WHEN o = 1 THEN '' WHEN ball = 1 THEN 'b' || c ELSE 'b2' END AS batter,
            CASE WHEN o = 0 AND ball = 1 THEN 'w' ELSE '' END AS bowler, CASE WHEN o = 0 AND ball = 1 THEN 'n' ELSE '' END AS non_striker,
            CASE WHEN o = 0 AND ball = 1 THEN a ELSE 0 END AS runs_batter, CASE WHEN o = 0 AND ball = 1 THEN 1 ELSE 0 END AS runs_extras,
            CASE WHEN o = 0 AND ball = 1 THEN a + 1 ELSE 0 END AS runs_total, CASE WHEN o = 0 AND ball = 2 THEN 1 ELSE 0 END AS is_wicket,
            CASE WHEN o = 0 AND ball = 2 THEN 'bowled' ELSE '' END AS dismissal_kind,
            CASE WHEN o = 0 AND ball = 2 THEN 'p' || c ELSE '' END AS player_dismissed
            FROM cards, (VALUES (0, 1), (0, 2), (1, 1)) v(o, ball) WHERE st <> 'P'""")),
    "unify_deliveries": (
        lambda s, d: scans.unify_deliveries(adapt(s, d, "ball_by_ball")),
        oracle("""SELECT sha256('ca_' || chr(31) || id) AS delivery_id, 'ca_' || match_id AS match_id, innings, over, ball, batter,
            bowler, non_striker, runs_batter, runs_extras, coalesce(runs_batter, 0) + coalesce(runs_extras, 0) AS runs_total,
            is_wicket, dismissal_kind, player_dismissed FROM ball_by_ball""", "ball_by_ball")),
    "live_events": (
        _events,
        card_oracle("""SELECT CAST(k AS VARCHAR) AS match_id, CASE pr WHEN '1' THEN 'Greatest Cup' WHEN '2' THEN 'IPL ' || c
              WHEN '3' THEN 'One Day Cup' ELSE 'League' END AS name, '' AS short_name,
            CASE WHEN st = 'F' THEN 'post' ELSE 'in' END AS status, CASE WHEN st = 'O' THEN 'Desc' ELSE 'Day ' || pr END AS status_detail,
            'T' || c AS team1, CAST(a AS VARCHAR) AS score1, 'U' AS team2, '' AS abbr2, '' AS venue, 'S' || yr AS series,
            yr || '-05-01' AS start_time, CASE pr WHEN '1' THEN 'Test' WHEN '2' THEN 'T20' WHEN '3' THEN 'ODI' ELSE 'Unknown' END AS format,
            CASE WHEN st = 'P' THEN '12.3' WHEN st = 'O' AND pr = '1' THEN '' END AS over,
            CASE WHEN st = 'P' THEN 'T' || c WHEN st = 'O' AND pr = '1' THEN '' END AS batsman,
            CASE WHEN st = 'P' OR st = 'O' AND pr = '1' THEN '' END AS note FROM cards WHERE pr <> '5'""")),
    "live_linescores": (
        lambda s, d: live.explode_linescores(_docs(s, d, "event")),
        card_oracle("""SELECT CAST(k AS VARCHAR) AS match_id, side, CASE WHEN side = 0 THEN 'A' || c ELSE '' END AS team, i AS innings_num,
            CASE WHEN side = 1 THEN 0 WHEN i = 1 THEN a ELSE 7 END AS runs, CASE WHEN side = 1 THEN 1 WHEN i = 1 THEN 3 ELSE 0 END AS wickets,
            CAST(CASE WHEN side = 0 AND i = 1 THEN 20 ELSE 0 END AS DOUBLE) AS overs
            FROM cards, (VALUES (0, 1), (0, 2), (1, 1)) v(side, i) WHERE pr <> '5'""")),
    "summary_header": (
        lambda s, d: live.summary_header(_docs(s, d, "summary"), "value", "doc_id"),
        card_oracle("SELECT CAST(k AS VARCHAR) AS doc_id, 'D' || pr AS status, 'V' || c AS venue FROM cards")),
    "roster_stats": (
        _rosters,
        card_oracle("""SELECT CAST(k AS VARCHAR) AS doc_id, CASE WHEN i = 0 THEN 'P' || k ELSE 'Q' END AS name, 'T' || c AS team,
            CASE WHEN i = 0 THEN CAST(a + 1 AS VARCHAR) END AS runs, CASE WHEN i = 0 THEN '9' END AS balls,
            CASE WHEN i = 0 AND st = 'F' THEN pr END AS wickets FROM cards, (VALUES (0), (1)) v(i)""")),
    "score_board": (
        _board,
        card_oracle("""SELECT CAST(k AS VARCHAR) AS doc_id, i AS item_no, CASE i WHEN 0 THEN 'e' || k ELSE 'f' || c END AS id
            FROM cards, (VALUES (0), (1)) v(i) WHERE st = 'F'""")),
    "commentary_answer_a": (_answer("a"), _answer_sql("dot")),
    "commentary_answer_b": (_answer("b"), _answer_sql("ball")),
    "embedded_matches": (
        lambda s, d: live.embedded_matches(_docs(s, d, "embedded"), "value", "doc_id"),
        card_oracle("""SELECT CAST(k AS VARCHAR) AS doc_id, i AS item_no, CASE i WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN 'x' || k
              ELSE '5' END AS match_id, CASE i WHEN 0 THEN 'M' || k WHEN 1 THEN 'N' ELSE '' END AS name,
            CASE i WHEN 0 THEN 'LIVE' WHEN 1 THEN 'done' ELSE '' END AS status, CASE i WHEN 1 THEN 'by ' || a ELSE '' END AS status_detail,
            CASE i WHEN 0 THEN 'T' || c ELSE '' END AS team1, '' AS team2, CASE i WHEN 1 THEN 'G' || c ELSE '' END AS venue,
            CASE i WHEN 1 THEN 'ODI' ELSE '' END AS format FROM cards, (VALUES (0), (1), (2)) v(i)""")),
    "embedded_commentary": (
        lambda s, d: live.embedded_commentary(_docs(s, d, "embedded"), "value", "doc_id").drop("item_no"),
        card_oracle("""SELECT CAST(k AS VARCHAR) AS doc_id, CASE i WHEN 0 THEN pr ELSE '1.2' END AS over,
            CASE i WHEN 0 THEN 'Four to ' || c ELSE 'Out ' || a END AS text, CASE i WHEN 0 THEN 4 ELSE 0 END AS runs,
            i = 1 AS is_wicket, CASE i WHEN 0 THEN 'ball' ELSE 'wicket' END AS type FROM cards, (VALUES (0), (1)) v(i)""")),
    "classify_ball": (
        _commentary("a"),
        _FEED_SQL.format(ball=2, runs="CASE WHEN event_type = 'view' THEN 0 ELSE 2 END", batsman="'B' || user_id", bowler="''",
                         text="CASE WHEN event_type = 'purchase' THEN 's' ELSE 't' END || event_id",
                         boundary="event_type IN ('error', 'click', 'signup')", out="bowled",
                         kind="CASE event_type WHEN 'error' THEN 'wicket' WHEN 'click' THEN 'six' WHEN 'signup' THEN 'four' "
                              "WHEN 'view' THEN 'dot' ELSE 'runs' END")),
    "classify_ball_b": (
        _commentary("b"),
        _FEED_SQL.format(ball=3, runs="1", batsman="''", bowler="'W' || user_id",
                         text="CASE WHEN event_type = 'purchase' THEN 't' || event_id ELSE '<p>h' || event_id || '</p>' END",
                         boundary="event_type IN ('error', 'click')", out="lbw",
                         kind="CASE event_type WHEN 'error' THEN 'wicket' WHEN 'click' THEN 'boundary' ELSE 'ball' END")),
    "new_commentary": (
        _new_commentary,
        "SELECT DISTINCT user_id AS match_id, event_type || ' ' || props AS text FROM events WHERE event_type <> 'error'"),
    "latest_scores": (
        _latest_scores,
        """SELECT user_id AS match_id, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id
             ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""),
}
