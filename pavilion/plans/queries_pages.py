"""Pages: markup, scorecards, leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import strip_tags, url_entity_id
from ..operators import dedup, leaderboards, pages, scorecards
from ..session import materialise
from . import derived
from .adapters import read
from .derived import card_oracle


def _web(s, d, *only):
    return pages.parse_pages(read(s, d, "pages"), "page_id", "html", only)


def _cards(s, d, *only):
    return pages.parse_pages(derived.scorecard_pages(s, d), only=only)


def _meta(s, d, *only):
    return scorecards.with_meta(_cards(s, d, *scorecards.FACTS), *only)


def _sides(s, d):
    return _meta(s, d, *scorecards.TEAM_IDS)


def _entities(s, d, *kinds):
    return scorecards.harvest_entities(_meta(s, d, *scorecards.named_fields(*kinds)), *kinds)


_META_COLUMNS = ["match_id", "title", "tournament_id", "tournament_name", "date", "venue", "ground_id", "format",
                 "team1_id", "team1_name", "team2_id", "team2_name", "toss_winner_id", "toss_decision", "result",
                 "win_margin_runs", "win_margin_wickets", "win_margin_text", "umpire1_id", "umpire2_id", "referee_id",
                 "points"]
_INNINGS_COLUMNS = ["match_id", "innings_number", "batting_team_id", "bowling_team_id", "runs", "wickets", "overs",
                    "extras_b", "extras_lb", "extras_nb", "extras_wd", "extras_total"]
_BAT_COLUMNS = ["match_id", "innings_number", "player_id", "dismissal_text", "runs", "balls", "mins", "fours", "sixes",
                "dots", "strike_rate", "name", "dob"]
_BOWL_COLUMNS = ["match_id", "bowling_team_id", "ordinal", "player_id", "overs", "maidens", "runs", "wickets", "wides",
                 "no_balls", "dots", "fours", "sixes", "econ", "name"]

_BAT_SQL = """
SELECT CAST(k AS VARCHAR) AS match_id, n AS innings_number, c || '0' || n AS player_id, 'c X b Y' AS dismissal_text,
  CASE WHEN st = 'F' THEN 1000 + a ELSE a END AS runs, a * 2 AS balls, CASE WHEN st = 'F' THEN 0 ELSE a END AS mins,
  n AS fours, CAST(c % 5 AS INT) AS sixes, 7 AS dots, CAST(55.25 AS DOUBLE) AS strike_rate, 'Bat ' || c || '-' || n AS name,
  '1 May ' || yr AS dob FROM inns
UNION ALL SELECT CAST(k AS VARCHAR), n, c || '9' || n, 'did not bat', 0, 0, NULL, 0, 0, 0, 0, 'Tail ' || n, NULL FROM inns
UNION ALL SELECT CAST(k AS VARCHAR), n, c || '0' || n, '', 0, 0, NULL, 0, 0, 0, 0, 'Bat', NULL FROM inns WHERE st = 'O'"""

_BOWL_SQL = """
SELECT CAST(k AS VARCHAR) AS match_id, CAST(bowl AS VARCHAR) AS bowling_team_id, CASE WHEN n = 3 THEN 2 ELSE 1 END AS ordinal,
  c || '7' || n AS player_id, CAST(4.3 AS DOUBLE) AS overs, 1 AS maidens, a AS runs, n AS wickets, 0 AS wides, 2 AS no_balls,
  9 AS dots, n AS fours, 0 AS sixes, CAST(CASE WHEN st = 'F' THEN 6.25 ELSE 4.65 END AS DOUBLE) AS econ, 'Bowl ' || n AS name
FROM inns"""


def _attach_batting(s, d):
    tables = materialise(scorecards.innings_tables(_sides(s, d)), "innings_tables", row_group=16 << 20)
    inns = tables.select("match_id", "innings_number", scorecards.innings_key("id"))
    rows = scorecards.attach_batting(scorecards.batting_lines(tables), inns)
    return rows.select("match_id", "innings_number", "player_id", "runs", "innings_id")


def _attach_bowling(mode):
    def run(s, d):
        kept = materialise(scorecards.bowling_with_sides(_sides(s, d)), "bowling")
        rows = scorecards.attach_bowling(kept.drop("_sides"), scorecards.innings_of_sides(kept), mode)
        return rows.select("match_id", "player_id", "bowling_team_id", "ordinal", "innings_number", "innings_id")

    return run


def _in_page(s, d):
    rows = scorecards.bowling_by_innings(_sides(s, d))
    return rows.select("match_id", "player_id", "bowling_team_id", "ordinal", "innings_number", "innings_id")


_KEY = "sha256(CAST({k} AS VARCHAR) || chr(31) || {n}) AS innings_id"


def _players(s, d):
    found = _entities(s, d, "player")
    ordered = found.withColumn("seen", F.struct("match_id", "seen"))
    return dedup.unique_players(ordered).select("id", "name", "dob")


def _teams(s, d):
    found = _entities(s, d, "team", "tournament")
    return dedup.last_wins(found, ["kind", "id"], F.struct("match_id", "seen")).select("kind", "id", "name", "url")


def _url_ids(s, d):
    web = read(s, d, "pages")
    path = F.regexp_replace("url", r"^http://[^/]*", "")
    made = {"player": F.concat(F.lit("/Players/1/2/"), "page_id", F.lit(".html?u="), path),
            "team": F.concat(F.lit("/Teams/7/"), "page_id", F.lit(".html")),
            "tournament": F.concat(F.lit("/Events/"), F.when(F.col("page_id") % 2 == 0, F.concat(
                F.col("page_id").cast("string"), F.lit("/x"))).otherwise(F.concat(F.lit("Cup_"), "page_id",
                                                                                  F.lit(".html")))),
            "ground": path}
    return web.select("page_id", *[url_entity_id(url, kind).alias(kind) for kind, url in made.items()])


def _valid(s, d):
    return pages.valid_pages(_cards(s, d, "n_tables"), 6).select("doc_id", "n_tables")


def _cells(s, d):
    docs = pages.parse_pages(derived.leaderboard_pages(s, d, "batting"))
    return pages.html_cells(docs).select("doc_id", "table_no", "row_no", "cell_no", "text")


_BOARD = "WITH p AS (SELECT *, c_nationkey AS n, c_custkey AS k FROM customer)"

ENTRIES = {
    "html_title": (
        lambda s, d: _web(s, d, "title", "script_title").select("doc_id", pages.page_title().alias("title")),
        """SELECT CAST(page_id AS VARCHAR) AS doc_id,
             trim(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'),
                  '&quot;', '"'), '&amp;', '&')) AS title FROM pages"""),
    "html_links": (
        lambda s, d: pages.html_links(_web(s, d, "pieces", "links")).select("doc_id", "link_no", "href"),
        """SELECT CAST(page_id AS VARCHAR) AS doc_id, CAST(i - 1 AS INT) AS link_no, l[i] AS href
           FROM (SELECT page_id, l, unnest(generate_series(1, len(l))) AS i
                 FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages))"""),
    "strip_tags": (
        lambda s, d: read(s, d, "pages").select("page_id", strip_tags("html").alias("text")),
        "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages"),
    "url_ids": (
        _url_ids,
        """SELECT page_id, CAST(page_id AS VARCHAR) AS player, CAST(page_id AS VARCHAR) AS team,
             CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) ELSE 'Cup_' || page_id END AS tournament,
             nullif(regexp_extract(url, '/Grounds/\\d+/(\\d+)\\.html', 1), '') AS ground FROM pages"""),
    "page_cells": (
        _cells,
        f"""{_BOARD}, r AS (SELECT k, 0 AS t, 0 AS r, ['A', 'B', 'C', 'D', 'Mat'] AS l FROM p
            UNION ALL SELECT k, 0, 1, ['1', '2', '3', '4', '5'] FROM p
            UNION ALL SELECT k, 1, 0, ['Player', 'Span', 'MAT', 'Inns', 'NO', 'Runs', 'HS', 'Ave', 'SR', '100', '4s'] FROM p
            UNION ALL SELECT k, 1, 1, [c_name || '†' || ' (' || CASE WHEN n % 2 = 0 THEN 'India' ELSE 'Long Land Name' END || ')',
              '2001-' || (2000 + n), n::VARCHAR, k::VARCHAR, '-', (k * 3) || '*', n || '*', n || '.5', 'DNB', 'TDNB', ''] FROM p
            UNION ALL SELECT k, 1, 2, ['Total', '', '9'] FROM p UNION ALL SELECT k, 1, 3, ['X', 'short'] FROM p)
            SELECT CAST(k AS VARCHAR) AS doc_id, t AS table_no, r AS row_no, CAST(i - 1 AS INT) AS cell_no, l[i] AS text
            FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM r)"""),
    "valid_pages": (
        _valid, card_oracle("""SELECT CAST(k AS VARCHAR) AS doc_id, 7 AS n_tables FROM cards WHERE st = 'P'""")),
    "match_meta": (
        lambda s, d: scorecards.match_meta(_meta(s, d, *_META_COLUMNS[1:])).select(_META_COLUMNS),
        card_oracle("""SELECT CAST(k AS VARCHAR) AS match_id, CASE WHEN st = 'P' THEN 'Match ' || k ELSE 'Card ' || k END AS title,
          CAST(c AS VARCHAR) AS tournament_id,
          'Cup ' || c || CASE WHEN pr = '5' THEN ' T20' WHEN pr = '4' THEN ' Shield' ELSE '' END AS tournament_name,
          '3rd May ' || yr AS date, 'Ground ' || c AS venue, CAST(c AS VARCHAR) AS ground_id,
          CASE pr WHEN '1' THEN 'T20' WHEN '2' THEN 'List A' WHEN '5' THEN 'T20' ELSE 'First-Class' END AS format,
          CAST(c AS VARCHAR) AS team1_id, 'Side ' || c AS team1_name, CAST(c + 1 AS VARCHAR) AS team2_id,
          'Side ' || (c + 1) AS team2_name, CASE WHEN st = 'F' THEN CAST(c AS VARCHAR) END AS toss_winner_id,
          CASE st WHEN 'F' THEN 'bat' WHEN 'O' THEN 'field' END AS toss_decision,
          CASE st WHEN 'F' THEN 'Side ' || c || ' won by ' || a || ' runs' WHEN 'O' THEN 'Side won by 1 wicket'
            ELSE 'Match drawn' END AS result, CASE WHEN st = 'F' THEN a ELSE 0 END AS win_margin_runs,
          CASE WHEN st = 'O' THEN 1 ELSE 0 END AS win_margin_wickets,
          CASE st WHEN 'F' THEN a || ' runs' WHEN 'O' THEN '1 wickets' END AS win_margin_text,
          c || '80' AS umpire1_id, CASE WHEN st = 'F' THEN c || '81' END AS umpire2_id, CAST(NULL AS VARCHAR) AS referee_id,
          a || '-2' AS points FROM cards""")),
    "innings_totals": (
        lambda s, d: scorecards.innings(_sides(s, d)).select(_INNINGS_COLUMNS),
        card_oracle("""SELECT CAST(k AS VARCHAR) AS match_id, n AS innings_number, CAST(bat AS VARCHAR) AS batting_team_id,
          CAST(bowl AS VARCHAR) AS bowling_team_id, a + 100 AS runs, CASE WHEN st = 'F' THEN 10 ELSE n END AS wickets,
          CASE WHEN st = 'F' THEN '18.4' ELSE '20' END AS overs, 2 AS extras_b, n AS extras_lb, 1 AS extras_nb,
          3 AS extras_wd, 6 + n AS extras_total FROM inns""")),
    "batting_rows": (lambda s, d: scorecards.batting_rows(_sides(s, d)).select(_BAT_COLUMNS), card_oracle(_BAT_SQL)),
    "bowling_rows": (lambda s, d: scorecards.bowling_rows(_sides(s, d)).select(_BOWL_COLUMNS), card_oracle(_BOWL_SQL)),
    "fall_of_wickets": (
        lambda s, d: scorecards.fall_of_wickets(_sides(s, d)).select(
            "match_id", "innings_number", "wicket_num", "score", "player_out_id", "overs"),
        card_oracle("""SELECT CAST(k AS VARCHAR) AS match_id, n AS innings_number, 1 AS wicket_num, a AS score,
          c || '0' || n AS player_out_id, CAST(5.5 AS DOUBLE) AS overs FROM inns
          UNION ALL SELECT CAST(k AS VARCHAR), n, 2, a + 10, c || '9' || n, 9.1 FROM inns
          UNION ALL SELECT CAST(k AS VARCHAR), n, 4, a + 30, NULL, 0 FROM inns WHERE st = 'P'""")),
    "match_notes": (
        lambda s, d: pages.match_notes(_cards(s, d, "notes")).select("doc_id", "note_text"),
        card_oracle("""SELECT CAST(k AS VARCHAR) AS doc_id, 'Match ' || k || ' note' AS note_text FROM cards
          UNION ALL SELECT CAST(k AS VARCHAR), 'Side ' || c || ' rested' FROM cards""")),
    "entity_players": (
        _players,
        card_oracle("""SELECT id, arg_min(name, seen_at) AS name, arg_min(dob, seen_at) AS dob FROM (
            SELECT c || '0' || n AS id, 'Bat ' || c || '-' || n AS name, '1 May ' || yr AS dob, CAST(k AS VARCHAR) AS seen_at
              FROM inns
            UNION ALL SELECT c || '9' || n, 'Tail ' || n, NULL, CAST(k AS VARCHAR) FROM inns
            UNION ALL SELECT c || '7' || n, 'Bowl ' || n, NULL, CAST(k AS VARCHAR) FROM inns
            UNION ALL SELECT c || '80', 'U ' || c, NULL, CAST(k AS VARCHAR) FROM cards
            UNION ALL SELECT c || '81', 'V', NULL, CAST(k AS VARCHAR) FROM cards WHERE st = 'F') GROUP BY id""")),
    "entity_teams": (
        _teams,
        card_oracle("""SELECT kind, CAST(id AS VARCHAR) AS id, arg_max(name, seen_at) AS name, arg_max(url, seen_at) AS url FROM (
            SELECT 'team' AS kind, c AS id, 'Side ' || c AS name, CASE WHEN st = 'P' THEN '/Teams/1/' || c || '/' || c || '.html'
              ELSE '/Teams/1/' || c || '.html' END AS url, CAST(k AS VARCHAR) AS seen_at FROM cards
            UNION ALL SELECT 'team', c + 1, 'Side ' || (c + 1), CASE WHEN st = 'P' THEN '/Teams/1/' || (c + 1) || '.html'
              ELSE '/Teams/1/' || (c + 1) || '/' || (c + 1) || '.html' END, CAST(k AS VARCHAR) FROM cards
            UNION ALL SELECT 'tournament', c, 'Cup ' || c || CASE WHEN pr = '5' THEN ' T20' WHEN pr = '4' THEN ' Shield' ELSE '' END,
              '/Events/' || c || '/Cup.html', CAST(k AS VARCHAR) FROM cards) GROUP BY kind, id""")),
    "attach_batting": (
        _attach_batting,
        card_oracle(f"""SELECT match_id, innings_number, player_id, runs,
          {_KEY.format(k='match_id', n='innings_number')} FROM ({_BAT_SQL.strip()})""")),
    "attach_bowling": (
        _attach_bowling("ordinal"),
        card_oracle(f"""SELECT CAST(k AS VARCHAR) AS match_id, c || '7' || n AS player_id, CAST(bowl AS VARCHAR) AS bowling_team_id,
          CASE WHEN n = 3 THEN 2 ELSE 1 END AS ordinal, n AS innings_number, {_KEY.format(k='k', n='n')} FROM inns""")),
    "bowling_by_innings": (
        _in_page,
        card_oracle(f"""SELECT CAST(k AS VARCHAR) AS match_id, c || '7' || n AS player_id, CAST(bowl AS VARCHAR) AS bowling_team_id,
          CASE WHEN n = 3 THEN 2 ELSE 1 END AS ordinal, n AS innings_number, {_KEY.format(k='k', n='n')} FROM inns""")),
    "attach_bowling_by_team": (
        _attach_bowling("team"),
        card_oracle(f"""SELECT CAST(r.k AS VARCHAR) AS match_id, r.c || '7' || r.n AS player_id,
          CAST(r.bowl AS VARCHAR) AS bowling_team_id, CASE WHEN r.n = 3 THEN 2 ELSE 1 END AS ordinal, i.n AS innings_number,
          {_KEY.format(k='i.k', n='i.n')} FROM inns r JOIN inns i ON r.k = i.k AND r.bowl = i.bowl""")),
    "batting_leaderboard": (
        lambda s, d: leaderboards.batting_leaderboard(pages.parse_pages(
            derived.leaderboard_pages(s, d, "batting"))).drop("row_no"),
        f"""{_BOARD} SELECT CAST(k AS VARCHAR) AS doc_id, replace(c_name, '#', '') AS name, CASE WHEN n % 2 = 0 THEN 'IND' ELSE 'LLN' END AS team,
          '2001-' || (2000 + n) AS span, n || '*' AS highest, n AS matches, CAST(k AS INT) AS innings, 0 AS not_outs,
          CAST(k * 3 AS INT) AS runs, n + CAST(0.5 AS DOUBLE) AS batting_avg, 0 AS balls_faced, CAST(0 AS DOUBLE) AS batting_sr,
          0 AS hundreds, 0 AS fifties, 0 AS fours, 0 AS sixes FROM p"""),
    "bowling_leaderboard": (
        lambda s, d: leaderboards.bowling_leaderboard(pages.parse_pages(
            derived.leaderboard_pages(s, d, "bowling"))).drop("row_no"),
        f"""{_BOARD} SELECT CAST(k AS VARCHAR) AS doc_id, replace(c_name, '#', '') AS name, CASE WHEN n % 2 = 0 THEN 'SL' ELSE 'UNK' END AS team,
          CAST(2000 + n AS VARCHAR) AS span, '3/' || k AS bbi, n AS matches, CAST(k AS INT) AS innings,
          CAST(12.3 AS DOUBLE) AS overs, 1 AS maidens, CAST(k AS INT) AS runs_conceded, n AS wickets,
          CAST(0 AS DOUBLE) AS bowling_avg, CAST(4.25 AS DOUBLE) AS economy, CAST(0 AS DOUBLE) AS bowling_sr,
          2 AS five_wickets, 0 AS ten_wickets FROM p"""),
}
