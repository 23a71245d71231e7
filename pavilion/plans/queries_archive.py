"""Archive queries: lists, search, seasons, status, scorecards."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import archive
from ..session import work_dir
from ..sources import layout
from .adapters import adapt, oracle

_CARD = ("scraped_matches", "scraped_innings", "scraped_fow", "scraped_batting", "scraped_bowling")
_FIELDS = ", ".join(archive.ROW_FIELDS)

_DISPLAY = """*, coalesce(nullif(season, ''), 'Unknown Date') AS date,
  coalesce(nullif(team1, ''), nullif(title, ''), 'Unknown') AS team1_name, coalesce(nullif(team2, ''), '') AS team2_name,
  CASE WHEN lower(coalesce(nullif(result, ''), nullif(series, ''), '')) LIKE '%won%'
       THEN trim(split_part(coalesce(nullif(result, ''), nullif(series, ''), ''), 'won', 1)) ELSE '' END AS winner_name"""

_ROWS = """
rows_all AS (
  SELECT match_id, innings_number, 'batting' AS section, id AS row_id, player_name, dismissal, runs, balls, mins, fours,
         sixes, NULL::INT AS overs, NULL::INT AS maidens, NULL::INT AS wickets, NULL::INT AS wides, NULL::INT AS no_balls
  FROM scraped_batting
  UNION ALL
  SELECT match_id, innings_number, 'bowling', id, player_name, NULL, runs, NULL, NULL, NULL, NULL, overs, maidens,
         wickets, wides, no_balls FROM scraped_bowling)"""

_NULLS = ", ".join(f"CAST(NULL AS {'VARCHAR' if f in ('player_name', 'dismissal') else 'INT'}) AS {f}" for f in archive.ROW_FIELDS)

_BAT_ROW = """match_id, innings_number, 'batting' AS section, id AS row_id, player_name, dismissal, runs, balls, mins, fours, sixes,
  CAST(NULL AS INT) AS overs, CAST(NULL AS INT) AS maidens, CAST(NULL AS INT) AS wickets, CAST(NULL AS INT) AS wides, CAST(NULL AS INT) AS no_balls"""
_BOWL_ROW = """match_id, innings_number, 'bowling' AS section, id AS row_id, player_name, CAST(NULL AS VARCHAR) AS dismissal, runs,
  CAST(NULL AS INT) AS balls, CAST(NULL AS INT) AS mins, CAST(NULL AS INT) AS fours, CAST(NULL AS INT) AS sixes, overs, maidens, wickets, wides, no_balls"""
_LISTED = """(match_id, innings_number) IN (SELECT (i.match_id, i.innings_number) FROM scraped_innings i
  WHERE i.match_id IN (SELECT m.match_id FROM scraped_matches m))"""
_SCORECARD_ROWS = f"""
SELECT {_BAT_ROW}, '' AS fow FROM scraped_batting WHERE {_LISTED}
UNION ALL SELECT {_BOWL_ROW}, '' AS fow FROM scraped_bowling WHERE {_LISTED}
UNION ALL SELECT h.match_id, h.innings_number, 'innings' AS section, CAST(0 AS BIGINT) AS row_id, {_NULLS}, coalesce(f.fow, '') AS fow
  FROM (SELECT DISTINCT i.match_id, i.innings_number FROM scraped_innings i WHERE i.match_id IN (SELECT m.match_id FROM scraped_matches m)) h
  LEFT JOIN (SELECT w.match_id, w.innings_number, arg_max(w.fow_string, w.id) AS fow FROM scraped_fow w GROUP BY w.match_id, w.innings_number) f
    ON h.match_id = f.match_id AND h.innings_number = f.innings_number"""

_HEADS = """
heads AS (SELECT i.match_id, i.innings_number, coalesce(f.fow, '') AS fow
          FROM scraped_innings i LEFT JOIN (SELECT match_id, innings_number, arg_max(fow_string, id) AS fow
            FROM scraped_fow GROUP BY match_id, innings_number) f
          ON i.match_id = f.match_id AND i.innings_number = f.innings_number
          WHERE i.match_id IN (SELECT match_id FROM scraped_matches))"""

_GAPS = """
known AS (SELECT * FROM rows_all WHERE match_id IN (SELECT match_id FROM scraped_matches)),
tops AS (SELECT match_id, max(innings_number) AS top FROM known GROUP BY match_id),
every AS (SELECT match_id, CAST(unnest(generate_series(1, top)) AS INT) AS innings_number FROM tops),
gaps AS (SELECT * FROM every EXCEPT SELECT match_id, innings_number FROM known)"""


def _joined(name: str, *fields: str):
    return F.array_join(F.transform(F.array_sort(name, lambda a, b: F.when(a.id < b.id, -1).when(a.id > b.id, 1)
                                                 .otherwise(a.runs - b.runs)),
                                    lambda r: F.concat_ws(":", *[r[f].cast("string") for f in fields])), ";").alias(name)


_BAT_TEXT, _BOWL_TEXT = ("player_name", "runs", "dismissal"), ("player_name", "wickets", "runs")


def _agg(table: str, fields) -> str:
    return (f"SELECT match_id, innings_number, string_agg({' || chr(58) || '.join(f'CAST({f} AS VARCHAR)' for f in fields)}, "
            f"';' ORDER BY id, runs) AS txt FROM {table} GROUP BY match_id, innings_number")


def _documents(heads: str) -> str:
    return f"""SELECT h.*, coalesce(b.txt, '') AS batting, coalesce(o.txt, '') AS bowling
      FROM {heads} h LEFT JOIN ({_agg('scraped_batting', _BAT_TEXT)}) b
        ON h.match_id = b.match_id AND h.innings_number = b.innings_number
      LEFT JOIN ({_agg('scraped_bowling', _BOWL_TEXT)}) o
        ON h.match_id = o.match_id AND h.innings_number = o.innings_number"""


def _scorecards(s, d):
    docs = archive.scorecards(*adapt(s, d, *_CARD))
    return docs.select("match_id", "innings_number", "fow", _joined("batting", *_BAT_TEXT),
                       _joined("bowling", *_BOWL_TEXT), F.col("match_meta.title").alias("title"))


def _archive_scorecards(s, d):
    m, _, _, bat, bowl = adapt(s, d, *_CARD)
    docs = archive.archive_scorecards(m, bat, bowl)
    return docs.select("match_id", "innings_number", "batting_team", _joined("batting", *_BAT_TEXT),
                       _joined("bowling", *_BOWL_TEXT))


def _innings_text(*head: str):
    """The innings of a match document as one text."""
    item = lambda rows, fields: F.array_join(F.transform(
        F.array_sort(rows, lambda a, b: F.when(a.id < b.id, -1).when(a.id > b.id, 1).otherwise(a.runs - b.runs)),
        lambda r: F.concat_ws(":", *[r[f].cast("string") for f in fields])), ";")
    return F.array_join(F.transform("innings", lambda i: F.concat_ws(
        "|", *[i[h].cast("string") for h in head], item(i.batting, _BAT_TEXT), item(i.bowling, _BOWL_TEXT))), "/").alias("innings")


def _match_scorecards(s, d):
    docs = archive.match_scorecards(*adapt(s, d, *_CARD))
    return docs.select("match_id", F.col("match_meta.title").alias("title"), F.size("innings").alias("n"),
                       _innings_text("innings_number", "fow"))


def _archive_match_scorecards(s, d):
    m, _, _, bat, bowl = adapt(s, d, *_CARD)
    docs = archive.archive_match_scorecards(m, bat, bowl)
    return docs.select("match_id", F.col("metadata.title").alias("title"), F.size("innings").alias("n"),
                       _innings_text("innings_number", "batting_team"))


def _match_documents(head: str) -> str:
    return f"""SELECT m.match_id, m.title, CAST(count(x.match_id) AS INT) AS n,
        coalesce(string_agg(CAST(x.innings_number AS VARCHAR) || '|' || {head} || '|' || x.batting || '|' || x.bowling, '/'
                            ORDER BY x.innings_number), '') AS innings
      FROM scraped_matches m LEFT JOIN docs x ON m.match_id = x.match_id GROUP BY m.match_id, m.title"""


def _archive_rows(s, d):
    m, _, _, bat, bowl = adapt(s, d, *_CARD)
    return archive.archive_scorecard_rows(m, bat, bowl)


def _search(table: str, ident: str, word: str):
    return (lambda s, d: archive.search(adapt(s, d, table), "name", ident, word),
            oracle(f"""SELECT {ident} AS id, name FROM {table} WHERE contains(lower(name), lower('{word}'))
                       ORDER BY name, id LIMIT 10""", table))


def _status(s, d):
    return archive.warehouse_status(*adapt(s, d, "scraped_matches", "progress", "scraped_batting"))


def _rejected(s, d):
    """Rows of innings that no match of five innings has."""
    _, _, _, bat, bowl = adapt(s, d, *_CARD)
    return archive.rejected_rows(bat, bowl, 5)


def laid_out(s, d, *names: str):
    """Adapted tables, written bucketed by match once and read as such."""
    folder = work_dir(s)
    session, tag = layout.co_partitioned(s), uuid.uuid4().hex
    for name, df in zip(names, adapt(s, d, *names)):
        layout.lay_out(df, f"{name}_{tag}", f"{folder}/{name}")
    return [session.table(f"{name}_{tag}") for name in names]


def _laid_out_rows(s, d):
    return archive.scorecard_rows(*laid_out(s, d, *_CARD))


ENTRIES = {
    "recent_matches": (
        lambda s, d: archive.recent_matches(adapt(s, d, "scraped_matches")),
        oracle(f"SELECT {_DISPLAY} FROM scraped_matches ORDER BY match_id DESC LIMIT 12", "scraped_matches")),
    "recent_matches_international": (
        lambda s, d: archive.recent_matches(adapt(s, d, "scraped_matches"), 20, "international"),
        oracle(f"""SELECT {_DISPLAY} FROM scraped_matches WHERE match_category = 'International'
                   ORDER BY match_id DESC LIMIT 20""", "scraped_matches")),
    "winner_name": (
        lambda s, d: archive.with_display_fields(adapt(s, d, "scraped_matches")),
        oracle(f"SELECT {_DISPLAY} FROM scraped_matches", "scraped_matches")),
    "season_matches": (
        lambda s, d: archive.season_matches(adapt(s, d, "scraped_matches"), "1997"),
        oracle(r"""SELECT * EXCLUDE (result), 
            coalesce(nullif(regexp_extract(series, 'on (\d+(?:st|nd|rd|th)? [A-Za-z]+ \d{4})', 1), ''),
                     nullif(regexp_extract(venue, 'on (\d+(?:st|nd|rd|th)? [A-Za-z]+ \d{4})', 1), ''),
                     'Date Unknown') AS date_string, '' AS month_string, 'Match' AS format,
            coalesce(nullif(result, ''), CASE WHEN lower(coalesce(series, '')) LIKE '%won%'
              OR lower(coalesce(series, '')) LIKE '%draw%' THEN series ELSE 'Result Pending' END) AS result
            FROM scraped_matches WHERE venue ILIKE '%1997%' OR series ILIKE '%1997%'""", "scraped_matches")),
    "seasons": (
        lambda s, d: archive.seasons(adapt(s, d, "scraped_matches")),
        oracle(r"""SELECT DISTINCT y AS id, y AS year FROM (SELECT
            coalesce(nullif(regexp_extract(venue, '\b(17|18|19|20)\d{2}\b', 0), ''),
                     nullif(regexp_extract(series, '\b(17|18|19|20)\d{2}\b', 0), '')) AS y FROM scraped_matches)
            WHERE y IS NOT NULL""", "scraped_matches")),
    "match_lookup": (
        lambda s, d: archive.match_by_id(adapt(s, d, "scraped_matches"), 42),
        oracle("SELECT * FROM scraped_matches WHERE match_id = 42", "scraped_matches")),
    "player_search": _search("players", "player_id", "#00000012"),
    "team_search": _search("team_dim", "team_id", "nation_1"),
    "venue_search": _search("venues", "venue_id", "K%SUPP"),
    "warehouse_status": (
        _status,
        oracle("""SELECT (SELECT count(*) FROM scraped_matches) AS total_matches,
                    (SELECT count(*) FROM progress) AS completed_extractions,
                    (SELECT CAST(sum(balls) AS BIGINT) FROM scraped_batting) AS total_balls_delivered,
                    (SELECT count(DISTINCT player_name) FROM scraped_batting) AS total_players""",
               "scraped_matches", "progress", "scraped_batting")),
    "recent_extractions": (
        lambda s, d: archive.recent_extractions(*adapt(s, d, "progress", "scraped_matches")),
        oracle("""SELECT seq, m.match_id, coalesce(nullif(team1, ''), 'Unknown') || ' vs ' ||
                    coalesce(nullif(team2, ''), 'Unknown') || ' (' || coalesce(nullif(season, ''), 'Unknown') || ')' AS label
                  FROM progress p JOIN scraped_matches m ON p.match_id = m.match_id ORDER BY seq DESC LIMIT 10""",
               "progress", "scraped_matches")),
    "scorecard_rows": (
        lambda s, d: archive.scorecard_rows(*adapt(s, d, *_CARD)),
        oracle(_SCORECARD_ROWS, *_CARD)),
    "scorecard_rows_by_match": (_laid_out_rows, oracle(_SCORECARD_ROWS, *_CARD)),
    "rejected_rows": (
        _rejected, oracle(f"""SELECT {_BAT_ROW} FROM scraped_batting WHERE innings_number > 5
            UNION ALL SELECT {_BOWL_ROW} FROM scraped_bowling WHERE innings_number > 5""", *_CARD)),
    "scorecard_documents": (
        _scorecards,
        oracle(f""", {_HEADS.strip()} SELECT x.*, m.title FROM ({_documents('heads')}) x
                 JOIN scraped_matches m ON x.match_id = m.match_id""", *_CARD)),
    "match_scorecard_documents": (
        _match_scorecards,
        oracle(f""", {_HEADS.strip()}, docs AS ({_documents('heads')}) {_match_documents('x.fow')}""", *_CARD)),
    "archive_match_documents": (
        _archive_match_scorecards,
        oracle(f""", {_ROWS.strip()}, {_GAPS.strip()},
            inns AS (SELECT DISTINCT match_id, innings_number FROM known UNION ALL SELECT * FROM gaps),
            labelled AS (SELECT match_id, innings_number, 'Innings ' || CAST(innings_number AS VARCHAR) AS batting_team
                         FROM inns), docs AS ({_documents('labelled')}) {_match_documents('x.batting_team')}""", *_CARD)),
    "archive_scorecard_rows": (
        _archive_rows,
        oracle(f""", {_ROWS.strip()}, {_GAPS.strip()}
            SELECT match_id, innings_number, 'Innings ' || CAST(innings_number AS VARCHAR) AS batting_team, section, row_id,
              {_FIELDS} FROM known
            UNION ALL SELECT match_id, innings_number, 'Innings ' || CAST(innings_number AS VARCHAR), 'empty', NULL, {_NULLS}
              FROM gaps""", *_CARD)),
    "archive_scorecard_documents": (
        _archive_scorecards,
        oracle(f""", {_ROWS.strip()}, {_GAPS.strip()},
            inns AS (SELECT DISTINCT match_id, innings_number FROM known UNION ALL SELECT * FROM gaps),
            labelled AS (SELECT match_id, innings_number, 'Innings ' || CAST(innings_number AS VARCHAR) AS batting_team
                         FROM inns)
            {_documents('labelled')}""", *_CARD)),
}
