"""Career statistics, records and ranked player queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import careers
from ..session import work_dir
from ..sources import layout
from .adapters import adapt, oracle

_CARD = ("batting", "bowling", "innings", "matches")

_BAT_ROWS = """
bat AS (SELECT b.*, m.format, coalesce(dismissal_text, '') AS how, coalesce(dismissal_text, '') <> 'did not bat' AS batted
        FROM batting b JOIN innings i ON b.innings_id = i.id JOIN matches m ON i.match_id = m.match_id
        WHERE m.format <> ''),
bat_ranked AS (SELECT *, row_number() OVER (PARTITION BY player_id, format
                 ORDER BY runs DESC, CASE WHEN lower(how) LIKE '%not out%' THEN 0 ELSE 1 END) AS rn
               FROM bat WHERE batted),
bt AS (SELECT player_id, format, count(*) AS matches, count(*) FILTER (batted) AS bat_innings,
         CAST(coalesce(sum(runs) FILTER (batted), 0) AS BIGINT) AS bat_runs,
         CAST(coalesce(sum(balls) FILTER (batted), 0) AS BIGINT) AS bat_balls,
         CAST(coalesce(sum(fours) FILTER (batted), 0) AS BIGINT) AS fours,
         CAST(coalesce(sum(sixes) FILTER (batted), 0) AS BIGINT) AS sixes,
         count(*) FILTER (batted AND lower(how) LIKE '%not out%') AS not_outs,
         count(*) FILTER (batted AND runs >= 100) AS hundreds,
         count(*) FILTER (batted AND runs >= 50 AND runs < 100) AS fifties
       FROM bat GROUP BY player_id, format),
bt2 AS (SELECT bt.*, CAST(coalesce(r.runs, 0) AS BIGINT) AS highest_score,
          coalesce(lower(r.how) LIKE '%not out%', false) AS highest_score_not_out
        FROM bt LEFT JOIN bat_ranked r ON bt.player_id = r.player_id AND bt.format = r.format AND r.rn = 1)"""

_BOWL_ROWS = """
parts AS (SELECT b.*, m.format, split_part(CAST(overs AS VARCHAR), '.', 1) AS p1, split_part(CAST(overs AS VARCHAR), '.', 2) AS p2
          FROM bowling b JOIN innings i ON b.innings_id = i.id JOIN matches m ON i.match_id = m.match_id
          WHERE m.format <> ''),
bowl AS (SELECT *, coalesce(CAST(p1 AS BIGINT) * 6 + CASE WHEN CAST(p2 AS BIGINT) >= 6 THEN CAST(p2 AS BIGINT) % 6
           ELSE CAST(p2 AS BIGINT) END, 0) AS bowled FROM parts),
best AS (SELECT *, row_number() OVER (PARTITION BY player_id, format ORDER BY wickets DESC, runs ASC) AS rn FROM bowl),
bo AS (SELECT player_id, format, count(*) AS bowl_innings, CAST(sum(bowled) AS BIGINT) AS bowl_balls,
         CAST(sum(maidens) AS BIGINT) AS bowl_maidens, CAST(sum(runs) AS BIGINT) AS bowl_runs,
         CAST(sum(wickets) AS BIGINT) AS bowl_wickets, count(*) FILTER (wickets >= 5) AS five_wickets
       FROM bowl GROUP BY player_id, format),
bo2 AS (SELECT bo.*, CAST(b.wickets AS BIGINT) AS best_bowling_wickets, CAST(b.runs AS BIGINT) AS best_bowling_runs
        FROM bo JOIN best b ON bo.player_id = b.player_id AND bo.format = b.format AND b.rn = 1)"""


def round2(value: str) -> str:
    """Two decimals on the exact binary value, as the operators round."""
    return f"CAST(format('{{:.2f}}', CAST({value} AS DOUBLE)) AS DOUBLE)"


def _ratio(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} > 0 THEN {round2(f'CAST({top} AS DOUBLE) / {bottom}')} END"


_CAREER = f"""
, {_BAT_ROWS.strip()}, {_BOWL_ROWS.strip()},
j AS (SELECT coalesce(bt2.player_id, bo2.player_id) AS player_id, coalesce(bt2.format, bo2.format) AS format,
        {', '.join(f'coalesce(bt2.{c}, 0) AS {c}' for c in ('matches', 'bat_innings', 'bat_runs', 'bat_balls', 'fours', 'sixes',
                                                             'not_outs', 'hundreds', 'fifties', 'highest_score'))},
        coalesce(highest_score_not_out, false) AS highest_score_not_out,
        {', '.join(f'coalesce(bo2.{c}, 0) AS {c}' for c in ('bowl_innings', 'bowl_balls', 'bowl_maidens', 'bowl_runs',
                                                             'bowl_wickets', 'five_wickets'))},
        best_bowling_runs, best_bowling_wickets
      FROM bt2 FULL JOIN bo2 ON bt2.player_id = bo2.player_id AND bt2.format = bo2.format)
SELECT player_id, format, matches, bat_innings, bat_runs,
  CASE WHEN bat_innings > 0 THEN CASE WHEN bat_innings > not_outs
    THEN {round2('CAST(bat_runs AS DOUBLE) / (bat_innings - not_outs)')} ELSE CAST(bat_runs AS DOUBLE) END END AS bat_avg,
  {_ratio('bat_runs * CAST(100 AS DOUBLE)', 'bat_balls')} AS bat_sr, highest_score, highest_score_not_out, fifties, hundreds,
  fours, sixes, not_outs, bowl_innings, CAST((bowl_balls // 6) * 10 + bowl_balls % 6 AS DOUBLE) / 10 AS bowl_overs,
  bowl_maidens, bowl_runs, bowl_wickets, {_ratio('bowl_runs', 'bowl_wickets')} AS bowl_avg,
  {_ratio('bowl_runs * CAST(6 AS DOUBLE)', 'bowl_balls')} AS bowl_econ, {_ratio('bowl_balls', 'bowl_wickets')} AS bowl_sr,
  five_wickets, best_bowling_runs, best_bowling_wickets
FROM j"""


def career_stats(spark, sf_dir):
    return careers.career_stats(*adapt(spark, sf_dir, *_CARD))


def _career_by_match(spark, sf_dir):
    """Facts that carry their match, laid out by it together with the matches."""
    bat, bowl, inns, matches = adapt(spark, sf_dir, *_CARD)
    of = inns.select(F.col("id").alias("innings_id"), "match_id")
    folder, session, tag = work_dir(spark), layout.co_partitioned(spark), uuid.uuid4().hex
    tables = {"batting": bat.join(of, "innings_id"), "bowling": bowl.join(of, "innings_id"), "matches": matches}
    for name, df in tables.items():
        layout.lay_out(df, f"{name}_{tag}", f"{folder}/{name}")
    return careers.career_stats_by_match(*[session.table(f"{name}_{tag}") for name in tables])


def _query(mode: str, filters: dict):
    def run(spark, sf_dir):
        bat, bowl, inns, matches = adapt(spark, sf_dir, *_CARD)
        return careers.player_query(bat, bowl, inns, matches, mode, filters)

    return run


_IN_SCOPE_BAT = """
SELECT b.* FROM batting b JOIN innings i ON b.innings_id = i.id JOIN matches m ON i.match_id = m.match_id
WHERE m.venue = 'Ground F' AND m.season >= 1995 AND m.season <= 1998 AND i.bowling_team_id = 'T3'"""

ENTRIES = {
    "career_stats": (career_stats, oracle(_CAREER, *_CARD)),
    "career_stats_by_match": (_career_by_match, oracle(_CAREER, *_CARD)),
    "batting_career": (
        lambda s, d: careers.batting_career(*adapt(s, d, "batting", "innings", "matches")),
        oracle(f""", {_BAT_ROWS.strip()} SELECT player_id, format, matches, bat_innings, bat_runs, bat_balls, fours, sixes,
              not_outs, hundreds, fifties, highest_score, highest_score_not_out FROM bt2""", "batting", "innings", "matches")),
    "bowling_career": (
        lambda s, d: careers.bowling_career(*adapt(s, d, "bowling", "innings", "matches")),
        oracle(f""", {_BOWL_ROWS.strip()} SELECT player_id, format, bowl_innings, bowl_balls, bowl_maidens, bowl_runs,
              bowl_wickets, five_wickets, best_bowling_wickets, best_bowling_runs FROM bo2""",
              "bowling", "innings", "matches")),
    "top_run_scorers": (
        lambda s, d: careers.top_by_sum(adapt(s, d, "scraped_batting"), "player_name", "runs", "total_runs"),
        oracle("""SELECT player_name, CAST(sum(runs) AS BIGINT) AS total_runs FROM scraped_batting
                  GROUP BY player_name ORDER BY total_runs DESC, player_name LIMIT 10""", "scraped_batting")),
    "top_wicket_takers": (
        lambda s, d: careers.top_by_sum(adapt(s, d, "scraped_bowling"), "player_name", "wickets", "total_wickets"),
        oracle("""SELECT player_name, CAST(sum(wickets) AS BIGINT) AS total_wickets FROM scraped_bowling
                  GROUP BY player_name ORDER BY total_wickets DESC, player_name LIMIT 10""", "scraped_bowling")),
    "player_query_batting": (
        _query("batting", {"venue": "Ground F", "season_from": 1995, "season_to": 1998, "opponent": "T3"}),
        oracle(f"""SELECT player_id, innings, total_runs, CASE WHEN innings > 0 THEN CASE WHEN innings > outs
                     THEN {round2('CAST(total_runs AS DOUBLE) / (innings - outs)')} ELSE CAST(total_runs AS DOUBLE) END END
                     AS average
                   FROM (SELECT player_id, count(*) FILTER (batted) AS innings,
                           count(*) FILTER (batted AND lower(how) LIKE '%not out%') AS outs,
                           CAST(coalesce(sum(runs) FILTER (batted), 0) AS BIGINT) AS total_runs
                         FROM (SELECT *, coalesce(dismissal_text, '') AS how,
                                 coalesce(dismissal_text, '') <> 'did not bat' AS batted FROM ({_IN_SCOPE_BAT}))
                         GROUP BY player_id)""", "batting", "innings", "matches")),
    "player_query_bowling": (
        _query("bowling", {"format": "5-LOW", "team": "T5", "min_innings": 2}),
        oracle(f"""SELECT player_id, innings, total_wickets, {_ratio('given', 'total_wickets')} AS bowling_average
                   FROM (SELECT player_id, count(*) AS innings, CAST(sum(wickets) AS BIGINT) AS total_wickets,
                           CAST(sum(runs) AS BIGINT) AS given
                         FROM bowling b JOIN innings i ON b.innings_id = i.id JOIN matches m ON i.match_id = m.match_id
                         WHERE m.format = '5-LOW' AND i.bowling_team_id = 'T5' GROUP BY player_id)
                   WHERE innings >= 2""", "bowling", "innings", "matches")),
}
