"""Player profiles, squads and playing elevens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cricket
from ..operators import joins, profiles
from .adapters import adapt, oracle
from .queries_careers import round2

_BOARDS = ("bat_records", "bowl_records")

_MERGED = """
bt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, team, format ORDER BY seq DESC) AS rn FROM bat_records) WHERE rn = 1),
bo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, team, format ORDER BY seq DESC) AS rn FROM bowl_records) WHERE rn = 1),
m AS (SELECT coalesce(bt.name, bo.name) AS name, coalesce(bt.team, bo.team) AS team, coalesce(bt.format, bo.format) AS format,
        bt.matches AS bat_matches, bt.innings AS bat_innings, bt.runs, bt.batting_avg, bt.batting_sr, bt.span AS bat_span,
        bo.matches AS bowl_matches, bo.innings AS bowl_innings, bo.wickets, bo.bowling_avg, bo.bowling_sr, bo.economy,
        bo.span AS bowl_span
      FROM bt FULL JOIN bo ON bt.name = bo.name AND bt.team = bo.team AND bt.format = bo.format)"""


def _mean(metric: str, inns: str, default: str) -> str:
    return (f"CASE WHEN {inns} > 0 THEN {round2(f'{metric} / {inns}')} ELSE CAST({default} AS DOUBLE) END AS {metric}")


_WEIGHTED = f"""
t AS (SELECT name, team, CAST(sum(coalesce(bat_innings, 0)) AS BIGINT) AS bat_innings,
        CAST(sum(coalesce(bowl_innings, 0)) AS BIGINT) AS bowl_innings,
        CAST(sum(greatest(coalesce(bat_matches, 0), coalesce(bowl_matches, 0))) AS BIGINT) AS experience,
        CAST(sum(coalesce(runs, 0)) AS BIGINT) AS total_runs, CAST(sum(coalesce(wickets, 0)) AS BIGINT) AS total_wickets,
        sum(coalesce(batting_avg * bat_innings, 0)) AS batting_avg, sum(coalesce(batting_sr * bat_innings, 0)) AS batting_sr,
        sum(coalesce(bowling_avg * bowl_innings, 0)) AS bowling_avg, sum(coalesce(bowling_sr * bowl_innings, 0)) AS bowling_sr,
        sum(coalesce(economy * bowl_innings, 0)) AS economy,
        max(greatest(coalesce(bat_span, ''), coalesce(bowl_span, ''))) AS span FROM m GROUP BY name, team),
w AS (SELECT name, team, span, bat_innings, bowl_innings, experience, total_runs, total_wickets,
        {_mean('batting_avg', 'bat_innings', '0')}, {_mean('batting_sr', 'bat_innings', '0')},
        {_mean('bowling_avg', 'bowl_innings', '99')}, {_mean('bowling_sr', 'bowl_innings', '0')},
        {_mean('economy', 'bowl_innings', '6')} FROM t)"""

_ROLE = """CASE WHEN NOT (bowl_innings >= 3 AND bowling_avg > 0 AND bowling_avg < 90) THEN 'Batsman'
  WHEN NOT (bat_innings >= 3 AND batting_avg > 0) THEN 'Bowler' WHEN batting_avg >= 25 AND bowling_avg <= 38 THEN 'Allrounder'
  WHEN batting_avg >= 28 THEN 'Batsman' WHEN bowling_avg <= 40 THEN 'Bowler' ELSE 'Allrounder' END"""
_ACTIVE = r"coalesce(try_cast(nullif(regexp_extract(string_split(span, '-')[-1], '(\d{4})', 1), '') AS INT) >= 2023, false)"
_FORM = round2(f"""least(CAST(1 AS DOUBLE), least(CAST(1 AS DOUBLE), CASE WHEN {_ACTIVE} THEN CAST(0.55 AS DOUBLE)
  ELSE CAST(0.25 AS DOUBLE) END + CASE WHEN batting_avg > 45 THEN CAST(0.2 AS DOUBLE) WHEN batting_avg > 35
  THEN CAST(0.12 AS DOUBLE) WHEN batting_avg > 25 THEN CAST(0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)
  + CASE WHEN bowl_innings > 10 AND bowling_avg > 0 AND bowling_avg < 25 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)""")
_KEEPER = "(team = 'IND' AND name LIKE 'M% Dhoni')"
_PROFILES = f"""
p AS (SELECT regexp_replace(replace(lower(name), ' ', '_'), '[^a-z0-9_]', '', 'g') || '_' || lower(team) AS player_id, name, team,
        CASE WHEN {_KEEPER} THEN 'Wicketkeeper' ELSE {_ROLE} END AS role, batting_avg, batting_sr, bowling_avg, bowling_sr,
        economy, {_FORM} AS recent_form, experience, (team = 'AUS' AND name LIKE 'P% Cummins') AS is_captain,
        {_KEEPER} AS is_wicketkeeper FROM w WHERE team NOT IN ('UNK', 'UNKNOWN', ''))"""


def _merged(s, d):
    return profiles.merge_disciplines(*adapt(s, d, *_BOARDS))


def _profiles(s, d):
    return profiles.player_profiles(*adapt(s, d, *_BOARDS))


def _flat(s, d):
    names = {"matches": "matches", "innings": "innings"}
    cols = [F.col(f"{side}.{c}").alias(f"{side}_{names[c]}") for side in ("bat", "bowl") for c in names]
    return _merged(s, d).select("name", "team", "format", *cols, "bat.runs", "bowl.wickets")


def _roles(s, d):
    c = F.col
    rows = profiles.weighted_profile(_merged(s, d))
    role = cricket.player_role(c("batting_avg"), c("bowling_avg"), c("bat_innings"), c("bowl_innings"))
    return rows.select("name", "team", role.alias("role"))


def _form(s, d):
    c = F.col
    rows = profiles.weighted_profile(_merged(s, d))
    active = cricket.is_active("span")
    score = cricket.form_score(active, c("batting_avg"), c("bowling_avg"), c("bowl_innings"))
    return rows.select("name", "team", active.alias("active"), score.alias("form"))


def _known(s, d):
    rows, names = adapt(s, d, "named_players", "known_names")
    return joins.flag_known(rows, names, "known", "k")


def _rollup(s, d):
    teams = profiles.team_rollup(adapt(s, d, "squads"))
    squad = F.array_join(F.transform("players", lambda p: p.player_id), ";")
    return teams.select("team_id", "name", "home_advantage", "part", F.size("players").alias("n"), squad.alias("squad"))


ENTRIES = {
    "merge_disciplines": (
        _flat, oracle(f""", {_MERGED.strip()} SELECT name, team, format, bat_matches, bat_innings, bowl_matches, bowl_innings,
                        runs, wickets FROM m""", *_BOARDS)),
    "weighted_profile": (
        lambda s, d: profiles.weighted_profile(_merged(s, d)),
        oracle(f", {_MERGED.strip()}, {_WEIGHTED.strip()} SELECT * FROM w", *_BOARDS)),
    "player_profiles": (
        _profiles, oracle(f", {_MERGED.strip()}, {_WEIGHTED.strip()}, {_PROFILES.strip()} SELECT * FROM p", *_BOARDS)),
    "player_roles": (
        _roles, oracle(f", {_MERGED.strip()}, {_WEIGHTED.strip()} SELECT name, team, {_ROLE} AS role FROM w", *_BOARDS)),
    "form_score": (
        _form, oracle(f""", {_MERGED.strip()}, {_WEIGHTED.strip()} SELECT name, team, {_ACTIVE} AS active, {_FORM} AS form
                        FROM w""", *_BOARDS)),
    "known_flags": (
        _known,
        oracle("""SELECT k, name, team, EXISTS (SELECT 1 FROM known_names n WHERE n.team = p.team AND (n.name = p.name OR
              (contains(n.name, ' ') AND ends_with(p.name, string_split(n.name, ' ')[-1])
               AND substr(p.name, 1, 1) = substr(n.name, 1, 1)))) AS known FROM named_players p""",
               "named_players", "known_names")),
    "team_rollup": (
        _rollup,
        oracle("""SELECT team AS team_id, team AS name, CAST(0.03 AS DOUBLE) AS home_advantage, part,
              CAST(count(*) AS INT) AS n, string_agg(player_id, ';' ORDER BY player_id) AS squad
              FROM (SELECT *, CAST(CAST('0x' || substr(md5(player_id), 1, 7) AS BIGINT) % 16 AS INT) AS part FROM squads)
              GROUP BY team, part""",
               "squads")),
    "team_rows": (
        lambda s, d: profiles.team_rows(adapt(s, d, "squads")).drop("country", "format_rankings"),
        oracle("""SELECT team AS team_id, team AS name, CAST(0.03 AS DOUBLE) AS home_advantage, player_id, team AS player_team, role, recent_form
                  FROM squads""", "squads")),
    "playing_xi": (
        lambda s, d: profiles.playing_xi(adapt(s, d, "squads")),
        oracle("""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY team ORDER BY recent_form DESC, player_id)
              AS INT) AS pick FROM squads) WHERE pick <= 11""", "squads")),
    "squad_sizes": (
        lambda s, d: profiles.squad_sizes(adapt(s, d, "squads")),
        oracle("SELECT team, count(*) AS players FROM squads GROUP BY team ORDER BY players DESC, team LIMIT 30", "squads")),
    "squad_total": (
        lambda s, d: profiles.squad_total(adapt(s, d, "squads")),
        oracle("SELECT count(DISTINCT team) AS teams, count(*) AS players FROM squads", "squads")),
    "batters": (
        lambda s, d: profiles.batters(adapt(s, d, "squads")),
        oracle("SELECT * FROM squads WHERE role IN ('Batsman', 'Allrounder', 'Wicketkeeper')", "squads")),
    "bowlers": (
        lambda s, d: profiles.bowlers(adapt(s, d, "squads")),
        oracle("SELECT * FROM squads WHERE role IN ('Bowler', 'Allrounder')", "squads")),
}
