"""The given tables in the shapes the operators work on.

Each adapter is one SELECT in SQL that Spark and DuckDB both read, over whole tables and
without grouping, so its work and its result grow with the data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ADAPTERS = {
    # --- warehouse tables: orders are matches, line items are scorecard lines --------------
    "matches": """
        SELECT CAST(o_orderkey AS STRING) AS match_id,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE o_orderpriority END AS format,
               'Ground ' || o_orderstatus AS venue, CAST(year(o_orderdate) AS INT) AS season
        FROM {orders}""",
    "innings": """
        SELECT o_orderkey AS id, CAST(o_orderkey AS STRING) AS match_id, 1 AS innings_number,
               'T' || o_orderstatus AS batting_team_id, 'T' || substr(o_orderpriority, 1, 1) AS bowling_team_id
        FROM {orders}""",
    "batting": """
        SELECT l_orderkey AS innings_id, 'P' || CAST(l_suppkey AS STRING) AS player_id,
               CASE WHEN l_linenumber = 7 AND l_linestatus = 'F' THEN NULL WHEN l_returnflag = 'N' THEN 'Not Out'
                    WHEN l_returnflag = 'A' THEN 'did not bat' ELSE 'b P' || CAST(l_partkey AS STRING)
               END AS dismissal_text,
               CAST(l_quantity AS INT) * 3 AS runs, CAST(l_quantity AS INT) * 3 + l_linenumber AS balls,
               l_linenumber AS fours, CAST(l_quantity AS INT) % 4 AS sixes
        FROM {lineitem}""",
    "bowling": """
        SELECT l_orderkey AS innings_id, 'P' || CAST(l_partkey AS STRING) AS player_id,
               CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN NULL
                    ELSE (CAST(l_quantity AS INT) * 10 + l_linenumber) / CAST(10 AS DOUBLE) END AS overs,
               l_linenumber % 3 AS maidens, CAST(l_quantity AS INT) AS runs, l_linenumber - 1 AS wickets
        FROM {lineitem}""",
    # --- archive tables -----------------------------------------------------------------------
    "scraped_matches": """
        SELECT o_orderkey AS match_id, 'Match ' || CAST(o_orderkey AS STRING) AS title,
               CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'Team ' || CAST(o_custkey AS STRING) END AS team1,
               CASE WHEN o_orderstatus = 'F' THEN 'Team ' || o_orderpriority END AS team2,
               CASE WHEN o_orderpriority < '3' THEN 'Oval on 3 May ' || CAST(year(o_orderdate) AS STRING) || ' (50-over)'
                    ELSE 'Park' END AS venue,
               CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'Cup on 5th June ' || CAST(year(o_orderdate) AS STRING) || '.'
                    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Side ' || CAST(o_custkey AS STRING) || ' won by 3 runs'
                    WHEN o_orderpriority = '1-URGENT' THEN 'League DRAWN' ELSE NULL END AS series,
               CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE CAST(year(o_orderdate) AS STRING) END AS season,
               CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'Side X Won'
                    WHEN o_orderstatus = 'F' THEN ' Team ' || CAST(o_custkey AS STRING) || ' won by 2 wickets, won well'
                    WHEN o_orderstatus = 'O' THEN '' END AS result,
               CASE WHEN o_orderstatus = 'F' THEN 'International' WHEN o_orderstatus = 'O' THEN 'Domestic'
                    ELSE 'Other' END AS match_category
        FROM {orders}""",
    "scraped_innings": """
        SELECT o_orderkey AS match_id, 1 AS innings_number FROM {orders}
        UNION ALL SELECT o_orderkey AS match_id, 2 AS innings_number FROM {orders}
        UNION ALL SELECT o_orderkey AS match_id, 4 AS innings_number FROM {orders} WHERE o_orderstatus = 'P'""",
    "scraped_fow": """
        SELECT l_orderkey AS match_id, l_linenumber AS innings_number, l_partkey * 1000000 + l_suppkey AS id,
               '1-' || CAST(CAST(l_quantity AS INT) AS STRING) AS fow_string
        FROM {lineitem}""",
    "scraped_batting": """
        SELECT l_partkey * 1000000 + l_suppkey AS id, l_orderkey AS match_id, l_linenumber AS innings_number,
               'Player ' || CAST(l_suppkey AS STRING) AS player_name,
               CASE WHEN l_returnflag = 'N' THEN 'not out' ELSE 'b ' || CAST(l_partkey AS STRING) END AS dismissal,
               CAST(l_quantity AS INT) * 2 AS runs, CAST(l_quantity AS INT) AS balls, l_linenumber * 10 AS mins,
               l_linenumber AS fours, l_linenumber % 3 AS sixes
        FROM {lineitem} WHERE l_returnflag <> 'A'""",
    "scraped_bowling": """
        SELECT l_partkey * 1000000 + l_suppkey AS id, l_orderkey AS match_id, l_linenumber AS innings_number,
               'Player ' || CAST(l_partkey AS STRING) AS player_name, CAST(l_quantity AS INT) AS overs,
               l_linenumber % 2 AS maidens, CAST(l_quantity AS INT) * 4 AS runs, l_linenumber - 1 AS wickets,
               l_linenumber % 5 AS wides, l_linenumber % 4 AS no_balls
        FROM {lineitem} WHERE l_returnflag = 'A'""",
    "progress": """
        SELECT o_orderkey AS match_id, o_custkey * 100000000 + o_orderkey AS seq
        FROM {orders}""",
    "players": "SELECT CAST(c_custkey AS STRING) AS player_id, c_name AS name FROM {customer}",
    "team_dim": "SELECT n_nationkey AS team_id, n_name AS name FROM {nation}",
    "team_names": """
        SELECT 't' || CAST(c_custkey AS STRING) AS team_id,
               CASE WHEN c_nationkey % 3 = 0 THEN 'IND' WHEN c_nationkey % 3 = 1 THEN 'India'
                    ELSE ' Side ' || CAST(c_nationkey AS STRING) END AS name
        FROM {customer}""",
    "team_heads": """
        SELECT n_nationkey AS team_id, n_name AS name,
               CASE WHEN n_nationkey % 2 = 0 THEN CAST(0.125 AS DOUBLE) END AS home_advantage
        FROM {nation}""",
    "side_names": """
        SELECT 's' || CAST(s_suppkey AS STRING) AS team_id, CASE WHEN s_nationkey % 2 = 0 THEN 'AUS' ELSE s_name END AS name
        FROM {supplier}""",
    "venues": "SELECT s_suppkey AS venue_id, 'Park%' || s_name AS name FROM {supplier}",
    # --- logs, registry, queue ------------------------------------------------------------------
    "log": """
        SELECT CASE WHEN source < 'src3' THEN source WHEN source < 'src5' THEN '' END AS source,
               CASE WHEN lang = 'fr' THEN '' ELSE lang || CAST(CAST(floor(doc_id / 40) AS BIGINT) AS STRING) END AS match_id,
               CASE WHEN lang = 'fr' AND n_chars % 3 <> 0 THEN CAST(CAST(floor(doc_id / 90) AS BIGINT) AS STRING) END AS id,
               CASE WHEN n_chars % 5 = 0 THEN 'Live Cricket Score ' || text ELSE text END AS title,
               doc_id AS line_no
        FROM {documents}""",
    "sightings": """
        SELECT o_orderkey AS seq,
               CASE WHEN o_custkey % 3 = 0 THEN 'IND' WHEN o_custkey % 3 = 1 THEN ' Side ' || CAST(o_custkey % 20 AS STRING)
                    ELSE NULL END AS team1,
               CASE WHEN o_custkey % 2 = 0 THEN 'AUS' ELSE 'India' END AS team2,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date,
               substr(o_orderpriority, 1, 1) AS format,
               CASE WHEN o_orderpriority < '2' THEN 'CA' WHEN o_orderpriority < '3' THEN 'cricbuzz'
                    WHEN o_orderpriority < '5' THEN 'espn' ELSE 'other' END AS source,
               's' || CAST(o_orderkey AS STRING) AS source_id
        FROM {orders}""",
    "queue": """
        SELECT CAST(doc_id AS STRING) AS ca_match_id,
               CASE WHEN lang = 'en' THEN 'SUCCESS' WHEN lang = 'fr' THEN 'FAILED' ELSE 'PENDING' END AS status,
               source AS discovered_at
        FROM {documents}""",
    "artifacts": "SELECT doc_id, quality FROM {labels}",
    "outcomes": "SELECT CAST(doc_id AS STRING) AS ca_match_id, quality = 1 AS ok FROM {labels}",
    "wide_queue": """
        SELECT CAST(o_orderkey * 7 AS STRING) AS ca_match_id,
               CASE WHEN o_orderstatus = 'F' THEN 'e' || CAST(o_custkey AS STRING)
                    WHEN o_orderstatus = 'O' THEN '' END AS espn_match_id,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'c' END AS cb_match_id,
               CASE WHEN o_orderstatus = 'P' THEN 'PENDING' WHEN o_orderstatus = 'F' THEN 'COMPLETED'
                    ELSE 'FAILED' END AS status
        FROM {orders}""",
    # --- texts and numbers ---------------------------------------------------------------------------
    "messy_numbers": """
        SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS INT) AS q,
               CASE WHEN l_linenumber % 4 = 1 THEN CAST(CAST(l_quantity AS INT) AS STRING) || 'x'
                    ELSE ' -' || CAST(CAST(l_quantity AS INT) AS STRING) || ',00' || CAST(l_linenumber AS STRING) || ' ' END
                 AS int_text,
               CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN CAST(CAST(l_quantity AS INT) AS STRING) || '.'
                    ELSE CAST(CAST(l_quantity AS INT) AS STRING) || '.5' END AS real_text,
               CASE l_linenumber WHEN 1 THEN 'DNB' WHEN 2 THEN 'nan'
                    ELSE CAST(CAST(l_quantity AS INT) AS STRING) || '.25*' END AS cell,
               CASE WHEN l_linenumber = 3 THEN NULL ELSE '  a ' || CAST(CAST(l_quantity AS INT) AS STRING) || '   ' END AS padded
        FROM {lineitem}""",
    "match_texts": """
        SELECT o_orderkey AS k, o_orderstatus AS st, substr(o_orderpriority, 1, 1) AS p, year(o_orderdate) AS y,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Somewhere'
                    ELSE 'Park on 2nd May ' || CAST(year(o_orderdate) AS STRING) ||
                      CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN ' (20-over match)' WHEN '2' THEN ' (One-Day)'
                        WHEN '3' THEN ' (four-day match)' ELSE '' END END AS venue,
               CASE o_orderstatus WHEN 'F' THEN 'One Day Cup' WHEN 'O' THEN 'County Plate' ELSE 'Friendlies' END AS tournament,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Greatest T20' WHEN '2' THEN 'World Twenty20'
                    WHEN '3' THEN 'One DAY final' WHEN '4' THEN 'Ipl night' ELSE 'League' END AS event,
               CASE o_orderstatus WHEN 'F' THEN 'BLUE won the toss and chose to bat first, not field'
                    WHEN 'O' THEN 'Red (and blue) will field' ELSE 'Nobody' END AS toss,
               'Red' AS side1, 'Blue' AS side2,
               CASE WHEN o_orderpriority < '3' THEN 'Red won by ' || CAST(year(o_orderdate) % 100 AS STRING) || ' runs'
                    WHEN o_orderpriority < '4' THEN 'Red won by 4 wickets' ELSE 'No result' END AS result
        FROM {orders}""",
    "score_lines": """
        SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS INT) AS q,
               '(' || CASE WHEN l_linenumber > 2 THEN CAST(CAST(l_quantity AS INT) AS STRING) || ' b, ' ELSE '' END ||
                 CAST(l_linenumber AS STRING) || ' lb' ||
                 CASE WHEN l_linenumber > 4 THEN ', ' || CAST(l_linenumber + 1 AS STRING) || ' w' ELSE '' END || ')' AS extras,
               CASE l_linenumber WHEN 1 THEN '(All Out, ' || CAST(CAST(l_quantity AS INT) AS STRING) || '.4 overs)'
                    WHEN 2 THEN '(innings closed)'
                    ELSE '(' || CAST(l_linenumber AS STRING) || ' wickets, ' || CAST(CAST(l_quantity AS INT) AS STRING) || '.4 overs)'
               END AS total
        FROM {lineitem}""",
    "over_texts": """
        SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS INT) AS q,
               CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN CAST(CAST(l_quantity AS INT) AS STRING)
                    WHEN 3 THEN CAST(CAST(l_quantity AS INT) AS STRING) || '.x'
                    WHEN 4 THEN CAST(CAST(l_quantity AS INT) AS STRING) || '.25'
                    WHEN 5 THEN CAST(CAST(l_quantity AS INT) AS STRING) || '.5'
                    WHEN 6 THEN CAST(CAST(l_quantity AS INT) AS STRING) || '.6'
                    ELSE CAST(CAST(l_quantity AS INT) AS STRING) || '.3.9' END AS overs
        FROM {lineitem}""",
    "order_figures": """
        SELECT o_orderkey AS k, CAST(floor(o_totalprice / 10) AS BIGINT) AS runs, o_custkey % 50 AS inns,
               CASE WHEN o_orderstatus = 'F' THEN o_custkey % 50 WHEN o_custkey % 50 > 7 THEN o_custkey % 7 ELSE 0 END AS outs,
               o_custkey AS balls
        FROM {orders}""",
    "team_labels": """
        SELECT c_custkey AS k, CASE c_custkey % 7 WHEN 0 THEN 'india' WHEN 1 THEN 'u.a.e.' WHEN 2 THEN 'nz'
                 WHEN 3 THEN 'land far south sea' WHEN 4 THEN 'London' WHEN 5 THEN 'abc' ELSE 'England' END AS label
        FROM {customer}""",
    "player_labels": """
        SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN ' P ' || CAST(c_custkey AS STRING) || '†* ( A B )'
                 ELSE 'P ' || CAST(c_custkey AS STRING) || '#' END AS label,
               CASE c_custkey % 3 WHEN 0 THEN 'ignored' WHEN 1 THEN ' Land ' ELSE 'None' END AS country
        FROM {customer}""",
    "raw_players": """
        SELECT CAST(c_custkey AS STRING) AS player_id, c_name AS name, c_mktsegment AS team,
               CASE c_nationkey % 6 WHEN 0 THEN 'Batsman' WHEN 1 THEN 'Bowler' WHEN 2 THEN 'Allrounder'
                    WHEN 3 THEN 'Wicketkeeper' WHEN 4 THEN 'Umpire' END AS role,
               CASE WHEN c_acctbal > 5000 THEN c_acctbal END AS batting_avg,
               CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bowling_avg,
               CASE WHEN c_acctbal < 0 THEN c_acctbal END AS economy
        FROM {customer}""",
    # --- leaderboard records and squads ----------------------------------------------------------------
    "bat_records": """
        SELECT CASE o_custkey % 5 WHEN 0 THEN 'Mark Dhoni' ELSE 'P. Cust-' || CAST(o_custkey AS STRING) || ' Cummins' END AS name,
               CASE o_custkey % 6 WHEN 0 THEN 'IND' WHEN 1 THEN 'AUS' WHEN 2 THEN 'UNK' WHEN 3 THEN '' ELSE 'ENG' END AS team,
               CASE o_orderstatus WHEN 'F' THEN 'Test' WHEN 'O' THEN 'ODI' ELSE 'T20' END AS format, o_orderkey AS seq,
               CAST(year(o_orderdate) - 9 AS STRING) || '-' || CAST(year(o_orderdate) + 25 AS STRING) AS span,
               CAST(o_custkey % 40 AS INT) AS matches, CAST(o_orderkey % 30 AS INT) AS innings, CAST(o_orderkey % 997 AS INT) AS runs,
               (o_orderkey % 200) / CAST(4 AS DOUBLE) AS batting_avg, (o_orderkey % 300) / CAST(2 AS DOUBLE) AS batting_sr
        FROM {orders}""",
    "bowl_records": """
        SELECT CASE o_custkey % 5 WHEN 0 THEN 'Mark Dhoni' ELSE 'P. Cust-' || CAST(o_custkey AS STRING) || ' Cummins' END AS name,
               CASE o_custkey % 6 WHEN 0 THEN 'IND' WHEN 1 THEN 'AUS' WHEN 2 THEN 'UNK' WHEN 3 THEN '' ELSE 'ENG' END AS team,
               CASE o_orderstatus WHEN 'F' THEN 'T20' WHEN 'O' THEN 'ODI' ELSE 'List A' END AS format, o_orderkey AS seq,
               CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(year(o_orderdate) + 24 AS STRING) END AS span,
               CAST(o_custkey % 50 AS INT) AS matches, CAST(o_orderkey % 20 AS INT) AS innings, CAST(o_orderkey % 97 AS INT) AS wickets,
               (o_orderkey % 160) / CAST(4 AS DOUBLE) AS bowling_avg, (o_orderkey % 120) / CAST(2 AS DOUBLE) AS bowling_sr,
               (o_orderkey % 40) / CAST(4 AS DOUBLE) AS economy
        FROM {orders}""",
    "squads": """
        SELECT c_name AS player_id, c_mktsegment AS team,
               CASE c_nationkey % 5 WHEN 0 THEN 'Batsman' WHEN 1 THEN 'Bowler' WHEN 2 THEN 'Allrounder'
                    WHEN 3 THEN 'Wicketkeeper' ELSE 'Coach' END AS role,
               c_nationkey / CAST(100 AS DOUBLE) AS recent_form
        FROM {customer}""",
    "named_players": """
        SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'M Cust' || CAST(o_custkey AS STRING)
                 WHEN 'O' THEN 'Mo X de Cust' || CAST(o_custkey AS STRING) ELSE 'N Cust' || CAST(o_custkey AS STRING) END AS name,
               substr(o_orderpriority, 1, 1) AS team
        FROM {orders}""",
    "known_names": """
        SELECT CASE WHEN c_acctbal > 2000 THEN 'Mary Cust' ELSE 'N Cust' END || CAST(c_custkey AS STRING) AS name,
               CASE WHEN c_acctbal > 2000 THEN CAST(c_nationkey % 5 AS STRING) ELSE '3' END AS team
        FROM {customer}""",
    "ball_by_ball": """
        SELECT l_partkey * 1000000 + l_suppkey AS id, CAST(l_orderkey AS STRING) AS match_id, 1 AS innings,
               CAST(l_quantity AS INT) AS over, l_linenumber AS ball, 'B' || CAST(l_suppkey AS STRING) AS batter,
               'W' || CAST(l_partkey AS STRING) AS bowler, 'N' AS non_striker,
               CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_linenumber END AS runs_batter,
               CASE WHEN l_returnflag = 'N' THEN NULL ELSE 1 END AS runs_extras,
               CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS is_wicket,
               CASE WHEN l_linestatus = 'F' THEN 'caught' ELSE '' END AS dismissal_kind, '' AS player_dismissed
        FROM {lineitem}""",
    # --- entities for de-duplication and merges ----------------------------------------------------
    "entity_rows": """
        SELECT l_suppkey AS id, 'N' || CAST(l_partkey AS STRING) AS name,
               CASE WHEN l_returnflag = 'A' THEN 'dob ' || CAST(CAST(l_quantity AS INT) AS STRING)
                    WHEN l_returnflag = 'N' THEN '' END AS dob,
               (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seen
        FROM {lineitem}""",
    "target_rows": """
        SELECT c_custkey AS id, c_name AS name, CASE WHEN c_mktsegment < 'F' THEN c_mktsegment END AS dob
        FROM {customer}""",
    "source_rows": """
        SELECT o_custkey * 2 AS id, 'O' || CAST(o_orderkey AS STRING) AS name,
               CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS dob, o_orderkey AS seq
        FROM {orders}""",
}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapt(spark: SparkSession, sf_dir: str, *names: str):
    """One adapted table, or several in the order asked for."""
    found = [_adapt_one(spark, sf_dir, name) for name in names]
    return found[0] if len(found) == 1 else found


def _adapt_one(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = ADAPTERS[name]
    used = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in used})


def oracle(select: str, *names: str) -> str:
    """DuckDB query over the same adapted tables; a ``select`` that starts with a comma adds CTEs of its own."""
    parts = [f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', ADAPTERS[n]).strip()})" for n in names]
    select = select.strip()
    return f"WITH {', '.join(parts)}{'' if select.startswith(',') else ' '}{select}" if parts else select
