"""Column functions on texts and numbers of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cricket, text
from ..functions import fixed_values as fixed
from ..operators import joins, profiles, scorecards
from .adapters import adapt, oracle, read
from .queries_careers import round2


def _numbers(s, d):
    rows = adapt(s, d, "messy_numbers")
    return rows.select("k", "n", text.lenient_int("int_text").alias("i"), text.lenient_double("real_text").alias("x"),
                       text.cell_int("cell").alias("cell_i"), text.cell_double("cell", 7.5).alias("cell_x"),
                       text.clean_text("padded").alias("padded"))


def _formats(s, d):
    rows = adapt(s, d, "match_texts")
    return rows.select("k", cricket.classify_format("venue", "tournament").alias("format"),
                       cricket.detect_format("event").alias("event_format"), cricket.extract_date("venue").alias("date"))


def _toss(s, d):
    rows = adapt(s, d, "match_texts")
    return rows.select(
        "k", cricket.toss_decision("toss").alias("decision"),
        cricket.toss_winner("toss", "side1", "side2", F.lit("1"), F.lit("2")).alias("winner"),
        cricket.margin_runs("result").alias("runs"), cricket.margin_wickets("result").alias("wickets"),
        cricket.margin_text("result").alias("margin"))


def _extras(s, d):
    rows = adapt(s, d, "score_lines")
    parts = [scorecards.extras_part(F.col("extras"), u).alias(n) for n, u in (("b", "b"), ("lb", "lb"), ("nb", "nb"), ("wd", "w"))]
    return rows.select("k", "n", *parts, scorecards.total_wickets(F.col("total")).alias("wickets"),
                       scorecards.total_overs(F.col("total")).alias("overs"))


def _overs(s, d):
    rows = adapt(s, d, "over_texts")
    balls = cricket.overs_to_balls("overs")
    return rows.select("k", "n", balls.alias("balls"), cricket.balls_to_overs(balls).alias("again"))


def _rates(s, d):
    c = F.col
    rows = adapt(s, d, "order_figures")
    return rows.select("k", cricket.batting_average(c("runs"), c("inns"), c("outs")).alias("average"),
                       cricket.ratio(c("runs") * F.lit(100.0), c("balls")).alias("strike_rate"),
                       cricket.ratio(c("runs") * F.lit(6.0), c("balls")).alias("economy"))


def _keys(s, d):
    docs = read(s, d, "documents")
    ident = F.col("n_chars").cast("string")
    key = text.row_key("doc_id", "lang", "n_chars", F.lit(None))
    return docs.select("doc_id", text.shard(ident).alias("shard"), text.prefix_id("ca_", "doc_id").alias("prefixed"),
                       key.alias("row_key"), text.slug("source", "lang").alias("slug"),
                       text.numeric_rank(F.when(F.col("lang") == "en", ident).otherwise(F.col("source"))).cast("bigint").alias("rank"))


def _team_codes(s, d):
    rows = adapt(s, d, "team_labels")
    return rows.select("k", cricket.team_code("label").alias("code"), cricket.team_name("label").alias("full_name"))


def _labels(s, d):
    rows = adapt(s, d, "player_labels")
    return rows.select("k", cricket.player_name("label").alias("name"), cricket.player_team("label", "country").alias("team"))


def _home(s, d):
    rows = adapt(s, d, "team_labels")
    code = cricket.team_code("label")
    return rows.select("k", text.lookup(fixed.HOME_ADVANTAGE, code, fixed.DEFAULT_HOME_ADVANTAGE).alias("home_advantage"),
                       text.lookup(cricket.CODE_NAMES, code, code).alias("name"))


def _lookup_dim(s, d):
    dim = read(s, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    rows = read(s, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 7).alias("key"))
    suppliers = read(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    return joins.lookup_or_default(suppliers.join(rows, "n_nationkey"), dim, "key", "value", F.lit("none"))


def _conform(n):
    def run(s, d):
        return profiles.conform_players(adapt(s, d, "raw_players"))[n]

    return run


def _valid_formats(s, d):
    rows = adapt(s, d, "match_texts").select("k", cricket.detect_format("event").alias("format"))
    return profiles.valid_formats(rows)


def _conform_teams(s, d):
    return profiles.conform_teams(adapt(s, d, "team_heads"))


_HOME = ", ".join(f"('{k}', {v})" for k, v in fixed.HOME_ADVANTAGE.items())
_NAMES = ", ".join(f"('{k}', '{v}')" for k, v in cricket.CODE_NAMES.items())
_CODE = """CASE k % 7 WHEN 0 THEN 'IND' WHEN 1 THEN 'UAE' WHEN 2 THEN 'NZ' WHEN 3 THEN 'LFS' WHEN 4 THEN 'LON'
  WHEN 5 THEN 'abc' ELSE 'ENG' END"""

ENTRIES = {
    "lenient_numbers": (
        _numbers,
        oracle("""SELECT k, n, CASE WHEN n % 4 = 1 THEN 0 ELSE q * 1000 + n END AS i,
            CASE n WHEN 1 THEN CAST(0 AS DOUBLE) WHEN 2 THEN CAST(q AS DOUBLE) ELSE q + CAST(0.5 AS DOUBLE) END AS x,
            CASE n WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE q END AS cell_i,
            CASE n WHEN 1 THEN CAST(7.5 AS DOUBLE) WHEN 2 THEN CAST(7.5 AS DOUBLE) ELSE q + CAST(0.25 AS DOUBLE) END AS cell_x,
            CASE WHEN n = 3 THEN '' ELSE 'a ' || q END AS padded FROM messy_numbers""", "messy_numbers")),
    "format_class": (
        _formats,
        oracle("""SELECT k, CASE WHEN p = '1' THEN 'T20' WHEN p = '2' THEN 'List A' WHEN p = '3' THEN 'First-Class'
              WHEN st = 'F' THEN 'List A' WHEN st = 'O' THEN 'First-Class' ELSE 'Other' END AS format,
            CASE p WHEN '1' THEN 'Test' WHEN '2' THEN 'T20' WHEN '3' THEN 'ODI' WHEN '4' THEN 'T20' ELSE 'Unknown' END
              AS event_format,
            CASE p WHEN '4' THEN NULL ELSE '2nd May ' || y END AS date FROM match_texts""", "match_texts")),
    "toss_margin": (
        _toss,
        oracle("""SELECT k, CASE st WHEN 'F' THEN 'bat' WHEN 'O' THEN 'field' END AS decision,
            CASE st WHEN 'F' THEN '2' WHEN 'O' THEN '1' END AS winner,
            CASE WHEN p < '3' THEN CAST(y % 100 AS INT) ELSE 0 END AS runs, CASE WHEN p = '3' THEN 4 ELSE 0 END AS wickets,
            CASE WHEN p < '3' THEN (y % 100) || ' runs' WHEN p = '3' THEN '4 wickets' END AS margin FROM match_texts""",
               "match_texts")),
    "extras_line": (
        _extras,
        oracle("""SELECT k, n, CASE WHEN n > 2 THEN q ELSE 0 END AS b, n AS lb, 0 AS nb, CASE WHEN n > 4 THEN n + 1 ELSE 0 END AS wd,
            CASE WHEN n = 1 THEN 10 WHEN n = 2 THEN 0 ELSE n END AS wickets, CASE WHEN n = 2 THEN '' ELSE q || '.4' END AS overs
            FROM score_lines""", "score_lines")),
    "overs_balls": (
        _overs,
        oracle("""SELECT k, n, balls, CAST(balls // 6 * 10 + balls % 6 AS DOUBLE) / 10 AS again FROM (
            SELECT k, n, CAST(CASE n WHEN 1 THEN 0 WHEN 2 THEN q * 6 WHEN 3 THEN 0 WHEN 4 THEN q * 6 + 1 WHEN 5 THEN q * 6 + 5
              WHEN 6 THEN q * 6 ELSE q * 6 + 3 END AS BIGINT) AS balls FROM over_texts)""", "over_texts")),
    "rates": (
        _rates,
        oracle(f"""SELECT k, CASE WHEN inns > outs THEN {round2('CAST(runs AS DOUBLE) / (inns - outs)')}
              WHEN inns > 0 THEN CAST(runs AS DOUBLE) END AS average,
            CASE WHEN balls > 0 THEN {round2('runs * CAST(100 AS DOUBLE) / balls')} END AS strike_rate,
            CASE WHEN balls > 0 THEN {round2('runs * CAST(6 AS DOUBLE) / balls')} END AS economy FROM order_figures""",
               "order_figures")),
    "row_keys": (
        _keys,
        """SELECT doc_id, CASE WHEN length(n_chars::VARCHAR) > 4 THEN substr(n_chars::VARCHAR, 1, 4)
             ELSE substr(n_chars::VARCHAR, 1, 3) END AS shard, 'ca_' || doc_id AS prefixed,
           sha256(doc_id || chr(31) || lang || chr(31) || n_chars || chr(31) || chr(0)) AS row_key,
           source || '_' || lang AS slug, CASE WHEN lang = 'en' THEN n_chars ELSE 0 END AS rank FROM documents"""),
    "team_code": (
        _team_codes,
        oracle(f"""SELECT k, {_CODE} AS code, CASE k % 7 WHEN 4 THEN 'London' ELSE coalesce(nullif(trim(label), ''), 'Unknown')
            END AS full_name FROM team_labels""", "team_labels")),
    "player_label": (
        _labels,
        oracle("""SELECT k, 'P ' || k AS name, CASE k % 3 WHEN 0 THEN 'A B' WHEN 1 THEN 'Land' ELSE 'UNK' END AS team
            FROM player_labels""", "player_labels")),
    "home_advantage": (
        _home,
        oracle(f"""SELECT k, coalesce(h.v, CAST(0.03 AS DOUBLE)) AS home_advantage, coalesce(m.v, code) AS name
            FROM (SELECT k, {_CODE} AS code FROM team_labels) t
            LEFT JOIN (SELECT a AS c, CAST(b AS DOUBLE) AS v FROM (VALUES {_HOME}) x(a, b)) h ON h.c = code
            LEFT JOIN (VALUES {_NAMES}) m(c, v) ON m.c = code""", "team_labels")),
    "lookup_default": (
        _lookup_dim,
        """SELECT s_nationkey AS n_nationkey, s_suppkey, s_nationkey % 7 AS key, coalesce(r_name, 'none') AS value
           FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON r_regionkey = s_nationkey % 7"""),
    "conform_players": (
        _conform(0),
        oracle("""SELECT player_id, name, team, role, coalesce(batting_avg, 0) AS batting_avg,
              coalesce(bowling_avg, CAST(99 AS DOUBLE)) AS bowling_avg,
              coalesce(economy, CAST(5 AS DOUBLE)) AS economy, CAST(0 AS DOUBLE) AS batting_sr, CAST(0 AS DOUBLE) AS bowling_sr,
              CAST(0.5 AS DOUBLE) AS recent_form, 0 AS experience, false AS is_captain, false AS is_wicketkeeper
            FROM raw_players WHERE role IN ('Batsman', 'Bowler', 'Allrounder', 'Wicketkeeper')""", "raw_players")),
    "conform_rejected": (
        _conform(1),
        oracle("""SELECT * FROM raw_players WHERE coalesce(role, '') NOT IN ('Batsman', 'Bowler', 'Allrounder', 'Wicketkeeper')""",
               "raw_players")),
    "valid_formats": (
        _valid_formats,
        oracle("""SELECT k, format FROM (SELECT k, CASE p WHEN '1' THEN 'Test' WHEN '2' THEN 'T20' WHEN '3' THEN 'ODI' WHEN '4' THEN 'T20'
                    ELSE 'Unknown' END AS format FROM match_texts) WHERE format <> 'Unknown'""", "match_texts")),
    "conform_teams": (
        _conform_teams, oracle("SELECT team_id, name, coalesce(home_advantage, 0) AS home_advantage FROM team_heads", "team_heads")),
}
