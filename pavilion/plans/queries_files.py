"""Scans, sinks, loads and file streams: the given tables written below the session's shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import numeric_rank
from ..operators import dedup, nested, pages, profiles
from ..operators.maintenance import apply_outcomes
from ..session import work_dir
from ..sources import scans, sinks
from ..streaming import streams
from . import derived, loads
from .adapters import adapt, oracle, read
from .derived import card_oracle
from .queries_pages import _KEY
from .queries_tables import _LOG

_TITLE = """trim(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'),
                  '&quot;', '"'), '&amp;', '&'))"""


def _page_files(s, d):
    path = f"{work_dir(s)}/mirror"
    sinks.write_files(read(s, d, "pages"), path, "page_id", "html", ".html")
    return path


def _scan_pages(s, d):
    found = scans.scan_pages(s, _page_files(s, d))
    size = found.select("doc_id", F.octet_length("content").alias("bytes"))
    titles = pages.parse_pages(found, only=("title", "script_title")).select(F.col("doc_id").alias("_doc"), pages.page_title().alias("title"))
    return size.join(titles, size["doc_id"] == titles["_doc"]).drop("_doc")


def _arrivals(s, d):
    """Pages as they arrive, a few files a batch; the queue takes their outcomes."""
    folder = work_dir(s)
    stream = streams.stream_pages(s, _page_files(s, d), files_per_batch=2000)
    streams.start_append(streams.page_outcomes(stream), f"{folder}/rows", f"{folder}/state", availableNow=True).awaitTermination()
    outcomes = s.read.schema("ca_match_id string, ok boolean").parquet(f"{folder}/rows")
    queue = read(s, d, "pages").select(F.col("page_id").cast("string").alias("ca_match_id"), F.lit("LOCAL_PENDING").alias("status"))
    return apply_outcomes(queue, outcomes)


_MATCH_SOURCE = """SELECT c_custkey AS k, c_nationkey AS c, CASE c_nationkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS st,
  2000 + c_nationkey AS yr, c_nationkey * 3 AS a FROM {customer}"""


def _scan_matches(s, d):
    path = f"{work_dir(s)}/matches"
    made = s.sql(_MATCH_SOURCE, customer=read(s, d, "customer"))
    made = made.select(F.concat(F.col("k").cast("string"), F.lit(".v1")).alias("name"), derived.fill(derived._MATCH_JSON).alias("content"))
    sinks.write_files(made, path, "name", "content", ".json")
    found = scans.scan_match_json(s, f"{path}/*")
    return nested.explode_match_info(found).select("match_id", "date", "city", "team1", "team2", "winner", "win_margin_runs")


def _log_file(s, d):
    """The log as lines of a file, some of them broken; de-duplicated, sorted, written, and read back."""
    folder = work_dir(s)
    log = adapt(s, d, "log").repartitionByRange("line_no").sortWithinPartitions("line_no")
    line = F.to_json(F.struct("source", "match_id", "id", "title"))
    broken = F.when(F.col("line_no") % 5 == 0, F.array(line, F.lit('{"match_id": "9", "title"'), F.lit(""))).otherwise(F.array(line))
    log.select(F.explode(broken).alias("value")).write.text(f"{folder}/log")
    best = dedup.dedup_log(scans.scan_jsonl(s, f"{folder}/log"), source="history").drop("line_no")
    sinks.write_sorted_jsonl(best, f"{folder}/sorted", "log_id")
    again = scans.scan_jsonl(s, f"{folder}/sorted", "source string, log_id string, title string")
    ranked = again.select("source", "log_id", "title", "line_no.file", "line_no", numeric_rank("log_id").alias("rank"))
    before = F.lag(F.struct("rank", "log_id")).over(Window.partitionBy("file").orderBy("line_no"))
    fits = F.coalesce(before <= F.struct("rank", "log_id"), F.lit(True))
    return ranked.select("source", "log_id", F.length("title").alias("n"), fits.alias("in_order"))


def _team_documents(s, d):
    path = f"{work_dir(s)}/teams"
    players = adapt(s, d, "squads").withColumn("name", F.concat(F.lit("P "), "player_id"))
    sinks.write_teams_json(profiles.team_heads(players), players, path)
    found = scans.parse_teams(s.read.text(path))
    return found.select("team_id", "player_name", F.col("player.player_id").alias("player_id"))


def _table(s, d):
    root = work_dir(s)
    players = adapt(s, d, "squads")
    sinks.refresh(players.withColumn("role", F.lit("old")), f"{root}/squads")
    sinks.refresh(players.filter(F.col("player_id") < "5"), f"{root}/squads")
    sinks.append(players.filter(F.col("player_id") >= "5"), f"{root}/squads")
    return scans.table(s, "squads", root).select("player_id", "role", "team")


#: A poll's rows lie in so many files, which a batch takes together.
POLL_FILES = 8


def _until_post(s, d):
    """Four polls, one after the other; the third says that the match is over."""
    folder = work_dir(s)
    for n in range(4):
        rows = read(s, d, "events").filter(F.col("event_id") % 4 == n).select("event_id", F.lit("post" if n == 2 else "in").alias("status"))
        rows.repartition(POLL_FILES, "event_id").write.option("compression", "none").json(f"{folder}/polls/poll={n}")
    polls = s.readStream.schema("event_id bigint, status string, poll int").option("maxFilesPerTrigger", POLL_FILES).json(f"{folder}/polls")
    polls = polls.drop("poll")
    streams.run_until_post(polls, lambda b: b.write.mode("append").parquet(f"{folder}/shown"), f"{folder}/state", "0 seconds", timeout=120)
    return s.read.schema("event_id bigint, status string").parquet(f"{folder}/shown")


def _shown(s, d):
    polls = read(s, d, "events").select(F.col("user_id").alias("match_id"), F.col("event_id").alias("position"))
    return streams.shown_order(polls, "position")


_WAREHOUSES: dict[tuple[str, str], str] = {}


def _warehouse(s, d):
    """The scorecard pages of all orders, loaded once a session; the same load again changes nothing."""
    key = (s.sparkContext.applicationId, d)
    if key not in _WAREHOUSES:
        root = f"{work_dir(s)}/warehouse"
        loads.create_warehouse(s, root)
        load = loads.load_scorecards(derived.scorecard_pages(s, d), loads.read_warehouse(s, root))
        load.write(root)
        load.write(root)
        _WAREHOUSES[key] = root
    return loads.read_warehouse(s, _WAREHOUSES[key])


#: of the pages of one game, the first by name is loaded
_FIRST = """, kinds AS (SELECT *, CASE pr WHEN '1' THEN 'T20' WHEN '5' THEN 'T20' WHEN '2' THEN 'List A' ELSE 'First-Class' END AS fmt FROM cards),
placed AS (SELECT *, row_number() OVER (PARTITION BY c, yr, fmt ORDER BY CAST(k AS VARCHAR)) AS nth FROM kinds),
loaded AS (SELECT i.*, {key} FROM inns i JOIN placed p ON i.k = p.k WHERE p.nth = 1)""".format(key=_KEY.format(k="i.k", n="i.n"))

ENTRIES = {
    "scan_pages": (
        _scan_pages, f"SELECT CAST(page_id AS VARCHAR) AS doc_id, CAST(strlen(html) AS INT) AS bytes, {_TITLE} AS title FROM pages"),
    "page_arrivals": (
        _arrivals, """SELECT CAST(page_id AS VARCHAR) AS ca_match_id,
            CASE WHEN len(regexp_extract_all(html, '<table[ >]')) >= 2 THEN 'COMPLETED' ELSE 'FAILED' END AS status FROM pages"""),
    "scan_match_json": (
        _scan_matches,
        f"""WITH cards AS ({_MATCH_SOURCE.replace('{customer}', 'customer')}) SELECT 'cricsheet_' || k AS match_id, yr || '-01-01' AS date,
            'C' || c AS city, 'T' || c AS team1, CASE WHEN st = 'F' THEN 'T' || (c + 1) ELSE 'Unknown' END AS team2,
            CASE WHEN st = 'F' THEN 'T' || c END AS winner, CASE WHEN st = 'F' THEN a ELSE 0 END AS win_margin_runs FROM cards"""),
    "log_file": (
        _log_file, oracle(f""", {_LOG.strip()} SELECT src AS source, lid AS log_id, CAST(length(title) AS INT) AS n, TRUE AS in_order
                              FROM best WHERE rn = 1""", "log")),
    "team_documents": (
        _team_documents, oracle("SELECT team AS team_id, 'P ' || player_id AS player_name, player_id FROM squads", "squads")),
    "table_round_trip": (_table, oracle("SELECT player_id, role, team FROM squads", "squads")),
    "until_post": (
        _until_post, "SELECT event_id, CASE WHEN event_id % 4 = 2 THEN 'post' ELSE 'in' END AS status FROM events WHERE event_id % 4 <= 2"),
    "newest_last": (
        _shown, """SELECT user_id AS match_id, event_id AS position,
            CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS INT) AS shown FROM events"""),
    "load_innings": (
        lambda s, d: _warehouse(s, d)["innings"].select("id", "match_id", "innings_number", "batting_team_id", "runs", "overs"),
        card_oracle(f"""{_FIRST} SELECT innings_id AS id, CAST(k AS VARCHAR) AS match_id, n AS innings_number, CAST(bat AS VARCHAR) AS batting_team_id,
            a + 100 AS runs, CASE WHEN st = 'F' THEN '18.4' ELSE '20' END AS overs FROM loaded""")),
    "load_batting": (
        lambda s, d: _warehouse(s, d)["batting"].select("innings_id", "player_id", "dismissal_text", "runs", "balls"),
        card_oracle(f"""{_FIRST} SELECT innings_id, c || '0' || n AS player_id, 'c X b Y' AS dismissal_text,
            CASE WHEN st = 'F' THEN 1000 + a ELSE a END AS runs, a * 2 AS balls FROM loaded
            UNION ALL SELECT innings_id, c || '9' || n, 'did not bat', 0, 0 FROM loaded
            UNION ALL SELECT innings_id, c || '0' || n, '', 0, 0 FROM loaded WHERE st = 'O'""")),
    "load_players": (
        lambda s, d: _warehouse(s, d)["players"].select("player_id", "name", "dob"),
        card_oracle(f"""{_FIRST} SELECT player_id, arg_min(name, seen_at) AS name, arg_min(dob, seen_at) AS dob FROM (
            SELECT c || '0' || n AS player_id, 'Bat ' || c || '-' || n AS name, '1 May ' || yr AS dob, CAST(k AS VARCHAR) AS seen_at FROM loaded
            UNION ALL SELECT c || '9' || n, 'Tail ' || n, NULL, CAST(k AS VARCHAR) FROM loaded
            UNION ALL SELECT c || '7' || n, 'Bowl ' || n, NULL, CAST(k AS VARCHAR) FROM loaded
            UNION ALL SELECT c || '80', 'U ' || c, NULL, CAST(k AS VARCHAR) FROM loaded
            UNION ALL SELECT c || '81', 'V', NULL, CAST(k AS VARCHAR) FROM loaded WHERE st = 'F') GROUP BY player_id""")),
    "load_registry": (
        lambda s, d: _warehouse(s, d)["match_registry"].select("team1", "team2", "match_date", "format", "ca_id"),
        card_oracle(f"""{_FIRST} SELECT 'Side ' || c AS team1, 'Side ' || (c + 1) AS team2, '3rd May ' || yr AS match_date, fmt AS format,
            max(CAST(k AS VARCHAR)) AS ca_id FROM placed GROUP BY c, yr, fmt""")),
}
