"""Tables that are kept up to date instead of made anew: careers, merged loads, queues, migrations, search indexes, sketches, dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cricket
from ..operators import archive, careers, live
from ..session import work_dir
from ..sources import commits, layout, scans
from ..streaming import streams
from . import career_table, derived, loads
from .adapters import adapt, oracle, read
from .derived import card_oracle
from .queries_careers import _CAREER, _CARD as _CAREER_TABLES
from .queries_files import _FIRST

_CARDS = ("scraped_matches", "progress", "scraped_batting")


def _career_loads(s, d):
    """Three days of scorecard lines, merged after the second; the first once more changes nothing."""
    root = f"{work_dir(s)}/warehouse"
    bat, bowl, inns, matches = adapt(s, d, *_CAREER_TABLES)
    facts = careers.career_facts(bat, bowl)
    career_table.create(s, root)
    for day in (0, 1, 2, 0):
        career_table.add(root, f"day-{day}", facts.where(F.pmod("innings_id", F.lit(3)) == day), inns, matches)
        if day == 1:
            career_table.merge(s, root)
    return career_table.read(s, root)


def _upsert_parts(s, d):
    """Two batches of changes, one after the other."""
    path = f"{work_dir(s)}/players"
    target, src = adapt(s, d, "target_rows", "source_rows")
    schema = ", ".join(f"{n} {k}" for n, k in target.dtypes)
    layout.write_parts(target, path, "id")
    half = src.agg(F.max("seq")).first()[0] / 2
    for batch in (src.where(F.col("seq") <= half), src.where(F.col("seq") > half)):
        layout.upsert_parts(path, schema, batch, "id", "seq")
    return layout.read_parts(s, path, schema).drop("part")


def _merged_loads(s, d):
    """The pages of all orders in two loads in the order of their names, merged into one whose predecessors are removed."""
    root = f"{work_dir(s)}/warehouse"
    loads.create_warehouse(s, root)
    pages = derived.scorecard_pages(s, d)
    for low, high in (("", "4"), ("4", "A")):
        loads.load_scorecards(pages.where((F.col("doc_id") >= low) & (F.col("doc_id") < high)), loads.read_warehouse(s, root)).write(root)
    loads.merge_loads(s, root)
    commits.remove_replaced(s, root, list(loads.TABLES))
    return loads.read_warehouse(s, root)["innings"].select("id", "match_id", "innings_number", "batting_team_id", "runs", "overs")


def _event_stream(s, d):
    schema = read(s, d, "events").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    over = (F.col("event_type") == "purchase") & (F.col("user_id") % 3 == 0)
    return stream.select(F.col("user_id").alias("match_id"), F.when(F.col("event_type") != "error", F.concat(
        "event_type", F.lit(" "), "props")).alias("text"), F.when(over, "post").otherwise("in").alias("status"), F.col("event_id").alias("place"))


def _match_commentary(s, d):
    folder = work_dir(s)
    streams.use_disk_state(s)
    rows = streams.match_commentary(_event_stream(s, d), parts=1)
    streams.start_append(rows, f"{folder}/rows", f"{folder}/state", availableNow=True).awaitTermination()
    return s.read.schema("match_id bigint, text string, place bigint").parquet(f"{folder}/rows")


def _queue(s, d):
    """Outcomes of labelled documents, in some files, merged into the queue as they arrive."""
    folder = work_dir(s)
    queue, outcomes = adapt(s, d, "queue", "outcomes")
    streams.create_queue(queue, f"{folder}/queue")
    outcomes.repartition(8, "ca_match_id").write.parquet(f"{folder}/outcomes")
    stream = s.readStream.schema(outcomes.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/outcomes")
    streams.keep_queue(stream, f"{folder}/queue", f"{folder}/state", availableNow=True).awaitTermination()
    return layout.read_parts(s, f"{folder}/queue", streams.QUEUE).select("ca_match_id", "status")


def _migrated(s, d):
    """Older rows in two lots; the second run takes only what the first has not."""
    folder = work_dir(s)
    rows = adapt(s, d, "ball_by_ball")
    schema = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes)
    for lot in (0, 1):
        rows.where(F.col("id") % 2 == lot).repartition(8).write.mode("append").parquet(f"{folder}/old")
        streams.migrate(s, f"{folder}/old", schema, scans.unify_deliveries, f"{folder}/new", f"{folder}/state", files_per_batch=8)
    return s.read.parquet(f"{folder}/new").drop("batch_id")


def _indexed(table: str, ident: str, word: str):
    def run(s, d):
        folder = work_dir(s)
        names = adapt(s, d, table)
        layout.write_parts(archive.postings(names, "name", ident), f"{folder}/postings", "gram", spread="id")
        index = layout.read_parts(s, f"{folder}/postings", f"gram string, id {dict(names.dtypes)[ident]}")
        index.groupBy("gram").agg(F.count("*").alias("n")).write.parquet(f"{folder}/counts")
        return archive.search_postings(names, index, s.read.schema("gram string, n bigint").parquet(f"{folder}/counts"), "name", ident, word)

    return run, oracle(f"SELECT {ident} AS id, name FROM {table} WHERE contains(lower(name), lower('{word}')) ORDER BY name, id LIMIT 10", table)


def _sketches(s, d):
    """The status of three loads, from what each has kept: exact counts, and whether the estimate is within four standard errors."""
    matches, progress, batting = adapt(s, d, *_CARDS)
    folder = work_dir(s)
    for n in range(3):
        of = F.pmod("match_id", F.lit(3)) == n
        archive.status_parts(matches.where(of), progress.where(of), batting.where(of)).write.mode("append").parquet(f"{folder}/status")
    told = archive.status_of(s.read.schema(archive.STATUS_PARTS).parquet(f"{folder}/status"))
    exact = batting.agg(F.count_distinct("player_name").alias("exact"))
    error = 4 * 1.04 / 2 ** (archive.SKETCH_BITS / 2)
    near = F.abs(told["total_players"] - F.col("exact")) <= F.lit(error) * F.col("exact")
    whole = told.withColumn("one", F.lit(1)).join(exact.withColumn("one", F.lit(1)), "one")
    return whole.select("total_matches", "completed_extractions", "total_balls_delivered", near.alias("players_within_error"))


#: An order's date in one of several forms.
_DATED = """SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS day,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN CAST(CAST(o_orderdate AS DATE) AS {text})
    WHEN '2' THEN CAST(day(o_orderdate) AS {text}) || CASE WHEN day(o_orderdate) IN (1, 21, 31) THEN 'st' WHEN day(o_orderdate) IN (2, 22) THEN 'nd'
      WHEN day(o_orderdate) IN (3, 23) THEN 'rd' ELSE 'th' END || ' ' || {month} || ', ' || CAST(year(o_orderdate) AS {text})
    WHEN '3' THEN upper({month}) || ' ' || CAST(day(o_orderdate) AS {text}) || 'th,  ' || CAST(year(o_orderdate) AS {text})
    WHEN '4' THEN 'Monday ' || CAST(day(o_orderdate) AS {text}) || ', 31st ' || {month} || ' ' || CAST(year(o_orderdate) AS {text})
    ELSE 'sometime in ' || CAST(year(o_orderdate) AS {text}) END AS date
FROM {orders}"""


def _dated(s, d):
    sql = _DATED.replace("{text}", "STRING").replace("{month}", "date_format(o_orderdate, 'MMMM')")
    return s.sql(sql, orders=read(s, d, "orders")).select("match_id", "date", cricket.parse_date("date").alias("day"))


def _dated_sql(select: str) -> str:
    inner = _DATED.replace("{text}", "VARCHAR").replace("{month}", "monthname(o_orderdate)").replace("{orders}", "orders")
    return f"WITH dated AS (SELECT match_id, date, CASE WHEN date NOT LIKE 'some%' THEN day END AS day FROM ({inner})) {select}"


def _between(s, d):
    """Matches of two years, from a table clustered by day."""
    path = f"{work_dir(s)}/matches"
    layout.write_clustered(_dated(s, d), path, "day", "match_id")
    rows = s.read.schema("match_id bigint, date string, day date").parquet(path)
    return layout.between(rows, "day", F.to_date(F.lit("1995-03-01")), F.to_date(F.lit("1996-12-31")))


def _drifting(s, d):
    """Embedded documents whose keys change their type from page to page."""
    page = derived.order_documents(s, d, "embedded")
    k = F.col("doc_id").cast("bigint") % 4
    value = F.col("value")
    value = F.when(k == 1, F.replace(value, F.lit('"data": {'), F.lit('"data": [1], "other": {'))).otherwise(value)
    value = F.when(k == 2, F.replace(value, F.lit('"ground": {'), F.lit('"team2": "a text", "ground": {'))).otherwise(value)
    value = F.when(k == 3, F.replace(value, F.lit('{"id": 5}'), F.lit('7, "x", null, {"id": {"a": 1}, "title": 12, "format": 3.5}'))).otherwise(value)
    return live.embedded_matches(page.select("doc_id", value.alias("value")), "value", "doc_id").drop("item_no")


ENTRIES = {
    "career_loads": (_career_loads, oracle(_CAREER, *_CAREER_TABLES)),
    "upsert_parts": (
        _upsert_parts,
        oracle("""SELECT * FROM target_rows WHERE id NOT IN (SELECT id FROM source_rows) UNION ALL
                  SELECT id, name, dob FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn
                  FROM source_rows) WHERE rn = 1""", "target_rows", "source_rows")),
    "merged_loads": (
        _merged_loads,
        card_oracle(f"""{_FIRST} SELECT innings_id AS id, CAST(k AS VARCHAR) AS match_id, n AS innings_number, CAST(bat AS VARCHAR) AS batting_team_id,
            a + 100 AS runs, CASE WHEN st = 'F' THEN '18.4' ELSE '20' END AS overs FROM loaded""")),
    "match_commentary": (
        _match_commentary,
        """WITH ends AS (SELECT user_id, min(event_id) AS over FROM events WHERE event_type = 'purchase' AND user_id % 3 = 0 GROUP BY user_id)
           SELECT e.user_id AS match_id, event_type || ' ' || props AS text, min(event_id) AS place
           FROM events e LEFT JOIN ends ON e.user_id = ends.user_id WHERE event_type <> 'error' AND event_id <= coalesce(ends.over, event_id)
           GROUP BY e.user_id, event_type || ' ' || props"""),
    "queue_stream": (
        _queue,
        oracle("""SELECT q.ca_match_id, CASE o.ok WHEN true THEN 'COMPLETED' WHEN false THEN 'FAILED' ELSE q.status END AS status
                  FROM queue q LEFT JOIN (SELECT ca_match_id, max(ok) AS ok FROM outcomes GROUP BY ca_match_id) o
                  ON q.ca_match_id = o.ca_match_id""", "queue", "outcomes")),
    "migrate_deliveries": (
        _migrated,
        oracle("""SELECT sha256('ca_' || chr(31) || id) AS delivery_id, 'ca_' || match_id AS match_id, innings, over, ball, batter,
            bowler, non_striker, runs_batter, runs_extras, coalesce(runs_batter, 0) + coalesce(runs_extras, 0) AS runs_total,
            is_wicket, dismissal_kind, player_dismissed FROM ball_by_ball""", "ball_by_ball")),
    "player_search_indexed": _indexed("players", "player_id", "R#00000012"),
    "venue_search_indexed": _indexed("venues", "venue_id", "K%SUPP"),
    "status_sketches": (
        _sketches,
        oracle("""SELECT (SELECT count(*) FROM scraped_matches) AS total_matches, (SELECT count(*) FROM progress) AS completed_extractions,
                    (SELECT CAST(sum(balls) AS BIGINT) FROM scraped_batting) AS total_balls_delivered, TRUE AS players_within_error""", *_CARDS)),
    "match_dates": (_dated, _dated_sql("SELECT * FROM dated")),
    "matches_between": (_between, _dated_sql("SELECT * FROM dated WHERE day BETWEEN DATE '1995-03-01' AND DATE '1996-12-31'")),
    "embedded_drifting": (
        _drifting,
        card_oracle("""SELECT CAST(k AS VARCHAR) AS doc_id, CASE i WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN 'x' || k
              WHEN 2 THEN '5' ELSE '{"a":1}' END AS match_id, CASE i WHEN 0 THEN 'M' || k WHEN 1 THEN 'N' WHEN 3 THEN '12' ELSE '' END AS name,
            CASE i WHEN 0 THEN 'LIVE' WHEN 1 THEN 'done' ELSE '' END AS status, CASE i WHEN 1 THEN 'by ' || a ELSE '' END AS status_detail,
            CASE i WHEN 0 THEN 'T' || c ELSE '' END AS team1, '' AS team2, CASE i WHEN 1 THEN 'G' || c ELSE '' END AS venue,
            CASE i WHEN 1 THEN 'ODI' WHEN 3 THEN '3.5' ELSE '' END AS format FROM cards, (VALUES (0), (1), (2), (3)) v(i)
            WHERE CASE i WHEN 0 THEN k % 4 <> 1 WHEN 1 THEN k % 4 <> 2 WHEN 2 THEN k % 4 <> 3 ELSE k % 4 = 3 END""")),
}
