"""De-duplication, registry, table maintenance, work queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..operators import crawl_queue, dedup, joins, maintenance, registry
from ..sources import sinks
from .adapters import adapt, oracle, read

_LOG = """
r AS (SELECT *, coalesce(nullif(match_id, ''), nullif(id, '')) AS lid, coalesce(source, 'history') AS src,
        coalesce(title, '') AS t FROM log),
k AS (SELECT *, row_number() OVER (PARTITION BY src, lid ORDER BY line_no) AS pos FROM r WHERE lid IS NOT NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY src, lid ORDER BY length(t) DESC, line_no) AS rn
         FROM k WHERE pos = 1 OR NOT contains(t, 'Live Cricket Score'))"""


def _fixed_source(log):
    return dedup.dedup_log(log, source="history")


_KNOWN = " ".join(f"WHEN '{code}' THEN '{name}'" for code, name in fixed.REGISTRY_TEAMS.items())
_TEAM = "CASE WHEN coalesce({c}, '') = '' THEN 'Unknown' ELSE CASE trim({c}) " + _KNOWN + " ELSE trim({c}) END END"

_SIGNED = f"""
named AS (SELECT *, {_TEAM.format(c='team1')} AS n1, {_TEAM.format(c='team2')} AS n2, lower(source) AS src FROM sightings),
signed AS (SELECT *, md5(least(lower(n1), lower(n2)) || '_' || greatest(lower(n1), lower(n2)) || '_' ||
             coalesce(date, 'None') || '_' || coalesce(format, 'None')) AS sig FROM named)"""

_RULED = ", ".join(f"max(CASE WHEN src = '{s}' THEN seq END) AS at_{s}" for s in ("ca", "cricbuzz", "espn"))


def _old_and_new(s, d):
    """The earlier half of the sightings as registry, by status; the rest as batch."""
    rows = adapt(s, d, "sightings")
    empty = s.createDataFrame([], "universal_match_id string, team1 string, team2 string, match_date string, "
                                  "format string, ca_id string, cricbuzz_id string, espn_id string")
    old, _ = registry.register(empty, rows.filter(F.col("date").isNull()))
    return old, rows.filter(F.col("date").isNotNull() | (F.col("format") < "3"))


def _registry(s, d):
    return registry.register(*_old_and_new(s, d))[0]


def _registry_new(s, d):
    return registry.register(*_old_and_new(s, d))[1].select("seq", "source_id", "is_new")


_TARGET = ("target_rows", "source_rows")


def _merge(fn, *extra):
    def run(s, d):
        target, src = adapt(s, d, *_TARGET)
        return fn(target, src, "id", *extra, "seq")

    return run


def _missing_ids(s, d):
    docs, labels = read(s, d, "documents"), read(s, d, "labels")
    bounds = docs.agg(F.lit(1).cast("bigint").alias("lo"), F.max("doc_id").alias("hi"))
    known = labels.select(F.col("doc_id").cast("string").alias("ca_match_id"))
    return crawl_queue.missing_below(bounds, known)


def _requeue(s, d):
    return crawl_queue.requeue_missing(*adapt(s, d, "queue", "artifacts"))


def _raw_new(s, d):
    return joins.only_new(read(s, d, "documents").select("doc_id", "source"), read(s, d, "labels"), "doc_id")


def _prefer(s, d):
    """Account, then order, then line item figures of a customer key; the first source that has it counts."""
    target, src = adapt(s, d, *_TARGET)
    a = target.select("id", F.lit("account").alias("origin"), "name")
    b = src.select("id", F.lit("order").alias("origin"), "name")
    return a, b


def _sorted_log(s, d):
    return sinks.sorted_by_id(dedup.dedup_log(adapt(s, d, "log"), source="history"), "log_id").select("log_id", "line_no")


ENTRIES = {
    "log_dedup": (
        lambda s, d: _fixed_source(adapt(s, d, "log")).select("source", "log_id", "line_no", "title"),
        oracle(f""", {_LOG.strip()} SELECT src AS source, lid AS log_id, line_no, title FROM best WHERE rn = 1""", "log")),
    "log_sorted": (
        _sorted_log, oracle(f""", {_LOG.strip()} SELECT lid AS log_id, line_no FROM best WHERE rn = 1""", "log")),
    "unique_players": (
        lambda s, d: dedup.unique_players(adapt(s, d, "entity_rows")),
        oracle("""SELECT id, name, dob, seen FROM (SELECT *, row_number() OVER (PARTITION BY id
                    ORDER BY CASE WHEN coalesce(dob, '') = '' THEN 1 ELSE 0 END, seen) AS rn FROM entity_rows) WHERE rn = 1""",
               "entity_rows")),
    "last_wins": (
        lambda s, d: dedup.last_wins(adapt(s, d, "entity_rows"), ["id"], "seen"),
        oracle("""SELECT id, name, dob, seen FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seen DESC) AS rn
                  FROM entity_rows) WHERE rn = 1""", "entity_rows")),
    "prefer_sources": (
        lambda s, d: dedup.prefer_sources(list(_prefer(s, d))),
        oracle("SELECT id, 'account' AS origin, name FROM target_rows", *_TARGET)),
    "prefer_sources_by_key": (
        lambda s, d: dedup.prefer_sources(list(_prefer(s, d)), "id"),
        oracle("""SELECT id, 'account' AS origin, name FROM target_rows UNION ALL
                  SELECT id, 'order', name FROM source_rows WHERE id NOT IN (SELECT id FROM target_rows)""", *_TARGET)),
    "union_sources": (
        lambda s, d: joins.union_sources(*adapt(s, d, *_TARGET)),
        oracle("""SELECT id, name, dob, NULL AS seq FROM target_rows UNION ALL SELECT id, name, dob, seq FROM source_rows""",
               *_TARGET)),
    "match_registry": (
        _registry,
        oracle(f""", {_SIGNED.strip()},
            used AS (SELECT * FROM signed WHERE date IS NULL OR date IS NOT NULL),
            per AS (SELECT sig, min(CASE WHEN date IS NULL THEN seq - 1000000000000 ELSE seq END) AS first_at, {_RULED}
                    FROM used GROUP BY sig)
            SELECT p.sig AS universal_match_id, f.n1 AS team1, f.n2 AS team2, f.date AS match_date, f.format,
              a.source_id AS ca_id, b.source_id AS cricbuzz_id, e.source_id AS espn_id
            FROM per p JOIN signed f ON f.sig = p.sig AND (CASE WHEN f.date IS NULL THEN f.seq - 1000000000000 ELSE f.seq END) = p.first_at
            LEFT JOIN signed a ON a.seq = p.at_ca LEFT JOIN signed b ON b.seq = p.at_cricbuzz
            LEFT JOIN signed e ON e.seq = p.at_espn""", "sightings")),
    "match_registry_new": (
        _registry_new,
        oracle(f""", {_SIGNED.strip()},
            batch AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY seq) AS rn FROM signed
                      WHERE date IS NOT NULL OR format < '3')
            SELECT seq, source_id, rn = 1 AND sig NOT IN (SELECT sig FROM signed WHERE date IS NULL) AS is_new
            FROM batch""", "sightings")),
    "insert_ignore": (
        _merge(maintenance.insert_ignore),
        oracle("""SELECT * FROM target_rows UNION ALL SELECT id, name, dob FROM (SELECT *, row_number() OVER
                  (PARTITION BY id ORDER BY seq) AS rn FROM source_rows) WHERE rn = 1
                  AND id NOT IN (SELECT id FROM target_rows)""", *_TARGET)),
    "upsert": (
        _merge(maintenance.upsert),
        oracle("""SELECT * FROM target_rows WHERE id NOT IN (SELECT id FROM source_rows) UNION ALL
                  SELECT id, name, dob FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn
                  FROM source_rows) WHERE rn = 1""", *_TARGET)),
    "fill_null": (
        _merge(maintenance.fill_null, "dob"),
        oracle("""SELECT t.id, t.name, coalesce(t.dob, s.dob) AS dob FROM target_rows t LEFT JOIN (SELECT id,
                  arg_min(dob, seq) AS dob FROM source_rows WHERE dob IS NOT NULL GROUP BY id) s ON t.id = s.id""", *_TARGET)),
    "transition": (
        lambda s, d: maintenance.transition(adapt(s, d, "queue"), F.col("status") == "FAILED", "PENDING"),
        oracle("""SELECT ca_match_id, CASE WHEN status = 'FAILED' THEN 'PENDING' ELSE status END AS status, discovered_at
                  FROM queue""", "queue")),
    "requeue_missing": (
        _requeue,
        oracle("""SELECT ca_match_id, CASE WHEN status = 'SUCCESS' AND ca_match_id NOT IN (SELECT CAST(doc_id AS VARCHAR)
                  FROM artifacts) THEN 'PENDING' ELSE status END AS status, discovered_at FROM queue""", "queue", "artifacts")),
    "apply_outcomes": (
        lambda s, d: maintenance.apply_outcomes(*adapt(s, d, "queue", "outcomes")),
        oracle("""SELECT q.ca_match_id, CASE WHEN ok THEN 'COMPLETED' WHEN NOT ok THEN 'FAILED' ELSE status END AS status,
                  discovered_at FROM queue q LEFT JOIN outcomes o ON q.ca_match_id = o.ca_match_id""", "queue", "outcomes")),
    "delete_where": (
        lambda s, d: maintenance.delete_where(adapt(s, d, "players"), "name", "CUSTOMER#0000001"),
        oracle("SELECT * FROM players WHERE name NOT ILIKE '%customer#0000001%'", "players")),
    "only_new": (
        _raw_new, "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "missing_artifacts": (
        lambda s, d: joins.missing_artifacts(*adapt(s, d, "queue", "artifacts")),
        oracle("""SELECT * FROM queue WHERE status = 'SUCCESS' AND ca_match_id NOT IN
                  (SELECT CAST(doc_id AS VARCHAR) FROM artifacts)""", "queue", "artifacts")),
    "missing_ids": (
        _missing_ids,
        """SELECT CAST(i AS VARCHAR) AS ca_match_id, 'PENDING' AS status
           FROM (SELECT unnest(generate_series(1, (SELECT max(doc_id) FROM documents))) AS i)
           WHERE i NOT IN (SELECT doc_id FROM labels)"""),
    "id_coverage": (
        lambda s, d: crawl_queue.id_coverage(adapt(s, d, "wide_queue"), ["espn_match_id", "cb_match_id", "ca_match_id"]),
        oracle("""SELECT count(nullif(espn_match_id, '')) AS espn_match_id, count(nullif(cb_match_id, '')) AS cb_match_id,
                  count(nullif(ca_match_id, '')) AS ca_match_id FROM wide_queue""", "wide_queue")),
    "id_range": (
        lambda s, d: crawl_queue.id_range(adapt(s, d, "wide_queue")),
        oracle("""SELECT status, min(CAST(ca_match_id AS BIGINT)) AS min_id, max(CAST(ca_match_id AS BIGINT)) AS max_id
                  FROM wide_queue GROUP BY status""", "wide_queue")),
    "id_range_text": (
        lambda s, d: crawl_queue.id_range(adapt(s, d, "wide_queue"), as_text=True),
        oracle("SELECT status, min(ca_match_id) AS min_id, max(ca_match_id) AS max_id FROM wide_queue GROUP BY status",
               "wide_queue")),
    "id_histogram": (
        lambda s, d: crawl_queue.id_histogram(adapt(s, d, "wide_queue")),
        oracle("""SELECT CAST(ca_match_id AS BIGINT) // 10000 * 10000 AS bucket, count(*) AS cnt FROM wide_queue
                  WHERE status = 'PENDING' GROUP BY 1""", "wide_queue")),
    "status_counts": (
        lambda s, d: crawl_queue.counts_by(adapt(s, d, "queue")),
        oracle("SELECT status, count(*) AS cnt FROM queue GROUP BY status", "queue")),
    "lookup_ids": (
        lambda s, d: joins.lookup_ids(adapt(s, d, "sightings").select("seq", "team1", "team2"),
                                      adapt(s, d, "team_names"), {"team1": "team1_id", "team2": "team2_id"},
                                      default_prefix=None),
        oracle("""SELECT s.seq, s.team1, s.team2, a.team_id AS team1_id, b.team_id AS team2_id FROM sightings s
                  LEFT JOIN (SELECT name, min(team_id) AS team_id FROM team_names GROUP BY name) a ON s.team1 = a.name
                  LEFT JOIN (SELECT name, min(team_id) AS team_id FROM team_names GROUP BY name) b ON s.team2 = b.name""",
               "sightings", "team_names")),
    "lookup_ids_default": (
        lambda s, d: joins.lookup_ids(adapt(s, d, "sightings").select("seq", "team2"),
                                      adapt(s, d, "side_names"), {"team2": "team2_id"}, default_prefix="T_"),
        oracle("""SELECT s.seq, s.team2, coalesce(b.team_id, 'T_' || upper(substr(s.team2, 1, 3))) AS team2_id
                  FROM sightings s LEFT JOIN (SELECT name, min(team_id) AS team_id FROM side_names GROUP BY name) b
                    ON s.team2 = b.name""", "sightings", "side_names")),
}
