"""The registered queries of these operators over the given tables, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed_dedup, language, minhash, mixing, packing, personal, phrases, records, repair, runs, topk, url_filter, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def _language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"))


def _mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.by_position(mixing.plan(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "position")


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.detect(table(spark, sf_dir, "documents"))


def _minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def _topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def _embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


def _url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def _warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeated(table(spark, sf_dir, "documents"))


def run_digests(docs: DataFrame) -> DataFrame:
    """What find_runs() says of the planted documents, in a few numbers and hashes a document."""
    found = runs.find_runs(runs.planted(docs))
    # of the longest the first, and of these the one with the smallest period
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
                       F.floor(1000 * F.col("top.length") / -F.col("top.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(table(spark, sf_dir, "documents"))


def _repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report_all(table(spark, sf_dir, "conversations"))


def _position_sql(share: str) -> str:
    """The inverse of the schedules in SQL, from the same constants."""
    def inverse(schedule: mixing.Schedule) -> str:
        out, after = "", None
        for t, length, w, slope, before in reversed(mixing.cumulative(schedule)):
            rest = f"greatest({share} - {before!r}::DOUBLE, 0::DOUBLE)"
            root = f"({w!r}::DOUBLE + sqrt(greatest({w * w!r}::DOUBLE + {2 * slope!r}::DOUBLE * {rest}, 0::DOUBLE)))"
            here = f"({t!r}::DOUBLE + least(CASE WHEN {root} > 0 THEN 2::DOUBLE * {rest} / {root} ELSE 0 END, {length!r}::DOUBLE))"
            out = here if after is None else f"CASE WHEN {share} < {after!r}::DOUBLE THEN {here} ELSE {out} END"
            after = before
        return out

    cases = " ".join(f"WHEN {k} THEN {inverse(s)}" for k, s in enumerate(mixing.SCHEDULES))
    return f"CASE CAST(ordinal % {len(mixing.WEIGHTS)} AS INTEGER) {cases} END"


_MIXING_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS place, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS ordinal
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, [{', '.join(map(str, mixing.WEIGHTS))}][CAST(ordinal % {len(mixing.WEIGHTS)} AS INTEGER) + 1] AS weight,
         sum(source_size) OVER () AS total FROM sources),
ranked AS (
  SELECT *, row_number() OVER w AS nth, CAST(sum(source_size) OVER w - source_size AS BIGINT) AS size_before,
         CAST(sum(weight) OVER () - sum(weight) OVER w + weight AS BIGINT) AS left_weight
  FROM weighed WINDOW w AS (ORDER BY source_size * 1.0::DOUBLE / weight, ordinal ROWS UNBOUNDED PRECEDING)),
level AS (
  SELECT nth AS free_from, CAST(total - {mixing.MOST_EPOCHS} * size_before AS BIGINT) AS words, left_weight AS weights FROM ranked
  WHERE {mixing.MOST_EPOCHS} * source_size * left_weight > (total - {mixing.MOST_EPOCHS} * size_before) * weight ORDER BY nth LIMIT 1),
goals AS (
  SELECT source, source_size, ordinal,
         CASE WHEN nth >= free_from THEN CAST(words * weight AS DOUBLE) / weights
              ELSE CAST({mixing.MOST_EPOCHS} * source_size AS DOUBLE) END AS target
  FROM ranked LEFT JOIN level ON true),
placed AS (
  SELECT doc_id, size, source_size, target, ordinal, CAST(floor(target) AS BIGINT) AS goal,
         CAST(sum(size) OVER (PARTITION BY ordinal ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS before
  FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source),
counted AS (
  SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS epochs, CASE WHEN goal > 0 THEN before / goal::DOUBLE END AS share FROM placed),
taken AS (
  SELECT *, CAST(epochs * size + least(greatest(goal - epochs * source_size - before, 0), size) AS BIGINT) AS taken FROM counted)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN {_position_sql('share')} END AS position FROM taken
"""

_TOPK_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.vec, c.vec) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

_EMBED_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
groups AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN groups ON vec_id = groups.a LEFT JOIN counts ON vec_id = counts.a
"""

def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string in SQL, by the table of CTE ``crc``."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, crc_steps[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295)"


_CRC_TABLE = """crc AS (
  SELECT list(list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) ORDER BY i) AS crc_steps
  FROM range(256) r(i))"""

_RUNS_SQL = rf"""
WITH {_CRC_TABLE},
texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, row_number() OVER () AS row, {_crc32_sql("doc_id::VARCHAR")} AS h FROM documents, crc),
places AS (SELECT *, CAST(len(words) AS BIGINT) AS n, h // 10 AS g, CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a FROM texts),
chosen AS (SELECT *, h % 10 = 0 AND n > 0 AS hit, 1 + (n - a) // (3 + g % 8) AS p FROM places),
docs AS (
  SELECT doc_id, row, n, CASE WHEN hit THEN list_transform(range(n), lambda i: words[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE words END AS words FROM chosen),
said AS (SELECT row, n, unnest(range(n)) AS i, unnest(words) AS w FROM docs WHERE n >= {runs.LEAST_LENGTH}),
fives AS (
  SELECT row, n, i, hash([w, lead(w, 1) OVER following, lead(w, 2) OVER following, lead(w, 3) OVER following, lead(w, 4) OVER following]) AS five
  FROM said WINDOW following AS (PARTITION BY row ORDER BY i) QUALIFY i <= n - 5),
pairs AS (
  SELECT x.row, x.i, y.i - x.i AS period FROM fives x JOIN fives y ON x.row = y.row AND x.five = y.five AND y.i > x.i AND y.i - x.i <= x.n // {runs.LEAST_EXPONENT}),
islands AS (SELECT row, period, i, i - row_number() OVER (PARTITION BY row, period ORDER BY i) AS island FROM pairs),
stretches AS (SELECT row, period, min(i) AS start, count(*) + 4 + period AS length FROM islands GROUP BY row, period, island),
found AS (
  SELECT row, start, length, min(period) AS period FROM stretches
  WHERE length >= greatest({runs.LEAST_LENGTH}, {runs.LEAST_EXPONENT} * period) GROUP BY row, start, length),
listed AS (
  SELECT row, count(*) AS n_runs, list({{'start': start, 'length': length, 'period': period}} ORDER BY length DESC, start, period)[1] AS top,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         list(list_value(start + period, start + length)) AS gone FROM found GROUP BY row),
kept AS (
  SELECT docs.row, doc_id, n_runs, top, lines,
         CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda w, i: len(list_filter(gone, lambda r: i > r[1] AND i <= r[2])) = 0) END AS words
  FROM docs LEFT JOIN listed ON docs.row = listed.row)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(top.start AS BIGINT) AS start, CAST(top.length AS BIGINT) AS length, CAST(top.period AS BIGINT) AS period,
       CAST(1000 * top.length // top.period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(array_to_string(words, ' '), '')) AS collapsed_sha256
FROM kept
"""

_REPAIR_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS damage FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN damage = 3 THEN 2 ELSE 1 END)) AS copy
  FROM given WHERE damage <> 0),
turns AS (
  SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS said,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS c, left(lag(role) OVER w, 1) AS c_before
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), copy)),
judged AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN said > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault FROM turns),
priced AS (SELECT *, CASE fault WHEN 'truncated' THEN {repair.TRUNCATED} ELSE 0 END AS t, fault IN ('blank', 'duplicate') AS gone FROM judged),
totals AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 0 AND c_before || c NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n FROM judged GROUP BY conv_id),
costs AS (  -- before turn i: least cost to the end with nothing yet, after the system turn, a user's, an assistant's; v is closed under insertion
  SELECT conv_id, n AS i, [0, {2 * repair.INSERT}, {repair.INSERT}, 0]::BIGINT[] AS v FROM totals
  UNION ALL
  SELECT conv_id, i, [least(b[1], {repair.INSERT} + least(b[3], {repair.INSERT} + b[4])), least(b[2], {repair.INSERT} + least(b[3], {repair.INSERT} + b[4])),
                      least(b[3], {repair.INSERT} + b[4]), least(b[4], {repair.INSERT} + b[3])]
  FROM (SELECT r.conv_id, r.i, CASE WHEN gone THEN list_transform(v, lambda x: x + {repair.DELETE}) ELSE [
          least({repair.DELETE} + v[1], {repair.REROLE} + t + v[3], CASE c WHEN 's' THEN t + v[2] WHEN 'u' THEN t + v[3] END),
          least({repair.DELETE} + v[2], {repair.REROLE} + t + v[3], CASE c WHEN 'u' THEN t + v[3] END),
          least({repair.DELETE} + v[3], {repair.REROLE} + t + v[4], CASE c WHEN 'a' THEN t + v[4] END),
          least({repair.DELETE} + v[4], {repair.REROLE} + t + v[3], CASE c WHEN 'u' THEN t + v[3] END)] END AS b
        FROM costs JOIN priced r ON r.conv_id IS NOT DISTINCT FROM costs.conv_id AND r.i = costs.i - 1)),
walked AS (  -- state s from 1; the least letter of those on a cheapest path
  SELECT conv_id, 0::BIGINT AS i, 1 AS s, '' AS audit, NULL::VARCHAR AS out, false AS done FROM totals
  UNION ALL
  SELECT conv_id, i + CASE WHEN letter IN ('D', 'K', 'R') THEN 1 ELSE 0 END,
         CASE letter WHEN 'D' THEN s WHEN 'K' THEN CASE c WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END WHEN '' THEN s ELSE CASE s WHEN 3 THEN 4 ELSE 3 END END,
         audit || letter,
         CASE WHEN letter IN ('D', '') THEN out ELSE concat_ws(chr(10), out, CASE letter WHEN 'K' THEN role || ':' || text
              ELSE CASE s WHEN 3 THEN 'assistant' ELSE 'user' END || ':' || CASE letter WHEN 'R' THEN text ELSE '' END END) END,
         letter = ''
  FROM (SELECT w.*, r.role, r.text, r.c,
               CASE WHEN r.i IS NULL THEN CASE WHEN s IN (1, 4) THEN '' ELSE 'I' END
                    WHEN {repair.DELETE} + after.v[s] = here.v[s] THEN 'D'
                    WHEN {repair.INSERT} + here.v[CASE s WHEN 3 THEN 4 ELSE 3 END] = here.v[s] THEN 'I'
                    WHEN NOT gone AND CASE WHEN r.c = 's' AND s = 1 THEN t + after.v[2] WHEN r.c = 'u' AND s <> 3 THEN t + after.v[3] WHEN r.c = 'a' AND s = 3 THEN t + after.v[4] END = here.v[s] THEN 'K'
                    ELSE 'R' END AS letter
        FROM walked w JOIN costs here ON here.conv_id IS NOT DISTINCT FROM w.conv_id AND here.i = w.i
        LEFT JOIN priced r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i
        LEFT JOIN costs after ON after.conv_id IS NOT DISTINCT FROM w.conv_id AND after.i = w.i + 1
        WHERE NOT done)),
ends AS (SELECT conv_id, audit, out FROM walked WHERE done),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(costs.v[1], 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(out, '')) AS repaired_sha256
FROM ids LEFT JOIN totals ON ids.conv_id IS NOT DISTINCT FROM totals.conv_id
LEFT JOIN costs ON ids.conv_id IS NOT DISTINCT FROM costs.conv_id AND costs.i = 0
LEFT JOIN ends ON ids.conv_id IS NOT DISTINCT FROM ends.conv_id
"""

#: Name: (query, SQL twin or None). Those without one are held against brute force in tests/llm.
ENTRIES: dict[str, tuple[Query, str | None]] = {
    "op1_packing": (_packing, None),
    "op2_language_id": (_language, None),
    "op3_mixing": (_mixing, _MIXING_SQL),
    "op4_personal_data": (_personal, None),
    "op5_minhash_dedup": (_minhash, None),
    "op6_exact_topk": (_topk, _TOPK_SQL),
    "op7_embedding_dedup": (_embed_dedup, _EMBED_SQL),
    "op8_url_filter": (_url_filter, None),
    "op9_warc": (_warc, None),
    "op10_repeated_phrases": (_phrases, None),
    "op11_periodic_runs": (_runs, _RUNS_SQL),
    "op12_token_records": (_records, None),
    "op13_conversation_repair": (_repair, _REPAIR_SQL),
}
