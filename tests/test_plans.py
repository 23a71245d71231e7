"""Plans: where rows move, what stays in the JVM, what reaches the scan."""

import re

import pytest
from pyspark.sql import functions as F

from pavilion.plans import catalog, queries_files, queries_kept, queries_pages

QUERIES = {name: run for name, (run, _) in catalog.entries().items()}
#: queries that start from pages already parsed into a written table, so their own plan has no Python left
PARSED_BEFORE = {"attach_batting", "attach_bowling", "attach_bowling_by_team"}
#: the markup pass is the only Python in any plan
WITH_PAGES = set(queries_pages.ENTRIES) - {"strip_tags", "url_ids"} - PARSED_BEFORE
#: queries that write files, streams or tables first and read them back
STREAMED = {"new_commentary", "latest_scores", "scorecard_rows_by_match", "career_stats_by_match"} | set(queries_files.ENTRIES) | set(queries_kept.ENTRIES)


def plan(df):
    return df._jdf.queryExecution().toString()


def physical(df):
    return plan(df).split("== Physical Plan ==")[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMED))
def test_no_cross_joins_and_no_stray_python(name, spark, sf_dir):
    text = physical(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    python = re.findall(r"\w*(?:Python|InArrow|InPandas|BatchEval)\w*", text)
    assert bool(python) == (name in WITH_PAGES), python
    # a window without partitions would pull all rows into one task
    assert not re.search(r"Window(?:GroupLimit)? \[[^\]]*\], \[\],", text)


def test_career_stats_moves_facts_once(spark, sf_dir):
    text = physical(QUERIES["career_stats"](spark, sf_dir))
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text and "FullOuter" not in text
    assert "partial_" in text
    scan = re.findall(r"ReadSchema: (struct<[^>]*>)", text)
    assert any("l_returnflag" in s and "l_extendedprice" not in s for s in scan)


def test_top_k_is_not_a_full_sort(spark, sf_dir):
    for name in ("top_run_scorers", "recent_matches", "recent_extractions", "player_search", "squad_sizes"):
        assert "TakeOrderedAndProject" in physical(QUERIES[name](spark, sf_dir)), name


def test_playing_xi_limits_before_the_shuffle(spark, sf_dir):
    text = physical(QUERIES["playing_xi"](spark, sf_dir))
    assert text.count("WindowGroupLimit") == 2


def test_filters_reach_the_scan(spark, sf_dir):
    assert "EqualTo(o_orderkey,42)" in physical(QUERIES["match_lookup"](spark, sf_dir))


def test_pages_to_facts_without_a_shuffle(spark, sf_dir):
    from pavilion.operators import pages, scorecards
    raw = spark.createDataFrame([("m", "<table></table>")], "doc_id string, content string")
    meta = scorecards.with_meta(pages.parse_pages(raw))
    for rows in (scorecards.match_meta(meta), scorecards.innings(meta), scorecards.batting_rows(meta),
                 scorecards.bowling_by_innings(meta), scorecards.fall_of_wickets(meta), scorecards.harvest_entities(meta)):
        assert "Exchange" not in physical(rows)


def test_tables_laid_out_by_match_join_where_they_lie(spark, sf_dir):
    from pavilion.plans.queries_archive import _CARD, laid_out
    from pavilion.operators import archive

    tables = laid_out(spark, sf_dir, *_CARD)
    tables[0].sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = physical(archive.scorecard_rows(*tables))
    assert "Exchange" not in text and text.count("SortMergeJoin") >= 4 and "Bucketed: true" in text


def test_careers_by_match_move_their_totals_only(spark, sf_dir):
    df = QUERIES["career_stats_by_match"](spark, sf_dir)
    df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = physical(df.select("*"))
    below = [part.split("Scan parquet")[0] for part in text.split("SortMergeJoin")[1:]]
    assert len(below) == 2 and not any("Exchange" in b for b in below)


def test_careers_by_match_are_added_up_once(spark, sf_dir):
    text = physical(QUERIES["career_stats_by_match"](spark, sf_dir))
    assert len(re.findall("Exchange hashpartitioning", text)) == 1 and text.count("HashAggregate") == 2


def test_tables_are_laid_out_without_a_sort(spark, tmp_path):
    from pavilion.sources import layout

    layout.lay_out(spark.range(100).select(F.col("id").alias("match_id")), "unsorted", str(tmp_path / "t"), buckets=4)
    told = {r["col_name"]: r["data_type"] for r in spark.sql("DESCRIBE EXTENDED unsorted").collect()}
    assert told["Num Buckets"] == "4" and "match_id" in told["Bucket Columns"] and told.get("Sort Columns", "[]") == "[]"
    spark.sql("DROP TABLE unsorted")


def test_ranges_and_parts_reach_the_scan(spark, sf_dir, tmp_path):
    from pavilion.sources import layout

    text = physical(QUERIES["matches_between"](spark, sf_dir))
    assert "GreaterThanOrEqual(day,1995-03-01)" in text and "LessThanOrEqual(day,1996-12-31)" in text
    rows = spark.range(1000).withColumn("v", F.col("id"))
    layout.write_parts(rows, str(tmp_path / "t"), "id", 16)
    some = layout.read_parts(spark, str(tmp_path / "t"), "id bigint, v bigint", [3, 5])
    assert "part#" in re.search(r"PartitionFilters: \[[^\]]*\]", physical(some)).group(0)


def test_scorecard_rows_move_once(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = physical(QUERIES["scorecard_rows"](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # batting and bowling rows move once each, straight from their scans, to the listed innings, which are worked out once
    assert len(set(re.findall(r"Exchange hashpartitioning\(match_id#\w+, innings_number#\w+, 4\)", text))) == 5, text
    assert len(re.findall(r"ReusedExchange", text)) >= 3


@pytest.mark.parametrize("name", ["entity_players", "entity_teams"])
def test_entities_take_one_pass_and_one_exchange(name, spark, sf_dir):
    text = physical(QUERIES[name](spark, sf_dir))
    assert len(re.findall("MapInArrow", text)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\((?!k#)", text)) == 1  # besides the rows that pages are made of
