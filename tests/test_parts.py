"""Nested results of oversized groups."""

from pyspark.sql import functions as F

from pavilion.operators import archive, profiles
from pavilion.operators.grouping import collect_parts


def test_parts_hold_every_row_once(spark):
    df = spark.range(60_000).select(F.when(F.col("id") < 40_000, 0).otherwise(F.col("id")).alias("k"), "id")
    parts = collect_parts(df, ["k"], F.struct("id"), "id", "items")
    hot = parts.filter("k = 0")  # far beyond any number at which the shape might change
    assert hot.count() == 16 and hot.agg(F.max(F.size("items")), F.min(F.size("items"))).first()[0] < 3_000
    assert parts.filter("k > 0").agg(F.max("part"), F.count("*")).first()[:] == (15, 20_000)
    ids = parts.select(F.explode("items").alias("i")).select("i.id")
    assert ids.count() == 60_000 and ids.distinct().count() == 60_000


def test_rollup_has_one_shape(spark):
    for n in (20, 30_000):
        players = spark.range(n).select(F.col("id").cast("string").alias("player_id"), F.lit("N").alias("name"), F.lit("IND").alias("team"))
        assert profiles.team_rollup(players).count() == 16 or n == 20
        assert profiles.team_rollup(players, parts=1).select(F.size("players")).first()[0] == n
        assert profiles.team_rows(players).count() == n


def test_scorecard_documents(spark):
    matches = spark.createDataFrame([(1, "t")], "match_id int, title string")
    innings = spark.createDataFrame([(1, 1), (1, 2)], "match_id int, innings_number int")
    fow = spark.createDataFrame([(1, 1, 5, "old"), (1, 1, 6, "new")], "match_id int, innings_number int, id int, fow_string string")
    batting = spark.createDataFrame([(i, 1, 1, f"p{i}", "b", i, 1, 1, 0, 0) for i in range(40)] + [(99, 1, 3, "x", "b", 1, 1, 1, 0, 0)],
                                    "id int, match_id int, innings_number int, player_name string, dismissal string, runs int, "
                                    "balls int, mins int, fours int, sixes int")
    bowling = spark.createDataFrame([(1, 1, 1, "q", 4.0, 0, 20, 2, 0, 0)],
                                    "id int, match_id int, innings_number int, player_name string, overs double, maidens int, "
                                    "runs int, wickets int, wides int, no_balls int")
    docs = archive.scorecards(matches, innings, fow, batting, bowling, match_id=1).orderBy("innings_number").collect()
    assert [(d.innings_number, d.fow, len(d.batting), len(d.bowling), d.match_meta.title) for d in docs] == [
        (1, "new", 40, 1, "t"), (2, "", 0, 0, "t")]
    assert [b.id for b in docs[0].batting] == list(range(40))
    old = archive.archive_scorecards(matches, batting, bowling).orderBy("innings_number").collect()
    assert [(d.batting_team, len(d.batting), len(d.bowling), d.fow) for d in old] == [
        ("Innings 1", 40, 1, []), ("Innings 2", 0, 0, []), ("Innings 3", 1, 0, [])]
    whole = archive.match_scorecards(matches, innings, fow, batting, bowling).collect()
    assert [(w.match_meta.title, [(i.innings_number, i.fow, len(i.batting)) for i in w.innings]) for w in whole] == [("t", [(1, "new", 40), (2, "", 0)])]
    two = matches.union(spark.createDataFrame([(2, "u")], matches.schema))
    assert {m.match_id: len(m.innings) for m in archive.match_scorecards(two, innings, fow, batting, bowling).collect()} == {1: 2, 2: 0}
    found = {m.match_id: (m.metadata.title, [i.batting_team for i in m.innings]) for m in archive.archive_match_scorecards(two, batting, bowling).collect()}
    assert found == {1: ("t", ["Innings 1", "Innings 2", "Innings 3"]), 2: ("u", [])}
    bad = batting.withColumn("innings_number", F.lit(2_000_000_000))
    assert archive.archive_scorecard_rows(matches, bad, bowling).count() == 1 and archive.rejected_rows(bad, bowling).count() == 41
    flat = archive.scorecard_rows(matches, innings, fow, batting, bowling, match_id=2)
    assert flat.count() == 0


def test_team_rollup(spark):
    players = spark.createDataFrame([("a_ind", "A", "IND"), ("b_ind", "B", "IND"), ("c_zzz", "C", "ZZZ")],
                                    "player_id string, name string, team string")
    teams = {r.team_id: r for r in profiles.team_rollup(players, parts=1).collect()}
    assert teams["IND"].name == "India" and teams["IND"].home_advantage == 0.12
    assert [p.player_id for p in teams["IND"].players] == ["a_ind", "b_ind"]
    assert teams["ZZZ"].name == "ZZZ" and teams["ZZZ"].home_advantage == 0.03


def test_status_without_tables(spark):
    batting = spark.createDataFrame([("a", None)], "player_name string, balls int")
    row = archive.warehouse_status(batting=batting).first()
    assert row.asDict() == {"total_matches": 0, "completed_extractions": 0, "total_balls_delivered": 0, "total_players": 1}


def test_search_takes_the_word_literally(spark):
    df = spark.createDataFrame([(1, "50% Off"), (2, "500 Off"), (3, None)], "id int, name string")
    assert [r.id for r in archive.search(df, "name", "id", "50% o").collect()] == [1]
