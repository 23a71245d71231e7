"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from pavilion import session
from pavilion.operators import crawl_queue, dedup, maintenance, nested, pages, profiles
from pavilion.plans import loads
from pavilion.sources import scans, sinks


def test_scan_pages(spark, tmp_path):
    (tmp_path / "1234").mkdir()
    (tmp_path / "1234" / "12345.html").write_bytes(b"<title>a\xff b</title>")
    (tmp_path / "7.html").write_text("<title>c</title>")
    (tmp_path / "x.txt").write_text("no")
    found = scans.scan_pages(spark, str(tmp_path))
    titles = {r.doc_id: r.title for r in pages.parse_pages(found).collect()}
    assert titles == {"12345": "a b", "7": "c"}


MATCH = {"info": {"match_type": "T20", "teams": ["A", "B"], "dates": ["2020-01-01"], "venue": "V",
                  "outcome": {"winner": "A", "by": {"wickets": 3}}},
         "innings": [{"team": "A", "overs": [{"over": 0, "deliveries": [
             {"batter": "x", "runs": {"batter": 4, "extras": 0, "total": 4}},
             {"batter": "y", "wickets": [{"kind": "bowled", "player_out": "y"}, {"kind": "run out"}]}]}]}]}


def test_match_json(spark, tmp_path):
    (tmp_path / "335.v2.json").write_text(json.dumps(MATCH, indent=1))
    (tmp_path / "336.json").write_text(json.dumps({"info": {}}))
    docs = scans.scan_match_json(spark, str(tmp_path))
    info = {r.match_id: r for r in nested.explode_match_info(docs).collect()}
    assert info["cricsheet_335"][1:] == ("2020-01-01", "V", "Unknown", "T20", "A", "B", "A", 0, 3)
    assert info["cricsheet_336"][1:] == ("Unknown", "Unknown", "Unknown", "Unknown", "Unknown", "Unknown", None, 0, 0)
    balls = nested.explode_deliveries(docs).orderBy("ball").collect()
    assert [(b.ball, b.batter, b.runs_total, b.is_wicket, b.dismissal_kind, b.player_dismissed) for b in balls] == [
        (1, "x", 4, 0, "", ""), (2, "y", 0, 1, "bowled", "y")]
    empty_m = nested.explode_match_info(docs).limit(0)
    empty_d = nested.explode_deliveries(docs).limit(0)
    first = loads.load_ball_by_ball(docs, empty_m, empty_d)
    again = loads.load_ball_by_ball(docs, first["matches"], first["deliveries"])
    assert (first["matches"].count(), first["deliveries"].count()) == (2, 2)
    assert (again["matches"].count(), again["deliveries"].count()) == (0, 0)


def test_jsonl_round_trip(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text("\n".join(['{"match_id": 20, "title": "short"}', "", "not json", '{"match_id": "20", "title": "longer é"}',
                              '{"id": "x1", "title": "t"}', '{"match_id": "3", "title": "Live Cricket Score first"}', "[1]",
                              '{"match_id": 3, "title": "n"}', '{"title": "no id"}', '{"match_id": 1000, "title": "a"}', "{broken"]))
    rows = scans.scan_jsonl(spark, str(log))
    assert rows.count() == 7
    best = dedup.dedup_log(rows, "line_no", source="web")
    out = str(tmp_path / "out")
    sinks.write_sorted_jsonl(best.select("source", F.col("log_id").alias("match_id"), "title"), out)
    lines = [json.loads(r.value) for r in spark.read.text(out).orderBy(F.monotonically_increasing_id()).collect()]
    assert {(r["match_id"], r["title"]) for r in lines} == {
        ("x1", "t"), ("3", "Live Cricket Score first"), ("20", "longer é"), ("1000", "a")}
    ordered = [r.log_id for r in sinks.sorted_by_id(best, "log_id").collect()]
    assert ordered == ["x1", "3", "20", "1000"]


def test_teams_round_trip(spark, tmp_path):
    doc = {"IND": {"team_id": "IND", "name": "India", "country": "India", "format_rankings": {"ODI": 1}, "home_advantage": 0.1,
                   "players": [{"player_id": "p1", "name": "P", "team": "IND", "role": "Bowler"}]},
           "Empty": {"name": "No players key"}}
    by_name = {"AUS": {"players": {"Q One": {"role": "Batsman", "batting_avg": 20.5}}}}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text(json.dumps(by_name))
    rows = {(r.team_id, r.player_name): r for r in scans.scan_teams(spark, str(tmp_path)).collect()}
    assert set(rows) == {("IND", "P"), ("AUS", "Q One")}
    assert rows["IND", "P"].format_rankings == {"ODI": 1} and rows["AUS", "Q One"].player.batting_avg == 20.5

    players = spark.createDataFrame([("p1", "P", "IND", "Bowler"), ("p2", "R", "IND", "Umpire")],
                                    "player_id string, name string, team string, role string")
    valid, rejected = profiles.conform_players(players)
    assert [r.player_id for r in rejected.collect()] == ["p2"]
    out = str(tmp_path / "teams")
    sinks.write_teams_json(profiles.team_heads(valid), valid, out)
    back = json.loads(spark.read.text(out).first().value)["IND"]
    assert {r.player_name for r in scans.parse_teams(spark.read.text(out)).collect()} == {"P"}
    assert back["team_id"] == "IND" and back["home_advantage"] == 0.12
    assert back["players"][0]["bowling_avg"] == 99.0 and back["players"][0]["is_captain"] is False


def test_append_refresh_and_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    root = str(tmp_path)
    sinks.append(df, f"{root}/t")
    sinks.append(df, f"{root}/t", None)
    assert scans.table(spark, "t", root).count() == 4
    sinks.refresh(df, f"{root}/t")
    assert scans.table(spark, "t", root).count() == 2
    sinks.append(df, f"{root}/p", ["s"])
    assert scans.table(spark, "p", root).filter("s = 'a'").count() == 1


def test_queue(spark):
    queue = spark.createDataFrame([("999", "PENDING"), ("1000", "PENDING"), ("20000", "PENDING"), ("x", "PENDING"), ("5", "FAILED")],
                                  "ca_match_id string, status string")
    text = {r.status: (r.min_id, r.max_id) for r in crawl_queue.id_range(queue, as_text=True).collect()}
    assert text["PENDING"] == ("1000", "x")
    number = {r.status: (r.min_id, r.max_id) for r in crawl_queue.id_range(queue).collect()}
    assert number["PENDING"] == (999, 20000)
    assert {r.bucket: r.cnt for r in crawl_queue.id_histogram(queue).collect()} == {0: 3, 20000: 1}
    left = crawl_queue.missing_ids(spark, 1, 1200, queue)
    assert left.count() == 1197 and left.filter("ca_match_id IN ('5', '999', '1000')").count() == 0
    results = spark.createDataFrame([("5", True, 1), ("999", True, 1), ("999", False, 2)], "ca_match_id string, ok boolean, at int")
    done = maintenance.apply_outcomes(queue, results, order="at")
    assert {r.ca_match_id: r.status for r in done.collect()} == {
        "5": "COMPLETED", "999": "FAILED", "1000": "PENDING", "20000": "PENDING", "x": "PENDING"}


def test_work_dir_comes_from_the_session(spark):
    assert session.work_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    with pytest.raises(ValueError):
        from pavilion.operators import careers
        careers.player_query(None, None, None, None, "fielding")


def test_small_files_are_read_and_listed_by_few_tasks(spark, tmp_path):
    for n in range(400):
        folder = tmp_path / str(n % 40)
        folder.mkdir(exist_ok=True)
        (folder / f"{n}.v1.json").write_text('{"info": {"city": "C"}}')
    found = scans.scan_match_json(spark, f"{tmp_path}/*")
    assert found.rdd.getNumPartitions() <= 8 and found.select("match_id").distinct().count() == 400
    assert found.sparkSession.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "16"
    assert spark.conf.get("spark.sql.files.openCostInBytes") != found.sparkSession.conf.get("spark.sql.files.openCostInBytes")


def test_driver_lists_no_file_of_a_folder(spark, tmp_path):
    """Odd files have the rows that Spark's own reader gives them, but their names stay in the tasks."""
    from pavilion import schemas
    files = {"1.v1": '{"info": {"city": "C"}}', "2": "", "3": " \n", "4": "[]", "5": '[{"info": {"city": "A"}}, {"info": {"city": "B"}}]', "6": "no json",
             "7": '{"info": "text", "innings": []}', "8": '{"info": {"city": "D"}} tail', "9": "null", "10": '{"info": {"city": "\u00e9"}}',
             "11": '{"info": {"dates": ["x"], "city": 5}, "innings": [{"team": "T", "overs": "no list"}]}', "12": '{"info": {"city": "E"'}
    for n, (name, content) in enumerate(files.items()):
        folder = tmp_path / f"f{n % 3}" / ("deep" if n % 2 else "")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.json").write_text(content)
    (tmp_path / "f0" / "13.json").write_bytes('{"info": {"city": "\u00e9"}}'.encode("utf-16"))
    (tmp_path / "f0" / "14.json").write_bytes(b'{"info": {"city": "\xff"}}')
    for hidden in ("_x.json", ".y.json", "z.txt"):
        (tmp_path / "f0" / hidden).write_text("{}")
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "15.json").write_text("{}")
    own = spark.read.schema(schemas.MATCH_JSON).option("multiLine", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True)
    own = own.json(str(tmp_path)).selectExpr("concat('cricsheet_', split_part(_metadata.file_name, '.', 1)) match_id", "info", "innings")
    for path in (str(tmp_path), f"{tmp_path}/*", f"{tmp_path}/f?/"):
        found = scans.scan_match_json(spark, path)
        assert found.inputFiles() == []
        assert sorted(map(str, found.collect())) == sorted(map(str, own.collect())), path
    with pytest.raises(FileNotFoundError):
        scans.scan_match_json(spark, f"{tmp_path}/nothing/*")
