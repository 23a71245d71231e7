"""Streams over files, run with availableNow, against their batch results."""

import json


from pavilion.operators import live
from pavilion.operators.maintenance import apply_outcomes
from pavilion.streaming import streams

SCHEMA = "match_id int, text string, score int, ts timestamp, status string"


def write(tmp_path, name, rows):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("match_id", "text", "score", "ts", "status"), r))) for r in rows))


def source(spark, tmp_path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def test_new_commentary_survives_a_restart(spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    write(tmp_path, "a.json", [(1, "x", 1, "2020-01-01T00:00:00", ""), (1, "x", 1, "2020-01-01T00:00:01", ""), (2, "x", 1, "2020-01-01T00:00:02", "")])
    write(tmp_path, "b.json", [(1, "x", 1, "2020-01-01T00:00:03", ""), (1, "", 1, "2020-01-01T00:00:04", ""), (1, "y", 1, "2020-01-01T00:00:05", "")])

    def run():
        query = streams.start_append(streams.new_commentary(source(spark, tmp_path)), out, state, availableNow=True)
        query.awaitTermination()
        return sorted((r.match_id, r.text) for r in spark.read.parquet(out).collect())

    want = [(1, "x"), (1, "y"), (2, "x")]
    assert run() == want
    assert run() == want
    write(tmp_path, "c.json", [(1, "y", 1, "2020-01-01T00:00:06", ""), (3, "z", 1, "2020-01-01T00:00:07", "")])
    assert run() == want + [(3, "z")]


def test_bounded_state(spark, tmp_path):
    write(tmp_path, "a.json", [(1, "x", 1, "2020-01-01T00:00:00", ""), (1, "x", 1, "2020-01-01T00:00:30", "")])
    rows = streams.new_commentary(source(spark, tmp_path), "ts", "10 minutes")
    streams.start_append(rows, str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_latest_scores_on_disk_state(spark, tmp_path):
    write(tmp_path, "a.json", [(1, "x", 10, "2020-01-01T00:00:00", ""), (2, "x", 5, "2020-01-01T00:00:00", "")])
    write(tmp_path, "b.json", [(1, "x", 12, "2020-01-01T00:01:00", ""), (1, "x", 11, "2020-01-01T00:00:30", "")])
    streams.use_disk_state(spark)
    try:
        rows = streams.latest_scores(source(spark, tmp_path), ["score"])
        streams.start_changelog(rows, str(tmp_path / "log"), str(tmp_path / "state"), availableNow=True).awaitTermination()
    finally:
        for key in streams.STATE_STORE:
            spark.conf.unset(key)
    got = {r.match_id: r.score for r in streams.read_changelog(spark, str(tmp_path / "log")).collect()}
    assert got == {1: 12, 2: 5}
    streams.compact_changelog(spark, str(tmp_path / "log"), str(tmp_path / "small"))
    assert spark.read.parquet(str(tmp_path / "small")).count() == 2
    assert {r.match_id: r.score for r in streams.read_changelog(spark, str(tmp_path / "small")).collect()} == got


def test_pages_arrive_once(spark, tmp_path):
    (tmp_path / "in" / "1234").mkdir(parents=True)
    card = "<table><tr><td>1</td></tr></table>"
    (tmp_path / "in" / "1234" / "12345.html").write_text(card * 2)
    (tmp_path / "in" / "7.html").write_text(card)

    def run():
        rows = streams.page_outcomes(streams.stream_pages(spark, str(tmp_path / "in"), 1))
        streams.start_append(rows, str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    assert {r.ca_match_id: r.ok for r in run().collect()} == {"12345": True, "7": False}
    assert run().count() == 2
    queue = spark.createDataFrame([("7", "LOCAL_PENDING"), ("12345", "LOCAL_PENDING")], "ca_match_id string, status string")
    assert {r.ca_match_id: r.status for r in apply_outcomes(queue, run()).collect()} == {"7": "FAILED", "12345": "COMPLETED"}


def test_stops_at_the_end_state(spark, tmp_path):
    write(tmp_path, "a.json", [(1, "x", 1, "2020-01-01T00:00:00", "in")])
    write(tmp_path, "b.json", [(1, "y", 1, "2020-01-01T00:01:00", "post")])
    shown = []

    def show(batch):
        shown.append([r.text for r in streams.newest_last(batch, "ts").collect()])

    assert streams.run_until_post(source(spark, tmp_path), show, str(tmp_path / "state"), "0 seconds", timeout=60)
    assert sorted(t for b in shown for t in b) == ["x", "y"]


def test_newest_last(spark):
    df = spark.createDataFrame([(0, "new"), (1, "mid"), (2, "old")], "pos int, text string")
    assert [r.text for r in streams.newest_last(df, "pos").collect()] == ["old", "mid", "new"]


def test_feeds_normalise_on_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"text": "t", "scoreValue": 0}\n{"text": "u", "dismissal": {"text": "b"}, "isSix": true}')
    rows = live.normalize_commentary(spark.readStream.text(str(tmp_path / "in")), "a")
    streams.start_append(rows, str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("text", "type", "is_wicket", "is_boundary").collect()
    assert sorted(map(tuple, got)) == [("t", "dot", False, False), ("u", "wicket", True, True)]
    listed = spark.createDataFrame([('[{"id": 5, "title": "M", "state": "LIVE"}, {}]',)], "value string")
    assert sorted(map(tuple, live.listed_matches(listed).collect())) == [("", "", ""), ("5", "M", "LIVE")]
