"""Loading scorecard pages: registry gate, tables, a second load, loads that stop on the way."""

import pytest

from pavilion.plans import loads
from pavilion.sources import sinks
from test_pages import PAGE

FACTS = {"innings": 2, "batting": 6, "bowling": 2, "fall_of_wickets": 4, "match_notes": 4}
DIMS = {"match_registry": 2, "players": 5, "matches": 2, "teams": 2, "tournaments": 1}


def counts(tables):
    return {n: df.count() for n, df in tables.items()}


def raw_pages(spark):
    other = PAGE.replace("26th July", "27th July").replace("dob: 1st Jan 1990", "none")
    rows = [("m1", PAGE), ("m2", other), ("m3", PAGE), ("m1", PAGE), ("m1", PAGE), ("bad", "<p>nothing</p>")]
    return spark.createDataFrame(rows, "doc_id string, content string")


def test_load_twice(spark, tmp_path):
    root, raw = str(tmp_path / "warehouse"), raw_pages(spark)
    loads.create_warehouse(spark, root)
    load = loads.load_scorecards(raw, loads.read_warehouse(spark, root))
    assert counts(load.added) == FACTS
    load.write(root)
    tables = loads.read_warehouse(spark, root)
    assert counts(tables) == {**FACTS, **DIMS}
    assert sorted(r.ca_id for r in tables["match_registry"].collect()) == ["m2", "m3"]     # the later page is linked
    assert {r.player_id: r.dob for r in tables["players"].collect()}["7"] == "1st Jan 1990"
    inn = {r.id for r in tables["innings"].collect()}
    assert {r.innings_id for r in tables["batting"].collect()} == inn == {r.innings_id for r in tables["bowling"].collect()}
    again = loads.load_scorecards(raw, tables)
    assert set(counts(again.added).values()) == {0} and again.load_id == load.load_id
    again.write(root)
    assert counts(loads.read_warehouse(spark, root)) == {**FACTS, **DIMS}


class Stopped(Exception):
    pass


@pytest.mark.parametrize("after", (0, 4, 10))
def test_a_load_that_stopped_leaves_nothing_twice(spark, tmp_path, monkeypatch, after):
    root, raw, written = str(tmp_path / "warehouse"), raw_pages(spark), []
    loads.create_warehouse(spark, root)
    plain = loads.sinks.replace_part

    def failing(df, path, load_id):
        if len(written) == after:
            raise Stopped
        plain(df, path, load_id)
        written.append(path)

    monkeypatch.setattr(loads.sinks, "replace_part", failing)
    with pytest.raises(Stopped):
        loads.load_scorecards(raw, loads.read_warehouse(spark, root)).write(root)
    assert set(counts(loads.read_warehouse(spark, root)).values()) == {0}  # nothing is seen before the commit
    monkeypatch.setattr(loads.sinks, "replace_part", plain)
    more = raw.union(spark.createDataFrame([("m9", PAGE.replace("26th July", "29th July"))], raw.schema))
    batch = more if after == 4 else raw  # the repeat may bring more pages
    loads.load_scorecards(batch, loads.read_warehouse(spark, root)).write(root)
    found = counts(loads.read_warehouse(spark, root))
    assert found["innings"] == (3 if after == 4 else 2) and found["batting"] == (9 if after == 4 else 6)


def test_later_loads_write_only_what_they_touch(spark, tmp_path):
    root = str(tmp_path / "warehouse")
    page = lambda i, html: spark.createDataFrame([(i, html)], "doc_id string, content string")
    bare = PAGE.replace("dob: 1st Jan 1990", "none")
    loads.create_warehouse(spark, root)
    loads.load_scorecards(page("m1", bare), loads.read_warehouse(spark, root)).write(root)
    loads.load_scorecards(page("x", PAGE.replace("/10/10", "/77/77").replace("Alpha", "Gamma").replace("/7/7", "/70/70")),
                          loads.read_warehouse(spark, root)).write(root)
    tables = loads.read_warehouse(spark, root)
    assert tables["players"].filter("dob IS NOT NULL").count() == 1
    third = loads.load_scorecards(page("m2", PAGE.replace("26th", "28th")), tables)
    assert third.changed["match_registry"].count() == 1 and third.changed["matches"].count() == 1
    assert {r.player_id: r.dob for r in third.changed["players"].collect()}["7"] == "1st Jan 1990"
    third.write(root)
    tables = loads.read_warehouse(spark, root)
    assert tables["matches"].count() == 3 and tables["match_registry"].count() == 3
    assert {r.player_id: r.dob for r in tables["players"].collect()}["7"] == "1st Jan 1990"


def test_new_pages_are_picked_once(spark):
    """Too many new pages for a broadcast: they are exchanged once, not for every table."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(f"m{i}", PAGE.replace("26th July", f"{i}th July")) for i in range(4, 9)]
        load = loads.load_scorecards(spark.createDataFrame(rows, "doc_id string, content string"), loads.empty_warehouse(spark))
        for name, df in load.added.items():
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString(), name
        assert load.added["innings"].count() == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_load_folders_are_packed_tight(spark, tmp_path):
    sinks.replace_part(spark.range(2000).selectExpr("sha2(string(id), 256) AS id"), str(tmp_path / "t"), "x")
    files = list((tmp_path / "t" / "load_id=x").glob("*.parquet"))
    assert sum(f.stat().st_size for f in files) < 2000 * 64 * 0.75


def test_pages_are_written_without_what_no_table_reads(spark, tmp_path, monkeypatch):
    written, real = {}, loads.materialise

    def seen(df, name, *args, **kwargs):
        written[name] = set(df.columns)
        return real(df, name, *args, **kwargs)

    monkeypatch.setattr(loads, "materialise", seen)
    root = str(tmp_path / "warehouse")
    loads.create_warehouse(spark, root)
    assert counts(loads.load_scorecards(raw_pages(spark), loads.read_warehouse(spark, root)).added) == FACTS
    for name in ("pages", "fresh_pages"):
        assert not written[name] & {"cells", "centers", "n_tables", "title", "script_title"}, written[name]
