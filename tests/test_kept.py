"""Tables that are kept up to date: careers by load, merged loads, parts by key, queues, migrations, indexes, sketches, dates, drifting documents."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from pavilion import schemas
from pavilion.functions import cricket
from pavilion.operators import archive, careers, live
from pavilion.plans import career_table, loads
from pavilion.plans.adapters import adapt
from pavilion.sources import commits, layout, scans
from pavilion.streaming import streams
from test_loads import PAGE, counts


class Stopped(Exception):
    pass


# ---------------------------------------------------------------- careers


@pytest.fixture(scope="module")
def lines(spark):
    bat, bowl, inns, matches = adapt(spark, "/root/testdata/sf0.001", "batting", "bowling", "innings", "matches")
    return careers.career_facts(bat, bowl), inns, matches, careers.career_stats(bat, bowl, inns, matches)


def same(found, want):
    return sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


def test_loads_add_up_to_the_full_table(spark, lines, tmp_path):
    facts, inns, matches, whole = lines
    root = str(tmp_path / "w")
    career_table.create(spark, root)
    assert career_table.read(spark, root).count() == 0
    for day in range(2):
        career_table.add(root, f"d{day}", facts.where(F.col("innings_id") % 2 == day), inns, matches)
    assert same(career_table.read(spark, root), whole)
    assert career_table.read(spark, root).dtypes == whole.dtypes == spark.createDataFrame([], schemas.CAREER).dtypes
    career_table.add(root, "d1", facts, inns, matches)  # known already
    assert same(career_table.read(spark, root), whole)
    merged = career_table.merge(spark, root)
    assert list(commits.current(spark, root)) == [merged] and same(career_table.read(spark, root), whole)
    assert commits.remove_replaced(spark, root, ["partials"]) == 4
    career_table.add(root, "d0", facts, inns, matches)  # known, though its folder is gone
    career_table.refresh(spark, root)
    assert same(career_table.read(spark, root), whole) and career_table.merge(spark, root) is None


def test_a_load_touches_its_players_only(spark, lines, tmp_path):
    facts, inns, matches, whole = lines
    root = str(tmp_path / "w")
    career_table.create(spark, root)
    career_table.add(root, "all", facts.where(F.col("player_id") != "P1"), inns, matches)
    one = facts.where(F.col("player_id") == "P1")
    stamps = lambda: {f.name: sorted(x.name for x in f.iterdir()) for f in (tmp_path / "w" / "careers").iterdir() if f.is_dir()}
    before = stamps()
    touched = career_table.add(root, "one", one, inns, matches)
    after = stamps()
    assert len(touched) == 1 and {k for k in after if before.get(k) != after[k]} == {f"part={touched[0]}"}
    assert same(career_table.read(spark, root), whole)


@pytest.mark.parametrize("where", ["partials", "commit", "refresh"])
def test_a_stopped_load_is_finished_by_the_same_load(spark, lines, tmp_path, monkeypatch, where):
    facts, inns, matches, whole = lines
    root = str(tmp_path / "w")
    career_table.create(spark, root)
    career_table.add(root, "d0", facts.where(F.col("innings_id") % 2 == 0), inns, matches)
    half = career_table.read(spark, root).count()

    def stop(*a, **k):
        raise Stopped

    target = {"partials": (career_table.layout, "write_parts"), "commit": (career_table.commits, "commit"), "refresh": (career_table, "refresh")}[where]
    with monkeypatch.context() as m:
        m.setattr(*target, stop)
        with pytest.raises(Stopped):
            career_table.add(root, "d1", facts.where(F.col("innings_id") % 2 == 1), inns, matches)
    assert career_table.read(spark, root).count() == half
    if where == "refresh":
        career_table.merge(spark, root)  # a merge in between doesn't lose it
    career_table.add(root, "d1", facts.where(F.col("innings_id") % 2 == 1), inns, matches)
    assert same(career_table.read(spark, root), whole)


def test_a_refresh_moves_the_partials_once(spark, lines, tmp_path, monkeypatch):
    facts, inns, matches, whole = lines
    root = str(tmp_path / "w")
    career_table.create(spark, root)
    written = []

    def put(rows, path):
        written.append(rows._jdf.queryExecution().toString().split("== Physical Plan ==")[1])
        plainly(rows, path)

    plainly = layout.put_parts
    monkeypatch.setattr(layout, "put_parts", put)
    monkeypatch.setattr(layout, "materialise", lambda *a: pytest.fail("written twice"))
    career_table.add(root, "d0", facts, inns, matches)
    assert len(written) == 1 and written[0].count("Exchange") == 1
    assert same(career_table.read(spark, root), whole)
    parts = layout.by_part(spark.range(100).withColumn("part", (F.col("id") % 32).cast("int")), 32)
    assert parts.groupBy(F.spark_partition_id()).agg(F.count_distinct("part").alias("n")).agg(F.max("n")).first()[0] == 1


def test_rates_stay_below_what_the_jvm_compiles(spark):
    rows = spark.range(10).select(F.col("id").cast("string").alias("player_id"), F.lit("f").alias("format"),
                                  *[(F.col("id") + n).alias(c) for n, c in enumerate([*careers.SUMS, *careers.TOPS])])
    code = careers.with_rates(careers.with_best(rows)).select(careers.CAREER_COLUMNS)._jdf.queryExecution().debug().codegenToSeq()
    assert 0 < max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) < 8000


# ---------------------------------------------------------------- loads


def test_merged_loads_read_as_before(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "w")
    loads.create_warehouse(spark, root)
    page = lambda i, html: spark.createDataFrame([(i, html)], "doc_id string, content string")
    pages = [page("m1", PAGE), page("m2", PAGE.replace("26th July", "27th July").replace("dob: 1st Jan 1990", "none"))]
    ids = []
    for raw in pages:
        load = loads.load_scorecards(raw, loads.read_warehouse(spark, root))
        load.write(root)
        ids.append(load.load_id)
    before = {n: sorted(map(str, df.collect())) for n, df in loads.read_warehouse(spark, root).items()}
    with monkeypatch.context() as m:
        m.setattr(commits, "commit", lambda *a, **k: (_ for _ in ()).throw(Stopped()))
        with pytest.raises(Stopped):
            loads.merge_loads(spark, root)
    assert set(commits.current(spark, root)) == set(ids)
    loads.merge_loads(spark, root)
    tables = loads.read_warehouse(spark, root)
    assert {n: sorted(map(str, df.collect())) for n, df in tables.items()} == before
    assert not any("Aggregate" in df._jdf.queryExecution().toString() for df in tables.values())  # nothing to pick any more
    assert commits.remove_replaced(spark, root, list(loads.TABLES)) == 2 * (len(loads.TABLES) + 1)
    assert commits.remove_replaced(spark, root, list(loads.TABLES)) == 0
    loads.load_scorecards(pages[0], loads.read_warehouse(spark, root)).write(root)  # merged long ago: adds nothing
    assert {n: len(rows) for n, rows in before.items()} == counts(loads.read_warehouse(spark, root))


def test_upserts_touch_the_parts_of_their_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    layout.write_parts(spark.range(1000).withColumn("v", F.lit("old")), path, "id", 32)
    src = spark.createDataFrame([(5, "a", 1), (5, "b", 2), (2000, "new", 1)], "id long, v string, seq int")
    touched = layout.upsert_parts(path, "id long, v string", src, "id", "seq", 32)
    assert 1 <= len(touched) <= 2
    rows = {r.id: r.v for r in layout.read_parts(spark, path, "id long, v string").collect()}
    assert len(rows) == 1001 and rows[5] == "b" and rows[2000] == "new" and rows[6] == "old"
    assert layout.upsert_parts(path, "id long, v string", src, "id", "seq", 32) == touched
    assert layout.read_parts(spark, path, "id long, v string").count() == 1001
    assert layout.upsert_parts(path, "id long, v string", src.limit(0), "id", "seq", 32) == []


# ---------------------------------------------------------------- streams


def put(folder, name, rows, fields):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(fields, r))) for r in rows))


SAID = ("match_id", "place", "text", "status")


def run_commentary(spark, tmp_path, **options):
    stream = spark.readStream.schema("match_id int, place int, text string, status string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    streams.start_append(streams.match_commentary(stream, **options), out, state, availableNow=True).awaitTermination()
    return sorted((r.match_id, r.place, r.text) for r in spark.read.schema("match_id int, text string, place bigint").parquet(out).collect())


def kept(spark, tmp_path):
    """(match, flag, texts) of all state entries."""
    rows = spark.read.format("statestore").load(str(tmp_path / "state"))
    return sorted((r.key.match_id, r.value.groupState.ended, len(r.value.groupState.hashes) // 16) for r in rows.collect())


@pytest.fixture
def disk_state(spark):
    streams.use_disk_state(spark)
    yield
    for key in streams.STATE_STORE:
        spark.conf.unset(key)


@pytest.mark.parametrize("parts", [1, 3])
def test_state_lives_as_long_as_the_match(spark, tmp_path, disk_state, parts):
    put(tmp_path / "in", "a.json", [(1, 1, "x", "in"), (1, 2, "y", "in"), (1, 3, "x", "in"), (2, 1, "x", None), (2, 2, " ", "in"), (2, 3, None, "in")], SAID)
    assert run_commentary(spark, tmp_path, parts=parts) == [(1, 1, "x"), (1, 2, "y"), (2, 1, "x")]
    assert sum(n for _, _, n in kept(spark, tmp_path)) == 3
    put(tmp_path / "in", "b.json", [(1, 6, "too late", "in"), (1, 4, "z", "in"), (1, 5, "won", "post"), (1, 5, "y", "in"), (2, 4, "x", "in")], SAID)
    want = [(1, 1, "x"), (1, 2, "y"), (1, 4, "z"), (1, 5, "won"), (2, 1, "x")]
    assert run_commentary(spark, tmp_path, parts=parts) == want  # a restart goes on with the state
    left = kept(spark, tmp_path)
    assert [n for m, _, n in left if m == 1] == [0] * parts and all(ended for m, ended, _ in left if m == 1) and sum(n for m, _, n in left if m == 2) == 1
    put(tmp_path / "in", "c.json", [(1, 7, "late again", "in"), (1, 3, "x", "in"), (2, 5, "new", "in")], SAID)
    assert run_commentary(spark, tmp_path, parts=parts) == [*want, (2, 5, "new")]


def test_nothing_is_left_of_a_match(spark, tmp_path, disk_state):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        put(tmp_path / "in", "a.json", [(1, 1, "x", "in"), (1, 2, "end", "post")], SAID)
        run_commentary(spark, tmp_path, parts=2, remembered=1)
        put(tmp_path / "in", "b.json", [(2, 1, "x", "in")], SAID)
        run_commentary(spark, tmp_path, parts=2, remembered=1)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert {m for m, _, _ in kept(spark, tmp_path)} == {2}


def test_a_batch_of_outcomes_run_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "queue")
    queue = spark.createDataFrame([(str(i), "LOCAL_PENDING") for i in range(50)], "ca_match_id string, status string")
    streams.create_queue(queue, path, 8)
    state = lambda: sorted(map(tuple, layout.read_parts(spark, path, streams.QUEUE).drop("part").collect()))
    told = lambda *rows: spark.createDataFrame(rows, "ca_match_id string, ok boolean")
    first = told(("1", True), ("2", False), ("2", True), ("3", False), ("99", True))
    changed = streams.merge_outcomes(first, path, 0, 8)
    once = state()
    assert streams.merge_outcomes(first, path, 0, 8) == changed and state() == once
    assert [r for r in once if r[2] == 0] == [("1", "COMPLETED", 0), ("2", "COMPLETED", 0), ("3", "FAILED", 0)] and len(once) == 50
    streams.merge_outcomes(told(("3", True)), path, 1, 8)
    later = state()
    streams.merge_outcomes(first, path, 0, 8)  # an earlier batch once more
    assert state() == later and ("3", "COMPLETED", 1) in later
    assert streams.merge_outcomes(told(), path, 2, 8) == []


def test_arrivals_keep_the_queue(spark, tmp_path):
    (tmp_path / "in").mkdir()
    card = "<table><tr><td>1</td></tr></table>"
    (tmp_path / "in" / "7.html").write_text(card)
    streams.create_queue(spark.createDataFrame([("7", "LOCAL_PENDING"), ("8", "LOCAL_PENDING")], "ca_match_id string, status string"), str(tmp_path / "queue"), 4)

    def run():
        outcomes = streams.page_outcomes(streams.stream_pages(spark, str(tmp_path / "in"), 1))
        streams.keep_queue(outcomes, str(tmp_path / "queue"), str(tmp_path / "state"), 4, availableNow=True).awaitTermination()
        return {r.ca_match_id: r.status for r in layout.read_parts(spark, str(tmp_path / "queue"), streams.QUEUE).collect()}

    assert run() == {"7": "FAILED", "8": "LOCAL_PENDING"}
    (tmp_path / "in" / "8.html").write_text(card * 2)
    assert run() == {"7": "FAILED", "8": "COMPLETED"}


def test_a_migration_that_stopped_goes_on(spark, tmp_path):
    old = adapt(spark, "/root/testdata/sf0.001", "ball_by_ball")
    schema = ", ".join(f"`{n}` {k}" for n, k in old.dtypes)
    old.repartition(6).write.parquet(str(tmp_path / "old"))
    calls = []

    def failing(batch):
        calls.append(1)
        if len(calls) == 3:
            raise Stopped
        return scans.unify_deliveries(batch)

    args = (spark, str(tmp_path / "old"), schema)
    with pytest.raises(Exception):
        streams.migrate(*args, failing, str(tmp_path / "new"), str(tmp_path / "state"), 2)
    assert 0 < spark.read.parquet(str(tmp_path / "new")).count() < old.count()
    streams.migrate(*args, scans.unify_deliveries, str(tmp_path / "new"), str(tmp_path / "state"), 2)
    assert same(spark.read.parquet(str(tmp_path / "new")).drop("batch_id"), scans.unify_deliveries(old))
    streams.migrate(*args, failing, str(tmp_path / "new"), str(tmp_path / "state"), 2)
    assert len(calls) == 3  # nothing new, no batch


# ---------------------------------------------------------------- search, status, dates, documents


def test_indexed_search_is_the_scan(spark):
    names = ["Ann Lee", "ANNA", "Hannah", "an", "", None, "Łódź Anna", "100% Anna_", "Ann Lee", "nnann", "Straße ann", "İann"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    index = archive.postings(df, "name", "id")
    counts_ = index.groupBy("gram").agg(F.count("*").alias("n"))
    for word in ("ann", "ANNA", "an", "a", "", "n L", "łódź", "% A", "anna_", "nothing here", "nnann", "ß", "İan"):
        for n in (10, 2):
            assert archive.search_postings(df, index, counts_, "name", "id", word, n).collect() == archive.search(df, "name", "id", word, n).collect(), word


def test_sketches_of_loads(spark):
    m = spark.range(10).withColumnRenamed("id", "match_id")
    bat = spark.range(3000).select(F.concat(F.lit("p"), F.col("id") % 700).alias("player_name"), F.lit(2).alias("balls"))
    one = archive.status_parts(m, m, bat).unionByName(archive.status_parts(m, m, bat)).unionByName(archive.status_parts(m.limit(0), m, bat.limit(0)))
    row = archive.status_of(one).first()
    assert (row.total_matches, row.completed_extractions, row.total_balls_delivered) == (20, 30, 12000) and abs(row.total_players - 700) < 700 * 0.033
    assert list(archive.status_of(one.limit(0)).first()) == [0, 0, 0, 0]
    assert one.dtypes == spark.createDataFrame([], archive.STATUS_PARTS).dtypes


def test_dates(spark):
    day = datetime.date
    cases = {"26th July 2025": day(2025, 7, 26), "1st Jan 1990": day(1990, 1, 1), "2nd, 3rd May 1999": day(1999, 5, 2), "3 MAY 1999": day(1999, 5, 3),
             "2025-07-26": day(2025, 7, 26), "July 4, 2020": day(2020, 7, 4), "Jul 4 2020": day(2020, 7, 4), "4/7/2020": day(2020, 7, 4), "20200704": day(2020, 7, 4),
             "  Saturday 4th July, 2020 ": day(2020, 7, 4), "26-29 July 2025": day(2025, 7, 26), "26th, 27th & 28th July 2025": day(2025, 7, 26),
             "30th July - 2nd August 2025": day(2025, 7, 30), "30 February 2020": None, "Date Unknown": None, "": None, None: None, "2020": None, "July 2020": None,
             "26th July 25": None, "x 26th July 2025": None}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", cricket.parse_date("t").alias("d"))
    assert {r.t: r.d for r in df.collect()} == cases


def test_documents_whose_keys_drift(spark):
    def page(doc):
        return f'<script id="__NEXT_DATA__">{doc if isinstance(doc, str) else json.dumps({"props": {"pageProps": doc}})}</script>'

    docs = [
        {"data": {"matches": [{"id": 5, "title": "a"}, {"objectId": "x5", "name": 7}, 3, None, [1]], "events": {"id": 9}}, "appData": "text", "content": [1]},
        {"data": {"matches": [{"id": 1, "team1": "text"}, {"id": 2, "team1": None}, {"id": 3, "ground": []}, {"id": 4, "team2": {"name": 8}}], "liveMatches": "x"}},
        {"content": {"liveMatches": [{"id": None, "title": ""}]}}, "no json", {"data": None}]
    rows = [(i, page(d)) for i, d in enumerate(docs)] + [(9, "<p>no script</p>"), (10, None)]
    found = live.embedded_matches(spark.createDataFrame(rows, "k int, html string"), "html", "k").collect()
    assert sorted((r.k, r.match_id, r.name, r.team2) for r in found) == [(0, "5", "a", ""), (0, "x5", "7", ""), (1, "4", "", "8"), (2, "", "", "")]
    said = [(0, page({"data": {"commentary": [{"over": 1.2, "text": 5, "runs": "4"}, {"html": "<b>x</b>", "isWicket": True, "runs": {"a": 1}}, 4], "recentBalls": {"text": "no list"}}}))]
    got = live.embedded_commentary(spark.createDataFrame(said, "k int, html string"), "html", "k").collect()
    assert [(r.over, r.text, r.runs, r.type) for r in got] == [("1.2", "5", 4, "ball"), ("", "x", 0, "wicket")]


def test_embedded_items_are_read_once(spark):
    pages = spark.createDataFrame([], "html string")
    for rows in (live.embedded_matches(pages), live.embedded_commentary(pages)):
        text = rows._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        # no path a list or field: the page's part and its lists, an item, and its three sides, which a filter reads first
        assert "schemaOfVariant" not in text and text.count("variant_get(") <= 3 + 6 and text.count("objectId") <= 2


def test_the_bound_of_innings_numbers_is_a_choice(spark):
    matches = spark.createDataFrame([(1,)], "match_id int")
    bat = spark.createDataFrame([(1, 1, 150, "p", "b", 1, 1, 1, 0, 0), (2, 1, 148, "q", "b", 1, 1, 1, 0, 0), (3, 1, 0, "r", "b", 1, 1, 1, 0, 0), (4, 1, None, "s", "b", 1, 1, 1, 0, 0)],
                                "id int, match_id int, innings_number int, player_name string, dismissal string, runs int, balls int, mins int, fours int, sixes int")
    bowl = spark.createDataFrame([], "id int, match_id int, innings_number int, player_name string, overs int, maidens int, runs int, wickets int, wides int, no_balls int")
    assert not archive.archive_scorecard_rows(matches, bat, bowl).count() and {r.player_name for r in archive.rejected_rows(bat, bowl).collect()} == {"p", "q", "r", "s"}
    rows = archive.archive_scorecard_rows(matches, bat, bowl, None)
    assert sorted(r.innings_number for r in rows.collect()) == list(range(1, 151)) and rows.where("section = 'empty'").count() == 148
    assert archive.archive_scorecards(matches, bat, bowl, None).count() == 150
    assert archive.archive_scorecards(matches, bat, bowl, most=148).count() == 148
    assert {r.player_name for r in archive.rejected_rows(bat, bowl, None).collect()} == {"r", "s"}
    assert {r.player_name for r in archive.rejected_rows(bat, bowl, 149).collect()} == {"p", "r", "s"}


def test_a_hot_key_is_dealt_to_many_files(spark, tmp_path):
    rows = spark.range(4000).selectExpr("if(id % 100 = 0, cast(id as string), 'hot') gram", "id")
    layout.write_parts(rows, f"{tmp_path}/p", "gram", 4, spread="id")
    back = layout.read_parts(spark, f"{tmp_path}/p", "gram string, id bigint")
    assert back.exceptAll(rows.withColumn("part", layout.part_of("gram", 4))).isEmpty() and back.count() == 4000
    per_file = back.where("gram = 'hot'").groupBy("_metadata.file_name").count().agg({"count": "max"}).first()[0]
    assert per_file < 1000


def test_postings_are_dealt_before_they_are_combined(spark, capsys):
    names = spark.createDataFrame([(1, "abcd"), (1, "abcd"), (2, "bcd"), (3, None), (4, "xy")], "id int, name string")
    found = archive.postings(names, "name", "id")
    found.explain()
    plan = capsys.readouterr().out
    assert sorted(map(tuple, found.collect())) == [("abc", 1), ("bcd", 1), ("bcd", 2)]
    assert plan.count("Exchange") == 1 and plan.rindex("HashAggregate") < plan.index("Exchange")


def test_migrated_rows_are_zstd(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/old")
    streams.migrate(spark, f"{tmp_path}/old", "id bigint", lambda b: b, f"{tmp_path}/new", f"{tmp_path}/state")
    names = [p.name for p in (tmp_path / "new").rglob("*.parquet")]
    assert names and all(n.endswith(".zstd.parquet") for n in names) and spark.read.parquet(f"{tmp_path}/new").count() == 3


def test_archive_rows_are_not_sorted_for_their_match(spark, sf_dir, capsys):
    matches, bat, bowl = adapt(spark, sf_dir, "scraped_matches", "scraped_batting", "scraped_bowling")
    archive._archive_rows(matches, bat, bowl, 100).explain()
    plan = capsys.readouterr().out
    assert "ShuffledHashJoin" in plan and "Sort " not in plan
