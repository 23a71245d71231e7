"""Aggregations against the sequential fold they replace, on random rows."""

import hashlib
import random

from pyspark.sql import functions as F

from pavilion.operators import careers, dedup, joins, registry


def test_career_best_figures(spark):
    """Highest score prefers a not out, best bowling the fewest runs; folds over random rows."""
    rng = random.Random(3)
    how = ["not out", "b X", "did not bat", None, "Retired Not Out"]
    bat = [(1 + rng.randrange(3), f"p{rng.randrange(9)}", rng.choice(how), rng.randrange(0, 120), rng.randrange(1, 99), 1, 0)
           for _ in range(600)] + [(1, None, "b", 5, 5, 0, 0), (1, "", "b", 5, 5, 0, 0), (1, "zero", "not out", 0, 1, 0, 0)]
    bowl = [(1 + rng.randrange(3), f"p{rng.randrange(3, 14)}", rng.choice([4.0, 10.3, 10.6, 0.0, None, 7.25]),
             rng.randrange(3), rng.randrange(0, 60), rng.randrange(0, 8)) for _ in range(600)]
    batting = spark.createDataFrame(bat, "innings_id int, player_id string, dismissal_text string, runs int, balls int, fours int, sixes int")
    bowling = spark.createDataFrame(bowl, "innings_id int, player_id string, overs double, maidens int, runs int, wickets int")
    innings = spark.createDataFrame([(1, "m1"), (2, "m2"), (3, "m3")], "id int, match_id string")
    matches = spark.createDataFrame([("m1", "ODI"), ("m2", "T20"), ("m3", "")], "match_id string, format string")
    got = {(r.player_id, r.format): r for r in careers.career_stats(batting, bowling, innings, matches).collect()}

    formats = {1: "ODI", 2: "T20"}
    high, outs, entries, best = {}, {}, {}, {}
    for inn, p, d, runs, *_ in bat:
        if not p or inn not in formats:
            continue
        k = (p, formats[inn])
        entries[k] = entries.get(k, 0) + 1
        if d == "did not bat":
            continue
        not_out = "not out" in (d or "").lower()
        h = high.get(k, (0, False))
        if runs > h[0]:
            h = (runs, not_out)
        elif runs == h[0] and not_out:
            h = (runs, True)
        high[k] = h
    for inn, p, _, _, runs, wkts in bowl:
        if inn in formats:
            k = (p, formats[inn])
            b = best.get(k)
            if b is None or wkts > b[0] or (wkts == b[0] and runs < b[1]):
                best[k] = (wkts, runs)
    assert set(got) == set(entries) | set(best)
    for k, r in got.items():
        assert r.matches == entries.get(k, 0)
        assert (r.highest_score, r.highest_score_not_out) == high.get(k, (0, False))
        assert (r.best_bowling_wickets, r.best_bowling_runs) == best.get(k, (None, None))
    assert got[("zero", "ODI")].bat_avg == 0.0 and got[("zero", "ODI")].highest_score_not_out


def test_log(spark):
    rng = random.Random(5)
    words = ["a", "bb", "Live Cricket Score long long", "cccc", None, "dddd x", ""]
    rows = [(i, rng.choice(["s", None]), rng.choice(["1", "2", "", None, "30"]), rng.choice(["9", None]), rng.choice(words))
            for i in range(400)]
    df = spark.createDataFrame(rows, "line_no int, source string, match_id string, id string, title string")
    kept = {}
    for line, source, match_id, ident, title in rows:
        key = match_id or ident
        if not key:
            continue
        k = (source or "web", key)
        if k not in kept or (len(title or "") > len(kept[k][1] or "") and "Live Cricket Score" not in (title or "")):
            kept[k] = (line, title)
    got = {(r.source, r.log_id): (r.line_no, r.title) for r in dedup.dedup_log(df, source="web").collect()}
    assert got == kept


def test_unique_players_and_last_wins(spark):
    rng = random.Random(7)
    rows = [(str(rng.randrange(20)), f"n{i}", rng.choice([None, "", "d1", "d2"]), i) for i in range(300)] + [(None, "x", None, 999)]
    df = spark.createDataFrame(rows, "id string, name string, dob string, seen int")
    first, last = {}, {}
    for i, n, d, s in rows:
        if not i:
            continue
        if i not in first or (d and not first[i][1]):
            first[i] = (n, d)
        last[i] = n
    assert {r.id: (r.name, r.dob) for r in dedup.unique_players(df).collect()} == first
    got = dedup.last_wins(df.filter("id IS NOT NULL"), ["id"], "seen")
    assert {r.id: r.name for r in got.collect()} == last


def test_registry_row_by_row(spark):
    rng = random.Random(11)
    teams = ["IND", "India", "AUS", "australia", "X", None, " SL "]
    batch = [(i, rng.choice(teams), rng.choice(teams), rng.choice(["d1", None]), "T20", rng.choice(["CA", "espn", "cricbuzz", "other"]),
              f"id{i}") for i in range(300)]
    names = {"IND": "India", "AUS": "Australia", "SL": "Sri Lanka"}
    norm = lambda t: names.get(t.strip(), t.strip()) if t else "Unknown"
    state, new = {}, {}
    for seq, a, b, d, f, src, sid in batch:
        pair = sorted([norm(a).lower(), norm(b).lower()])
        sig = hashlib.md5(f"{pair[0]}_{pair[1]}_{d}_{f}".encode()).hexdigest()
        new[seq] = sig not in state
        row = state.setdefault(sig, {"team1": norm(a), "team2": norm(b), "ca": None, "cricbuzz": None, "espn": None})
        if src.lower() in row:
            row[src.lower()] = sid
    columns = "seq int, team1 string, team2 string, date string, format string, source string, source_id string"
    empty = spark.createDataFrame([], "universal_match_id string, team1 string, team2 string, match_date string, format string, "
                                      "ca_id string, cricbuzz_id string, espn_id string")
    half = 150
    first, told1 = registry.register(empty, spark.createDataFrame(batch[:half], columns))
    both, told2 = registry.register(first, spark.createDataFrame(batch[half:], columns))
    got = {r.universal_match_id: {"team1": r.team1, "team2": r.team2, "ca": r.ca_id, "cricbuzz": r.cricbuzz_id, "espn": r.espn_id}
           for r in both.collect()}
    assert got == state
    assert {r.seq: r.is_new for r in told1.unionByName(told2).collect()} == new


def test_prefer_sources(spark):
    empty = spark.createDataFrame([], "k int, v string")
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    b = spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert [r.v for r in dedup.prefer_sources([empty, b, a]).collect()] == ["b", "b"]
    assert sorted((r.k, r.v) for r in dedup.prefer_sources([a, empty, b], "k").collect()) == [(1, "a"), (2, "b")]
    assert dedup.prefer_sources([empty, empty]).count() == 0


def test_known_names_match_the_fixed_list_rule(spark):
    names = {"A": ["Al Bo", "Cy"], "B": ["Al de Bo"]}
    rows = [(1, "Al Bo", "A"), (2, "Aon Xbo", "A"), (3, "Axx Bo", "A"), (4, "Zed Bo", "A"), (5, "Cy", "A"), (6, "My Cy", "A"),
            (7, "A Bo", "B"), (8, "ABo", "B"), (9, "Al Bo", "C"), (10, "", "A")]
    df = spark.createDataFrame(rows, "i int, name string, team string")
    listed = spark.createDataFrame([(n, t) for t, ns in names.items() for n in ns], "name string, team string")

    def rule(name, team):
        return any(name == k or (len(k.split()) > 1 and name.endswith(k.split()[-1]) and name[:1] == k[0])
                   for k in names.get(team, []))

    got = {r.i: r.known for r in joins.flag_known(df, listed, "known", "i").collect()}
    assert got == {i: rule(n, t) for i, n, t in rows}


def test_hot_key_takes_a_third_of_all_rows(spark):
    """One player and one innings with a third of the rows: results stay whole."""
    n = 60_000
    hot = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500)
    rows = spark.range(n).select(hot.cast("int").alias("innings_id"), F.concat(F.lit("p"), hot.cast("string")).alias("player_id"),
                                 F.lit("b").alias("dismissal_text"), F.lit(2).alias("runs"), F.lit(3).alias("balls"),
                                 F.lit(1).alias("fours"), F.lit(0).alias("sixes"))
    innings = spark.range(500).select(F.col("id").cast("int"), F.lit("m").alias("match_id"))
    matches = spark.createDataFrame([("m", "ODI")], "match_id string, format string")
    total = careers.batting_career(rows, innings, matches).agg(F.sum("matches"), F.max("matches")).first()
    assert total[0] == n and total[1] == rows.filter("player_id = 'p0'").count() > n / 3


def test_hot_innings_is_split_by_the_join(spark):
    """With broadcasts off and small thresholds, the join to the formats splits the hot innings."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        n = 90_000
        inn = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 3000).cast("int")
        rows = spark.range(0, n, 1, 8).select(
            inn.alias("innings_id"), F.concat(F.lit("player "), F.col("id").cast("string")).alias("player_id"),
            F.lit("b").alias("dismissal_text"), F.lit(2).alias("runs"), F.lit(3).alias("balls"), F.lit(1).alias("fours"),
            F.lit(0).alias("sixes"))
        innings = spark.range(3000).select(F.col("id").cast("int"), F.col("id").cast("string").alias("match_id"))
        matches = spark.range(3000).select(F.col("id").cast("string").alias("match_id"), F.lit("ODI").alias("format"))
        out = careers.batting_career(rows, innings, matches)
        assert len(out.collect()) == n
        assert "SortMergeJoin(skew=true)" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
