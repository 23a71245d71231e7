"""Column functions against plain Python on edge cases and random values."""

import math
import random

from pyspark.sql import functions as F

from pavilion.functions import cricket, text


def column(spark, values, kind, fn):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_lenient_int(spark):
    values = ["12", " 1,050 ", "-5", "-", "", None, "7.5", "x", " 5 ", "+3", "99999999999"]
    assert column(spark, values, "string", text.lenient_int) == [12, 1050, 5, 0, 0, 0, 0, 0, 5, 3, 0]


def test_lenient_double(spark):
    values = ["12", "1,050.5", "-5.25", "-", "", None, "7.", ".5", "x", "1d", "1e2"]
    assert column(spark, values, "string", text.lenient_double) == [12, 1050.5, 5.25, 0, 0, 0, 7, 0.5, 0, 0, 100]


def test_cell_numbers(spark):
    values = ["200*", "-", "DNB", "TDNB", "nan", "NaN", "", None, "12.7", "1,2", "4.50"]
    assert column(spark, values, "string", text.cell_int) == [200, 0, 0, 0, 0, 0, 0, 0, 12, 0, 4]
    assert column(spark, values, "string", lambda c: text.cell_double(c, 9.0)) == [200, 9, 9, 9, 9, 9, 9, 9, 12.7, 9, 4.5]


def test_clean_text(spark):
    values = ["  a b \n", None, "", "\t x"]
    assert column(spark, values, "string", text.clean_text) == ["a b", "", "", "x"]


def test_round2_is_exact(spark):
    rng = random.Random(1)
    values = [2.675, 0.125, 0.375, 1.005, 1e6 + 0.005] + [rng.randrange(1, 10**6) / rng.randrange(1, 999) for _ in range(3000)]
    assert column(spark, values, "double", text.round2) == [round(v, 2) for v in values]


def test_round2_keeps_what_is_not_finite_and_has_no_negative_zero(spark):
    values = [float("inf"), float("-inf"), None, -0.001, -2.675, -0.125, 1e300, 12345678.125]
    assert list(map(str, column(spark, values, "double", text.round2))) == ["inf", "-inf", "None", "0.0", "-2.67", "-0.12", "1e+300", "12345678.12"]
    assert math.isnan(column(spark, [float("nan")], "double", text.round2)[0])


def _balls(overs):
    if not overs:
        return 0
    parts = str(overs).split(".")
    try:
        whole, odd = int(parts[0]), int(parts[1]) if len(parts) > 1 else 0
    except ValueError:
        return 0
    return whole * 6 + (odd % 6 if odd >= 6 else odd)


def test_overs_to_balls(spark):
    texts = ["10.3", "10.6", "4", "4.0", "0", "", None, "10.", "x", "10.3.9", "10.25", "3.30", " 7.2 ", "-1.3"]
    assert column(spark, texts, "string", cricket.overs_to_balls) == [_balls(t) for t in texts]
    numbers = [n / 10 for n in range(0, 3000)] + [0.25, 10.25, 1234.5, None, 3.333333, 250000.4]
    assert column(spark, numbers, "double", lambda c: cricket.overs_to_balls(c, True)) == [_balls(n) for n in numbers]


def test_balls_to_overs(spark):
    balls = list(range(0, 40000, 7))
    assert column(spark, balls, "bigint", cricket.balls_to_overs) == [float(f"{b // 6}.{b % 6}") for b in balls]


def test_entity_ids(spark):
    df = spark.createDataFrame([("/Players/1/2/33.html", "/Teams/5/66.html", "/Events/7/x.html", "/Grounds/8/99.html"),
                                ("/Players/1/22.html", "/Teams/1/2/3.html", "/Events/IPL_1.html", "/x"),
                                (None, "", "/Events/12/", "/Grounds/8/9/10.html")], "p string, t string, e string, g string")
    kinds = ("player", "team", "tournament", "ground")
    rows = df.select(*[text.url_entity_id(c, k) for c, k in zip("pteg", kinds)]).collect()
    assert [tuple(r) for r in rows] == [("33", "66", "7", "99"), ("22", "3", "IPL_1", None), (None, None, "12", None)]


def test_formats(spark):
    df = spark.createDataFrame([("20-over", "Test"), ("x", "Ranji"), ("x", "ODI T20"), ("x", None), ("Test Ground", "T20")],
                               "v string, t string")
    got = [r[0] for r in df.select(cricket.classify_format("v", "t")).collect()]
    assert got == ["T20", "First-Class", "T20", "Other", "First-Class"]
    names = ["The Greatest T20", "ODI", "one day", "ipl", "x", None]
    assert column(spark, names, "string", cricket.detect_format) == ["Test", "ODI", "ODI", "T20", "Unknown", "Unknown"]


def test_winner(spark):
    rows = [("X Won", None, "X Won"), ("A won by 3", "", "A"), ("", "B won", "B"), (None, "draw", ""), ("tie", "C won", "")]
    df = spark.createDataFrame([r[:2] for r in rows], "r string, s string")
    assert [r[0] for r in df.select(cricket.winner_name("r", "s")).collect()] == [r[2] for r in rows]


def test_team_code(spark):
    values = ["U.A.E.", "u.a.e.", "united states of america", "United States of America", "nz", "Land Of Far Sea", "Sussex", "x", "ind"]
    got = column(spark, values, "string", cricket.team_code)
    assert got == ["UAE", "UAE", "USO", "USA", "NZ", "LOF", "SUS", "x", "IND"]
    assert cricket.CODE_NAMES["UAE"] == "United Arab Emirates" and cricket.CODE_NAMES["SWZ"] == "Swaziland"


def test_signature(spark):
    import hashlib
    df = spark.createDataFrame([("IND", "AUS", None, "T20"), ("Australia", " India", None, "T20"), (None, "B", "d", None)],
                               "a string, b string, d string, f string")
    got = [r[0] for r in df.select(cricket.match_signature(*[F.col(c) for c in "abdf"])).collect()]
    one = hashlib.md5(b"australia_india_None_T20").hexdigest()
    assert got == [one, one, hashlib.md5(b"b_unknown_d_None").hexdigest()]


def test_dob_and_span(spark):
    assert column(spark, ["tip('dob: 1 May<br>')", "x", None], "string", cricket.dob) == ["1 May", None, None]
    assert column(spark, ["2004-2023", "2022", "2004-", "x-y2024z", None], "string", cricket.is_active) == [
        True, False, False, True, False]


def test_known_name(spark):
    names = {"IND": ["MS Dhoni"], "SL": ["Malinga"]}
    rows = [("MS Dhoni", "IND", True), ("Mahendra Dhoni", "IND", True), ("R Dhoni", "IND", False), ("MS Dhoni", "AUS", False),
            ("L Malinga", "SL", False), ("Malinga", "SL", True)]
    df = spark.createDataFrame([r[:2] for r in rows], "n string, t string")
    assert [r[0] for r in df.select(cricket.known_name("n", "t", names)).collect()] == [r[2] for r in rows]


def test_shard_and_season(spark):
    assert column(spark, ["12345", "1234", "12"], "string", text.shard) == ["1234", "123", "12"]
    df = spark.createDataFrame([("Oval 1999", "2001"), ("a1999", "in 2001/02"), ("21990", None), ("x 1699", "2100")], "v string, s string")
    got = [r[0] for r in df.select(cricket.season_year("v", "s")).collect()]
    assert got == ["1999", "2001", None, None]
