"""Mixing: targets by rounds of resharing, words taken, positions, rows of the mix."""

import re
from collections import defaultdict

from pavilion.llm import mixing
from pavilion.llm.common import table

from .edge import documents, empty_documents, odd_documents, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reshared(sizes, weights=mixing.WEIGHTS, most=3):
    """The rule as it is told: share out, stop who is above, reshare until none is."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, stopped = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(most * sizes[s] for s in stopped)
        target = {s: most * sizes[s] if s in stopped else left * weight[s] / sum(weight[f] for f in free) for s in names}
        above = [s for s in free if target[s] > most * sizes[s]]
        if not above:
            return target
        stopped.update(above)


def check(found, texts):
    """``texts``: (doc_id, text, source) of all rows."""
    sizes = defaultdict(int)
    for _, text, source in texts:
        sizes[source] += len(WORD.findall(text or ""))
    target = reshared(sizes)
    names = {round(t, 6) for t in target.values()}
    assert all(round(r["target"], 6) in names and r["taken"] <= 3 * r["size"] for r in found)
    taken = defaultdict(int)
    source_of = {i: s for i, _, s in texts}
    for r in found:
        source = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[source] and abs(r["target"] - target[source]) < 1e-6 * max(1, target[source])
        taken[source] += r["taken"]
    for source, t in target.items():
        assert abs(taken[source] - t) <= 1.001


def test_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = rows(mixing.plan(docs))
    assert len(found) == docs.count()
    check(found, [tuple(r) for r in docs.select("doc_id", "text", "source").collect()])
    assert found and sorted(map(str, found)) == sorted(map(str, rows(mixing.plan(docs))))  # reruns agree


def test_small_source_stops_at_three_times(spark):
    texts = [(1, "a b", "s1"), (2, "x " * 100, "s2"), (3, "y " * 100, "s3"), (4, "z " * 50, None), (5, None, "s4")]
    docs = documents(spark, [(i, t, "en", s, 1) for i, t, s in texts])
    found = rows(mixing.plan(docs))
    check(found, texts)
    assert next(r for r in found if r["doc_id"] == 1)["taken"] == 6


def test_stretches_change_nothing(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    whole = {r["doc_id"]: r["taken"] for r in rows(mixing.plan(docs))}
    monkeypatch.setattr(mixing, "STRETCH", 3)
    monkeypatch.setattr(mixing, "SECTION", 4)
    assert {r["doc_id"]: r["taken"] for r in rows(mixing.plan(docs))} == whole


def test_running_sums_of_many_sections(spark):
    words = {(o, r): (7 * r + 3 * o) % 11 for o in range(3) for r in range(50) if (o + r) % 4}
    found = mixing.running(spark.createDataFrame([(*k, v) for k, v in words.items()], "ordinal long, stretch long, words long"), 5).collect()
    assert len(found) == len(words)
    assert all(r["words_before"] == sum(v for (o, s), v in words.items() if o == r["ordinal"] and s < r["stretch"]) for r in found)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = rows(mixing.plan(docs))
    assert len(found) == docs.count()
    assert all(r["taken"] == 0 and r["position"] is None for r in found if r["size"] == 0)
    for df in (mixing.plan(empty_documents(spark)), mixing.mix(empty_documents(spark))):
        assert df.count() == 0
    nothing = documents(spark, [(1, None, None, "a", 0), (2, "", None, None, 0)])
    assert [r["taken"] for r in rows(mixing.plan(nothing))] == [0, 0]


def test_schedule_is_inverted(spark):
    for schedule in (*mixing.SCHEDULES, ((0.0, 0.0), (0.25, 4.0), (0.5, 0.0), (1.0, 1.0))):
        shares = [i / 200 for i in range(200)]
        df = spark.createDataFrame([(s,) for s in shares], "s double").select("s", mixing.invert(mixing.F.col("s"), schedule).alias("t"))
        pieces = mixing.cumulative(schedule)
        for s, t in df.collect():
            t0, length, w, slope, before = [p for p in pieces if p[0] <= t][-1]
            assert abs(before + w * (t - t0) + slope * (t - t0) ** 2 / 2 - s) < 1e-9


def test_mix_repeats_and_cuts(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    plan = {r["doc_id"]: r for r in rows(mixing.plan(docs))}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    words, original = defaultdict(int), {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert original[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert {i: n for i, n in words.items()} == {i: r["taken"] for i, r in plan.items() if r["taken"]}


def test_main_path_is_native(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    for df in (mixing.by_position(mixing.plan(docs)), mixing.mix(docs)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|CartesianProduct|BroadcastNestedLoopJoin", text)
