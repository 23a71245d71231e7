"""The pipeline, stage by stage, against plain readings of what each stage has to do."""

import re

import pytest

import corpus_pipeline
from pavilion.llm.common import table
from pavilion.session import materialise

from .edge import documents, empty_documents, odd_documents, rows
from .test_minhash import brute as near
from .test_mixing import check as mixed
from .test_packing import check as packed
from .test_packing import tokenizer  # noqa: F401
from .test_personal import base

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, docs, SF), name)
        out.append((docs, after))
        docs = after
    return dict(zip((n for n, _ in corpus_pipeline.STAGES), out))


def training_time(share, schedule):
    """Time by which ``share`` of a schedule's area is asked for, by bisection."""
    def area(upto):
        total = 0.0
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
            d = min(max(upto - t0, 0.0), t1 - t0)
            total += d * (w0 + (w1 - w0) / (t1 - t0) * d / 2)
        return total

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if area(mid) < share * area(1.0) else (low, mid)
    return low


def test_stages_return_documents(steps):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "personal_data", "mixing", "packing"]
    for name in names[:-1]:
        before, after = steps[name]
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_language_keeps_clean_documents(steps):
    before, after = steps["language"]
    kept = {r["doc_id"] for r in after.collect()}
    gone = [r for r in before.collect() if r["doc_id"] not in kept]
    assert all(not re.search(r"[^\W\d_]", r["text"] or "") for r in gone) and kept


def test_one_of_each_group_stays(steps):
    before, after = steps["near_duplicates"]
    want = near({r["doc_id"]: r["text"] for r in before.collect()}, corpus_pipeline.NEAR)
    assert {r["doc_id"] for r in after.collect()} == {i for i, (_, component) in want.items() if i == component}
    text = {r["doc_id"]: r["text"] for r in before.collect()}
    assert all(text[r["doc_id"]] == r["text"] for r in after.collect())


def test_pairs_below_the_query_threshold_go(spark):
    words = [[f"w{i}x{k}" for k in range(104)] for i in range(60)]
    texts = {}
    for i, own in enumerate(words):  # 100 runs of five words; k words less at the end and k others leave 100 - k in common
        k = (10, 11, 12, 8)[i % 4]  # similarities 0.818, 0.802, 0.786, 0.852
        texts[i], texts[100 + i] = " ".join(own), " ".join([*own[:-k], *(f"v{i}x{j}" for j in range(k))])
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    kept = {r["doc_id"] for r in stage(spark, documents(spark, [(i, t, "en", "a", 1) for i, t in texts.items()]), SF).collect()}
    assert kept == {*range(60), *(100 + i for i in range(60) if i % 4 == 2)}


def test_no_personal_data_is_left(steps):
    before, after = steps["personal_data"]
    old, new = ({r["doc_id"]: r for r in df.collect()} for df in (before, after))
    assert old.keys() == new.keys() and any(base(r["text"]) for r in old.values())
    for i, r in new.items():
        assert not base(r["text"]) and r["n_chars"] == len(r["text"])
        assert base(old[i]["text"]) or "<" in r["text"] or r["text"] == old[i]["text"]


def test_mix_meets_its_targets(steps):
    from pavilion.llm import mixing

    before, after = steps["mixing"]
    plan = rows(mixing.plan(before))
    mixed(plan, [(r["doc_id"], r["text"], r["source"]) for r in before.collect()])
    words = {}
    for r in after.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert words == {r["doc_id"]: r["taken"] for r in plan if r["taken"]}


def test_windows_hold_all_that_was_mixed(steps, tokenizer):  # noqa: F811
    before, after = steps["packing"]
    pieces = rows(after)
    padding, _ = packed(pieces, [(r["doc_id"], r["text"]) for r in before.collect()], tokenizer)
    assert padding < 0.1 and all(len(p["ids"]) == p["length"] for p in pieces)


def test_windows_follow_training_time(steps):
    from pavilion.llm import mixing

    plan = {r["doc_id"]: r for r in rows(mixing.plan(steps["mixing"][0])) if r["taken"]}
    heads = sorted((p["sequence_id"], p["offset"], p["doc_id"]) for p in rows(steps["packing"][1]) if p["start"] == 0)
    turns, times = {}, []
    for _, _, i in heads:
        r, turns[i] = plan[i], turns.get(i, 0) + 1
        times.append(training_time(r["share"] + (turns[i] - 1) * r["step"], mixing.SCHEDULES[r["rank"]]))
    assert max(turns.values()) > 1 and turns == {i: r["copies"] + (r["cut"] > 0) for i, r in plan.items()}
    assert all(a <= b + 1e-9 for a, b in zip(times, times[1:]))


def test_run_and_odd_tables(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    for docs in (odd_documents(spark), empty_documents(spark)):
        for name, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, SF), name)
        assert "sequence_id" in docs.columns
