"""Repair of conversations against a plain search of all edits, whole and cut into small blocks."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pavilion.llm import repair

from .edge import with_clashes

TURNS = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit, lines) of the cheapest edits, of these the least letters; rows: (role, text, fault)."""
    @functools.cache
    def best(i, last, inserted):
        options = []
        if i == len(rows):
            if last in ("", "a"):
                options.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            cost, letters, lines = best(i + 1, last, 0)
            options.append((cost + 2, "D" + letters, lines))
            if fault not in ("blank", "duplicate"):
                for new, letter, price in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    if follows(last, new[:1]):
                        cost, letters, lines = best(i + 1, new[:1], 0)
                        options.append((cost + price + 5 * (fault == "truncated"), letter + letters, (f"{new}:{text}", *lines)))
        if inserted < 3:
            for new in ("user", "assistant"):
                if follows(last, new[:1]):
                    cost, letters, lines = best(i, new[:1], inserted + 1)
                    options.append((cost + 5, "I" + letters, (f"{new}:", *lines)))
        return min(options, key=lambda o: o[:2]) if options else (10**9, "", ())

    return best(0, "", 0)


def follows(last, new):
    return {"": new in ("s", "u"), "s": new == "u", "u": new == "a", "a": new == "u"}[last] and new != ""


def judged(turns):
    """Report of one conversation; turns: (turn, role, text) in order."""
    seen, rows, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        rows.append((role, text, fault))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    cost, audit, lines = cheapest(tuple(rows))
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d:
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def order(turn, role, text):
    return (turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest())


def wanted(rows, ids):
    by = {i: [] for i in ids}
    for conv, turn, role, text in rows:
        by[conv].append((turn, role, text))
    return sorted(((i, *judged(sorted(turns, key=lambda t: order(*t)))) for i, turns in by.items()), key=str)


def test_pattern():
    for text in ("", "s", "u", "a", "sua", "uaua", "su", "ss", "uu", "as", "aua", "suauau"):
        last, legal = "", True
        for c in text:
            legal = legal and follows(last, c)
            last = c
        assert (legal and last in ("", "a")) == bool(re.fullmatch("(s?(ua)+)?", text))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["fine", "short", "gone"])), max_size=9))
def test_walk_is_cheapest_and_least(turns):
    faults = {"fine": 0, "short": 1, "gone": 2}
    codes = bytes(3 * ("sua".index(r[0]) if r[:1] in ("s", "u", "a") and r else 3) + faults[f] for r, f in turns)
    letters, edits, _, cost = repair.walk(codes, repair.AT_END, repair.START, True)
    rows = tuple((r, str(i), {"fine": None, "short": "truncated", "gone": "blank"}[f]) for i, (r, f) in enumerate(turns))
    want_cost, want_letters, want_lines = cheapest(rows)
    assert (cost, letters) == (want_cost, want_letters)
    assert tuple(f"{role if role is not None else turns[i][0]}:{i if i >= 0 else ''}" for i, role in edits) == want_lines


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 11), max_size=300), st.lists(st.integers(0, 300), max_size=6))
def test_blocks_chain_to_the_whole(codes, places):
    codes = bytes(codes)
    bounds = sorted({0, len(codes), *(p for p in places if p < len(codes))})
    parts = [codes[a:b] for a, b in zip(bounds, bounds[1:])] or [b""]
    ahead, costs = [], repair.AT_END
    for part in reversed(parts):
        ahead.append(costs)
        cells = repair.matrix(part)
        costs = tuple(min(cells[4 * s + t] + costs[t] for t in range(4)) for s in range(4))
    state, letters, total = repair.START, "", 0
    for k, part in enumerate(parts):
        some, _, state, cost = repair.walk(part, ahead[-1 - k], state, k == len(parts) - 1)
        letters, total = letters + some, total + cost
    whole = repair.walk(codes, repair.AT_END, repair.START, True)
    assert (letters, total) == (whole[0], whole[3]) and total == costs[repair.START]


def test_only_checkpoints_are_stored():
    assert len(repair.checkpoints(bytes(10_000), repair.AT_END)[1]) == 101


def conversations(seed, n=60):
    rng, out = random.Random(seed), []
    texts = ["Yes.", "No!", "Why?", "cut off", "", "  \n", "So it is. ", "a, b", None]
    for conv in range(n):
        for turn in range(rng.randrange(1, 14)):
            if rng.random() < 0.1:
                continue
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            out.append((conv, None if rng.random() < 0.03 else turn, role, rng.choice(texts) if rng.random() < 0.5 else f"Turn {turn}."))
    out += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hi."), (None, 2, "assistant", "Hi."), (-7, None, None, None), (10**6, 3, "user", "x" * 100_000 + ".")]
    return out


@pytest.mark.parametrize("block_rows", [1, 3, 4096])
def test_query_against_search(spark, block_rows):
    rows = conversations(block_rows)
    df = with_clashes(spark.createDataFrame(rows, TURNS))
    found = sorted((tuple(r) for r in repair.report_all(df, block_rows).collect()), key=str)
    assert found == wanted(damaged(rows), {r[0] for r in rows})


def test_a_conversation_of_many_blocks(spark):
    rng = random.Random(4)
    rows = [(5, t, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice(["Yes.", "No.", "and so", f"Answer {t}."])) for t in range(900)]
    df = spark.createDataFrame(rows, TURNS)
    small, big = (repair.report(repair.repair(df, block_rows=b)).collect() for b in (7, 10_000))
    assert small == big and len(small) == 1
    blocks = repair.repair(df, block_rows=7)
    assert blocks.count() > 100 and not blocks.where("whole").count()
    initials = "".join(r["role"][0] for r in blocks.orderBy("block").select(F.explode("turns").alias("t")).select("t.*").collect())
    assert re.fullmatch("(s?(ua)+)?", initials)


def test_table_and_empty(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    found = sorted((tuple(r) for r in repair.report_all(df).collect()), key=str)
    assert found == wanted(damaged(rows), {r[0] for r in rows})
    assert repair.report_all(df.limit(0)).count() == 0
    blocks = repair.repair(df.limit(0))
    assert blocks.count() == 0 and blocks.columns[0] == "conv_id"
