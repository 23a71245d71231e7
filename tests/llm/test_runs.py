"""Periodic runs against a plain search of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pavilion.llm import queries, runs
from pavilion.llm.common import table

from .edge import documents, empty_documents, odd_documents, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least_length=6, least_exponent=4):
    """(start, length, period) by trying every period at every place."""
    n, found = len(words), {}
    for p in range(1, n // least_exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least_length, least_exponent * p):
                found.setdefault((i, j + p - i), p)  # periods rise: the smallest stays
            i = j + 1
    return sorted((s, length, p) for (s, length), p in found.items())


def collapsed(words, found):
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def damaged(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def wanted(docs):
    out = []
    for doc_id, text in docs:
        words = damaged(doc_id, text)
        found = brute(words)
        top = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
        out.append((doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None,
                    digest("".join(f"{s},{length},{p}\n" for s, length, p in found)), digest(collapsed(words, found))))
    return sorted(out, key=str)


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def check(df, docs):
    assert sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str) == wanted(docs)


def found_in(texts, *least):
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    symbols = np.array([s for t in texts for s in t], dtype=np.int64)
    out = [[] for _ in texts]
    for text, start, length, period in runs.runs_of(symbols, bounds, *least).tolist():
        out[text].append((start, length, period))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=5), st.sampled_from([(6, 4), (2, 2), (1, 3)]))
def test_small_alphabets(texts, least):
    assert found_in(texts, *least) == [brute(t, *least) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6))
def test_repeats_of_repeats(seed):
    rng = random.Random(seed)
    text = [rng.randrange(3) for _ in range(rng.randrange(1, 6))]
    while len(text) < 300:
        a = rng.randrange(len(text))
        text += text[a:a + rng.randrange(1, 12)] * rng.randrange(1, 7) + [rng.randrange(4)] * rng.randrange(3)
    assert found_in([text], 6, 4)[0] == brute(text) and found_in([text], 2, 2)[0] == brute(text, 2, 2)


def test_suffixes_and_prefixes():
    rng = random.Random(3)
    texts = [[rng.randrange(k) for _ in range(n)] for k, n in ((1, 40), (2, 100), (3, 1), (5, 0), (9, 80))]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    symbols = np.array([s for t in texts for s in t], dtype=np.int64)
    order, rank = runs.suffix_array(symbols, bounds)
    want = [int(b) + i for t, b in zip(texts, bounds) for i in sorted(range(len(t)), key=lambda i: t[i:])]
    assert order.tolist() == want and rank[order].tolist() == list(range(len(want)))
    lcp = runs.common_prefixes(symbols, bounds, order).tolist()
    at = 0
    for t, b in zip(texts, bounds.tolist()):
        places = [i - b for i in want[at:at + len(t)]]
        for k, i in enumerate(places):
            j = places[k - 1] if k else len(t)
            assert lcp[at + k] == next((x for x, (u, v) in enumerate(zip(t[i:], t[j:])) if u != v), min(len(t) - i, len(t) - j))
        at += len(t)


def test_long_texts_stay_fast():
    """Work grows with n log n also where everything repeats."""
    for text in ([0] * 200_000, [0, 1] * 100_000, list(range(50_000)) * 4, [0] * 99_999 + [1] + [0] * 100_000):
        found = found_in([text], 6, 4)[0]
        assert found and all(length >= 4 * p for _, length, p in found)
    assert found_in([[0] * 200_000])[0] == [(0, 200_000, 1)]
    assert found_in([list(range(50_000)) * 4])[0] == [(0, 200_000, 50_000)]


def test_operator_and_odd_rows(spark):
    texts = [(20, "a b a b a b a b c"), (21, "x x x x x"), (22, "x x x x x x"), (23, "say it say it say it say it now now now now now now"), (24, " lead\tand  trail \n"),
             (25, "é é é é é é 　 ü"), (26, None), (27, "")]
    got = {r["doc_id"]: r for r in rows(runs.find_runs(documents(spark, [(i, t, "en", "a", 1) for i, t in texts])))}
    for i, t in texts:
        words = WORD.findall(t or "")
        assert [(r["start"], r["length"], r["period"]) for r in got[i]["runs"]] == brute(words) and got[i]["n_words"] == len(words)
        assert got[i]["collapsed"] == collapsed(words, brute(words))
    assert got[20]["collapsed"] == "a b c" and got[22]["collapsed"] == "x"
    odd = odd_documents(spark)
    assert runs.find_runs(odd).count() == odd.count() and runs.find_runs(empty_documents(spark)).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(odd, least_exponent=1)


def test_query_on_odd_rows(spark):
    odd = [(i, t) for i, t in ((r["doc_id"], r["text"]) for r in odd_documents(spark).collect()) if len(t or "") < 100_000]
    rng = random.Random(9)
    odd += [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 120)))) for i in range(100, 400)]
    docs = documents(spark, [(i, t, "en", "a", 1) for i, t in odd])
    check(queries.run_digests(docs), odd)


def test_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    check(queries.run_digests(docs), [(r["doc_id"], r["text"]) for r in docs.collect() if True])
