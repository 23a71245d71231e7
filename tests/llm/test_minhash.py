"""Near-duplicates: sketches, exact links, components, odd rows."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pavilion.llm import minhash
from pavilion.llm.common import components, table

from .edge import documents, empty_documents, odd_documents, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(texts, least=85):
    """component of each document by all pairs that share a shingle; texts: {doc_id: text}, ``least``: hundredths of similarity."""
    sets, inverted, parent = {i: shingles(t) for i, t in texts.items()}, defaultdict(list), {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        common = defaultdict(int)
        for s in sets[i]:
            for j in inverted[s]:
                common[j] += 1
            inverted[s].append(i)
        for j, n in common.items():
            if 100 * n >= least * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(found, texts):
    want = brute(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found) and len(found) == len(want)


def test_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    check(rows(minhash.near_duplicates(docs)), {r["doc_id"]: r["text"] for r in docs.collect()})


def near_group(n, edits, seed):
    """Copies of a text, each with some words replaced: close to the text, less close to one another."""
    rng = random.Random(seed)
    text = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    out = []
    for i in range(n):
        copy = list(text)
        for k in rng.sample(range(0, 200, 6), edits):
            copy[k] = f"e{i}x{k}"
        out.append(" ".join(copy))
    return [*out, " ".join(text)]


@pytest.mark.parametrize("block", [512, 16])
def test_groups_without_a_central_first_document(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "GROUP", block // 2)
    texts = dict(enumerate([*near_group(60, 3, 1), *near_group(40, 2, 2), *near_group(30, 5, 3)]))
    docs = documents(spark, [(i, t, "en", "a", 1) for i, t in texts.items()])
    check(rows(minhash.near_duplicates(docs)), texts)


def test_chain_of_links(spark):
    words, texts = [f"w{i}" for i in range(400)], {}
    for i in range(40):  # each text shifts the window a little: neighbours are linked, the ends are far apart
        texts[100 - i] = " ".join(words[4 * i:4 * i + 160])
    docs = documents(spark, [(i, t, "en", "a", 1) for i, t in texts.items()])
    found = rows(minhash.near_duplicates(docs))
    check(found, texts)
    assert {r["component_id"] for r in found} == {61}


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = rows(minhash.near_duplicates(docs))
    assert len(found) == docs.count()
    by_id = defaultdict(list)
    for r in found:
        by_id[r["doc_id"]].append(r)
    assert all(r["n_shingles"] == 0 and r["kept"] for i in (1, 2, 3) for r in by_id[i])
    assert all(r["component_id"] == 4 and not r["kept"] for r in by_id[5]) and len(by_id[5]) == 2
    assert sorted(r["component_id"] for r in by_id[None] if r["component_id"] is not None) == [4]  # a null id sorts last
    assert minhash.near_duplicates(empty_documents(spark)).count() == 0


def test_keep_one(spark):
    docs = odd_documents(spark)
    out = minhash.keep_one(docs)
    assert out.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sum(i == 4 for i, _ in kept) == 1 and not any(i == 5 for i, _ in kept) and (1, None) in kept
    assert minhash.keep_one(empty_documents(spark)).count() == 0
    twice = documents(spark, [(1, "a b c", "en", "a", 1), (1, "a b c", "en", "a", 1)])
    assert minhash.keep_one(twice).count() == 1


def test_sketches_agree_as_often_as_sets():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    agree = []
    for _ in range(60):
        own = rng.permutation(pool)[:1200]
        a, b = own[:1100], own[100:]  # similarity 1000 / 1200
        drawn = minhash.sketch([np.unique(a), np.unique(b)])
        agree.append((drawn[0] == drawn[1]).mean())
    assert abs(np.mean(agree) - 1000 / 1200) < 0.02 and np.std(agree) < 0.045
    small = minhash.sketch([np.array([7], dtype=np.uint64), np.array([7, 8, 9], dtype=np.uint64)])
    assert (small != np.iinfo(np.uint64).max).all()  # every bin is filled


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (10, 11), (11, 12), (7, 7), (1, 2)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10, 12: 10}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    path = [(i, i + 1) for i in range(300)]
    random.Random(0).shuffle(path)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert set(found.values()) == {0} and len(found) == 301


@pytest.mark.parametrize("rounds", [1, 2])
def test_large_clusters_in_small_blocks(spark, monkeypatch, rounds):
    """Clusters of many blocks: one tight, one of two halves, one chain; every link of the brute force is found."""
    monkeypatch.setattr(minhash, "GROUP", 4)
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    rng = random.Random(6)
    texts, word = {}, lambda: f"w{rng.randrange(10**6)}"
    tight = [word() for _ in range(120)]
    for i in range(40):
        own = list(tight)
        own[rng.randrange(120)] = word()
        texts[i] = " ".join(own)
    half = [tight[:60] + [word() for _ in range(60)], [word() for _ in range(120)]]
    half[1][:90] = half[0][:90]
    for i in range(30):
        own = list(half[i % 2])
        own[rng.choice([0, 119])] = word()
        texts[100 + i] = " ".join(own)
    chain = [word() for _ in range(150)]
    for i in range(25):
        chain[4 * i:4 * i + 4] = [word() for _ in range(4)]
        texts[200 + i] = " ".join(chain)
    order = list(texts)
    rng.shuffle(order)
    docs = documents(spark, [(i, texts[i], "en", "a", 1) for i in order])
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert found == brute(texts)


def test_a_tight_cluster_costs_its_size(spark):
    """All rows are of one star but three: no row is copied more than once for each block of those."""
    rows = spark.range(5000).select(F.lit(7).alias("key"), F.col("id").alias("node"), F.when(F.col("id") < 3, 0).otherwise(1).cast("long").alias("star"))
    dealt = minhash.apart(rows, 256)
    assert dealt.count() <= 5000 + 3 * (5000 // 256 + 2)
    groups = dealt.groupBy("low", "high").agg(F.count("*").alias("n"), F.collect_set("block").alias("b")).collect()
    assert max(r["n"] for r in groups) < 400 and not any(len(r["b"]) == 1 and r["low"] != r["high"] for r in groups)
    alone = spark.range(2000).select(F.lit(7).alias("key"), F.col("id").alias("node"), F.lit(0).cast("long").alias("star"))
    met = minhash.apart(alone, 500)
    pairs = met.alias("x").join(met.alias("y"), ["key", "low", "high"]).where("x.node < y.node AND (x.block <> y.block OR low = high)").select("x.node", "y.node")
    assert pairs.count() == pairs.distinct().count() == 2000 * 1999 // 2
