"""Top-k search and near-duplicate vectors against plain computations."""

import math

import numpy as np
import pytest

from pavilion.llm import embed_dedup, topk

from .edge import with_clashes

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, data, kind="float"):
    df = spark.createDataFrame([(i, v, 1) for i, v in data], VECTORS.replace("float", kind))
    return with_clashes(df)


def odd(spark):
    nan, inf = float("nan"), float("inf")
    return vectors(spark, [(0, [1.0, 2.0, 0.5]), (1, None), (2, [1.0, None, 2.0]), (3, [nan, 1.0, 1.0]), (4, [inf, 1.0, 1.0]), (5, [0.0, 0.0, 0.0]), (6, []),
                           (7, [2.0, 4.0, 1.0]), (7, [2.0, 4.0, 1.0]), (None, [1.0, 2.0, 0.5]), (50, [-1.0, 0.1, 0.0]), (51, [1.0, 2.0]), (8, [-0.0, 1.0, 0.0]), (9, [0.0, 1.0, 0.0])])


def brute_topk(data, every, k):
    usable = {}
    for i, v in data:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.setdefault(i, []).append([math.floor(256 * float(np.float32(x))) for x in v])
    out = []
    for q in sorted(usable):
        if q % every == 0:
            own = max(usable[q])
            hits = {i: max(sum(a * b for a, b in zip(own, v)) for v in vs) for i, vs in usable.items() if i != q}
            out += [(q, n + 1, i, s) for n, (i, s) in enumerate(sorted(hits.items(), key=lambda h: (-h[1], h[0]))[:k])]
    return out


def plain(df):
    return sorted(tuple(r) for r in df.collect())


def test_topk_odd_rows(spark):
    df = odd(spark)
    assert plain(topk.search(df)) == brute_topk([(r["vec_id"], r["embedding"]) for r in df.collect()], 50, 5)
    assert topk.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("cell,block", [(8192, 4096), (7, 3)])
def test_topk_with_many_ties(spark, monkeypatch, cell, block):
    monkeypatch.setattr(topk, "CELL_ROWS", cell)
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in rng.integers(-1, 2, 6) / 4]) for i in range(120)]
    assert plain(topk.search(vectors(spark, data), every=5)) == brute_topk(data, 5, 5)


def test_accumulate_is_exact():
    rng = np.random.default_rng(4)
    for top in (10, 10**6, 10**12):
        a, b = (rng.integers(-top, top, (9, 5)).astype(float) * (rng.random((9, 5)) < 0.7) for _ in range(2))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
        assert topk.accumulate(a, b).tolist() == want


def brute_links(data, at_least=0.95):
    unit = {}
    for n, (i, v) in enumerate(data):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array([float(np.float32(x)) for x in v])
            unit[n] = a / math.sqrt(a @ a)
    parent, count = list(range(len(data))), [0] * len(data)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in unit:
        for b in unit:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= at_least:
                count[a] += 1
                count[b] += 1
                parent[find(b)] = find(a)
    low = {}
    for n, (i, _) in enumerate(data):
        low[find(n)] = min(low.get(find(n), embed_dedup.LAST), embed_dedup.LAST if i is None else i)
    return sorted(((i, count[n], low[find(n)]) for n, (i, _) in enumerate(data)), key=str)


def found_links(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in df.collect()), key=str)


def test_links_odd_rows(spark):
    df = odd(spark)
    data = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert found_links(embed_dedup.link_vectors(df)) == brute_links(data)
    assert embed_dedup.link_vectors(df.limit(0)).count() == 0
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in embed_dedup.link_vectors(df).collect() if r["vec_id"] is not None)


@pytest.mark.parametrize("block", [4096, 40])
def test_links_of_groups(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    data = []
    for i in range(300):
        v = centres[i % 12] + rng.normal(size=16) * [0.05, 0.2, 0.25, 0.3][i % 4]
        data.append((1000 - i, [float(x) for x in v.astype(np.float32)]))
    data += [(2000 + i, data[i % 3][1]) for i in range(60)]  # copies
    assert found_links(embed_dedup.link_vectors(vectors(spark, data), block_rows=block)) == brute_links(data)


def test_links_of_rare_widths(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=16)
    data = [(i, [float(x) for x in (centre + rng.normal(size=16) * 0.05).astype(np.float32)]) for i in range(120)]
    for k, width in enumerate((2, 3, 5)):  # fewer vectors than blocks, so many blocks have none
        data += [(1000 + 10 * k + i, [1.0] * (width - 1) + [1.0 + i / 64]) for i in range(4)]
    assert found_links(embed_dedup.link_vectors(vectors(spark, data), block_rows=10)) == brute_links(data)


def test_error_bound_holds():
    rng = np.random.default_rng(6)
    unit = rng.normal(size=(400, 64)) * rng.random((400, 1))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    q, s, near, error = embed_dedup.quantise(unit)
    gap = np.abs(unit @ unit.T - embed_dedup._product(q, q) * s[:, None] * s[None])
    assert (gap <= near[:, None] * error[None] + error[:, None] * near[None] + error[:, None] * error[None] + 1e-12).all()
    assert np.abs(q).max() <= 127
    wide = rng.integers(-127, 128, (3, 5000)).astype(np.float32)
    assert (embed_dedup._product(wide, wide) == wide.astype(int) @ wide.astype(int).T).all()


def test_huge_and_tiny_components(spark):
    data = [(1, [1e30, 1e-30]), (2, [1e38, 0.0]), (3, [1e-38, 0.0]), (4, [0.0, 1e-38])]
    assert found_links(embed_dedup.link_vectors(vectors(spark, data, "double"))) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4)]
