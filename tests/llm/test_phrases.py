"""Repeated passages against a plain loop over all windows."""

import hashlib
import random
import re

import pytest

from pavilion.llm import phrases
from pavilion.llm.common import table

from .edge import documents, empty_documents, odd_documents, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts):
    """(doc_id, n_words, n_removed, hash) of (doc_id, text) rows with different ids."""
    seen, out = set(), []
    for doc_id, text in sorted(texts):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            key = tuple(words[i:i + 20])
            if key in seen:
                gone[i:i + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def check(spark, texts):
    docs = documents(spark, [(i, t, "en", "a", 1) for i, t in texts])
    found = sorted(tuple(r) for r in phrases.remove_repeated(docs).collect())
    assert found == brute(texts)


def test_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    assert sorted(tuple(r) for r in phrases.remove_repeated(docs).collect()) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def corpus():
    rng = random.Random(5)

    def some(n):
        return [f"w{rng.randrange(5000)}" for _ in range(n)]

    shared = [some(n) for n in (19, 20, 21, 60, 300)]
    texts = []
    for i in range(60):
        parts = [some(rng.randrange(0, 80))]
        for _ in range(rng.randrange(0, 4)):
            passage = rng.choice(shared)
            a = rng.randrange(0, max(1, len(passage) - 30))
            parts += [passage[a:a + rng.randrange(15, 120)], some(rng.randrange(0, 40))]
        texts.append((rng.randrange(10**6) * 100 + i, rng.choice([" ", "\n", "  "]).join(w for p in parts for w in p)))
    texts += [(7, " ".join(["again"] * 100)), (8, "again " * 45), (9, " ".join(shared[3] * 3)), (10, "again " * 20), (11, " ".join(shared[4])), (12, "\t" + "\n".join(shared[4]))]
    return texts


@pytest.mark.parametrize("shard,hot", [(4000, 20_000), (1, 20_000), (4000, 1), (50, 3)])
def test_passages(spark, monkeypatch, shard, hot):
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "HOT", hot)
    check(spark, corpus())


def test_windows_are_judged_on_the_input(spark):
    words = [f"w{i}" for i in range(60)]
    # the second text repeats the first, the third repeats what is gone from the second
    check(spark, [(1, " ".join(words[:40])), (2, " ".join(["x", *words[:40], "y"])), (3, " ".join(["x", *words[:25]]))])


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = rows(phrases.remove_repeated(docs))
    assert len(found) == docs.count()
    empty = hashlib.sha256(b"").hexdigest()
    for r in found:
        if r["doc_id"] in (1, 2, 3):
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (0, 0, empty)
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by_id[4]["n_removed"] == 0 and by_id[5]["n_removed"] == 400 and by_id[8]["n_removed"] > 39_000
    assert sorted(r["n_removed"] for r in found if r["doc_id"] is None) == [0, 0, 400]
    assert phrases.remove_repeated(empty_documents(spark)).count() == 0


def test_versions_of_a_document_do_not_mix(spark):
    words = [f"w{i}" for i in range(100)]
    rows_ = [(1, " ".join(words[:30]), "en", "a", 1), (2, " ".join(["x", *words[:30]]), "en", "a", 1), (2, " ".join([*words[50:80], "y"]), "en", "a", 1)]
    found = sorted((r["n_words"], r["n_removed"]) for r in phrases.remove_repeated(documents(spark, rows_)).collect())
    assert found == [(30, 0), (31, 0), (31, 30)]
