"""Packing: every id once, in order, windows within bounds, the plan least in cost."""

import itertools
import os
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pavilion.llm import packing
from pavilion.llm.common import table

from .edge import documents, empty_documents, odd_documents, rows


@pytest.fixture(scope="module")
def tokenizer():
    out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out.encode_special_tokens = True
    return out


def check(pieces, texts, tokenizer, size=2048):
    """``texts``: (doc_id, text) of all rows. Rebuilds each document's ids and each sequence."""
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    want = {}
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want.setdefault(doc_id, []).append(np.array(ids, dtype="<u4"))
    assert by_doc.keys() == want.keys()
    for doc_id, found in by_doc.items():
        left = list(want[doc_id])
        assert sum(p["length"] for p in found) == sum(map(len, left))
        for p in found:
            assert any(p["doc_tokens"] == len(ids) and zlib.crc32(ids[p["start"]:p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for ids in left)
        if len(left) == 1:
            at = 0
            for p in sorted(found, key=lambda p: p["start"]):
                assert p["start"] == at
                at += p["length"]
    windows = {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    padding = 0
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / max(1, sum(p["length"] for p in pieces)), windows


def test_table(spark, tokenizer):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    pieces = rows(packing.pack(docs))
    padding, windows = check(pieces, [tuple(r) for r in docs.select("doc_id", "text").collect()], tokenizer)
    assert padding < 0.03
    order = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    assert [p["doc_id"] for p in order] == sorted(p["doc_id"] for p in order)  # the order of documents is kept


def test_odd_rows(spark, tokenizer):
    docs = odd_documents(spark)
    pieces = rows(packing.pack(docs, ids=True))
    check(pieces, [tuple(r) for r in docs.select("doc_id", "text").collect()], tokenizer)
    assert all(len(p["ids"]) == p["length"] for p in pieces)
    assert packing.pack(empty_documents(spark)).count() == 0


SPACES = st.text(alphabet=st.sampled_from(list("ab.,' \n\t 　é9<|>\x00\x1c\x85")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(SPACES, min_size=1, max_size=4))
def test_encoder_is_the_tokenizer(texts):
    global ENCODER
    try:
        encoder = ENCODER
    except NameError:
        encoder = ENCODER = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*texts, "a <|endoftext|> b"]
    assert [x.tolist() for x in encoder(pa.array(texts))] == [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens_are_the_tokenizers(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = [f"a {mark} b", f"x{mark}y z x", mark, f"{mark}{mark}\n{mark} end", f"no{mark[:-1]} >", f" {mark}\n", "x y z", f"a\t{mark}"]
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(2):  # the second time words are known
        assert [x.tolist() for x in encoder(pa.array(texts))] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    docs = documents(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])
    check(rows(packing.pack(docs)), list(enumerate(texts)), plain)


def cost(at, penalty, ends, size):
    total, before = 0, 0
    for j in ends:
        length = at[j] - at[before]
        if length > size:
            return None
        free = length & (length - 1) == 0 and length >= packing.LEAST
        total += (0 if free else size - length) + penalty[j] + packing.PER_WINDOW
        before = j
    return total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 200), st.sampled_from([0, 16, 256])), min_size=1, max_size=9))
def test_plan_is_least(steps):
    at = np.concatenate([[0], np.cumsum([s for s, _ in steps])])
    penalty = np.array([0, *(p for _, p in steps)])
    n, size = len(at) - 1, 256
    best = min(c for k in range(n) for cut in itertools.combinations(range(1, n), k) if (c := cost(at, penalty, [*cut, n], size)) is not None)
    assert cost(at, penalty, packing.plan(at, penalty, size), size) == best


def test_horizon_carries_over(monkeypatch):
    monkeypatch.setattr(packing, "HORIZON", 5000)
    sentence = np.zeros(50, dtype=bool)
    sentence[7] = True
    packer, out = packing.Packer(sentence, 256, 0), []
    monkeypatch.setattr(packing, "AGAIN", 512)
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50, rng.integers(1, 900)).astype("<u4") for _ in range(80)]
    for i, d in enumerate(docs):
        out += packer.add(i, d)
    out += packer.flush()
    for i, d in enumerate(docs):
        assert np.concatenate([p[2] for p in out if p[0] == i]).tolist() == d.tolist()
    assert [p[4] for p in out] == sorted(p[4] for p in out)


def test_encoder_stays_on_the_tasks_core():
    """Every thread of the tokenizer's own would keep a heap in the worker; a task has one core."""
    code = """
import os, pyarrow as pa, public_tokenizers
from pavilion.llm import packing
encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
before = len(os.listdir("/proc/self/task"))
encoder(pa.array([" ".join(f"w{i}x{j}" for j in range(2000)) for i in range(20)]))
print(len(os.listdir("/proc/self/task")) - before)
"""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    told = subprocess.run([sys.executable, "-c", code], env=env, cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True)
    assert told.stdout.split() == ["0"], told.stdout
