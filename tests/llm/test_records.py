"""Records of token ids: exact round trip, shuffled reads, damaged files, lost attempts."""

import glob
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pavilion.llm import records
from pavilion.llm.common import table
from pavilion.session import work_dir

from .edge import documents, empty_documents, odd_documents, rows


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")


def check(df, texts, tokenizer):
    """``texts``: (doc_id, text) of all rows; those that share a doc_id may lie in any order."""
    found = sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i or 0))
    left = {}
    for doc_id, text in texts:
        ids = ids_of(tokenizer, text)
        left.setdefault(doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    at = 0
    for doc_id, start, n, crc in found:
        assert start == at
        left[doc_id].remove((n, crc))
        at += n


def test_table(spark, tokenizer):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    df = records.round_trip(docs)
    assert df.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    check(df, [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer)


def test_odd_rows(spark, tokenizer):
    odd = odd_documents(spark).unionByName(documents(spark, [(11, "<|endoftext|> and more", "en", "a", 1)] * 40))
    check(records.round_trip(odd), [(r["doc_id"], r["text"]) for r in odd.collect()], tokenizer)
    assert records.round_trip(empty_documents(spark)).count() == 0


@pytest.fixture(scope="module")
def written(spark):
    docs = documents(spark, [(i, f"text {i} " * (i % 7), "en", "a", 1) for i in range(300)])
    path = f"{work_dir(spark)}/records"
    records.write_records(records.encode(docs), path, file_bytes=600)
    return path


def test_file_format(written):
    """Frames as any reader of length-delimited records would take them, and index entries that point at them."""
    seen = 0
    for name in glob.glob(f"{written}/*.records"):
        data, index = open(name, "rb").read(), open(f"{name}.index", "rb").read()
        at, before = 12, 0
        assert data[:8] == b"IDREC001" and struct.unpack("<I", data[8:12]) == (4,)
        for offset, size, start, n in struct.iter_unpack("<QQQQ", index):
            assert (offset, start) == (at, before)
            assert struct.unpack("<Q", data[at:at + 8])[0] == size == 9 + 4 * n
            for part, check in ((data[at:at + 8], data[at + 8:at + 12]), (data[at + 12:at + 12 + size], data[at + 12 + size:at + 16 + size])):
                crc = zlib.crc32(part)
                assert struct.unpack("<I", check)[0] == (((crc >> 15) | (crc << 17) & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF
            at, before, seen = at + size + 16, before + n, seen + 1
        assert at == len(data)
    assert seen == 300 and len(glob.glob(f"{written}/*.records")) > 4


def test_shuffled_reads(spark, written):
    plain = {r["start"]: r for r in rows(records.read_records(spark, written))}
    orders = []
    for seed in (1, 1, 2):
        found = rows(records.read_shuffled(spark, written, seed))
        assert sorted(r["start"] for r in found) == sorted(plain)
        assert all(plain[r["start"]]["ids"] == r["ids"] and plain[r["start"]]["doc_id"] == r["doc_id"] and len(r["ids"]) == 4 * r["n_tokens"] for r in found)
        orders.append([r["start"] for r in found])
    assert orders[0] == orders[1] != orders[2] and orders[0] != sorted(orders[0])
    index = rows(records.read_index(spark, written))
    assert {(r["file"], r["position"], r["start"], r["n_tokens"]) for r in index} == {(r["file"], r["position"], r["start"], r["n_tokens"]) for r in plain.values()}


def test_columns_of_the_reader(spark, written):
    df = records.read_records(spark, written, "n_tokens long, doc_id long")
    assert df.columns == ["n_tokens", "doc_id"] and df.where("doc_id = 0").first()["n_tokens"] == 1


def test_narrow_ids(spark, tokenizer):
    import pyarrow as pa

    assert records.round_trip(documents(spark, [(1, "abc", "en", "a", 1)]), width=4).first() == records.round_trip(documents(spark, [(1, "abc", "en", "a", 1)]), width=2).first()
    writer = records.Writer({"path": work_dir(spark), "width": "1"})
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([np.array([256], dtype="<u4").tobytes()], pa.binary())], names=["doc_id", "ids"])
    with pytest.raises(ValueError, match="needs more"):
        writer.write(iter([batch]))


@pytest.mark.parametrize("place", ["length", "payload", "end"])
def test_damage_is_noticed(spark, place):
    path = f"{work_dir(spark)}/records"
    records.write_records(records.encode(documents(spark, [(i, "some words here", "en", "a", 1) for i in range(5)])), path)
    name = glob.glob(f"{path}/*.records")[0]
    data = bytearray(open(name, "rb").read())
    if place == "end":
        data = data[:-3]
    else:
        data[13 if place == "length" else 30] ^= 1
    open(name, "wb").write(data)
    with pytest.raises(Exception, match="record"):
        records.read_records(spark, path).collect()


def test_a_lost_attempt_is_not_read(spark):
    path = f"{work_dir(spark)}/records"
    records.write_records(records.encode(documents(spark, [(1, "a b", "en", "a", 1)])), path)
    with open(f"{path}/stray.records", "wb") as out:
        out.write(b"half a file")
    assert records.read_records(spark, path).count() == 1
