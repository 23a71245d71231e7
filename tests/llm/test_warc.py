"""Archives: round trip, revisits, valid gzip, push-down, damaged payloads, lost attempts."""

import base64
import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from pavilion.llm import warc
from pavilion.llm.common import table
from pavilion.session import work_dir

from .edge import rows, with_clashes

PAGES = "page_id long, url string, html string"


def expected(pages, least=0):
    first = {}
    for i, h in pages:
        data = (h or "").encode()
        if i is not None:
            first[data] = min(first.get(data, i), i)
    out = []
    for i, h in pages:
        data = (h or "").encode()
        again = len(data) >= least and data in first and i != first[data]
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[data] if again else None))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def odd(spark):
    data = [(3, "http://a/", "same"), (1, None, "same"), (2, "http://b/\r\nX: y z", "same"), (4, "u", None), (5, "u", ""), (None, "u", "only here"), (None, "u", "same"),
            (6, "u", "long " * 400_000), (7, "ü", "Ä\r\n\r\n\x00"), (8, "u", "twice"), (8, "u", "twice"), (9, "u", "twice"), (-1, "u", "\r\n\r\n")]
    return with_clashes(spark.createDataFrame(data, PAGES))


@pytest.mark.parametrize("least", [0, 5])
def test_odd_rows(spark, least):
    df = odd(spark)
    assert found(warc.round_trip(df, least)) == expected([(r["page_id"], r["html"]) for r in df.collect()], least)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_table(spark):
    df = table(spark, "/root/testdata/sf0.001", "pages")
    assert found(warc.round_trip(df)) == expected([(r["page_id"], r["html"]) for r in df.collect()])


@pytest.fixture
def archive(spark):
    path = f"{work_dir(spark)}/archive"
    warc.write_pages(odd(spark), path)
    return path


def test_files_are_gzip_and_warc(spark, archive):
    text = b"".join(gzip.open(f).read() for f in glob.glob(f"{archive.removeprefix('file://')}/*.warc.gz"))
    assert text.count(b"WARC/1.1\r\n") == 13
    assert text.count(b"WARC-Profile: " + warc.REVISIT.encode()) == text.count(b"WARC-Type: revisit")
    assert b"X: y" not in text  # a url can't add a header


def test_payloads_come_back(spark, archive):
    got = {r["record_id"]: r["payload"] for r in warc.read_records(spark, archive, "record_id string, record_type string, payload binary").collect()
           if r["record_type"] == "response"}
    assert bytes(got["<urn:page:7>"]) == "Ä\r\n\r\n\x00".encode() and bytes(got["<urn:page:6>"]) == b"long " * 400_000


def test_filters_reach_the_reader(spark, archive):
    reader = warc.Reader(spark.createDataFrame([], "record_id string").schema, {"path": archive})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

    other = GreaterThan(("payload_bytes",), 3)
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("target_uri",), ("http://a/", "u")), StringStartsWith(("record_id",), "<urn:"), other]))
    assert left == [other]
    ids = sorted(r[0] for p in reader.partitions() for r in reader.read(p))
    assert ids == ["<urn:page:3>", "<urn:page:9>", "<urn:page:none>"] or ids == ["<urn:page:3>", "<urn:page:5>", "<urn:page:9>", "<urn:page:none>"]
    df = warc.read_records(spark, archive, "record_id string, record_type string").where((F.col("record_type") == "revisit") & F.col("record_id").isNotNull())
    assert "Filter" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() == sum(r["record_type"] == "revisit" for r in warc.read_records(spark, archive, "record_id string, record_type string").collect())


def test_unwanted_payloads_are_not_inflated(spark, archive, monkeypatch):
    calls = []
    plain = warc.zlib.decompressobj

    class Counting:
        def __init__(self, *a):
            self.own = plain(*a)

        def decompress(self, *a):
            out = self.own.decompress(*a)
            calls.append(len(out))
            return out

        def __getattr__(self, name):
            return getattr(self.own, name)

    monkeypatch.setattr(warc.zlib, "decompressobj", Counting)
    reader = warc.Reader(spark.createDataFrame([], "record_id string").schema, {"path": archive})
    assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == 13
    assert sum(calls) <= 13 * warc.HEAD


def test_damage_is_noticed():
    row = {"record_type": "response", "record_id": "<urn:page:1>", "payload_digest": warc.digest(b"other"), "payload": b"this", "payload_bytes": 4, "target_uri": None,
           "refers_to": None}
    import pyarrow as pa

    class Schema:
        names = ["record_id"]

    data = warc.member(warc.record(row, "1970-01-01T00:00:00Z"))
    for verify in ("true", "false"):
        reader = warc.Reader(Schema, {"path": "file:///none", "verify": verify})
        if verify == "true":
            with pytest.raises(ValueError):
                list(reader.records(pa.PythonFile(__import__("io").BytesIO(data), mode="r")))
        else:
            assert list(reader.records(pa.PythonFile(__import__("io").BytesIO(data), mode="r"))) == [("<urn:page:1>",)]


def foreign_record(kind, block, content_type=None, **fields):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{len(block)}:{kind}>", *(f"WARC-{k.replace('_', '-')}: {v}" for k, v in fields.items())]
    if content_type:
        head.append(f"Content-Type: {content_type}")
    return "\r\n".join(["WARC/1.0", *head, f"content-length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Long: a\r\n b\r\n"
BODY = b"<p>one</p>" * 30_000
CHUNKS = b"".join(b"%x;ext=1\r\n%s\r\n" % (len(BODY[i:i + 7001]), BODY[i:i + 7001]) for i in range(0, len(BODY), 7001)) + b"0\r\nTrailer: x\r\n\r\n"


def foreign():
    """(records, what is to be read: type, payload bytes, payload) of an archive by another writer."""
    http = "application/http; msgtype=response"
    return [
        (foreign_record("warcinfo", b"software: other\r\n\r\nformat: x", "application/warc-fields"), ("warcinfo", 28, b"software: other\r\n\r\nformat: x")),
        (foreign_record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "application/http;msgtype=request"), ("request", 0, b"")),
        (foreign_record("response", HTTP + b"\r\n" + BODY, http, Payload_Digest="sha1:" + warc.digest(BODY), Target_URI="http://a/"), ("response", len(BODY), BODY)),
        (foreign_record("response", HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + CHUNKS, http, Payload_Digest="sha1:" + warc.digest(BODY)), ("response", len(BODY), BODY)),
        (foreign_record("response", HTTP + b"Transfer-Encoding: chunked\r\n\r\nnot in chunks", http, Payload_Digest="sha256:abc"), ("response", 13, b"not in chunks")),
        (foreign_record("response", b"HTTP/1.1 200 OK", http), ("response", 15, b"HTTP/1.1 200 OK")),
        (foreign_record("resource", b"\x00\x01\r\n\r\n\xff", "image/png"), ("resource", 7, b"\x00\x01\r\n\r\n\xff")),
        (foreign_record("metadata", b""), ("metadata", 0, b"")),
        (foreign_record("revisit", HTTP + b"Content-Length: 5\r\n\r\n", http, Refers_To="<urn:x>"), ("revisit", 5, None)),
        (foreign_record("revisit", b""), ("revisit", None, None)),
    ]


@pytest.mark.parametrize("form", ["plain", "members", "one member", "padded"])
def test_archives_of_other_writers(spark, tmp_path, form):
    records = [r for r, _ in foreign()]
    (tmp_path / "below").mkdir()
    name = tmp_path / "below" / ("a.warc" if form == "plain" else "a.warc.gz")
    name.write_bytes({"plain": b"".join(records), "members": b"".join(map(gzip.compress, records)), "one member": gzip.compress(b"".join(records)),
                      "padded": b"".join(gzip.compress(r) + b"\0" * 7 for r in records)}[form])
    (tmp_path / "note.txt").write_text("no archive")
    for path in (tmp_path, name):
        df = warc.read_records(spark, f"file://{path}", "record_type string, payload_bytes long, payload binary", verify=True)
        assert [(r[0], r[1], None if r[2] is None else bytes(r[2])) for r in df.collect()] == [want for _, want in foreign()]
        sizes = warc.read_records(spark, f"file://{path}", "payload_bytes long, target_uri string, refers_to string").collect()
        assert [r[0] for r in sizes] == [want[1] for _, want in foreign()]
        assert [r[1] for r in sizes if r[1]] == ["http://a/"] and [r[2] for r in sizes if r[2]] == ["<urn:x>"]
        assert df.where("record_type = 'resource'").count() == 1


def test_payloads_of_other_writers_are_skipped(spark, tmp_path, monkeypatch):
    """A plain file is sought in, a compressed one holds a block at a time; what a predicate refuses makes no row."""
    from pyspark.sql.datasource import EqualTo

    records = [r for r, _ in foreign()]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    reader = warc.Reader(spark.createDataFrame([], "record_id string, payload binary").schema, {"path": f"file://{tmp_path}"})
    assert list(reader.pushFilters([EqualTo(("record_type",), "metadata")])) == []
    taken = []
    plain = warc.Bytes._more
    monkeypatch.setattr(warc.Bytes, "_more", lambda self: (plain(self), taken.append(len(self.held)))[0])
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == ["<urn:0:metadata>"]
    assert sum(taken) < len(BODY) / 2


@pytest.mark.parametrize("damage", ["cut", "no header", "cut gz", "digest"])
def test_damaged_archives_of_other_writers(spark, tmp_path, damage):
    record = foreign_record("response", HTTP + b"\r\n" + BODY, "application/http", Payload_Digest="sha1:" + warc.digest(b"other" if damage == "digest" else BODY))
    name = tmp_path / ("a.warc.gz" if damage == "cut gz" else "a.warc")
    name.write_bytes({"cut": record[:-400], "no header": record + b"noise\r\n\r\nmore", "cut gz": gzip.compress(record)[:-200], "digest": record}[damage])
    with pytest.raises(Exception, match="ends early|no record|differs"):
        warc.read_records(spark, f"file://{name}", verify=True).collect()


def test_files_of_lost_attempts_are_not_read(spark, archive):
    before = warc.read_records(spark, archive, "record_id string").count()
    with open(f"{archive.removeprefix('file://')}/lost.warc.gz", "wb") as out:
        out.write(b"half a record")
    assert warc.read_records(spark, archive, "record_id string").count() == before == len(rows(odd(spark)))
