"""WARC archives as a Spark data source in Python.

Writing: one gzip member a record, with its own length in the member's extra field, so a reader can step over
a record without inflating it. Files are listed in a manifest that is written when all tasks have ended; what a lost
task leaves behind is in no manifest and is never read.

Reading: a folder with a manifest, or any other file or folder of ``.warc`` and ``.warc.gz`` files. Files are planned into partitions by size.
Predicates on the record type and on headers are pushed down; a record's headers are inflated first, and the rest only if the record is
wanted and a column needs the payload. Members that state their length are stepped over; in other compressed files what isn't wanted is inflated
and thrown away, in plain ones it is skipped.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull,
                                    StringStartsWith, WriterCommitMessage)
from pyspark.sql.types import StructType

from ..session import work_dir

#: Column of the data source and header of a record that holds it.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
           "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
SCHEMA = ("record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, "
          "payload_bytes long, payload binary")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "manifest.json"
#: A file is closed beyond so many bytes; a read partition takes files up to so many.
FILE_BYTES, SPLIT_BYTES = 64 << 20, 64 << 20
#: Inflated first, to see the headers.
HEAD = 4096
#: Read or thrown away at once.
CHUNK = 1 << 20
#: Headers longer than this are damage.
MOST_HEAD = 16 << 20


def _clean(value: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in value)


def member(block: bytes) -> bytes:
    """A gzip member with its whole length and its inflated length in the extra field ``sl``."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(block) + pack.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(block) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def record(row: dict, date: str) -> bytes:
    """One response or revisit record. A revisit keeps the HTTP header, so it still states its payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + (row["payload"] or b"" if row["record_type"] == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {row['record_id']}", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{row['payload_digest']}", "Content-Type: application/http; msgtype=response"]
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_clean(row['target_uri'])}")
    if row["record_type"] == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {row['refers_to']}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.date = options["path"].rstrip("/"), options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = fs.FileSystem.from_uri(self.path)
        store.create_dir(base, recursive=True)
        files, out, name, size = [], None, "", 0
        for batch in iterator:
            columns = {n: batch.column(n) for n in batch.schema.names}
            small = {n: c.to_pylist() for n, c in columns.items() if n != "payload"}
            for i in range(batch.num_rows):
                row = {n: values[i] for n, values in small.items()}
                row["payload"], row["payload_digest"] = columns["payload"][i].as_py(), base32(row["payload_digest"])
                if out is None:  # the name is new in every attempt of a task
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                out.write(data := member(record(row, self.date)))
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Without a manifest nothing of the attempt is ever read."""


@dataclass
class Files(InputPartition):
    names: list[str]


def parse_head(head: bytes) -> dict[str, str]:
    """Fields by lower-case name, the first of each; lines that begin with white space go on with the one before."""
    fields: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").splitlines()[1:]:
        if line[:1] in (" ", "\t") and name is not None:
            fields[name] += " " + line.strip()
            continue
        key, _, value = line.partition(":")
        name = key.strip().lower()
        if name in fields:
            name = None
        else:
            fields[name] = value.strip()
    return fields


class Bytes:
    """The bytes of an archive file from its start on, inflated member by member if they are compressed."""

    def __init__(self, source: pa.NativeFile, end: int) -> None:
        self.source, self.end = source, end
        self.held = b""
        self.raw = source.read(2)
        self.inflate = zlib.decompressobj(31) if self.raw == b"\x1f\x8b" else None

    def _more(self) -> bool:
        """Take some more bytes; False at the end."""
        if self.inflate is None:
            data, self.raw = self.raw or self.source.read(HEAD), b""
            self.held += data
            return bool(data)
        while True:
            if self.inflate.eof:  # the next member, after what pads this one
                self.raw = self.inflate.unused_data.lstrip(b"\0") or self.source.read(CHUNK).lstrip(b"\0")
                if not self.raw:
                    return False
                self.inflate = zlib.decompressobj(31)
            data = self.raw or self.inflate.unconsumed_tail or self.source.read(CHUNK)
            if not data:
                raise ValueError("a compressed record ends early")
            self.raw = b""
            if text := self.inflate.decompress(data, CHUNK):
                self.held += text
                return True

    def head(self) -> bytes | None:
        """A record's header with its version line, without line ends around it; None at the end of the file."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            for mark in (b"\r\n\r\n", b"\n\n"):
                at = self.held.find(mark)
                if at >= 0:
                    head, self.held = self.held[:at], self.held[at + len(mark):]
                    return head
            if len(self.held) > MOST_HEAD:
                raise ValueError("no end of a record's header")
            if not self._more():
                if self.held:
                    raise ValueError("a record's header ends early")
                return None

    def read(self, most: int) -> bytes:
        """Some bytes, ``most`` at most; empty at the end."""
        if not self.held:
            self._more()
        data, self.held = self.held[:most], self.held[most:]
        return data

    def skip(self, size: int) -> None:
        take = min(size, len(self.held))
        self.held, size = self.held[take:], size - take
        if self.inflate is None and size > len(self.raw):
            if self.source.tell() + size - len(self.raw) > self.end:
                raise ValueError("a record ends early")
            self.source.seek(self.source.tell() + size - len(self.raw))
            self.raw = b""
            return
        while size:
            if not (data := self.read(min(size, CHUNK))):
                raise ValueError("a record ends early")
            size -= len(data)


class Block:
    """The block of one record: reads until its length is used up."""

    def __init__(self, source: Bytes, size: int) -> None:
        self.source, self.left = source, size

    def more(self) -> bytes:
        data = self.source.read(min(self.left, CHUNK)) if self.left else b""
        if self.left and not data:
            raise ValueError("a record ends early")
        self.left -= len(data)
        return data


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunks (as it is, if it isn't in chunks after all)."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0].strip() or b"x", 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or end + 2 + size > len(body):
            return body
        if not size:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + size])
        at = end + 4 + size


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.path, self.names = options["path"].rstrip("/"), schema.names
        self.verify = options.get("verify", "false").lower() == "true"
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.wanted.append(("in", column, (f.value,)))
            elif isinstance(f, In):
                self.wanted.append(("in", column, tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.wanted.append(("starts", column, f.value))
            elif isinstance(f, IsNotNull):
                self.wanted.append(("there", column, None))
            else:
                yield f

    def partitions(self) -> Sequence[Files]:
        store, base = fs.FileSystem.from_uri(self.path)
        files = self.listed(store, base)
        out, size = [], 0
        for name, length in files:
            if not out or size + length > SPLIT_BYTES:
                out, size = [*out, Files([])], 0
            out[-1].names.append(name)
            size += length
        return out or [Files([])]

    def listed(self, store: fs.FileSystem, base: str) -> list[tuple[str, int]]:
        """(name, bytes) of the files: those of the manifest, or without one all archives in the folder and below, or the file itself."""
        at = store.get_file_info(base)
        if at.type == fs.FileType.File:
            return [("", at.size)]
        if store.get_file_info(f"{base}/{MANIFEST}").type == fs.FileType.File:
            with store.open_input_stream(f"{base}/{MANIFEST}", compression=None) as source:
                return json.loads(source.read())
        found = store.get_file_info(fs.FileSelector(base, recursive=True))
        return sorted((f.path[f.path.index(base) + len(base):].lstrip("/"), f.size) for f in found
                      if f.type == fs.FileType.File and f.path.endswith((".warc", ".warc.gz")) and not f.base_name.startswith((".", "_")))

    def fits(self, values: dict[str, str | None]) -> bool:
        for kind, column, want in self.wanted:
            value = values[column]
            if value is None or kind == "in" and value not in want or kind == "starts" and not value.startswith(want):
                return False
        return True

    def read(self, partition: Files) -> Iterator[tuple]:
        store, base = fs.FileSystem.from_uri(self.path)
        for name in partition.names:
            with store.open_input_file(f"{base}/{name}" if name else base) as source:
                start = source.read(14)
                source.seek(0)
                try:
                    yield from self.records(source) if start[:4] == b"\x1f\x8b\x08\x04" and start[12:14] == b"sl" else self.foreign(source)
                except (ValueError, zlib.error) as error:
                    raise ValueError(f"{name or base}: {error}") from error

    def headers(self, head: bytes) -> tuple[dict, dict]:
        """(values of the columns, all fields) of a record's header."""
        if not head.startswith(b"WARC/"):
            raise ValueError("no record's header where one should be")
        fields = parse_head(head)
        values = {column: fields.get(header.lower()) for column, header in HEADERS.items()}
        if values["payload_digest"]:
            values["payload_digest"] = values["payload_digest"].removeprefix("sha1:")
        return values, fields

    def foreign(self, source: pa.NativeFile) -> Iterator[tuple]:
        """Records of a file that says no more than the standard asks for."""
        data = Bytes(source, source.size())
        while (head := data.head()) is not None:
            values, fields = self.headers(head)
            block = Block(data, int(fields["content-length"]))
            if self.fits(values):
                yield self.row(values, fields, b"", block.more)
            data.skip(block.left)

    def records(self, source: pa.NativeFile) -> Iterator[tuple]:
        """Records of a file whose members state their length."""
        at, end = 0, source.size()
        while at < end:
            source.seek(at)
            start = source.read(24)
            if len(start) < 24 or start[:4] != b"\x1f\x8b\x08\x04" or start[12:14] != b"sl":
                raise ValueError(f"no record that states its length at byte {at}")
            size, = struct.unpack("<I", start[16:20])
            inflate = zlib.decompressobj(-15)
            packed = source.read(min(HEAD, size - 32))
            text = inflate.decompress(packed, HEAD)
            rest = size - 32 - len(packed)

            def inflated() -> bytes:
                nonlocal rest
                data = inflate.unconsumed_tail
                if not data and rest:
                    data = source.read(min(CHUNK, rest))
                    rest -= len(data)
                return inflate.decompress(data, CHUNK)

            while b"\r\n\r\n" not in text and (new := inflated()):
                text += new
            head, _, block = text.partition(b"\r\n\r\n")
            values, fields = self.headers(head)
            if self.fits(values):
                left = max(int(fields["content-length"]) - len(block), 0)

                def more() -> bytes:
                    nonlocal left
                    data = inflated()[:left] if left else b""
                    left -= len(data)
                    return data

                yield self.row(values, fields, block[:int(fields["content-length"])], more)
            at += size

    def row(self, values: dict, fields: dict, block: bytes, more) -> tuple:
        """The asked columns of a record whose block starts with ``block`` and goes on with what ``more()`` gives until it is empty.

        Payload: what follows the HTTP header, chunks put together; of a block that isn't HTTP, all of it. A revisit has none, and as many bytes as its HTTP header
        says, or NULL.
        """
        if "payload_bytes" in self.names or "payload" in self.names or self.verify:
            size = int(fields["content-length"])
            http: dict[str, str] = {}
            if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
                while b"\r\n\r\n" not in block and len(block) < MOST_HEAD and (new := more()):
                    block += new
                head, mark, rest = block.partition(b"\r\n\r\n")
                if mark:
                    http, size, block = parse_head(head), size - len(head) - 4, rest
            chunked = http.get("transfer-encoding", "").lower().endswith("chunked")
            revisit = values["record_type"] == "revisit"
            if revisit:
                size = http.get("content-length")
                size = int(size) if size is not None and size.isdigit() else None
            elif "payload" in self.names or chunked or self.verify and values["payload_digest"]:
                parts = [block]
                while new := more():
                    parts.append(new)
                sent = b"".join(parts)
                payload = unchunked(sent) if chunked else sent
                size = len(payload)
                # some writers hash the body as it was sent
                if self.verify and len(values["payload_digest"] or "") == 32 and values["payload_digest"] not in (digest(payload), digest(sent)):
                    raise ValueError(f"payload of {values['record_id']} differs from its digest")
                values["payload"] = payload
            values["payload_bytes"] = size
        return tuple(values.get(name) for name in self.names)


class WarcSource(DataSource):
    """``spark.read.format("warc").schema(...).load(path)``: any columns of SCHEMA; only asked ones are decoded. Option verify: check payloads against SHA-1 digests.

    ``path`` is a folder that write_pages() made, any folder with ``.warc`` and ``.warc.gz`` files in it or below, or one such file.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options)


def base32(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_pages(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to a new folder ``path``.

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of at least ``least`` bytes, the one with the smallest page_id
    is a response and the others revisit it; shorter payloads are all responses. Rows that repeat the smallest page_id with the same payload are all
    responses. A null page_id sorts last; payloads that only such rows have are responses. A null url has no target header. An empty table
    writes a manifest without files.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    first = rows.groupBy(F.col("sha").alias("of")).agg(F.min("page_id").alias("first"))
    rows = rows.join(first, rows["sha"] == first["of"])
    again = (F.col("payload_bytes") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))

    def name(column: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("none")), F.lit(">"))

    rows = rows.select(
        name("page_id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"), F.lit(None).cast("string").alias("date"), F.col("sha").alias("payload_digest"),
        F.when(again, name("first")).alias("refers_to"), "payload_bytes", F.when(~again, F.col("payload")).alias("payload"))
    rows.write.format("warc").mode("append").save(path)


def read_records(spark, path: str, columns: str = SCHEMA, verify: bool = False) -> DataFrame:
    """The records of ``path``: ``columns`` is a part of SCHEMA. Filters on the header columns reach the reader."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").schema(columns).option("verify", str(verify).lower()).load(path)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages``, read the archives back and check every payload against its digest.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to (page_id of the response; null for responses).
    """
    spark = pages.sparkSession
    path = f"{work_dir(spark)}/warc"
    write_pages(pages, path, least)
    rows = read_records(spark, path, "record_id string, record_type string, payload_digest string, refers_to string, payload_bytes long", True)

    def page(column: str) -> Column:
        return F.nullif(F.regexp_extract(column, r"^<urn:page:(-?[0-9]+)>$", 1), F.lit("")).cast("long")

    return rows.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
