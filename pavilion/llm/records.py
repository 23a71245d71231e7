"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A file of records is a header and one frame a sequence: the payload's length, a masked checksum of that length, the payload, a masked
checksum of the payload (masked, so that a checksum of stored checksums stays meaningful). The payload is the sequence's name and its ids
at the width that the header states. Beside each file lies an index of fixed-width entries: where a frame starts, how long it is, how many ids come
before it in the file. A manifest, written last, lists the files in the order of the sequences with what each of them holds,
so the ids before any sequence are known without reading one. What a lost task leaves behind is in no manifest.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import work_dir
from .common import partitions, slices, small_batches
from .packing import Encoder

MAGIC = b"IDREC001"
MANIFEST = "records.json"
END_OF_TEXT = 2
#: A file is closed beyond so many bytes; a read partition takes files up to so many.
FILE_BYTES, SPLIT_BYTES = 128 << 20, 64 << 20
MASK = 0xA282EAD8
#: Entry of an index: frame's offset, payload's length, ids before it in its file, its number of ids.
ENTRY = "<QQQQ"
#: Name of a sequence in its payload: whether it has one, and the number.
NAME = "<?q"
#: Bytes read at once, and records that a shuffled read returns together.
CHUNK, TOGETHER = 1 << 20, 64


def masked(data: bytes) -> int:
    """CRC-32 of ``data``, rotated right by 15 bits and moved by a constant."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def unframe(data: bytes, at: int, name: str) -> bytes:
    """The payload of the whole frame ``data``, which starts at byte ``at`` of file ``name``."""
    if len(data) < 16 or struct.unpack("<I", data[8:12])[0] != masked(data[:8]):
        raise ValueError(f"{name}: no record length at byte {at}")
    size, = struct.unpack("<Q", data[:8])
    payload = data[12:12 + size]
    if len(data) != size + 16 or struct.unpack("<I", data[-4:])[0] != masked(payload):
        raise ValueError(f"{name}: damaged record at byte {at}")
    return payload


def parse(payload: bytes, width: int) -> tuple[int | None, np.ndarray]:
    there, name = struct.unpack(NAME, payload[:struct.calcsize(NAME)])
    return name if there else None, np.frombuffer(payload, dtype=f"<u{width}", offset=struct.calcsize(NAME)).astype("<u4")


@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: list[tuple[str, int, int, int]]  # name, bytes, sequences, ids


class Writer(DataSourceArrowWriter):
    """Takes rows (doc_id: long, ids: binary of little-endian 32-bit ids) in the order in which they are to be numbered."""

    def __init__(self, options: dict) -> None:
        self.path, self.width = options["path"].rstrip("/"), int(options.get("width", "4"))
        self.file_bytes = int(options.get("file_bytes", str(FILE_BYTES)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(self.path)
        store.create_dir(base, recursive=True)
        files, out, index, name, size, tokens = [], None, [], "", 0, 0

        def close() -> None:
            out.close()
            with store.open_output_stream(f"{base}/{name}.index", compression=None) as entries:
                entries.write(b"".join(index))
            files.append((name, size, len(index), tokens))

        for batch in iterator:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                if out is None:  # the name is new in every attempt of a task
                    name, index, tokens = f"{uuid.uuid4().hex}.records", [], 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    head = MAGIC + struct.pack("<I", self.width)
                    out.write(head)
                    size = len(head)
                found = np.frombuffer(ids.as_buffer() or b"", dtype="<u4")
                if self.width < 4 and len(found) and int(found.max()) >= 1 << 8 * self.width:
                    raise ValueError(f"an id of document {doc_id} needs more than {self.width} bytes")
                data = frame(struct.pack(NAME, doc_id is not None, doc_id or 0) + found.astype(f"<u{self.width}").tobytes())
                out.write(data)
                index.append(struct.pack(ENTRY, size, len(data) - 16, tokens, len(found)))
                size, tokens = size + len(data), tokens + len(found)
                if size >= self.file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        return Written(TaskContext.get().partitionId(), files)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        store.create_dir(base, recursive=True)
        files = [f for m in sorted((m for m in messages if m), key=lambda m: m.partition) for f in m.files]
        with store.open_output_stream(f"{base}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps({"width": self.width, "files": files}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Without a manifest nothing of the attempt is ever read."""


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int, int]]  # name, its number, ids before it


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.path, self.names = options["path"].rstrip("/"), schema.names

    def partitions(self) -> Sequence[Files]:
        out, size, before = [], 0, 0
        for number, (name, length, _, tokens) in enumerate(manifest(self.path)["files"]):
            if not out or size + length > SPLIT_BYTES:
                out, size = [*out, Files([])], 0
            out[-1].files.append((name, number, before))
            size, before = size + length, before + tokens
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, base = fs.FileSystem.from_uri(self.path)
        for name, number, before in partition.files:
            with store.open_input_stream(f"{base}/{name}", compression=None, buffer_size=CHUNK) as source:
                width = header(source.read(12), name)
                at, start, position = 12, before, 0
                while head := source.read(8):
                    size, = struct.unpack("<Q", head) if len(head) == 8 else (0,)
                    check = source.read(4)
                    if len(head) < 8 or check != struct.pack("<I", masked(head)):  # before so much is asked for
                        raise ValueError(f"{name}: no record length at byte {at}")
                    doc_id, ids = parse(unframe(head + check + source.read(size + 4), at, name), width)
                    values = {"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids": ids.tobytes(), "file": number, "position": position}
                    yield tuple(values[n] for n in self.names)
                    at, start, position = at + size + 16, start + len(ids), position + 1


def header(data: bytes, name: str) -> int:
    if data[:8] != MAGIC or len(data) < 12:
        raise ValueError(f"{name} is no file of records")
    return struct.unpack("<I", data[8:])[0]


def manifest(path: str) -> dict:
    store, base = fs.FileSystem.from_uri(path.rstrip("/"))
    with store.open_input_stream(f"{base}/{MANIFEST}", compression=None) as source:
        return json.loads(source.read())


SCHEMA = "doc_id long, start long, n_tokens long, ids binary, file long, position long"


class RecordSource(DataSource):
    """``spark.read.format("id_records").load(path)``: any columns of SCHEMA, checked against their checksums as they are read."""

    @classmethod
    def name(cls) -> str:
        return "id_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options)


def encode(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = END_OF_TEXT) -> DataFrame:
    """(doc_id, ids) of all documents in ascending order of doc_id, nulls first; ids as little-endian 32-bit integers, the end id last.

    Rows that share a doc_id lie by a hash of the text, equal rows as they come; all of them are dealt to many ranges. Null texts are empty.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for part in (part for b in batches for part in slices(b, "text", 1 << 20)):
            tokens = tokens or Encoder(tokenizer_path)
            ids = [np.append(found, np.uint32(end_id)).astype("<u4").tobytes() for found in tokens(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return rows.mapInArrow(run, "doc_id long, ids binary")


def write_records(sequences: DataFrame, path: str, width: int = 4, file_bytes: int = FILE_BYTES) -> None:
    """Write (doc_id, ids) to a new folder ``path``, in the order of the partitions of ``sequences`` and of the rows in each.

    ``width``: bytes of a stored id, 1, 2 or 4; an id that needs more is an error. An empty table writes a manifest without files.
    """
    spark = sequences.sparkSession
    spark.dataSource.register(RecordSource)
    sequences.select("doc_id", "ids").write.format("id_records").option("width", str(width)).option("file_bytes", str(file_bytes)).mode("append").save(path)


def read_records(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """The records of ``path`` in their order. ``start`` counts the ids of all records before; ``file`` and ``position`` say where a record lies."""
    spark.dataSource.register(RecordSource)
    return spark.read.format("id_records").schema(columns).load(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """What the index files say, without reading a record: (file, name, position, offset, size, start, n_tokens), a row a record."""
    files, before = [], 0
    for number, (name, _, _, tokens) in enumerate(manifest(path)["files"]):
        files.append((number, name, before))
        before += tokens
    listed = spark.createDataFrame(files, "file long, name string, before long").repartition(partitions(spark), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path.rstrip("/"))
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(f"{base}/{row['name']}.index", compression=None) as source:
                    done = 0
                    while data := source.read(CHUNK // 32 * 32):
                        found = np.frombuffer(data, dtype="<i8").reshape(-1, 4)
                        n = len(found)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, row["file"])), pa.array([row["name"]] * n, pa.string()), pa.array(np.arange(done, done + n)), pa.array(found[:, 0].copy()),
                             pa.array(found[:, 1].copy()), pa.array(found[:, 2] + row["before"]), pa.array(found[:, 3].copy())],
                            names=["file", "name", "position", "offset", "size", "start", "n_tokens"])
                        done += n

    return listed.mapInArrow(run, "file long, name string, position long, offset long, size long, start long, n_tokens long")


def read_shuffled(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all records in an order that ``seed`` decides, the same at every run.

    Only index entries are exchanged; a record is sought out in its file by the task that returns it.
    """
    places = read_index(spark, path).withColumn("draw", F.xxhash64(F.lit(seed), "file", "position"))
    places = places.repartitionByRange(partitions(spark), "draw", "file", "position").sortWithinPartitions("draw", "file", "position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path.rstrip("/"))
        for batch in batches:
            rows = batch.to_pylist()
            for some in (rows[i:i + TOGETHER] for i in range(0, len(rows), TOGETHER)):
                found: list = [None] * len(some)
                by_file: dict[str, list[int]] = {}
                for k, row in enumerate(some):
                    by_file.setdefault(row["name"], []).append(k)
                for name, wanted in by_file.items():  # one visit a file; rows go out in the order drawn
                    with store.open_input_file(f"{base}/{name}") as source:
                        width = header(source.read(12), name)
                        for k in sorted(wanted, key=lambda k: some[k]["offset"]):
                            source.seek(some[k]["offset"])
                            found[k] = parse(unframe(source.read(some[k]["size"] + 16), some[k]["offset"], name), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id for doc_id, _ in found], pa.int64()), pa.array([r["start"] for r in some], pa.int64()),
                     pa.array([r["n_tokens"] for r in some], pa.int64()), pa.array([ids.tobytes() for _, ids in found], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])

    return places.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str | None = None, width: int = 2, end_id: int = END_OF_TEXT) -> DataFrame:
    """Write the ids of ``docs`` and read them back: doc_id, start, n_tokens, ids_crc32.

    Documents lie in ascending order of doc_id, nulls first; rows that share one follow each other. Null and empty texts are the end
    id alone. An empty table has no rows. Nothing is known of a document that its file doesn't say.
    """
    spark = docs.sparkSession
    path = f"{work_dir(spark)}/records"
    write_records(encode(docs, tokenizer_path, end_id), path, width)
    rows = read_records(spark, path, "doc_id long, start long, n_tokens long, ids binary")
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
