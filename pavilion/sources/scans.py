"""Scans: pages, ball-by-ball JSON, JSONL logs, team documents, warehouse tables."""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import fixed_values as fixed
from ..functions.text import blank_default, is_blank, prefix_id, row_key, strip


def _stem(suffix: str):
    return F.regexp_replace(F.col("_metadata.file_name"), rf"{suffix}$", "")


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """``.html`` files of a flat or sharded folder as (doc_id, content).

    The bytes are kept; undecodable ones are dropped when the page is parsed.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.html").load(path))
    return files.select(_stem(r"\.html").alias("doc_id"), "content")


#: What opening a file counts for, in bytes, where files are small and many: about a thousand of them go to a task, 32 by Spark's default.
SMALL_FILE = 128 * 1024


def _for_small_files(spark: SparkSession) -> SparkSession:
    """A session over the same catalog that deals many small files, and many folders to list, to a task.

    By default a folder is listed by a task of its own, up to 10,000 of them, and a task reads 32 files; starting the tasks takes most of the time.
    """
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.checkpoint.dir"):
        if (value := spark.conf.get(key, None)) and session.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.files.openCostInBytes", str(SMALL_FILE))
    session.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * spark.sparkContext.defaultParallelism))
    return session


def _fixed_part(path: str) -> tuple[str, str]:
    """A path up to its first part with wildcards, and the rest."""
    uri = path.rstrip("/") if "://" in path else f"file://{path.rstrip('/')}"
    parts = uri.split("/")
    first = next((i for i, part in enumerate(parts) if any(sign in part for sign in "*?[")), len(parts))
    return "/".join(parts[:first]), "/".join(parts[first:])


def _named_by(path: str) -> list[tuple[str, bool]]:
    """(entry, is a folder) that a path with wildcards names; nothing below them is looked at."""
    fixed_part, rest = _fixed_part(path)
    store, base = fs.FileSystem.from_uri(fixed_part)
    found = [(base.rstrip("/") or "/", store.get_file_info(base).type == fs.FileType.Directory)]
    for part in filter(None, rest.split("/")):
        below = [f for folder, is_folder in found if is_folder for f in _entries(store, folder)]
        found = [(f.path, f.type == fs.FileType.Directory) for f in below if fnmatch.fnmatchcase(f.base_name, part)]
    if not found or store.get_file_info(found[0][0]).type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return found


def _entries(store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    """Entries of a folder but hidden ones, which Spark's own readers leave out too."""
    return [f for f in store.get_file_info(fs.FileSelector(folder)) if f.base_name[:1] not in ("_", ".")]


#: Bytes of files that a task hands over together.
FILES_TOGETHER = 4 * 1024 * 1024


def read_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Small text files as (name, content), NULL where the bytes are no text.

    Tasks list the folders that ``path`` names, are dealt the files and read them, so the driver holds no more than the names of
    these folders; a file source would keep the status of every file there. A folder is listed by one task.
    """
    root = _fixed_part(path)[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for entry, is_folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if is_folder:
                    below = store.get_file_info(fs.FileSelector(entry, recursive=True))
                    files = [f.path for f in below if f.type == fs.FileType.File and f.path.endswith(suffix)
                             and not any(part[:1] in ("_", ".") for part in f.path[len(entry):].split("/") if part)]
                else:
                    files = [entry] if entry.endswith(suffix) else []
                for start in range(0, len(files), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(files[start:start + 10_000], pa.string())], names=["path"])

    def text(content: bytes) -> str | None:
        try:
            return content.decode(json.detect_encoding(content)).removeprefix("\ufeff")
        except UnicodeDecodeError:
            return None

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        names, texts, size = [], [], 0

        def together() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["name", "content"])

        for batch in batches:
            for file in batch.column(0).to_pylist():
                with store.open_input_file(file) as source:
                    content = source.read()
                names.append(file.rpartition("/")[2])
                texts.append(text(content))
                size += len(content)
                if size >= FILES_TOGETHER or len(names) >= 10_000:
                    yield together()
                    names, texts, size = [], [], 0
        if names:
            yield together()

    entries = spark.createDataFrame(_named_by(path), "path string, is_folder boolean").repartition(parts)
    files = entries.mapInArrow(listed, "path string").repartition(parts, "path")
    return files.mapInArrow(taken, "name string, content string")


def scan_match_json(spark: SparkSession, path: str) -> DataFrame:
    """One ball-by-ball match per JSON file as (match_id, info, innings); a file of a list has a row per item.

    A file that is no JSON has a row with nothing but its id, an empty one has none, as the reader of JSON files has it.
    """
    files = read_files(_for_small_files(spark), path, ".json")
    kind = f"struct<{schemas.MATCH_JSON}>"
    records = F.coalesce(F.from_json("content", f"array<{kind}>"), F.array(F.lit(None).cast(kind)))
    rows = files.filter(F.col("content").isNull() | F.col("content").rlike(r"\S")).select("name", F.explode(records).alias("m"))
    return rows.select(prefix_id(fixed.BALL_BY_BALL_PREFIX, F.split_part("name", F.lit("."), F.lit(1))).alias("match_id"), "m.info", "m.innings")


def parse_jsonl(lines: DataFrame, schema: str = schemas.HISTORY, line: str = "value") -> DataFrame:
    """S3: keep the lines that hold a JSON object, with the parsed record as ``record``."""
    shape = f"{schema}, _bad string"
    parsed = F.from_json(strip(line), shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    kept = lines.filter(~is_blank(strip(line))).withColumn("record", parsed)
    kept = kept.filter(F.col("record._bad").isNull() & strip(line).startswith("{"))
    return kept.withColumn("record", F.col("record").dropFields("_bad"))


def scan_jsonl(spark: SparkSession, path: str, schema: str = schemas.HISTORY) -> DataFrame:
    """S3: records of an append-only log with their position as sortable ``line_no``.

    File, block offset and row id within the block order the lines of a file as they
    stand, without numbering them in a second job.
    """
    lines = spark.read.text(path).select(
        "value", F.struct(F.col("_metadata.file_path").alias("file"),
                          F.col("_metadata.file_block_start").alias("block"),
                          F.monotonically_increasing_id().alias("row")).alias("line_no"))
    return parse_jsonl(lines, schema).select("line_no", "record.*")


def parse_teams(docs: DataFrame, col: str = "value") -> DataFrame:
    """One row per team and player of a team document; teams without players are skipped.

    Players may be an array or a map keyed by name. A player without a name takes its map key.
    """
    head = [F.coalesce(F.col("t.team_id"), F.col("team_key")).alias("team_id"),
            F.coalesce(F.col("t.name"), F.col("team_key")).alias("team_name"),
            F.col("t.country").alias("country"), F.col("t.format_rankings").alias("format_rankings"),
            F.col("t.home_advantage").alias("home_advantage")]

    def read(shape: str, players):
        teams = docs.select(F.explode(F.from_json(F.col(col), shape)).alias("team_key", "t"))
        return teams.filter(F.col("t.players").isNotNull()).select(*head, players)

    as_list = read(schemas.TEAM_LIST_DOC, F.explode_outer("t.players").alias("player"))
    as_list = as_list.select("*", F.col("player.name").alias("player_name"))
    as_map = read(schemas.TEAM_MAP_DOC, F.explode_outer("t.players").alias("player_key", "player"))
    as_map = as_map.select(*[c for c in as_map.columns if c != "player_key"],
                           blank_default(F.col("player.name"), F.col("player_key")).alias("player_name"))
    return as_list.unionByName(as_map)


def scan_teams(spark: SparkSession, path: str) -> DataFrame:
    """Team documents, one JSON object per file."""
    return parse_teams(spark.read.text(path, wholetext=True))


def table(spark: SparkSession, name: str, root: str | None = None) -> DataFrame:
    """Warehouse table, from a folder of Parquet tables or from the catalog."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}") if root else spark.table(name)


def unify_deliveries(ball_by_ball: DataFrame, prefix: str = fixed.ARCHIVE_PREFIX) -> DataFrame:
    """Older ball-by-ball rows in the shape of ``deliveries``, keyed by their own id."""
    total = F.coalesce("runs_batter", F.lit(0)) + F.coalesce("runs_extras", F.lit(0))
    return ball_by_ball.select(
        row_key(F.lit(prefix), "id").alias("delivery_id"), prefix_id(prefix, "match_id").alias("match_id"),
        "innings", "over", "ball", "batter", "bowler", "non_striker", "runs_batter", "runs_extras",
        total.alias("runs_total"), "is_wicket", "dismissal_kind", "player_dismissed")
