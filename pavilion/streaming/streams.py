"""Streams: arriving pages, new commentary, latest scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import is_blank
from ..operators.dedup import last_wins
from ..operators.pages import parse_pages
from ..sources import layout

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"

#: Keeps the state of long-running jobs on local disk of the executors, with changelog
#: checkpoints in the shared folder, instead of in their heap.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def use_disk_state(spark: SparkSession) -> None:
    """Set the state store for the streams started from now on."""
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)


def stream_pages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Pages as they arrive in a folder, each file once, as (doc_id, content)."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", True) \
        .option("pathGlobFilter", "*.html")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    files = reader.load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.regexp_replace(name, r"\.html$", "").alias("doc_id"), "content")


def page_outcomes(pages: DataFrame) -> DataFrame:
    """Outcome per arrived page: is it a scorecard? Feeds ``apply_outcomes``."""
    docs = parse_pages(pages, only=("n_tables",))
    return docs.select(F.col("doc_id").alias("ca_match_id"), (F.col("n_tables") >= 2).alias("ok"))


def new_commentary(stream: DataFrame, ts: str | None = None, delay: str | None = None, salts: int = 8) -> DataFrame:
    """Each text of a match once, blank texts dropped.

    Exact by default, with state that grows with the distinct texts. With an event time
    column and a delay the state is bounded: a text may come again after the delay.

    Copies of one text all meet in one task. So they are first thinned out in up to
    ``salts`` tasks, by the input task they come from, and only the rest meets; that costs
    a second state entry per text. ``salts=1`` leaves the first step out.
    """
    key = ["match_id", "text"]
    spoken = stream.filter(~is_blank("text"))
    if ts is not None:
        spoken = spoken.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay or "1 hour")

    def once(df: DataFrame, columns: list[str]) -> DataFrame:
        return df.dropDuplicates(columns) if ts is None else df.dropDuplicatesWithinWatermark(columns)

    if salts > 1:
        spoken = once(spoken.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts))), [*key, "_salt"]).drop("_salt")
    return once(spoken, key)


#: The state of a share of a match's texts: whether the match is over, and 16 bytes for each text it has shown.
SEEN = "ended boolean, hashes binary"


def _once_until_post(remembered: int | None):
    def show(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        frames = list(frames)
        ended, stored = state.get if state.exists else (False, b"")
        if ended or not frames:
            return
        batch = pd.concat(frames).sort_values(["place", "hash"], kind="stable")
        over = batch.loc[batch["over"], "place"]
        if len(over):  # texts up to the end are shown, and those of the same place
            batch = batch[batch["place"] <= over.min()]
        stored = bytes(stored)
        known = {stored[i:i + 16] for i in range(0, len(stored), 16)}
        texts = batch[batch["text"].str.strip() != ""].drop_duplicates("hash")
        fresh = texts.loc[[bytes(h) not in known for h in texts["hash"]]]
        if len(over):
            state.update((True, b""))
            if remembered is not None:
                state.setTimeoutDuration(remembered)
        else:
            state.update((False, stored + b"".join(map(bytes, fresh["hash"]))))
        if len(fresh):
            yield fresh[["match_id", "text", "place"]]

    return show


def match_commentary(stream: DataFrame, place: str = "place", parts: int = 4, remembered: int | None = None) -> DataFrame:
    """Each text of a match once while the match lasts; rows (match_id, text, place).

    ``stream`` has match_id, text and status; ``place`` is a number that rises within a match. Once a row of status ``post`` comes, what
    lies behind it is not shown and the match's texts leave the state. One flag a part says that it is over, so what comes late is not shown either;
    after ``remembered`` milliseconds, if given, the flag goes as well and nothing is left of the match. (Spark then runs batches also without new rows; with
    a trigger that is to end, set spark.sql.streaming.noDataMicroBatches.enabled to false.) NULL and blank texts are left out.

    The texts of a match are dealt to ``parts`` tasks by a hash, and its end is told to each, so a match that everybody talks about is
    neither one task nor one state entry.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stream.select("match_id", text.alias("text"), (F.coalesce("status", F.lit("")) == "post").alias("over"), F.col(place).cast("bigint").alias("place"),
                         F.unhex(F.md5(text)).alias("hash"), F.pmod(F.xxhash64(text), F.lit(parts)).cast("int").alias("own"))
    every = F.when(F.col("over"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array("own"))
    rows = rows.withColumn("part", F.explode(every))
    rows = rows.withColumn("text", F.when(F.col("part") == F.col("own"), F.col("text")).otherwise(F.lit("")))
    kind = stream.schema["match_id"].dataType.simpleString()
    return rows.groupBy("match_id", "part").applyInPandasWithState(
        _once_until_post(remembered), f"match_id {kind}, text string, place bigint", SEEN, "append",
        GroupStateTimeout.NoTimeout if remembered is None else GroupStateTimeout.ProcessingTimeTimeout)


def latest_scores(stream: DataFrame, value: list[str], order: Column | str = "ts", key: str = "match_id") -> DataFrame:
    """T4: last known state of each match; run it in update mode."""
    row = F.max_by(F.struct(*value), order).alias("r")
    return stream.groupBy(key).agg(row).select(key, "r.*")


QUEUE = "ca_match_id string, status string, batch bigint"


def create_queue(queue: DataFrame, path: str, parts: int = layout.PARTS) -> None:
    """A status table (ca_match_id, status) that keep_queue() takes outcomes to, by hash of the id."""
    layout.write_parts(queue.select("ca_match_id", "status", F.lit(None).cast("bigint").alias("batch")), path, "ca_match_id", parts)


def keep_queue(outcomes: DataFrame, path: str, checkpoint: str, parts: int = layout.PARTS, **trigger) -> StreamingQuery:
    """Merge a stream of outcomes (ca_match_id, ok) into the status table at ``path``, batch by batch.

    A row says which batch decided it, and a batch changes no row that a later one has decided, so a batch that is run again, whole or from where it
    stopped, changes nothing. Only the parts that have an outcome are read and written. Of several outcomes in a batch success counts;
    outcomes of ids that are not queued are left out.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        merge_outcomes(batch, path, batch_id, parts)

    return (outcomes.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**(trigger or {"processingTime": "30 seconds"})).start())


def merge_outcomes(batch: DataFrame, path: str, batch_id: int, parts: int = layout.PARTS) -> list[int]:
    """One batch of keep_queue(); returns the parts it changed."""
    def change(stored: DataFrame, rows: DataFrame) -> DataFrame:
        told = rows.groupBy("ca_match_id").agg(F.max("ok").alias("_ok"))
        mine = F.col("_ok").isNotNull() & (F.coalesce("batch", F.lit(-1)) <= batch_id)
        state = F.when(mine & F.col("_ok"), "COMPLETED").when(mine, "FAILED").otherwise(F.col("status"))
        now = F.when(mine, F.lit(batch_id).cast("bigint")).otherwise(F.col("batch"))
        return stored.join(told, "ca_match_id", "left").withColumns({"status": state, "batch": now}).drop("_ok")

    return layout.merge_parts(path, QUEUE, batch.select("ca_match_id", "ok"), "ca_match_id", change, parts)


def migrate(spark: SparkSession, path: str, schema: str, change: Callable[[DataFrame], DataFrame], into: str, checkpoint: str,
            files_per_batch: int = 1000) -> None:
    """Take what is new in a folder of Parquet files through ``change`` to the folder ``into``, some files a batch, until all are done.

    Which files are done is committed in ``checkpoint`` after each batch. A run that stops goes on with the batch it was at, whose folder is
    replaced; a run that finds nothing new does nothing. Rows are mostly keys, hexadecimal digests, which zstd nearly halves.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        change(batch).write.option("compression", "zstd").mode("overwrite").parquet(f"{into}/batch_id={batch_id}")

    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).parquet(path)
    files.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def start_append(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a stream to a Parquet folder, once per row."""
    return (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**(trigger or {"processingTime": "30 seconds"})).start())


def start_changelog(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write an updating stream as a log of changes, one folder per batch.

    A batch that is run again replaces its own folder, so a restart leaves no duplicates.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
            .outputMode("update").trigger(**(trigger or {"processingTime": "30 seconds"})).start())


def read_changelog(spark: SparkSession, path: str, key: str = "match_id") -> DataFrame:
    """Latest state per key of a log of changes."""
    return last_wins(spark.read.parquet(path), [key], F.col("batch_id")).drop("batch_id")


def compact_changelog(spark: SparkSession, path: str, into: str, key: str = "match_id") -> None:
    """Write the rows of a log of changes that still count to the new folder ``into``, which reads like the log.

    To be run between two runs of the stream; the next run then goes on in ``into``.
    """
    latest = last_wins(spark.read.parquet(path), [key], F.col("batch_id"))
    latest.repartition("batch_id").write.partitionBy("batch_id").parquet(into)


def newest_last(batch: DataFrame, position: str) -> DataFrame:
    """A poll lists the newest ball first; show it last."""
    return batch.orderBy(F.desc(position))


def shown_order(polls: DataFrame, position: str, key: str = "match_id") -> DataFrame:
    """T6 for many polls at once: ``shown``, the place from 1 at which a ball is shown within its own poll."""
    return polls.withColumn("shown", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(position))))


def run_until_post(stream: DataFrame, show: Callable[[DataFrame], None], checkpoint: str,
                   interval: str = "30 seconds", timeout: float | None = None) -> bool:
    """T5: hand each poll to ``show`` and stop once a row has status ``post``.

    Returns whether the end state was seen. A poll is read once; one that arrives while the query is
    being stopped is not shown any more.
    """
    ended = []

    def poll(batch: DataFrame, batch_id: int) -> None:
        if ended:
            return
        batch = batch.persist()
        try:
            show(batch)
            if not batch.filter(F.col("status") == "post").isEmpty():
                ended.append(batch_id)
        finally:
            batch.unpersist()

    query = stream.writeStream.foreachBatch(poll).option("checkpointLocation", checkpoint) \
        .trigger(processingTime=interval).start()
    waited = 0.0
    while query.isActive and not ended and (timeout is None or waited < timeout):
        query.awaitTermination(0.5)
        waited += 0.5
    query.stop()
    return bool(ended)
