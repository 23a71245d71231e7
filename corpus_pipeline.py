"""From raw documents to packed training windows: five stages, each one operator of ``pavilion.llm``.

Every stage works on all that its predecessor kept. A cluster that writes each stage and reads it again calls the functions
of STAGES itself; run() does the same in the session's shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pavilion.llm import language, minhash, mixing, packing, personal
from pavilion.llm.common import table
from pavilion.session import materialise

#: Hundredths of similarity from which the pipeline takes two documents for one.
NEAR = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the table's labelled rows teach; texts without letters or in none of these go."""
    return language.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates."""
    return minhash.keep_one(docs, NEAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return personal.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every pass over a document, in training order."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids, by training window, in the order in which the stage before has written ``docs``.

    The files of a range-sorted table are numbered in its order, so the number in a file's name and a row's place in it are the training
    order. ``docs`` has to be read from Parquet files that Spark has written.
    """
    at = docs.metadataColumn("_metadata")
    number = F.regexp_extract(at["file_name"], r"^part-(\d+)", 1).cast("long")
    return packing.pack(docs, ids=True, order=[number, at["file_name"], at["row_index"]])


STAGES: list[tuple[str, Stage]] = [("language", language_id), ("near_duplicates", near_dedup), ("personal_data", personal_data),
                                   ("mixing", mixing_sources), ("packing", pack)]

#: SQL has no word for learned languages or tokenizers; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
