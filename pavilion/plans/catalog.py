"""All queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (queries_archive, queries_careers, queries_files, queries_kept, queries_live, queries_pages, queries_profiles, queries_tables,
               queries_text)

Query = Callable[[SparkSession, str], DataFrame]

MODULES = [queries_careers, queries_archive, queries_tables, queries_pages, queries_text, queries_profiles,
           queries_live, queries_files, queries_kept]


def entries() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}
    for module in MODULES:
        for name, entry in module.ENTRIES.items():
            if name in out:
                raise ValueError(f"query registered twice: {name}")
            out[name] = entry
    return out
