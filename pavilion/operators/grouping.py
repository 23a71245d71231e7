"""Grouping helpers that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of a key are dealt to, whatever their number.
PARTS = 16


def part_of(row_id: str | Column, parts: int = PARTS) -> Column:
    """Part of a row, from a hash of its id alone."""
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    head = F.substring(F.md5(F.coalesce(row_id.cast("string"), F.lit(""))), 1, 7)
    return (F.conv(head, 16, 10).cast("bigint") % parts).cast("int")


def collect_parts(df: DataFrame, keys: list[str], item: Column, row_id: str | Column, name: str, parts: int = PARTS) -> DataFrame:
    """Sorted arrays of ``item`` per key and numbered part.

    Rows are always dealt to ``parts`` parts of their key by a hash of ``row_id``; a part without rows is not there.
    The shape does not depend on how many rows a key has: with a thousand times the rows, take more parts.
    """
    dealt = df.select(*keys, part_of(row_id, parts).alias("part"), item.alias("_item"))
    return dealt.groupBy(*keys, "part").agg(F.array_sort(F.collect_list("_item")).alias(name))
