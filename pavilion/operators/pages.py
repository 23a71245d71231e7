"""Pages: markup to tables, titles, links, notes.

One pass over the markup is the only Python work on pages. It records structure and
text, nothing else; what the tables mean is worked out downstream in column expressions.
Each page gives one row, so every step from a page to its facts is free of shuffles.

A page row holds each element once, with ranges for what is below it. The functions here turn
the ranges of the elements that are wanted into texts, links, rows and cells.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schemas
from ..functions import fixed_values as fixed
from ..functions.text import clean_text, strip
from . import markup

cloudpickle.register_pickle_by_value(markup)


#: columns of a page row that ranges point into
LISTS = ["pieces", "links", "centers", "cells", "rows"]


def parse_pages(pages: DataFrame, doc_id: str = "doc_id", content: str = "content", only: Sequence[str] = ()) -> DataFrame:
    """One row per page with its title, note lines, number of tables, text pieces, links, tables, rows and cells.

    ``content`` is text or bytes; bytes that are not UTF-8 are dropped. A table has every
    row below it, those of nested tables included, and a row every cell below it.
    ``only`` names the columns that are wanted besides doc_id, all unless given; what nobody wants is not worked out, and titles,
    notes and the number of tables take no look at the elements.
    """
    schema = T.StructType([f for f in schemas.PAGE if not only or f.name == "doc_id" or f.name in only])
    reader = markup.batch_reader(to_arrow_schema(schema))
    return pages.select(F.col(doc_id).cast("string").alias("doc_id"), content).mapInArrow(reader, schema)


def each(start: Column, end: Column, item: Callable[[Column], Column]) -> Column:
    """``item`` of every place in a range. Takes time in proportion to the range; ``slice`` would copy the whole list first."""
    places = F.when(end > start, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, item)


def _range(name: str, start: Column, end: Column) -> Column:
    return each(start, end, lambda i: F.get(name, i))


def text_of(element: Column, pieces: str = "pieces") -> Column:
    """All text below an element, most often one piece."""
    return F.when(element.p1 == element.p0 + 1, F.get(pieces, element.p0)).otherwise(
        F.array_join(_range(pieces, element.p0, element.p1), ""))


def told(element: Column, pieces: str = "pieces") -> Column:
    """All text below an element that keeps it, which is only put together where the element holds another of its kind."""
    return F.coalesce(element.text, text_of(element, pieces))


def links_of(element: Column) -> Column:
    """All links below an element, with their texts."""
    return F.transform(_range("links", element.l0, element.l1), lambda a: F.struct(a.text.alias("text"), a.href.alias("href")))


def link_of(element: Column, n: Column | int = 0, links: str = "links") -> Column:
    """The n-th link below an element, counted from 0, NULL if there are not so many."""
    return F.when(element.l1 - element.l0 > n, F.get(links, element.l0 + n))


def rows_of(table: Column, skip: int = 0) -> Column:
    return _range("rows", table.r0 + skip, table.r1)


def cells_of(row: Column) -> Column:
    return _range("cells", row.c0, row.c1)


def center_of(element: Column) -> Column:
    """The first centred part of a cell, NULL if there is none."""
    return F.when(element.m1 > element.m0, F.get("centers", element.m0))


def unfused(value: Column) -> Column:
    """``value`` as it is, in a step that Spark doesn't fuse with others, which it never does with lambdas.

    A fused step is one generated method, and the JVM never compiles one of more than 8,000 bytes. The code of other steps is split.
    """
    return F.get(F.transform(F.array(value), lambda v: v), F.lit(0))


def explode_all(df: DataFrame, keep: list, items: Column, position: str, name: str) -> DataFrame:
    """A row per item of a computed array.

    The outer form keeps Spark from working the array out a second time for a filter on its size.
    """
    return df.select(*keep, F.posexplode_outer(items).alias(position, name)).filter(F.col(position).isNotNull())


def html_cells(docs: DataFrame) -> DataFrame:
    """Flat cell table, positions counted from 0."""
    found = docs.select("doc_id", *LISTS, F.posexplode("tables").alias("table_no", "t"))
    found = explode_all(found, ["doc_id", "pieces", "links", "cells", "table_no"], rows_of(F.col("t")), "row_no", "r")
    found = explode_all(found, ["doc_id", "pieces", "links", "table_no", "row_no"], cells_of(F.col("r")), "cell_no", "c")
    return found.select("doc_id", "table_no", "row_no", "cell_no", text_of(F.col("c")).alias("text"),
                        links_of(F.col("c")).alias("anchors"), "c.tooltip")


def html_links(docs: DataFrame) -> DataFrame:
    """Every link of a page in document order."""
    links = docs.select("doc_id", F.posexplode("links").alias("link_no", "a"))
    return links.select("doc_id", "link_no", "a.href", clean_text("a.text").alias("text"))


def page_title() -> Column:
    """Title of a parsed page; the generic one gives way to the title set by script."""
    title = clean_text("title")
    return F.when(title == fixed.GENERIC_PAGE_TITLE, F.coalesce("script_title", title)).otherwise(title)


def valid_pages(docs: DataFrame, min_tables: int = 2) -> DataFrame:
    """F8: pages with enough tables to be a scorecard."""
    return docs.filter(F.col("n_tables") >= min_tables)


def match_notes(docs: DataFrame) -> DataFrame:
    """Marked note lines in page order, without the mark."""
    notes = docs.select("doc_id", F.posexplode("notes").alias("note_no", "line"))
    line = clean_text("line")
    return notes.filter(F.startswith(line, F.lit(fixed.NOTE_MARK))).select(
        "doc_id", "note_no", strip(F.replace(line, F.lit(fixed.NOTE_MARK), F.lit(""))).alias("note_text"))
