"""Leaderboard pages: pick the statistics table, resolve its headers, read its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cricket
from ..functions import fixed_values as fixed
from ..functions.text import cell_double, cell_int, clean_text
from .pages import cells_of, explode_all, rows_of, text_of


def resolve(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Rename the columns of ``df`` to the names of ``aliases``, in any case, first alias first."""
    present = {c.lower().strip(): c for c in df.columns}
    renames: dict[str, str] = {}
    for name, headers in aliases.items():
        hit = next((present[h.lower()] for h in headers if h.lower() in present), None)
        if hit is not None and hit not in renames:
            renames[hit] = name
    return df.withColumnsRenamed(renames)


def _grid(table: Column, no: Column) -> Column:
    """Header and body of a table; only a first row made of heading cells is a header."""
    rows = F.filter(rows_of(table), lambda r: r.c1 > r.c0)
    first = F.try_element_at(rows, F.lit(1))
    headed = F.coalesce((first.c1 > first.c0) & F.forall(cells_of(first), lambda c: c.tag == "th"), F.lit(False))
    texts = lambda row: F.transform(cells_of(row), lambda c: clean_text(text_of(c)))
    header = F.when(headed, F.transform(texts(first), F.lower)).otherwise(F.array().cast("array<string>"))
    body = F.transform(F.when(headed, F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))))
                       .otherwise(rows), texts)
    return F.struct(no.alias("no"), header.alias("header"), body.alias("body"),
                    F.size(body).alias("n_rows"),
                    F.greatest(F.size(header), F.array_max(F.transform(body, F.size))).alias("n_cols"))


def best_stat_table(docs: DataFrame, kind: str = "batting") -> DataFrame:
    """The table with most marker headers, earliest on ties.

    Without any marked table it is the third one, and failing that the longest.
    """
    markers = F.array(*[F.lit(m) for m in fixed.TABLE_MARKERS.get(kind, fixed.TABLE_MARKERS["batting"])])
    filled = F.filter("tables", lambda t: clean_text(text_of(t)) != "")
    grids = docs.select("doc_id", F.transform(filled, lambda t, i: _grid(t, i)).alias("_g"))

    def top(keep, score) -> Column:
        found = F.filter("_g", keep)
        rank = F.array_max(F.transform(found, lambda g: F.struct(score(g).alias("score"), (-g.no).alias("neg"))))
        return F.try_element_at("_g", 1 - rank.neg)

    marked = lambda g: F.size(F.array_intersect(markers, g.header))
    wide = lambda g: (g.n_rows >= 1) & (g.n_cols >= 5)
    third = F.try_element_at("_g", F.lit(3))
    best = F.coalesce(top(lambda g: wide(g) & (marked(g) > 0), marked),
                      F.when(third.n_rows > 0, third),
                      top(lambda g: (g.n_rows > 1) & (g.n_cols >= 5), lambda g: g.n_rows))
    chosen = grids.select("doc_id", best.alias("g")).filter(F.col("g").isNotNull())
    return chosen.select("doc_id", F.col("g.no").alias("table_no"), "g.header", "g.body")


def _leaderboard(table: DataFrame, headers: dict[str, list[str]], numbers: dict[str, str],
                 texts: dict[str, str]) -> DataFrame:
    rows = explode_all(table, ["doc_id", "header"], F.col("body"), "row_no", "cells")

    def value(*names: str) -> Column:
        picks = [F.when(F.array_position("header", n.lower()) > 0,
                        F.try_element_at("cells", F.array_position("header", n.lower()).cast("int"))) for n in names]
        known = F.exists("header", lambda h: h.isin(*[n.lower() for n in names]))
        return F.when(known, F.coalesce(*picks, F.lit("")))

    label = F.coalesce(value("Player"), F.try_element_at("cells", F.lit(1)), F.lit(""))
    rows = rows.select("*", label.alias("_label"), value(*headers["country"]).alias("_country"))
    rows = rows.filter(~F.lower("_label").isin(fixed.SUMMARY_LABELS))
    read = {"int": cell_int, "double": cell_double}
    out = rows.select(
        "doc_id", "row_no", cricket.player_name("_label").alias("name"),
        cricket.team_code(cricket.player_team("_label", F.col("_country"))).alias("team"),
        F.coalesce(value(*headers["span"]), F.lit("")).alias("span"),
        *[F.coalesce(value(*headers[c]), F.lit(default)).alias(c) for c, default in texts.items()],
        *[read[kind](value(*headers[c])).alias(c) for c, kind in numbers.items()])
    return out.filter(F.length("name") >= 2)


def batting_leaderboard(docs: DataFrame) -> DataFrame:
    """Batting lines of the statistics table of each page."""
    numbers = {"matches": "int", "innings": "int", "not_outs": "int", "runs": "int", "batting_avg": "double",
               "balls_faced": "int", "batting_sr": "double", "hundreds": "int", "fifties": "int",
               "fours": "int", "sixes": "int"}
    return _leaderboard(best_stat_table(docs, "batting"), fixed.BATTING_HEADERS, numbers, {"highest": "0"})


def bowling_leaderboard(docs: DataFrame) -> DataFrame:
    """Bowling lines of the statistics table of each page."""
    numbers = {"matches": "int", "innings": "int", "overs": "double", "maidens": "int", "runs_conceded": "int",
               "wickets": "int", "bowling_avg": "double", "economy": "double", "bowling_sr": "double",
               "five_wickets": "int", "ten_wickets": "int"}
    return _leaderboard(best_stat_table(docs, "bowling"), fixed.BOWLING_HEADERS, numbers, {"bbi": "0/0"})
