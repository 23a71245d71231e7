"""Batch loads: scorecard pages and ball-by-ball documents into warehouse tables."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import dedup, maintenance, nested, pages, registry, scorecards
from ..functions.text import row_key
from ..session import materialise
from ..sources import commits, sinks

TABLES = {
    "match_registry": schemas.REGISTRY, "tournaments": schemas.TOURNAMENTS, "teams": schemas.TEAMS,
    "players": schemas.PLAYERS, "matches": schemas.MATCHES, "innings": schemas.INNINGS, "batting": schemas.BATTING,
    "bowling": schemas.BOWLING, "fall_of_wickets": schemas.FALL_OF_WICKETS, "match_notes": schemas.MATCH_NOTES,
}


#: key by which a table's later rows replace earlier ones; the others only grow
KEYS = {"match_registry": "universal_match_id", "tournaments": "tournament_id", "teams": "team_id", "players": "player_id",
        "matches": "match_id"}


@dataclass
class Load:
    """Result of a load: rows to add to some tables, and rows of others that are new or changed."""

    load_id: str
    added: dict[str, DataFrame]
    changed: dict[str, DataFrame]

    def write(self, root: str) -> None:
        """Add the load to the warehouse at ``root``.

        Every table gets a folder for this load. They count from the moment its commit is there, which is the last step: a load that
        stopped on the way is invisible, and running it again replaces its folders. One that is committed already changes nothing.
        """
        spark = next(iter(self.added.values())).sparkSession
        if commits.is_known(spark, root, self.load_id):
            return
        for name, df in {**self.added, **self.changed}.items():
            sinks.replace_part(df, f"{root}/{name}", self.load_id)
        commits.commit(spark, root, self.load_id)


def create_warehouse(spark: SparkSession, root: str) -> None:
    """Empty tables at ``root``."""
    for name, schema in TABLES.items():
        sinks.replace_part(spark.createDataFrame([], schema), f"{root}/{name}", "none")
    commits.create(spark, root)


def read_warehouse(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables at ``root`` as the committed loads left them; of a key that several loads wrote, the last row counts.

    Where one load counts, as after merge_loads(), there is nothing to pick and no table is grouped.
    """
    loads, out = commits.current(spark, root), {}
    for name, schema in TABLES.items():
        rows = commits.stored(spark, root, name, schema, loads)
        if name in KEYS and len(loads) > 1:
            order = F.element_at(F.create_map(*[F.lit(x) for pair in loads.items() for x in pair]), F.col("load_id"))
            rows = dedup.pick_one(rows.withColumn("seq", order).drop("load_id"), [KEYS[name]], "seq", last=True).drop("seq")
        out[name] = rows.drop("load_id")
    return out


def merge_loads(spark: SparkSession, root: str) -> str | None:
    """Replace all loads by one that holds the same tables; returns its id, None if there is nothing to merge.

    Every table is read and written once, those with a key with one row a key. The merged load counts from its commit on, and those that it
    replaces don't any more; a merge that stopped changes nothing. ``commits.remove_replaced`` deletes the old folders.
    """
    loads = commits.current(spark, root)
    if len(loads) < 2:
        return None
    load_id = "merged-" + hashlib.md5(" ".join(sorted(loads)).encode()).hexdigest()
    for name, rows in read_warehouse(spark, root).items():
        sinks.replace_part(rows, f"{root}/{name}", load_id)
    commits.commit(spark, root, load_id, max(loads.values()), sorted(loads))
    return load_id


def empty_warehouse(spark: SparkSession) -> dict[str, DataFrame]:
    """The warehouse before its first load."""
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


def load_scorecards(raw: DataFrame, warehouse: dict[str, DataFrame], mode: str = "ordinal") -> Load:
    """M8: load scorecard pages (doc_id, content).

    A page whose match is registered already adds nothing but its link in the registry, and
    of several copies of a page only one is read. Pages are parsed once; everything else is
    derived from the written result. New pages are picked from it by
    their row, a unique key, and written once; of these each table reads its own columns. All rows of a page follow from the page alone, so
    behind that nothing but narrow metadata and entities is shuffled. Keys follow from the page too: loading the
    same pages again adds no row. Of the tables that change, only the rows that the batch touches
    are grouped and written, so a day's pages cost a day's work.
    """
    sign = F.xxhash64("doc_id", F.coalesce("title", F.lit("")), F.array_join("pieces", "")).cast("decimal(38,0)")
    tagged = pages.parse_pages(raw, only=[*scorecards.FACTS, "notes"]).withColumns({"_row": F.monotonically_increasing_id(), "_sign": sign})
    # metadata is all that titles and centred parts are for
    parsed = materialise(scorecards.with_meta(tagged).drop("title", "script_title", "centers"), "pages", row_group=16 << 20)
    count, total = parsed.agg(F.count("*"), F.sum("_sign")).first()
    load_id = hashlib.md5(f"{count} {total}".encode()).hexdigest()
    seen = parsed.select("_row", F.col("meta.team1_name").alias("team1"), F.col("meta.team2_name").alias("team2"),
                         "meta.date", "meta.format", F.lit("ca").alias("source"), F.col("doc_id").alias("source_id"))
    batch = dedup.pick_one(seen, ["source_id"], "_row")
    registered, told = registry.register(registry.touched(warehouse["match_registry"], batch), batch, "source_id")
    new = materialise(told.filter("is_new").select("_row"), "new_pages")
    # picked once: a batch with many new pages is too large a list to be sent to every task, and then pages are exchanged
    fresh = materialise(parsed.join(new, "_row", "left_semi").drop("_row", "_sign"), "fresh_pages", row_group=16 << 20)

    place = lambda *at: row_key("innings_id", *at).alias("id")
    inns, bat, fow = (f(fresh) for f in (scorecards.innings, scorecards.batting_rows, scorecards.fall_of_wickets))
    bowl = scorecards.bowling_by_innings(fresh, mode)
    notes = pages.match_notes(fresh).withColumnRenamed("doc_id", "match_id")
    added = {
        "innings": inns, "batting": bat.withColumn("id", place("row_no")),
        "bowling": bowl.withColumn("id", place("table_no", "row_no")),
        "fall_of_wickets": fow.withColumn("id", place("row_no", "part_no")),
        "match_notes": notes.withColumn("id", row_key("match_id", "note_no"))}

    found = materialise(scorecards.harvest_entities(fresh), "entities")
    people = found.filter(F.col("kind") == "player")
    people = dedup.pick_one(people, ["match_id", "id"], F.struct(F.col("dob").isNull().alias("_none"), F.col("seen")))
    people = people.withColumnRenamed("id", "player_id")
    meta = scorecards.match_meta(fresh)

    def known(table: str, key: str, rows: DataFrame) -> DataFrame:
        """The rows of a table that the batch can change."""
        return warehouse[table].join(rows.select(key).distinct(), key, "left_semi").select(warehouse[table].columns)

    changed = {
        "match_registry": registered,
        "players": maintenance.fill_null(
            maintenance.insert_ignore(known("players", "player_id", people), people, "player_id", "match_id"),
            people, "player_id", "dob", "match_id"),
        "matches": maintenance.upsert(known("matches", "match_id", meta), meta, "match_id", F.lit(0))}
    for kind, table in (("team", "teams"), ("tournament", "tournaments")):
        one = dedup.last_wins(found.filter(F.col("kind") == kind), ["match_id", "id"], "seen")
        one = one.withColumnRenamed("id", f"{kind}_id")
        changed[table] = maintenance.insert_ignore(known(table, f"{kind}_id", one), one, f"{kind}_id", "match_id")
    return Load(load_id, {n: df.select(warehouse[n].columns) for n, df in added.items()}, changed)


def load_ball_by_ball(documents: DataFrame, matches: DataFrame, deliveries: DataFrame) -> dict[str, DataFrame]:
    """Rows that ball-by-ball documents (match_id, info, innings) add to both tables.

    Unlike random keys, the delivery keys make a second load of the same document add nothing.
    """
    info = nested.explode_match_info(documents)
    balls = nested.explode_deliveries(documents)
    return {"matches": maintenance.new_rows(matches, info, "match_id", F.lit(0)),
            "deliveries": maintenance.new_rows(deliveries, balls, "delivery_id", F.lit(0))}
