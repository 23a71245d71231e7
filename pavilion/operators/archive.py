"""Archive queries: match lists, search, seasons, status, scorecards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cricket
from ..functions.text import as_col, blank_default

CATEGORIES = {"international": "International", "domestic": "Domestic"}

BAT_FIELDS = ["player_name", "dismissal", "runs", "balls", "mins", "fours", "sixes"]
BOWL_FIELDS = ["player_name", "overs", "maidens", "runs", "wickets", "wides", "no_balls"]
ROW_FIELDS = ["player_name", "dismissal", "runs", "balls", "mins", "fours", "sixes", "overs", "maidens", "wickets",
              "wides", "no_balls"]


# ---------------------------------------------------------------- lists and search


def by_category(matches: DataFrame, category: str = "recent") -> DataFrame:
    """matches of a category; any other word means all of them."""
    wanted = CATEGORIES.get(category)
    return matches.filter(F.col("match_category") == wanted) if wanted else matches


def recent_matches(matches: DataFrame, n: int = 12, category: str = "recent") -> DataFrame:
    """L1: the matches with the highest ids, with display names and winner."""
    latest = by_category(matches, category).orderBy(F.desc("match_id")).limit(n)
    return with_display_fields(latest)


def with_display_fields(matches: DataFrame) -> DataFrame:
    """Date, side names and winner of a match list."""
    return matches.withColumns({
        "date": blank_default("season", F.lit("Unknown Date")),
        "team1_name": blank_default("team1", "title", F.lit("Unknown")),
        "team2_name": blank_default("team2", F.lit("")),
        "winner_name": cricket.winner_name("result", "series")})


def contains_text(col: str, word: str) -> Column:
    """substring test in any case; the word is taken literally."""
    return F.coalesce(F.lower(col).contains(F.lower(F.lit(word))), F.lit(False))


def season_matches(matches: DataFrame, season: str) -> DataFrame:
    """matches whose venue or series names the season, newest first."""
    hits = matches.filter(contains_text("venue", season) | contains_text("series", season))
    shown = hits.withColumns({
        "date_string": cricket.ordinal_date("series", "venue"), "month_string": F.lit(""), "format": F.lit("Match"),
        "result": cricket.pending_result("result", "series")})
    return shown.orderBy(F.desc("match_id"))


def seasons(matches: DataFrame) -> DataFrame:
    """The years named by venues and series, latest first."""
    years = matches.select(cricket.season_year("venue", "series").alias("year")).distinct()
    return years.filter(F.col("year").isNotNull()).select(F.col("year").alias("id"), "year").orderBy(F.desc("year"))


def match_by_id(matches: DataFrame, match_id) -> DataFrame:
    """the match, or no row."""
    return matches.filter(F.col("match_id") == F.lit(match_id))


def search(df: DataFrame, name: str, ident: str, word: str, n: int = 10) -> DataFrame:
    """up to ``n`` entries whose name holds the word, in name order."""
    hits = df.filter(contains_text(name, word)).select(F.col(ident).alias("id"), F.col(name).alias("name"))
    return hits.orderBy("name", "id").limit(n)


def grams(text: Column | str, size: int = 3) -> Column:
    """The different runs of ``size`` letters of a text, lower-cased; none in a shorter or NULL text."""
    low = F.lower(as_col(text))
    places = F.sequence(F.lit(1), F.length(low) - (size - 1))
    return F.when(F.length(low) >= size, F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(size)))))


def postings(df: DataFrame, name: str, ident: str) -> DataFrame:
    """an inverted index of names: (gram, id), each once.

    Rows are dealt first: hardly any is there twice, so combining them where they are read would hold all grams of a file's names for nothing.
    """
    return df.select(F.explode(grams(name)).alias("gram"), F.col(ident).alias("id")).repartition("gram", "id").distinct()


def search_postings(df: DataFrame, index: DataFrame, counts: DataFrame, name: str, ident: str, word: str, n: int = 10, rarest: int = 3) -> DataFrame:
    """what search() returns, by an index of trigrams.

    ``index`` has rows (gram, id), ``counts`` (gram, n). Only entries that hold the ``rarest`` grams of the word are candidates,
    and each is checked by its text; a word of less than three letters has no gram, so it is looked for in all names. Filters on gram reach the scan of
    an index that is laid out by it.
    """
    spark = df.sparkSession
    asked = spark.range(1).select(grams(F.lit(word)).alias("g")).first()["g"]  # as Spark lower-cases them
    if not asked:
        return search(df, name, ident, word, n)
    known = {r["gram"]: r["n"] for r in counts.where(F.col("gram").isin(asked)).collect()}  # a row a letter of the word at most
    if len(known) < len(asked):
        return search(df.where(F.lit(False)), name, ident, word, n)
    few = sorted(known, key=lambda g: (known[g], g))[:rarest]
    held = index.where(F.col("gram").isin(few)).groupBy("id").agg(F.count("*").alias("_n")).where(F.col("_n") == len(few))
    return search(df.join(held.select(F.col("id").alias("_id")), F.col(ident) == F.col("_id"), "left_semi"), name, ident, word, n)


#: log2 of the buckets of a sketch of names: its estimate is off by 1.04 / sqrt(2 ** SKETCH_BITS) = 0.8 % (one standard error).
SKETCH_BITS = 14
STATUS_PARTS = "total_matches bigint, completed_extractions bigint, total_balls_delivered bigint, players binary"


def status_parts(matches: DataFrame, progress: DataFrame, batting: DataFrame) -> DataFrame:
    """A8, A9 for one load: its counts and a sketch of its players' names, in one small row."""
    none = F.lit(None).cast("bigint")
    rows = matches.agg(F.count("*").alias("total_matches")).select("total_matches", none.alias("completed_extractions"),
                                                                   none.alias("total_balls_delivered"), F.lit(None).cast("binary").alias("players"))
    rows = rows.unionByName(progress.agg(F.count("*").alias("completed_extractions")).select(
        none.alias("total_matches"), "completed_extractions", none.alias("total_balls_delivered"), F.lit(None).cast("binary").alias("players")))
    rows = rows.unionByName(batting.agg(F.sum("balls").cast("bigint").alias("total_balls_delivered"), F.hll_sketch_agg("player_name", SKETCH_BITS).alias("players"))
                            .select(none.alias("total_matches"), none.alias("completed_extractions"), "total_balls_delivered", "players"))
    return rows.agg(*[F.max(c).alias(c) for c in ("total_matches", "completed_extractions", "total_balls_delivered", "players")])


def status_of(parts: DataFrame) -> DataFrame:
    """A8, A9 from the rows of status_parts() of all loads: sums, and an estimate of the different names (see SKETCH_BITS).

    Loads may name the same players; they count once. Without a load everything is 0.
    """
    players = F.hll_sketch_estimate(F.hll_union_agg("players"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("total_matches", "completed_extractions", "total_balls_delivered")]
    return parts.agg(*sums, F.coalesce(players, F.lit(0)).cast("bigint").alias("total_players"))


def warehouse_status(matches: DataFrame | None = None, progress: DataFrame | None = None,
                     batting: DataFrame | None = None, approximate: bool = False) -> DataFrame:
    """Sizes of the warehouse in one row; a table that is missing counts 0."""
    names = ["total_matches", "completed_extractions", "total_balls_delivered", "total_players"]
    players = F.approx_count_distinct if approximate else F.count_distinct

    def row(df: DataFrame, **values: Column) -> DataFrame:
        return df.agg(*[values.get(n, F.lit(None)).cast("bigint").alias(n) for n in names])

    rows = []
    if matches is not None:
        rows.append(row(matches, total_matches=F.count("*")))
    if progress is not None:
        rows.append(row(progress, completed_extractions=F.count("*")))
    if batting is not None:
        rows.append(row(batting, total_balls_delivered=F.sum("balls"), total_players=players("player_name")))
    if not rows:
        raise ValueError("no table given")
    stacked = reduce(DataFrame.unionByName, rows)
    return stacked.agg(*[F.coalesce(F.max(n), F.lit(0)).alias(n) for n in names])


def recent_extractions(progress: DataFrame, matches: DataFrame, n: int = 10, order: str = "seq") -> DataFrame:
    """Labels of the matches extracted last."""
    shown = progress.select("match_id", order).join(matches.select("match_id"), "match_id", "left_semi").orderBy(F.desc(order)).limit(n)
    latest = matches.select("match_id", "team1", "team2", "season").join(shown, "match_id").orderBy(F.desc(order)).limit(n)
    name = lambda c: blank_default(c, F.lit("Unknown"))
    label = F.concat(name("team1"), F.lit(" vs "), name("team2"), F.lit(" ("), name("season"), F.lit(")"))
    return latest.select(order, "match_id", label.alias("label"))


# ---------------------------------------------------------------- scorecards


def _card_rows(batting: DataFrame, bowling: DataFrame) -> DataFrame:
    """Batting and bowling rows in one shape."""

    def shaped(df: DataFrame, section: str, fields: list[str], other: DataFrame) -> DataFrame:
        kinds = {**dict(other.dtypes), **dict(df.dtypes)}
        cols = [F.col(f) if f in fields else F.lit(None).cast(kinds.get(f, "string")).alias(f) for f in ROW_FIELDS]
        return df.select("match_id", "innings_number", F.lit(section).alias("section"),
                         F.col("id").cast("bigint").alias("row_id"), *cols)

    return shaped(batting, "batting", BAT_FIELDS, bowling).unionByName(
        shaped(bowling, "bowling", BOWL_FIELDS, batting))


def _listed(matches: DataFrame, innings: DataFrame) -> DataFrame:
    """The innings that known matches list."""
    return innings.select("match_id", "innings_number").join(matches.select("match_id"), "match_id", "left_semi")


def _innings_heads(matches: DataFrame, innings: DataFrame, fow: DataFrame) -> DataFrame:
    """One row per innings that its match lists, with its last fall of wickets."""
    keys = ["match_id", "innings_number"]
    last = fow.groupBy(*keys).agg(F.max_by("fow_string", "id" if "id" in fow.columns else "fow_string").alias("fow"))
    return _listed(matches, innings).distinct().join(last, keys, "left").withColumn("fow", F.coalesce("fow", F.lit("")))


def scorecard_rows(matches: DataFrame, innings: DataFrame, fow: DataFrame, batting: DataFrame, bowling: DataFrame,
                   match_id=None) -> DataFrame:
    """J10, flat: a head row per innings and its batting and bowling rows.

    Rows of an innings the match does not list are left out; an innings without rows keeps
    its head. Nothing is collected, so a scorecard may have any size. Each table meets the listed innings on its own, so
    tables bucketed by match (``layout.lay_out``) are joined where they lie.
    """
    if match_id is not None:
        matches, innings, fow, batting, bowling = (match_by_id(t, match_id)
                                                   for t in (matches, innings, fow, batting, bowling))
    keys, listed = ["match_id", "innings_number"], _listed(matches, innings)
    rows = _card_rows(batting.join(listed, keys, "left_semi"), bowling.join(listed, keys, "left_semi")).withColumn("fow", F.lit(""))
    shape = {f.name: f.dataType for f in rows.schema.fields}
    heads = _innings_heads(matches, innings, fow).select(
        *keys, F.lit("innings").alias("section"), F.lit(0).cast("bigint").alias("row_id"),
        *[F.lit(None).cast(shape[f]).alias(f) for f in ROW_FIELDS], "fow")
    return heads.unionByName(rows)


def _section(section: str, fields: list[str]) -> Column:
    rows = F.filter("rows", lambda r: r.section == section)
    return F.transform(rows, lambda r: F.struct(r.row_id.alias("id"), *[r[f].alias(f) for f in fields])).alias(section)


def _cards(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each innings as sorted arrays. An innings is small by nature, so it is one document at every size."""
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("section", "row_id", *ROW_FIELDS))).alias("rows"))
    return packed.select(*keys, _section("batting", BAT_FIELDS), _section("bowling", BOWL_FIELDS))


def _with_cards(heads: DataFrame, rows: DataFrame) -> DataFrame:
    keys = ["match_id", "innings_number"]
    cards = _cards(rows, keys)
    none = {c: F.array().cast(cards.schema[c].dataType) for c in ("batting", "bowling")}
    return heads.join(cards, keys, "left").withColumns({c: F.coalesce(c, empty) for c, empty in none.items()})


def scorecards(matches: DataFrame, innings: DataFrame, fow: DataFrame, batting: DataFrame, bowling: DataFrame,
               match_id=None) -> DataFrame:
    """J10, nested by innings: one document per innings with its batting and bowling arrays."""
    if match_id is not None:
        matches, innings, fow, batting, bowling = (match_by_id(t, match_id)
                                                   for t in (matches, innings, fow, batting, bowling))
    heads = _innings_heads(matches, innings, fow)
    meta = matches.select("match_id", F.struct(*matches.columns).alias("match_meta"))
    return _with_cards(heads, _card_rows(batting, bowling)).join(meta, "match_id")


def match_scorecards(matches: DataFrame, innings: DataFrame, fow: DataFrame, batting: DataFrame, bowling: DataFrame,
                     match_id=None) -> DataFrame:
    """One document per match, its metadata and its innings in order; a match without innings has none."""
    if match_id is not None:
        matches, innings, fow, batting, bowling = (match_by_id(t, match_id)
                                                   for t in (matches, innings, fow, batting, bowling))
    heads = _innings_heads(matches, innings, fow)
    return _by_match(matches, _with_cards(heads, _card_rows(batting, bowling)), "match_meta",
                     ["innings_number", "fow", "batting", "bowling"])


def _by_match(matches: DataFrame, cards: DataFrame, meta: str, fields: list[str]) -> DataFrame:
    """A row per match with its innings documents in order."""
    every = cards.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("innings"))
    heads = matches.select("match_id", F.struct(*matches.columns).alias(meta))
    joined = heads.join(every, "match_id", "left")
    return joined.withColumn("innings", F.coalesce("innings", F.array().cast(every.schema["innings"].dataType)))


# ---------------------------------------------------------------- archive scorecards


#: Unless told otherwise, a row of a higher innings is a mistake, since the gaps up to its number would have to be filled; rejected_rows() shows it.
MAX_INNINGS = 100


def _possible(most: int | None) -> Column:
    """An innings has a number from 1 on, up to ``most`` unless that is None."""
    test = F.col("innings_number") >= 1
    return test if most is None else test & (F.col("innings_number") <= most)


def rejected_rows(batting: DataFrame, bowling: DataFrame, most: int | None = MAX_INNINGS) -> DataFrame:
    """Rows whose innings number is missing, below 1 or above ``most``: those that no archive scorecard with that ``most`` shows."""
    return _card_rows(batting, bowling).filter(~F.coalesce(_possible(most), F.lit(False)))


def _archive_rows(matches: DataFrame, batting: DataFrame, bowling: DataFrame, most: int | None) -> DataFrame:
    """Rows of known matches. The matches, one narrow column each once, are hashed by their id, so no task sorts its rows for this join."""
    rows = _card_rows(batting, bowling).filter(_possible(most))
    known = matches.select(F.col("match_id").alias("_match")).distinct().hint("shuffle_hash")
    return rows.join(known, F.col("match_id") == F.col("_match")).drop("_match")


def _label() -> Column:
    return F.concat(F.lit("Innings "), F.col("innings_number").cast("string")).alias("batting_team")


def _gaps(rows: DataFrame) -> DataFrame:
    """Innings without rows below the highest one of their match: the numbers between one that was played and the one before."""
    played = rows.select("match_id", "innings_number").distinct()
    before = F.coalesce(F.lag("innings_number").over(Window.partitionBy("match_id").orderBy("innings_number")), F.lit(0))
    spans = played.select("match_id", before.alias("low"), F.col("innings_number").alias("high")).where("high - low > 1")
    return spans.select("match_id", F.explode(F.sequence(F.col("low") + 1, F.col("high") - 1)).alias("innings_number"))


def archive_scorecard_rows(matches: DataFrame, batting: DataFrame, bowling: DataFrame, most: int | None = MAX_INNINGS) -> DataFrame:
    """J11, W4, flat: rows of innings 1 to the highest one seen; one without rows gives one empty row.

    Gaps come from neighbouring numbers that were played. Rows of an innings above ``most`` are in rejected_rows() instead; with None there is no bound.
    """
    rows = _archive_rows(matches, batting, bowling, most)
    shape = {f.name: f.dataType for f in rows.schema.fields}
    empty = _gaps(rows).select("match_id", "innings_number", F.lit("empty").alias("section"),
                               *[F.lit(None).cast(shape[f]).alias(f) for f in ["row_id", *ROW_FIELDS]])
    return rows.unionByName(empty).select("match_id", "innings_number", _label(), "section", "row_id", *ROW_FIELDS)


def archive_scorecards(matches: DataFrame, batting: DataFrame, bowling: DataFrame, most: int | None = MAX_INNINGS) -> DataFrame:
    """J11, nested by innings: one document per innings 1 to the highest one; gaps are empty innings."""
    cards = archive_match_scorecards(matches, batting, bowling, most).select("match_id", F.explode("innings").alias("i"))
    return cards.select("match_id", "i.*")


def archive_match_scorecards(matches: DataFrame, batting: DataFrame, bowling: DataFrame, most: int | None = MAX_INNINGS) -> DataFrame:
    """One document per match, its metadata and its innings 1 to the highest one seen.

    Gaps are empty innings; a match without rows has none. Rows are grouped by innings and then by match;
    the gaps come from the grouped rows, so nothing is read twice.
    """
    cards = _cards(_card_rows(batting, bowling).filter(_possible(most)), ["match_id", "innings_number"])
    fields = F.struct("innings_number", _label(), "batting", "bowling", F.array().cast("array<string>").alias("fow"))
    every = cards.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct("innings_number", fields.alias("card")))).alias("_cards"),
                                          F.max("innings_number").alias("_top"))
    kind = every.schema["_cards"].dataType.valueType
    arrays = {f.name: f.dataType for f in kind.fields}

    def gap(i: Column) -> Column:
        return F.struct(i.alias("innings_number"), F.concat(F.lit("Innings "), i.cast("string")).alias("batting_team"),
                        *[F.array().cast(arrays[c]).alias(c) for c in ("batting", "bowling", "fow")])

    whole = every.select(F.col("match_id").alias("_match"), F.transform(
        F.sequence(F.lit(1), F.col("_top")), lambda i: F.coalesce(F.try_element_at("_cards", i), gap(i))).alias("innings"))
    heads = matches.select("match_id", F.struct(*matches.columns).alias("metadata"))
    joined = heads.join(whole, heads["match_id"] == whole["_match"], "left").drop("_match")
    return joined.withColumn("innings", F.coalesce("innings", F.array().cast(whole.schema["innings"].dataType)))
