"""Live feeds: score boards, rosters, commentary, and pages that embed them as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.cricket import detect_format
from ..functions.text import as_col, blank_default, first_group, is_blank, strip_tags

_TEAM = "struct<displayName:string,abbreviation:string>"
EVENT = ("id string, name string, shortName string, date string, season struct<name:string>, "
         "competitions array<struct<status:struct<type:struct<state:string,detail:string,description:string>>,"
         "venue:struct<fullName:string>,"
         f"competitors:array<struct<team:{_TEAM},score:string,"
         "linescores:array<struct<runs:int,wickets:int,overs:double>>>>,"
         "situation:struct<lastBattingTeam:struct<displayName:string>,over:string,currentRunRate:string,"
         "requiredRunRate:string,lastWicket:string,note:string>>>")

_STAT = "struct<type:string,stats:array<struct<name:string,displayValue:string>>>"
SUMMARY = ("header struct<competitions:array<struct<status:struct<type:struct<detail:string>>,"
           "venue:struct<fullName:string>>>>, "
           "rosters array<struct<team:struct<displayName:string>,roster:array<struct<"
           f"athlete:struct<displayName:string>,statistics:array<{_STAT}>>>>>")

FEED_A = ("over struct<number:string,ball:string>, scoreValue int, "
          "batsman struct<athlete:struct<displayName:string>>, bowler struct<athlete:struct<displayName:string>>, "
          "text string, shortText string, dismissal struct<text:string>, isBoundary boolean, isSix boolean")
FEED_B = ("overNumber string, ballNumber string, totalRuns int, batsmanStriker struct<name:string>, "
          "bowlerStriker struct<name:string>, commentTextItems array<struct<html:string>>, text string, "
          "isWicket boolean, isBoundary boolean, dismissalText string")

#: The situation as a map: one that tells other things than the known six still is one.
_SITUATED = "competitions array<struct<situation:map<string,string>>>"


def _text(value: Column | str) -> Column:
    return F.coalesce(as_col(value), F.lit(""))


# ---------------------------------------------------------------- answers of feeds


def unwrap(df: DataFrame, keys: tuple[str, ...], col: str = "value", *keep: str) -> DataFrame:
    """Items of a feed's answer, a row each with the item's JSON as ``value``.

    The first of ``keys`` that the answer has counts, whatever it holds; an answer without any, or with something else than
    a list there, gives no row.
    """
    answer = F.from_json(col, "map<string,string>")
    read = df.select(*keep, answer.alias("_a"))
    value = F.lit(None).cast("string")
    for key in reversed(keys):
        value = F.when(F.map_contains_key("_a", F.lit(key)), F.col("_a")[key]).otherwise(value)
    return read.select(*keep, F.posexplode(F.from_json(F.when(value.startswith("["), value), "array<string>")).alias("item_no", "value"))


def score_board(df: DataFrame, col: str = "value", *keep: str) -> DataFrame:
    """Events of a score board's answer."""
    return unwrap(df, ("events",), col, *keep)


def commentary_answer(df: DataFrame, feed: str, col: str = "value", *keep: str) -> DataFrame:
    """Commentary items of either feed's answer."""
    return unwrap(df, ("commentary", "items") if feed == "a" else ("commentaryList", "comments"), col, *keep)


# ---------------------------------------------------------------- score boards


def _competitions(df: DataFrame, col: str, *keep: str) -> DataFrame:
    event = df.select(*keep, F.from_json(col, EVENT).alias("e"))
    comp = F.try_element_at("e.competitions", F.lit(1))
    return event.withColumn("c", comp).filter(F.size("c.competitors") >= 2)


def flatten_events(df: DataFrame, col: str = "value") -> DataFrame:
    """One row per event with two sides; ``situation`` is NULL unless the feed has one."""
    told = F.try_element_at(F.from_json(col, _SITUATED)["competitions"], F.lit(1)).situation
    events = _competitions(df.withColumn("_told", told), col, "_told")
    kind, now = "c.status.type", F.col("c.situation")

    def side(n: int) -> Column:
        s = F.try_element_at("c.competitors", F.lit(n))
        return F.struct(_text(s.team.displayName).alias("name"), _text(s.team.abbreviation).alias("abbreviation"),
                        _text(s.score).alias("score"))

    parts = {"current_batsman": now.lastBattingTeam.displayName, "current_over": now["over"],
             "current_rr": now.currentRunRate, "required_rr": now.requiredRunRate,
             "last_wicket": now.lastWicket, "note": now.note}
    return events.select(
        _text("e.id").alias("match_id"), _text("e.name").alias("name"), _text("e.shortName").alias("short_name"),
        _text(f"{kind}.state").alias("status"),
        _text(blank_default(f"{kind}.detail", f"{kind}.description")).alias("status_detail"),
        side(1).alias("team1"), side(2).alias("team2"), _text("c.venue.fullName").alias("venue"),
        _text("e.season.name").alias("series"), _text("e.date").alias("start_time"),
        detect_format("e.name").alias("format"),
        F.when(F.size("_told") > 0, F.struct(*[_text(v).alias(k) for k, v in parts.items()])).alias("situation"))


def explode_linescores(df: DataFrame, col: str = "value") -> DataFrame:
    """One row per innings of each side, numbered within the side."""
    sides = _competitions(df, col).select(_text("e.id").alias("match_id"),
                                          F.posexplode("c.competitors").alias("side", "s"))
    lines = sides.select("match_id", "side", _text("s.team.abbreviation").alias("team"),
                         F.posexplode("s.linescores").alias("_pos", "l"))
    return lines.select("match_id", "side", "team", (F.col("_pos") + 1).alias("innings_num"),
                        F.coalesce("l.runs", F.lit(0)).alias("runs"), F.coalesce("l.wickets", F.lit(0)).alias("wickets"),
                        F.coalesce("l.overs", F.lit(0.0)).alias("overs"))


def summary_header(df: DataFrame, col: str = "value", *keep: str) -> DataFrame:
    """Status and venue of a match summary."""
    comp = F.try_element_at("s.header.competitions", F.lit(1))
    rows = df.select(*keep, F.from_json(col, SUMMARY).alias("s")).withColumn("c", comp)
    rows = rows.filter(F.col("c").isNotNull())
    return rows.select(*keep, _text("c.status.type.detail").alias("status"), _text("c.venue.fullName").alias("venue"))


def roster_stats(df: DataFrame, col: str = "value", *keep: str) -> DataFrame:
    """One row per rostered player with batting and bowling figures by name."""
    rosters = df.select(*keep, F.explode(F.from_json(col, SUMMARY)["rosters"]).alias("r"))
    players = rosters.select(*keep, _text("r.team.displayName").alias("team"), F.explode("r.roster").alias("p"))

    def figures(kind: str) -> Column:
        of_kind = F.filter("p.statistics", lambda s: s.type == kind)
        stats = F.filter(F.try_element_at(of_kind, F.lit(-1)).stats, lambda s: s["name"].isNotNull())
        # a figure named twice keeps its last value
        names = F.transform(stats, lambda s: s["name"])
        last = F.filter(stats, lambda s, i: ~F.array_contains(
            F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), s["name"]))
        return F.map_from_entries(F.transform(last, lambda s: F.struct(s["name"], s.displayValue)))

    return players.select(*keep, _text("p.athlete.displayName").alias("name"), "team",
                          figures("batting").alias("batting"), figures("bowling").alias("bowling"))


# ---------------------------------------------------------------- pages that embed JSON


def _embedded(df: DataFrame, html: str, parts: list[str], lists: list[str], item: str, keep) -> DataFrame:
    """Items of the lists under any of the paths, each a struct ``m`` of the fields ``item``.

    The document is parsed once and all lists are taken out together, as are all fields of an item: a path that leads nowhere costs a thrown
    exception in Spark, a field that is missing costs nothing. A part that is no object, a list that is none and an item that is no object give
    no row and leave the others as they are, whatever their keys hold.
    """
    props = F.try_variant_get(F.try_parse_json(first_group(html, fixed.EMBEDDED_DATA)), "$.props.pageProps", "variant")
    part = f"struct<{','.join(f'{name}:array<variant>' for name in lists)}>"
    read = df.select(*keep, F.try_variant_get(props, "$", f"struct<{','.join(f'{name}:{part}' for name in parts)}>").alias("pp"))
    none = F.array().cast("array<variant>")
    every = F.concat(*[F.coalesce(F.col(f"pp.{part}.{name}"), none) for part in parts for name in lists])
    # read before they are rows: a filter on rows would be moved below the reading and read each item again
    items = F.transform(every, lambda m: F.try_variant_get(m, "$", f"struct<{item}>"))
    return read.select(*keep, F.posexplode(items).alias("item_no", "m")).filter(F.col("m").isNotNull())


def embedded_matches(df: DataFrame, html: str = "html", *keep: str) -> DataFrame:
    """Matches listed in the JSON that a page embeds, under any of nine paths.

    Ids may be numbers or texts. A match whose side or ground is there but no object can't be read and is left out.
    """
    sides = ["team1", "team2", "ground"]
    texts = ["objectId", "id", "title", "name", "state", "status", "statusText", "statusDetail", "format"]
    item = ",".join([*[f"{name}:string" for name in texts], *[f"{name}:variant" for name in sides]])
    rows = _embedded(df, html, ["data", "appData", "content"], ["matches", "events", "liveMatches"], item, keep)
    rows = rows.select(*keep, "item_no", "m", *[F.try_variant_get(f"m.{name}", "$", "struct<name:string>").alias(f"_{name}") for name in sides])
    for name in sides:
        rows = rows.filter(F.col(f"m.{name}").isNull() | F.col(f"_{name}").isNotNull())
    either = lambda *paths: F.coalesce(*[F.col(p) for p in paths], F.lit(""))
    return rows.select(
        *keep, "item_no", either("m.objectId", "m.id").alias("match_id"), either("m.title", "m.name").alias("name"),
        either("m.state", "m.status").alias("status"), either("m.statusText", "m.statusDetail").alias("status_detail"),
        either("_team1.name").alias("team1"), either("_team2.name").alias("team2"),
        either("_ground.name").alias("venue"), either("m.format").alias("format"))


def listed_matches(df: DataFrame, col: str = "value") -> DataFrame:
    """Matches of a feed that is a bare list."""
    rows = df.select(F.explode(F.from_json(col, "array<struct<id:string,title:string,state:string>>")).alias("m"))
    return rows.select(_text("m.id").alias("match_id"), _text("m.title").alias("name"), _text("m.state").alias("status"))


def embedded_commentary(df: DataFrame, html: str = "html", *keep: str) -> DataFrame:
    """Commentary in the JSON that a page embeds; blank texts dropped, markup removed."""
    item = "text:string,html:string,over:string,runs:int,isWicket:boolean"
    rows = _embedded(df, html, ["data", "appData"], ["commentary", "commentaryList", "recentBalls"], item, keep)
    text = F.coalesce("m.text", "m.html", F.lit(""))
    wicket = F.coalesce("m.isWicket", F.lit(False))
    return rows.filter(text != "").select(
        *keep, "item_no", _text("m.over").alias("over"), strip_tags(text).alias("text"),
        F.coalesce("m.runs", F.lit(0)).alias("runs"), wicket.alias("is_wicket"),
        F.when(wicket, F.lit("wicket")).otherwise(F.lit("ball")).alias("type"))


# ---------------------------------------------------------------- commentary items


def classify_ball(item: Column, feed: str) -> Column:
    """Kind of a ball in either feed."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    if feed == "a":
        return (F.when(~is_blank(item.dismissal.text), F.lit("wicket")).when(yes(item.isSix), F.lit("six"))
                .when(yes(item.isBoundary), F.lit("four"))
                .when(F.coalesce(item.scoreValue, F.lit(0)) == 0, F.lit("dot")).otherwise(F.lit("runs")))
    if feed == "b":
        return F.when(yes(item.isWicket), F.lit("wicket")).when(yes(item.isBoundary), F.lit("boundary")) \
            .otherwise(F.lit("ball"))
    raise ValueError(f"unknown feed: {feed}")


def normalize_commentary(df: DataFrame, feed: str, col: str = "value", *keep: str) -> DataFrame:
    """Commentary items of either feed in one shape; works on streams as on tables."""
    items = df.select(*keep, F.from_json(col, FEED_A if feed == "a" else FEED_B).alias("i"))
    i = F.col("i")
    yes = lambda c: F.coalesce(c, F.lit(False))
    if feed == "a":
        fields = {"over": _text(i["over"].number), "ball": _text(i["over"].ball),
                  "runs": F.coalesce(i.scoreValue, F.lit(0)), "batsman": _text(i.batsman.athlete.displayName),
                  "bowler": _text(i.bowler.athlete.displayName), "text": F.coalesce(i.text, i.shortText, F.lit("")),
                  "is_wicket": ~is_blank(i.dismissal.text), "is_boundary": yes(i.isBoundary) | yes(i.isSix),
                  "dismissal": _text(i.dismissal.text)}
    else:
        spoken = F.when(F.size(i.commentTextItems) > 0, _text(F.try_element_at(i.commentTextItems, F.lit(1)).html))
        fields = {"over": _text(i.overNumber), "ball": _text(i.ballNumber),
                  "runs": F.coalesce(i.totalRuns, F.lit(0)), "batsman": _text(i.batsmanStriker["name"]),
                  "bowler": _text(i.bowlerStriker["name"]), "text": F.coalesce(spoken, i.text, F.lit("")),
                  "is_wicket": yes(i.isWicket), "is_boundary": yes(i.isBoundary), "dismissal": _text(i.dismissalText)}
    rows = items.filter(i.isNotNull())
    return rows.select(*keep, *[v.alias(k) for k, v in fields.items()], classify_ball(i, feed).alias("type"))
