"""Scorecard pages: metadata, innings, batting, bowling, fall of wickets, entities.

Works on the rows of ``parse_pages``. Everything is a projection or an explode of a
page's own row; nothing is shuffled until facts of different tables are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cricket, text
from ..functions import fixed_values as fixed
from ..functions.text import clean_text, first_group, lenient_double, lenient_int, row_key, url_entity_id
from .pages import center_of, explode_all, link_of, page_title, rows_of, text_of, told, unfused

OFFICIALS = {"TV umpire": "tv_umpire", "Referee": "referee", "Reserve Umpire": "reserve_umpire",
             "Player of the Match": "player_of_match"}


#: metadata that innings and bowling rows read
TEAM_IDS = ("team1_id", "team2_id")
#: columns of a parsed page that facts look things up in
LOOKUPS = ["pieces", "links", "data", "rows"]
#: columns of a parsed page that metadata and facts are made of
FACTS = ["title", "script_title", *LOOKUPS, "centers", "tables"]


_TABLE = "struct<p0:int,p1:int,l0:int,l1:int,r0:int,r1:int,header:string>"


def _last(rows: Column) -> Column:
    return F.try_element_at(rows, F.lit(-1))


# ---------------------------------------------------------------- metadata


def with_meta(docs: DataFrame, *only: str) -> DataFrame:
    """Add the match metadata of each page as ``meta``; pages without any are left out.

    ``only`` names the fields that are wanted, all unless given: Spark works out a struct whole where several of its fields are read.
    """
    # the first such table, most often the page's first: no text is put together behind it. The outer form of the explode keeps Spark
    # from working it out a second time for the filter
    main = F.aggregate("tables", F.lit(None).cast(_TABLE), lambda found, t: F.coalesce(found, F.when(text_of(t).rlike("Venue|Toss|Result"), t)))
    pages = explode_all(docs, docs.columns, F.array(main), "_place", "_main").drop("_place").filter(F.col("_main").isNotNull())
    cells = F.transform(F.filter(rows_of(F.col("_main")), lambda r: r.d1 - r.d0 >= 2), lambda r: F.struct(
        F.get("data", r.d0).alias("key"), F.get("data", r.d0 + 1).alias("cell")))
    pages = pages.withColumn("_kv", F.transform(cells, lambda r: F.struct(clean_text(told(r.key)).alias("key"), r.cell.alias("cell"))))

    def row(key: str, links: int = 0) -> Column:
        return _last(F.filter("_kv", lambda r: (r.key == key) & (r.cell.l1 - r.cell.l0 >= links))).cell

    def said(key: str) -> Column:
        return F.when(row(key).isNotNull(), clean_text(told(row(key))))

    centers = F.transform(cells, lambda r: center_of(r.cell))
    cup = _last(F.filter("_kv", lambda r: (r.key == "") & (center_of(r.cell).l1 > center_of(r.cell).l0))).cell
    pages = pages.withColumns({
        "_sides": _last(F.filter(centers, lambda c: (c.l1 - c.l0 >= 2) & told(c).contains(" v "))),
        "_cup": link_of(center_of(cup)), "_venue": said("Venue"), "_ground": link_of(row("Venue", 1)),
        "_toss": said("Toss"), "_result": said("Result"), "_points": said("Points"),
        "_umpire1": link_of(row("Umpires", 1)), "_umpire2": link_of(row("Umpires", 2), 1),
        **{f"_{name}": link_of(row(key, 1)) for key, name in OFFICIALS.items()},
    })
    pages = pages.withColumns({"_team1": link_of(F.col("_sides")), "_team2": link_of(F.col("_sides"), 1)})
    team1, team2, cup = F.col("_team1"), F.col("_team2"), F.col("_cup")

    def entity(name: str, kind: str) -> dict[str, Column]:
        a = F.col(f"_{name}")
        return {f"{name}_id": url_entity_id(a.href, kind), f"{name}_name": F.when(a.isNotNull(), clean_text(a.text)), f"{name}_url": a.href}

    venue_text, result, toss = F.col("_venue"), F.col("_result"), F.col("_toss")
    people = {k: v for p in ("umpire1", "umpire2", *OFFICIALS.values()) for k, v in entity(p, "player").items()}
    meta = {
        "title": page_title(),
        "tournament_id": url_entity_id(cup.href, "tournament"),
        "tournament_name": F.when(cup.isNotNull(), clean_text(cup.text)), "tournament_url": cup.href,
        "date": cricket.extract_date(venue_text),
        "venue": F.when(F.col("_ground").isNotNull(), clean_text("_ground.text")),
        "ground_id": url_entity_id("_ground.href", "ground"),
        "format": cricket.classify_format(venue_text, clean_text(cup.text)),
        **entity("team1", "team"), **entity("team2", "team"),
        "toss_winner_id": cricket.toss_winner(toss, clean_text(team1.text), clean_text(team2.text),
                                              url_entity_id(team1.href, "team"), url_entity_id(team2.href, "team")),
        "toss_decision": cricket.toss_decision(toss), "result": result,
        "win_margin_runs": F.coalesce(cricket.margin_runs(result), F.lit(0)),
        "win_margin_wickets": F.coalesce(cricket.margin_wickets(result), F.lit(0)),
        "win_margin_text": cricket.margin_text(result), **people, "points": F.col("_points")}
    meta = F.struct(*[value.alias(name) for name, value in meta.items() if not only or name in only])
    return pages.select(*docs.columns, unfused(meta).alias("meta"))


def match_meta(pages: DataFrame) -> DataFrame:
    """Flat metadata, one row per match page."""
    return pages.select(F.col("doc_id").alias("match_id"), "meta.*")


# ---------------------------------------------------------------- innings


def _first_row(table: Column) -> Column:
    return F.when(table.r1 > table.r0, F.get("rows", table.r0))


def _numbered_tables() -> Column:
    """Tables with their place on the page and header."""
    header = lambda t: F.coalesce(t.header, text_of(_first_row(t)))
    return F.transform("tables", lambda t, i: F.struct(i.alias("no"), clean_text(header(t)).alias("header"), t.alias("t")))


def _header_link(table: Column) -> Column:
    """First link of a table's header."""
    return link_of(_first_row(table))


def _innings_tables() -> Column:
    return F.filter(_numbered_tables(), lambda n: text.has_word(n.header, " innings"))


def _bowling_tables() -> Column:
    return F.filter(_numbered_tables(), lambda n: text.has_word(n.header, " bowling")
                    & ~text.has_word(n.header, " innings"))


def _with_teams(pages: DataFrame) -> DataFrame:
    """Pages with no more of the metadata than the teams. An explode that carried all of it would have all of it worked out."""
    return pages.select("doc_id", F.struct("meta.team1_id", "meta.team2_id").alias("meta"), *LOOKUPS, "tables")


def _places(table: Column) -> Column:
    """Where the rows of a table behind its header are."""
    return F.when(table.r1 - table.r0 > 1, F.sequence(table.r0 + 1, table.r1 - 1)).otherwise(F.array().cast("array<int>"))


def _first_cell(row: Column) -> Column:
    return F.when(row.d1 > row.d0, F.get("data", row.d0))


def _narrow(lines: DataFrame, keep: list, line: Column) -> DataFrame:
    """Lines with no more of their page than the struct ``line``, whose fields become columns.

    What follows has lambdas for the odd cell that holds others, and Spark copies whole rows around those. It would also move a filter
    with such a lambda before this step, but not before an explode.
    """
    kept = explode_all(lines, keep, F.array(line), "_one", "_line")
    return kept.select(*[c for c in kept.columns if c not in ("_one", "_line")], "_line.*")


def _line() -> Column:
    """A line of a table: its data cells, the first link of the first of them, and the page's pieces if a cell holds others."""
    row = F.col("_row")
    return F.struct(F.slice("data", row.d0 + 1, row.d1 - row.d0).alias("line"), link_of(_first_cell(row)).alias("link"),
                    F.when(row.deep, F.col("pieces")).alias("deep"))


def _lines(tables: DataFrame, keep: list, table: str, outer: bool = False) -> DataFrame:
    """A row per line of a table, as ``_row``, with the page's lookups; ``outer``: a table without lines has one without a row."""
    columns = [*keep, *LOOKUPS, F.col(f"{table}.r1").alias("_end")]
    lines = tables.select(*columns, F.posexplode_outer(_places(F.col(table))).alias("row_no", "_place"))
    if not outer:
        lines = lines.filter(F.col("row_no").isNotNull())
    return lines.withColumn("_row", F.get("rows", F.col("_place")))


def innings_tables(pages: DataFrame) -> DataFrame:
    """The lines of the innings tables in document order, with the number and sides of their innings; a table without lines has one
    without cells."""
    tables = _sides(explode_all(_with_teams(pages), ["doc_id", "meta", *LOOKUPS], _innings_tables(), "_pos", "n"))
    keep = ["match_id", "table_no", "innings_number", "batting_team_id", "bowling_team_id"]
    lines = _lines(tables, keep, "_table", outer=True)
    return _narrow(lines, [*keep, "row_no"], _line())


def _sides(tables: DataFrame) -> DataFrame:
    """Exploded innings tables with number and sides."""
    bat = url_entity_id(_header_link(F.col("n.t")).href, "team")
    tables = tables.select(F.col("doc_id").alias("match_id"), "meta", F.col("n.no").alias("table_no"), F.col("n.t").alias("_table"),
                           (F.col("_pos") + 1).alias("innings_number"), bat.alias("batting_team_id"), *LOOKUPS)
    other = F.when(F.col("batting_team_id").eqNullSafe(F.col("meta.team1_id")), F.col("meta.team2_id")).otherwise(F.col("meta.team1_id"))
    return tables.withColumn("bowling_team_id", other).drop("meta")


def innings_key(name: str = "innings_id") -> Column:
    """P25: key of an innings; it follows from the page, so rows of a page need no join to learn it."""
    return row_key("match_id", "innings_number").alias(name)


def innings(pages: DataFrame) -> DataFrame:
    """One row per innings with extras and totals."""
    rows = _sides(explode_all(_with_teams(pages), ["doc_id", "meta", *LOOKUPS], _innings_tables(), "_pos", "n"))
    keyed = F.transform(rows_of(F.col("_table"), 1), lambda r: F.struct(clean_text(told(_first_cell(r))).alias("key"), r.alias("row")))
    rows = rows.withColumn("_keyed", F.filter(keyed, lambda l: l.key.isin("Extras", "Total") & (l.row.d1 > l.row.d0)))
    # of the last line of each kind, only the cells that are asked for become texts
    rows = rows.withColumns({f"_{key.lower()}": _last(F.filter("_keyed", lambda l: l.key == key)).row for key in ("Extras", "Total")})

    def cell_text(row: str, n: int) -> Column:
        row = F.col(row)
        return F.when(row.d1 - row.d0 >= n, told(F.get("data", row.d0 + n - 1)))

    rows = rows.select("match_id", "innings_number", "batting_team_id", "bowling_team_id", *[
        cell_text(row, n).alias(f"{row}{n}") for row in ("_extras", "_total") for n in (2, 3)])
    return rows.select(
        innings_key("id"), "match_id", "innings_number", "batting_team_id",
        "bowling_team_id", lenient_int("_total3").alias("runs"),
        total_wickets(F.col("_total2")).alias("wickets"), total_overs(F.col("_total2")).alias("overs"),
        *[extras_part(F.col("_extras2"), unit).alias(name) for name, unit in
          (("extras_b", "b"), ("extras_lb", "lb"), ("extras_nb", "nb"), ("extras_wd", "w"))],
        lenient_int("_extras3").alias("extras_total"))


def extras_part(line: Column, unit: str) -> Column:
    """One kind of extra from a line such as ``(2 b, 9 lb, 1 nb, 2 w)``."""
    return F.coalesce(first_group(clean_text(line), fixed.EXTRAS_PART.format(unit=unit)).try_cast("int"), F.lit(0))


def total_wickets(line: Column) -> Column:
    """Wickets of a total line; "all out" is ten."""
    line = clean_text(line)
    return F.when(text.has_word(line, "all out"), F.lit(10)).otherwise(
        F.coalesce(first_group(line, fixed.TOTAL_WICKETS).try_cast("int"), F.lit(0)))


def total_overs(line: Column) -> Column:
    """Overs of a total line, as text."""
    return F.coalesce(first_group(clean_text(line), fixed.TOTAL_OVERS), F.lit(""))


def _at(n: int) -> Column:
    """Text of the n-th data cell of a line, counted from 0."""
    cell = F.get("line", F.lit(n))
    return F.when(cell.isNotNull(), told(cell, "deep"))


def _to_player(link: Column) -> Column:
    return link.href.contains("/Players/")


def _is_player(link: Column, first_text: Column) -> Column:
    """A line of an innings that links to a player, which may be a wicket list as well."""
    return F.coalesce(_to_player(link) & ~first_text.isin("Extras", "Total"), F.lit(False))


def _falls(first_text: Column) -> Column:
    return text.has_word(first_text, "fall of wickets")


def _below() -> Column:
    """First cell of the next line, and whether it holds others."""
    row = F.when(F.col("_place") + 1 < F.col("_end"), F.get("rows", F.col("_place") + 1))
    return F.when(row.d1 > row.d0, F.struct(F.get("data", row.d0).alias("cell"), row.deep.alias("deep")))


def _wicket_line() -> tuple[Column, Column, Column]:
    """(may a line be a list of wickets, the cell that lists them, may that or the label's cell hold others).

    It is the label's own cell, or the one below a bare label. That a line may be one is all that is looked at here, in little code.
    """
    row = F.col("_row")
    first, below = _first_cell(row), _below()
    bare = (first.l1 == first.l0) & below.isNotNull()
    may = first.isNotNull() & (first.text.isNull() | F.lower(first.text).contains("wickets"))
    return may, F.when(bare, below.cell).otherwise(first), row.deep | F.coalesce(below.deep, F.lit(False))


def _wicket_parts(listing: Column) -> Column:
    """The wickets of a list as texts; the k-th belongs to the k-th link."""
    listing = text.strip(F.replace(clean_text(listing), F.lit("Fall of wickets:"), F.lit("")))
    return F.transform(F.split(listing, r"\),"), text.strip)


def _is_wicket(part: Column) -> Column:
    return part.rlike(fixed.FALLEN_WICKET)


def batting_rows(pages: DataFrame) -> DataFrame:
    """One row per batting line, with the player's name, link and date of birth.

    Any line whose first cell links to a player counts, also the line below a bare
    "Fall of wickets" label; a line that is Extras, Total or a wicket list does not.
    """
    return batting_lines(innings_tables(pages))


def batting_lines(tables: DataFrame) -> DataFrame:
    """N5 for the rows of ``innings_tables``."""
    first_text = clean_text(_at(0))
    lines = tables.filter(_to_player(F.col("link"))).filter(_is_player(F.col("link"), first_text) & ~_falls(first_text))
    mins = F.when(F.size("line") >= 5, lenient_int(_at(4)))
    return lines.select(
        "match_id", "table_no", "innings_number", innings_key(), "row_no", url_entity_id("link.href", "player").alias("player_id"),
        clean_text(_at(1)).alias("dismissal_text"), lenient_int(_at(2)).alias("runs"),
        lenient_int(_at(3)).alias("balls"), mins.alias("mins"), lenient_int(_at(5)).alias("fours"),
        lenient_int(_at(6)).alias("sixes"), lenient_int(_at(7)).alias("dots"),
        lenient_double(_at(8)).alias("strike_rate"), clean_text("link.text").alias("name"),
        F.col("link.href").alias("url"), cricket.dob(F.get("line", F.lit(0)).tooltip).alias("dob"))


def bowling_rows(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per bowling line; ``ordinal`` counts the side's bowling tables on the page."""
    tables = F.transform(_bowling_tables(), lambda n: F.struct(
        n.no.alias("no"), url_entity_id(_header_link(n.t).href, "team").alias("team"), n.t.alias("t")))
    tables = pages.select("doc_id", *keep, *LOOKUPS, tables.alias("_tables"))
    tables = explode_all(tables, ["doc_id", *keep, *LOOKUPS, "_tables"], F.col("_tables"), "_pos", "t")
    earlier = F.filter(F.slice("_tables", F.lit(1), F.col("_pos") + 1),
                       lambda u: u.team.eqNullSafe(F.col("t.team")))
    tables = tables.select(*keep, F.col("doc_id").alias("match_id"), F.col("t.no").alias("table_no"), F.size(earlier).alias("ordinal"),
                           F.col("t.team").alias("bowling_team_id"), *LOOKUPS, F.col("t.t").alias("_table"))
    keep_line = [*keep, "match_id", "table_no", "ordinal", "bowling_team_id"]
    lines = _lines(tables, keep_line, "_table")
    row = F.col("_row")
    lines = lines.filter((row.d1 - row.d0 >= 2) & _to_player(link_of(_first_cell(row))))
    lines = _narrow(lines, [*keep_line, "row_no"], _line())
    econ = lenient_double(F.when(F.size("line") >= 12, _at(11)).otherwise(_at(10)))
    names = ["maidens", "runs", "wickets", "wides", "no_balls", "dots", "fours", "sixes"]
    return lines.select(
        *keep, "match_id", "table_no", "row_no", "ordinal", "bowling_team_id",
        url_entity_id("link.href", "player").alias("player_id"), lenient_double(_at(1)).alias("overs"),
        *[lenient_int(_at(n)).alias(name) for n, name in enumerate(names, start=2)], econ.alias("econ"),
        clean_text("link.text").alias("name"), F.col("link.href").alias("url"))


def fall_of_wickets(pages: DataFrame) -> DataFrame:
    """One row per fallen wicket; the k-th part of the list belongs to the k-th link."""
    tables = _sides(explode_all(_with_teams(pages), ["doc_id", "meta", *LOOKUPS], _innings_tables(), "_pos", "n"))
    keep = ["match_id", "table_no", "innings_number", "row_no"]
    may, source, deep = _wicket_line()
    lines = _lines(tables, keep[:-1], "_table").filter(may)
    lines = _narrow(lines, keep, F.struct(_first_cell(F.col("_row")).alias("first"), source.alias("source"), "links",
                                          F.when(deep, F.col("pieces")).alias("deep")))
    lines = lines.filter(_falls(clean_text(told(F.col("first"), "deep"))))
    parts = explode_all(lines, [*keep, "source", "links"], _wicket_parts(told(F.col("source"), "deep")), "part_no", "part")
    part = F.col("part")
    link = link_of(F.col("source"), F.col("part_no"))
    over = unfused(first_group(part, fixed.FALLEN_OVERS))
    return parts.filter(_is_wicket(part)).select(
        "match_id", "table_no", "innings_number", innings_key(), "row_no", "part_no",
        F.regexp_extract(part, fixed.FALLEN_WICKET, 1).try_cast("int").alias("wicket_num"),
        F.regexp_extract(part, fixed.FALLEN_WICKET, 2).try_cast("int").alias("score"),
        url_entity_id(link.href, "player").alias("player_out_id"),
        F.coalesce(lenient_double(over), F.lit(0.0)).alias("overs"),
        F.when(link.isNotNull(), clean_text(link.text)).alias("name"), link.href.alias("url"))


# ---------------------------------------------------------------- entities


#: the entities that metadata names, in the order they are seen in
_NAMED = [("team", "team1"), ("team", "team2"), ("tournament", "tournament"),
          *[("player", p) for p in ("umpire1", "umpire2", *OFFICIALS.values())]]


def named_fields(*kinds: str) -> list[str]:
    """The metadata that ``harvest_entities`` of these kinds reads."""
    return [f"{who}_{part}" for kind, who in _NAMED if kind in kinds for part in ("id", "name", "url")]


def harvest_entities(pages: DataFrame, *kinds: str) -> DataFrame:
    """Every team, player and tournament a page names, with the order it was seen in.

    The page's metadata, the headers of its tables and their lines go through one chain of explodes, so a page is read once.
    ``kinds``: the kinds that are wanted, all unless given. What only the others need is not worked out: lines name players, headers teams.
    """
    kinds = kinds or ("team", "player", "tournament")
    none = F.lit(None).cast("string")

    def entry(seen: list, kind: str, ident: Column, name: Column, url: Column, dob: Column = none) -> Column:
        at = F.array(*[F.lit(s).cast("int") if isinstance(s, int) else s.cast("int") for s in seen])
        return F.struct(at.alias("seen"), F.lit(kind).alias("kind"), ident.alias("id"), name.alias("name"), url.alias("url"),
                        dob.alias("dob"))

    def linked(seen: list, kind: str, link: Column, dob: Column = none) -> Column:
        return entry(seen, kind, url_entity_id(link.href, kind), F.when(link.isNotNull(), clean_text(link.text)), link.href, dob)

    from_meta = F.array(*[entry([-1, n, 0], kind, *(F.col(f"meta.{who}_{part}") for part in ("id", "name", "url")))
                          for n, (kind, who) in enumerate(_NAMED) if kind in kinds])
    # the first "table" stands for the metadata, the first "line" of a table for its header
    tables = F.filter(_numbered_tables(), lambda n: text.has_word(n.header, " innings") | text.has_word(n.header, " bowling"))
    tables = F.transform(tables, lambda n: F.struct(n.no.alias("no"), text.has_word(n.header, " innings").alias("bats"), n.t.alias("t")))
    blank = F.array(F.lit(None).cast(f"struct<no:int,bats:boolean,t:{_TABLE}>"))
    # no more of the metadata than it names goes through the explode
    pages = pages.select("doc_id", from_meta.alias("_named"), *LOOKUPS, "tables")
    found = explode_all(pages, ["doc_id", "_named", *LOOKUPS], F.concat(blank, tables), "_i", "n")
    head = _header_link(F.col("n.t"))
    found = found.select(F.col("doc_id").alias("match_id"), F.col("n.no").alias("no"), F.col("n.bats").alias("bats"), F.col("n.t").alias("_table"),
                         F.when(F.col("n").isNull(), F.col("_named")).alias("_meta"), F.struct(head.text.alias("text"), head.href.alias("href")).alias("_head"),
                         head.isNotNull().alias("_headed"), *LOOKUPS)
    no, bats = F.col("no"), F.col("bats")
    empty = F.array().cast("array<struct<seen:array<int>,kind:string,id:string,name:string,url:string,dob:string>>")
    head = F.array(linked([no, -1, 0], "team", F.when(F.col("_headed"), F.col("_head")))) if "team" in kinds else empty
    named = F.coalesce("_meta", head)
    if "player" not in kinds:
        every = explode_all(found, ["match_id"], named, "_k", "e").select("match_id", "e.*")
        return every.filter(~text.is_blank("id")).select("match_id", "seen", "kind", "id", "name", "url", "dob")

    keep = ["match_id", "no", "bats", "_meta", "_head", "_headed"]
    # place -1 stands for the header
    places = F.concat(F.array(F.lit(-1)), F.when(F.col("_table").isNotNull(), _places(F.col("_table"))).otherwise(F.array().cast("array<int>")))
    lines = found.select(*keep, *LOOKUPS, F.col("_table.r1").alias("_end"), F.posexplode_outer(places).alias("_j", "_place"))
    lines = lines.withColumn("_row", F.get("rows", F.col("_place"))).withColumn("row", F.col("_j") - 1)
    page_row, row = F.col("_row"), F.col("row")
    may, source, deep = _wicket_line()
    may = F.coalesce(bats & may, F.lit(False))
    link = link_of(_first_cell(page_row))
    # a line goes without its page, and only what may list wickets with links
    lines = lines.filter((row == -1) | may | F.coalesce(_to_player(link), F.lit(False)))
    lines = _narrow(lines, [*keep, "row"], F.struct(
        (page_row.d1 - page_row.d0).alias("n"), _first_cell(page_row).alias("first"), link.alias("link"), F.when(may, source).alias("source"),
        F.when(may, F.col("links")).alias("links"), F.when(deep, F.col("pieces")).alias("deep")))
    first_text = clean_text(told(F.col("first"), "deep"))
    lines = lines.withColumn("_first_text", F.when(F.col("first").isNotNull(), first_text))
    link, dob = F.col("link"), cricket.dob(F.col("first.tooltip"))
    fallen = F.transform(_wicket_parts(told(F.col("source"), "deep")), lambda part, i: F.when(
        _is_wicket(part), linked([no, row, i], "player", link_of(F.col("source"), i))))
    in_line = (
        F.when(row == -1, named)
        .when(bats & _falls(F.col("_first_text")), F.filter(fallen, lambda e: e.isNotNull()))
        .when(bats & _is_player(link, F.col("_first_text")), F.array(linked([no, row, 0], "player", link, dob)))
        .when(~bats & (F.col("n") >= 2) & F.coalesce(_to_player(link), F.lit(False)), F.array(linked([no, row, 0], "player", link)))
        .otherwise(empty))
    every = explode_all(lines, ["match_id"], in_line, "_k", "e").select("match_id", "e.*")
    return every.filter(~text.is_blank("id")).select("match_id", "seen", "kind", "id", "name", "url", "dob")


# ---------------------------------------------------------------- facts to innings


def bowling_with_sides(pages: DataFrame) -> DataFrame:
    """Bowling rows with the sides that bowled in the innings of their page as ``_sides``."""
    bat_ids = F.transform(_innings_tables(), lambda n: url_entity_id(_header_link(n.t).href, "team"))
    one, two = F.col("meta.team1_id"), F.col("meta.team2_id")
    sides = F.transform(bat_ids, lambda t, i: F.struct(
        (i + 1).alias("innings_number"), F.when(t.eqNullSafe(one), two).otherwise(one).alias("team")))
    return bowling_rows(pages.withColumn("_sides", sides), "_sides")


def innings_of_sides(rows: DataFrame) -> DataFrame:
    """The innings of ``bowling_with_sides``, as attach_bowling() takes them; a page without bowling rows has none."""
    inns = rows.select("match_id", F.explode("_sides").alias("_s")).select("match_id", "_s.innings_number", F.col("_s.team").alias("bowling_team_id"))
    return inns.withColumn("id", innings_key())


def bowling_by_innings(pages: DataFrame, mode: str = "ordinal") -> DataFrame:
    """J3 within the page: bowling rows with the number and key of their innings, without a shuffle."""
    _check(mode)
    rows = bowling_with_sides(pages)
    own = F.filter("_sides", lambda s: s.team.eqNullSafe(F.col("bowling_team_id")))
    if mode == "ordinal":
        own = F.filter(F.slice(own, F.col("ordinal"), 1), lambda s: s.innings_number.isNotNull())
    rows = rows.withColumn("_own", F.explode(own)).withColumn("innings_number", F.col("_own.innings_number"))
    return rows.withColumn("innings_id", innings_key()).drop("_own", "_sides")


def _check(mode: str) -> None:
    if mode not in ("ordinal", "team"):
        raise ValueError(f"unknown mode: {mode}")


def attach_batting(rows: DataFrame, inns: DataFrame) -> DataFrame:
    """Batting or wicket rows of a table with the id of their innings."""
    rows = rows.drop("innings_id")
    keys = inns.select("match_id", "innings_number", F.col("id").alias("innings_id")).distinct()
    return rows.join(keys, ["match_id", "innings_number"])


def attach_bowling(rows: DataFrame, inns: DataFrame, mode: str = "ordinal") -> DataFrame:
    """Bowling rows with the id of the innings they belong to.

    ``mode="team"`` attaches a row to every innings its side bowled in, which counts it
    twice in a two-innings match. ``mode="ordinal"`` also asks for the k-th bowling table
    of the side to meet the k-th innings it bowled in.
    """
    _check(mode)
    # Copies of an innings go first; what is left of a match are its own few innings, which
    # are numbered per side inside one small array.
    inns = inns.select("match_id", "innings_number", "bowling_team_id", "id").distinct()
    order = F.array_sort(F.collect_list(F.struct("innings_number", F.col("id").alias("innings_id"))))
    sides = inns.groupBy("match_id", "bowling_team_id").agg(order.alias("_list"))
    keys = sides.select(F.col("match_id").alias("_match"), F.col("bowling_team_id").alias("_team"),
                        F.posexplode("_list").alias("_pos", "_inn"))
    on = (F.col("match_id") == F.col("_match")) & F.col("bowling_team_id").eqNullSafe(F.col("_team"))
    if mode == "ordinal":
        on = on & (F.col("ordinal") == F.col("_pos") + 1)
    return rows.join(keys, on).select(rows["*"], F.col("_inn.innings_number").alias("innings_number"),
                                      F.col("_inn.innings_id").alias("innings_id"))
