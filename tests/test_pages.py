"""Markup pass and scorecard pages on a hand-written page."""

import time

import pytest

from pavilion.operators import leaderboards, markup, pages, scorecards

PAGE = """<html><head><title>The Home of CricketArchive</title><script>document.title = "A v B"; var x = "<table><tr>";</script></head><body>
<!-- <table><tr><td>Venue</td></tr></table> -->
<table><tr><td>&nbsp;</td><td><center><a href="/Events/12/Cup.html">The T20 Cup</a></center></td></tr>
<TR><TD>Match<TD><CENTER><b><a href='/Teams/1/10/10.html'>Alpha</a> v <a href=/Teams/1/11.html>Beta</a></b></CENTER>
<tr><td>Venue</td><td><a href="/Grounds/5/55.html">The Oval</a> on 26th July 2025 (friendly match)
<tr><td>Toss<td>Beta won the toss and decided to field
<tr><td>Result<td>Alpha won by 5 wickets</tr>
<tr><td>Umpires<td><a href="/Players/1/1.html">U One</a>, <a href="/Players/1/2/2.html">U Two</a></tr>
<tr><td>Referee<td>nobody linked</tr><tr><td>single</td></tr></table>
<table><tr><td colspan=3><b><a href="/Teams/1/10/10.html">Alpha</a> innings</b> (20 overs)</td></tr>
<tr><td onmouseover="x('dob: 1st Jan 1990<br>')"><a href="/Players/0/7/7.html">A &amp; Bat</a></td><td>not out</td><td>1,050</td><td>30</td><td>40</td><td>6</td><td>2</td><td>3</td><td>166.66</td></tr>
<tr><td><a href="/Players/0/8/8.html">B Bat</a></td><td>did not bat</td></tr>
<tr><td><a href="/Elsewhere/8.html">No player</a></td><td>x</td></tr>
<tr><td>Extras</td><td>(2 b, 9 lb, 1 nb, 2 w)</td><td>14</td></tr><tr><td>Total</td><td>(ALL OUT, 18.4 overs)</td><td>150</td></tr>
<tr><td>Fall of wickets:</td></tr><tr><td>1-47 (<a href="/Players/0/7/7.html">A Bat</a>, 5.5 ov), junk), 2-77 (<a href="/Players/0/8/8.html">B Bat</a>, 9.1 ov)</td></tr></table>
<table><tr><td><a href="/Teams/1/11/11.html">Beta</a> bowling</td></tr><tr><td><a href="/Players/0/9/9.html">C Bowl</a></td><td>4</td><td>0</td><td>20</td><td>3</td><td>1</td><td>-</td><td>10</td><td>1</td><td>0</td><td>8.0</td></tr></table>
<table><tr><td>outer<table><tr><td>inner</td></tr></table></td></tr></table>
<b>Footnotes</b><br>--> first note<br><i>--> second <a href="x">note</a></i><br>plain<hr>--> after
</body></html>"""


def parsed(spark, *contents):
    rows = [(f"m{i}", c if isinstance(c, bytes) else c.encode()) for i, c in enumerate(contents)]
    return pages.parse_pages(spark.createDataFrame([(i, bytearray(c)) for i, c in rows], "doc_id string, content binary"))


def test_scorecard(spark):
    docs = parsed(spark, PAGE.encode() + b"\xff\xfe", "<p>no table</p>", "<table><tr><td>x</td></tr></table>", "").cache()
    meta = scorecards.with_meta(docs)
    m = scorecards.match_meta(meta).collect()
    assert len(m) == 1
    m = m[0]
    assert (m.title, m.tournament_id, m.tournament_name, m.date, m.venue, m.ground_id, m.format) == (
        "A v B", "12", "The T20 Cup", "26th July 2025", "The Oval", "55", "T20")
    assert (m.team1_id, m.team2_id, m.toss_winner_id, m.toss_decision) == ("10", "11", "11", "field")
    assert (m.win_margin_runs, m.win_margin_wickets, m.win_margin_text) == (0, 5, "5 wickets")
    assert (m.umpire1_id, m.umpire2_id, m.referee_id, m.points) == ("1", "2", None, None)
    inn = scorecards.innings(meta).first()
    assert inn[1:] == ("m0", 1, "10", "11", 150, 10, "18.4", 2, 9, 1, 2, 14)
    bat = [r[5:] for r in scorecards.batting_rows(meta).orderBy("row_no").collect()]
    assert bat[0] == ("7", "not out", 1050, 30, 40, 6, 2, 3, 166.66, "A & Bat", "/Players/0/7/7.html", "1st Jan 1990")
    assert bat[1] == ("8", "did not bat", 0, 0, None, 0, 0, 0, 0.0, "B Bat", "/Players/0/8/8.html", None)
    assert [b[0] for b in bat] == ["7", "8", "7"]          # the wicket list below its label counts as a line
    bowl = scorecards.bowling_rows(meta).first()
    assert (bowl.bowling_team_id, bowl.player_id, bowl.overs, bowl.wickets, bowl.no_balls, bowl.econ) == ("11", "9", 4.0, 3, 0, 8.0)
    fow = scorecards.fall_of_wickets(meta).orderBy("part_no").collect()
    assert [(f.wicket_num, f.score, f.player_out_id, f.overs) for f in fow] == [(1, 47, "7", 5.5), (2, 77, None, 9.1)]
    assert [n.note_text for n in pages.match_notes(docs).orderBy("note_no").collect()] == ["first note", "second note"]
    assert sorted(r.doc_id for r in pages.valid_pages(docs).collect()) == ["m0"]


def test_cells_of_nested_tables(spark):
    cells = pages.html_cells(parsed(spark, PAGE)).filter("table_no >= 3").orderBy("table_no", "row_no", "cell_no").collect()
    assert [(c.table_no, c.row_no, c.cell_no, c.text) for c in cells] == [
        (3, 0, 0, "outerinner"), (3, 0, 1, "inner"), (3, 1, 0, "inner"), (4, 0, 0, "inner")]


def test_two_innings_bowling(spark):
    def table(kind, team, player):
        return (f'<table><tr><td><a href="/Teams/1/{team}.html">T</a> {kind}</td></tr>'
                f'<tr><td><a href="/Players/1/{player}.html">P</a></td><td>3</td></tr></table>')

    page = ('<table><tr><td>Venue</td><td>x</td></tr><tr><td>M</td><td><center><a href="/Teams/1/1.html">A</a> v '
            '<a href="/Teams/1/2.html">B</a></center></td></tr></table>' + table("innings", 1, 11) + table("bowling", 2, 21)
            + table("innings", 2, 12) + table("bowling", 1, 22) + table("innings", 1, 13) + table("bowling", 2, 23))
    meta = scorecards.with_meta(parsed(spark, page)).cache()
    rows, inns = scorecards.bowling_rows(meta), scorecards.innings(meta)
    exact = scorecards.attach_bowling(rows, inns).select("player_id", "innings_number").collect()
    assert sorted(map(tuple, exact)) == [("21", 1), ("22", 2), ("23", 3)]
    team = scorecards.attach_bowling(rows, inns, "team").select("player_id", "innings_number").collect()
    assert sorted(map(tuple, team)) == [("21", 1), ("21", 3), ("22", 2), ("23", 1), ("23", 3)]


def test_best_table_fallbacks(spark):
    grid = lambda rows, cols: "<table>" + "".join("<tr>" + "".join(f"<td>{r}{c}</td>" for c in range(cols)) + "</tr>"
                                                   for r in range(rows)) + "</table>"
    two = grid(2, 5) + grid(3, 6)
    three = grid(4, 5) + grid(1, 2) + grid(1, 1)
    small = grid(3, 2)
    got = {r.doc_id: r.table_no for r in leaderboards.best_stat_table(parsed(spark, two, three, small)).collect()}
    assert got == {"m0": 1, "m1": 2}


def test_header_aliases(spark):
    df = spark.createDataFrame([(1, 2)], "`AVE ` int, avg int")
    assert leaderboards.resolve(df, {"mean": ["Ave", "Avg"]}).columns == ["mean", "avg"]


BAD = {
    "unclosed quotes": lambda n: "<table><tr>" + '<td a="x><b>y</b>' * n,
    "one quote, no end": lambda n: "<table><tr><td>" + "<a '" * n,
    "quotes that hide every end": lambda n: '<a "<a ">" "' * n,
    "unclosed bold": lambda n: "notes<table>" + "<b>Notes " * n,
    "bold in bold": lambda n: "notes" + "<b>" * n + "x",
    "open centres": lambda n: "<table><tr><td>" + "<center>" * n + "</center></td>" * n,
    "nested tables": lambda n: "<table><tr><td>x" * n,
    "comments": lambda n: "<!-- <table> " * n,
    "scripts": lambda n: "<script <title " * n,
    "signs": lambda n: "< " * n,
    "attributes": lambda n: "<td onmouseover" + " = " * n + ">",
}


@pytest.mark.parametrize("kind", BAD)
def test_reading_is_linear(kind):
    def run(n):
        page = BAD[kind](n)
        start = time.process_time()
        found, _, notes = markup.read_page(page)
        taken = time.process_time() - start
        return taken, sum(map(len, found.elements)) // 6 + len(found.pieces) + len(found.hrefs) + len(notes), sum(map(len, found.pieces))

    run(1000)
    small, large = (min(run(n) for _ in range(3)) for n in (10_000, 40_000))
    assert large[0] < 8 * small[0] + 0.02, (small, large)
    assert large[1] <= 4.2 * small[1] + 100 and large[2] <= 4.2 * small[2] + 100


def test_bad_markup_reads_as_meant():
    def cells(page):
        found = markup.read_page(page)[0]
        return ["".join(found.pieces[a:b]) for a, b in zip(found.elements[2][::6], found.elements[2][1::6])]

    assert cells("<table><tr><td>a<td>b<tr><th>c</table>d") == ["a", "b", "c"]
    assert cells('<table><tr><td a="1>2">x</td><TD A=\'">"\'>y') == ["x", "y"]
    assert cells("<table><tr><td>1 < 2 &lt; 3 <") == ["1 < 2 < 3 <"]
    assert cells('<table><tr><td>x</td><td "y>z') == ["x", "z"]
    assert cells("<table><tr><td>a<table><tr><td>b</table>c</table>") == ["abc", "b"]


def test_notes_heading_holds_one_string():
    lines = lambda page: markup.read_page(page)[2]
    assert lines("<b>Notes</b>--> a<br>--> b<hr>c") == ["--> a", "--> b"]
    assert lines("<b><i>Match NOTES</i></b>x") == ["x"]
    assert lines("<b>Notes <i>more</i></b>x<b>Footnotes</b>y") == ["y"]
    assert lines("<b><br>Notes</b>x") == [] and lines("<i>Notes</i>x") == [] and lines("<b>Notes") == []
    assert lines("<p><b>Notes</b>x<i>y<u>z</u></i></p>w") == ["x", "yz", ""]


def test_wanted_columns_are_those_of_whole_pages(spark):
    pieces = ["<title>a &amp; b</title>", "<TITLE>c</TITLE>", "<table>", "<table 'x>", "</table>", "<TABLE a=\"1>2\">", "<tr><td>x", "<!-- <table> -->",
              "<script>document.title = \"s\"; <table></script>", "<b>Notes</b>--> n<br>", "y < z", "<table "]
    odd = ["".join(pieces[(i * j + j) % len(pieces)] for j in range(1, 2 + i % 9)) for i in range(60)]
    rows = spark.createDataFrame([(f"m{i}", c) for i, c in enumerate([PAGE, "", None, *odd, *(make(50) for make in BAD.values())])], "doc_id string, content string")
    whole = pages.parse_pages(rows)
    assert {r.doc_id: r.n_tables for r in whole.collect()} == {r.doc_id: r.n for r in whole.selectExpr("doc_id", "size(tables) n").collect()}
    for only in (["n_tables"], ["title", "script_title"], ["notes"], ["notes", "n_tables"], ["pieces", "links"], ["tables"]):
        some = pages.parse_pages(rows, only=only)
        assert some.columns == ["doc_id", *(c for c in whole.columns if c in only)]
        assert sorted(map(repr, some.collect())) == sorted(map(repr, whole.select(some.columns).collect())), only


def test_notes_and_counts_read_no_elements(monkeypatch):
    def never(*_):
        raise AssertionError("elements were read")

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema
    import pyarrow as pa

    from pavilion import schemas
    monkeypatch.setattr(markup.Page, "read", never)
    reader = markup.batch_reader(to_arrow_schema(T.StructType([f for f in schemas.PAGE if f.name in ("doc_id", "notes", "n_tables", "title", "script_title")])))
    got = next(reader([pa.RecordBatch.from_pydict({"doc_id": ["m"], "content": [PAGE]})])).to_pylist()
    assert got == [{"doc_id": "m", "title": "The Home of CricketArchive", "script_title": "A v B", "notes": got[0]["notes"], "n_tables": 5}]


def test_ranges_of_a_page_copy_no_list(spark, capsys):
    meta = scorecards.with_meta(parsed(spark, PAGE))
    for facts in (scorecards.innings, scorecards.batting_rows, scorecards.bowling_rows, scorecards.harvest_entities):
        facts(meta).explain()
        plan = capsys.readouterr().out
        assert not any(f"slice({name}" in plan for name in pages.LISTS), facts


def test_words_in_any_case(spark):
    from pavilion.functions.text import has_word
    words = ["Side 1 INNINGS", "x innings", "innings", "İnnings", " İnnings", " inningſ", "", None]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    got = {r.i: (r.a, r.b) for r in rows.selectExpr("i", "w", "contains(lower(w), ' innings') a").withColumn("b", has_word(rows["w"], " innings")).collect()}
    assert all(a == b for a, b in got.values()) and got[0] == (True, True) and got[7] == (None, None)


def test_attached_rows_are_cut_from_narrow_tables(spark, sf_dir, monkeypatch):
    from pavilion.plans import queries_pages
    written, real = [], queries_pages.materialise

    def narrow(df, *args, **kwargs):
        written.append(set(df.columns))
        return real(df, *args, **kwargs)

    monkeypatch.setattr(queries_pages, "materialise", narrow)
    for name in ("attach_batting", "attach_bowling", "attach_bowling_by_team"):
        queries_pages.ENTRIES[name][0](spark, sf_dir)
    assert len(written) == 3 and not any(w & {"pieces", "cells", "links"} for w in written)


def test_what_nobody_asks_of_a_page_is_not_worked_out(spark, sf_dir, capsys):
    from pavilion.plans import queries_pages
    for name in ("entity_players", "entity_teams", "innings_totals", "attach_bowling", "bowling_rows"):
        queries_pages.ENTRIES[name][0](spark, sf_dir).explain()
        assert "toss" not in capsys.readouterr().out.split("MapInArrow")[0].lower().replace("venue|toss|result", ""), name


def test_kinds_of_entities_are_those_of_the_whole_harvest(spark):
    whole = scorecards.harvest_entities(scorecards.with_meta(parsed(spark, PAGE))).collect()
    for kinds in (("player",), ("team", "tournament"), ("tournament",)):
        pages = scorecards.with_meta(parsed(spark, PAGE), *scorecards.named_fields(*kinds))
        some = scorecards.harvest_entities(pages, *kinds).collect()
        assert some and sorted(map(str, some)) == sorted(str(r) for r in whole if r.kind in kinds)


def test_links_are_read_alike(spark):
    from pavilion.operators import markup
    for tag in ('a href=""', 'a href="x"', 'a href="x&amp;y\'s"', 'a href="x>y"', 'a href="x" id="y"', 'A HREF="x"', 'a href="x', "a href='x'"):
        page, slow = f"<td><{tag}>text</a>rest</td>", markup.Page()
        slow.read(markup._marks_of(markup.tokens(page)))
        fast = markup.read_page(page)[0]
        assert (fast.hrefs, fast.anchors, "".join(fast.pieces)) == (slow.hrefs, slow.anchors, "".join(slow.pieces)), tag
    assert markup.read_page('<a href="">x</a><a href="y&amp;z">x</a>')[0].hrefs == ["", "y&z"]


def test_ends_are_stripped_alike(spark):
    from pavilion.functions.text import _SPACES, lenient_int, strip
    texts = ["", "a", "!", "~", "\x7f", "a\xa0", "\u3000a", "\x1f", " a b ", "é", "\xa0é\t", "x\x85", "- 5", "5 -", " -1,2 ", "-", None]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(texts)], "i int, w string")
    for i, w, got, number in rows.select("i", "w", strip("w"), lenient_int("w")).collect():
        assert got == (None if w is None else w.strip(_SPACES))
        assert number == {12: 5, 13: 5, 14: 12}.get(i, 0)


def _read(contents, reader):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    from pavilion import schemas
    ids, content = pa.array([str(i) for i in range(len(contents))]), pa.array(contents, pa.string())
    return reader(ids, content, to_arrow_schema(schemas.PAGE))


def test_pages_are_read_together(monkeypatch):
    plain = [PAGE.replace("<table><tr><td>outer<table><tr><td>inner</td></tr></table></td></tr></table>", ""), "", None, "no markup é",
             "<center><table><tr><td>a</table></center>", "<table><tr><th>1<td>2<a href='x'>y<tbody><tr><td><center>z</table>w"]
    slow = _read(plain, markup._one_by_one).to_pylist()

    def never(*_):
        raise AssertionError("a page was read on its own")

    monkeypatch.setattr(markup.Page, "read", never)
    pages, odd = _read(plain, markup._at_once)
    assert not odd.any() and pages.to_pylist() == slow


def test_pages_read_together_are_those_read_alone():
    import random

    soup = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "<TD a='1'>", "<td onmouseover=\"t('<br>')\">", "<td/>", '<td"x">', "<td\xa0>", "<tdx>",
            "<center>", "</center>", '<a href="u">', "</a>", "<a name=x>", '<A HREF="v&amp;w">', '<a href="x>y">', "text", "&amp;&nbsp;é", "<b>", "<tbody>", "</tbody>",
            "<!-- <table> -->", "<!-- é -->", "<title>T &amp; t</title>", '<script>document.title = "s"; <td></script>', ">", '"', "< ", "<ſcript>", "<!DOCTYPE 'a'>",
            "<b>Notes</b>--> x<br>", "<table", '<td a="']
    deal = random.Random(4)
    shapes = [lambda: "<table><tr>" + "".join(deal.choices(["<td>", "</td>", "<th>", "x", "<a href=\"u\">", "</a>", "<center>", "</center>", "</tr><tr>"], k=9)) + "</table>",
              lambda: "".join(deal.choices(soup, k=deal.choice([1, 4, 12])))]
    contents = [PAGE, None, *(shapes[i % 2]() for i in range(600)), *(make(40) for make in BAD.values())]
    pages, odd = _read(contents, markup._at_once)
    alone = _read(contents, markup._one_by_one).to_pylist()
    assert 100 < odd.sum() < 500
    for content, page, is_odd, one in zip(contents, pages.to_pylist(), odd, alone):
        assert is_odd or page == one, content


def test_steps_of_a_page_are_small_enough_to_be_compiled(spark, sf_dir):
    """The JVM interprets a method of more than 8,000 bytes for ever."""
    from pavilion.plans import queries_pages
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("match_meta", "fall_of_wickets", "batting_rows", "entity_players"):
            stages = debug.codegenStringSeq(queries_pages.ENTRIES[name][0](spark, sf_dir)._jdf.queryExecution().executedPlan())
            sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
            assert sizes and max(sizes) < 8000, (name, sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_texts_are_kept_once(spark):
    deep = "<table><tr><td>x" * 400
    page = pages.parse_pages(spark.createDataFrame([("m", deep + "<table><tr><td>a<td>b &amp; c")], "doc_id string, content string")).first()
    assert [d.text for d in page.data[-2:]] == ["a", "b & c"] and page.tables[-1].header == "ab & c"
    assert sum(len(d.text or "") for d in page.data) <= len(deep) and page.rows[0].deep and not page.rows[-1].deep
