"""Markup reader: records the tables, links and note lines of pages.

Runs inside Spark tasks. The module uses nothing but the standard library, numpy and Arrow, and is
sent to the tasks by value, so executors need no copy of the package.

A page becomes flat lists: text pieces in page order, and links, centred parts, cells, rows and tables that
remember where they start and end in those lists. So every element is recorded once, however deep it is nested, and what is
"all below it" is a range. Reading takes time in proportion to the page: an unclosed quote or comment ends the page's
markup once, and open elements are kept by kind.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_QUOTED = r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+"""
_TOKENS = (r"([^<]*+)(?:<!--.*?(?:-->|\Z)"
           r"|<(script|style|title)\b[^>]*+(?:>(.*?)(?:</\2\s*>|\Z)|\Z)"
           r"|<(?=[a-z/!?])(/?+)((?:[a-z][^\s/>\"']*+)?+)({inside})(>|\Z)"
           r"|(<)|\Z)")
#: Tags whose attributes may hold ">" in quotes, and tags that end at the next ">" whatever the quotes.
_TOKEN = re.compile(_TOKENS.replace("{inside}", _QUOTED), re.S | re.I)
_PLAIN = re.compile(_TOKENS.replace("{inside}", "[^>]*+"), re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]+))?""")
_ONE_ATTRIBUTE = re.compile(r"""\s*+([^\s=/>"']++)="([^"]*+)"\s*+""")
_SCRIPT_TITLE = re.compile(r'document\.title\s*=\s*"([^"]+)"')
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}
_TABLE, _ROW, _CELL, _CENTER, _LINK, _SECTION = range(6)
_KINDS = {"table": _TABLE, "tr": _ROW, "td": _CELL, "th": _CELL, "center": _CENTER, "a": _LINK,
          "thead": _SECTION, "tbody": _SECTION, "tfoot": _SECTION}
#: Closing an element looks no further out than the innermost open one of this kind.
_STOP = {_CELL: _ROW, _ROW: _TABLE, _TABLE: None, _CENTER: _CELL}


def tokens(page: str) -> list[tuple]:
    """(text, raw element, its content, "/", tag, attributes, ">", "<") in page order; most of them empty.

    A tag whose quotes never let it end is dropped up to the next ">", and from there on quotes count no more.
    """
    found = _TOKEN.findall(page)
    for pattern in (_PLAIN, None):
        cut = next((i for i in range(len(found) - 1, max(-1, len(found) - 3), -1) if _unended(found[i])), None)
        if cut is None:
            return found
        text, _, _, slash, tag, inside, _, _ = found[cut]
        rest = slash + tag + inside
        end = rest.find(">")
        found = found[:cut]
        if end < 0 or pattern is None:
            return [*found, (text, "", "", "", "", "", "", ""), ("<" + rest, "", "", "", "", "", "", "")]
        found = [*found, (text, "", "", "", "", "", "", ""), *pattern.findall(rest[end + 1:])]
    return found


def _unended(token: tuple) -> bool:
    return not token[6] and bool(token[3] or token[4] or token[5])


#: A mark is what a token means for the elements: (kind, closes, tag, attributes). No element: one of these kinds.
_OTHER, _TITLE = -1, -2
_NOTHING = (_OTHER, False, "", "")
#: Marks of plain tags that were seen before, by what stands between "<" and ">". Tags with quotes are not kept.
_KNOWN: dict[str, tuple] = {}
_MOST_KNOWN, _LONGEST_KNOWN = 4096, 64


def _mark(token: tuple) -> tuple:
    _, raw, inner, slash, tag, inside, _, _ = token
    if not tag:
        return (_TITLE, False, "", inner) if raw.lower() == "title" else _NOTHING
    tag = tag.lower()
    kind = _KINDS.get(tag, _OTHER)
    if inside[:1] in ("'", '"') or (kind == _SECTION and slash):
        kind = _OTHER
    return (kind, bool(slash), tag, inside) if kind != _OTHER else _NOTHING


def _marks_of(found: list[tuple]) -> Iterator[tuple[tuple, str]]:
    for token in found:
        yield _NOTHING, token[0]
        yield _mark(token), token[7]


def marks(page: str) -> Iterator[tuple[tuple, str]]:
    """The marks of ``tokens(page)``, each with the text behind it.

    Most tags are plain and known, so the page is split at "<" and the pattern is asked about the others only.
    """
    known, parts = _KNOWN, iter(page.split("<"))
    text = next(parts)
    yield _NOTHING, text
    after = done = len(text)
    for part in parts:
        at = after                                  # this part is page[at + 1:after], behind a "<" at ``at``
        after += len(part) + 1
        if done > at:                               # the last token took this "<" too
            if done < after:
                yield _NOTHING, page[done:after]
            continue
        head, end, text = part.partition(">")
        mark = known.get(head) if end else None
        if mark is None and end and head[:8] == 'a href="' and head[-1] == '"' and head.count('"') == 2:
            mark = (_LINK, False, "a", head[1:])    # a plain link: its one quoted value ends where the tag does
        if mark is None:
            match = _TOKEN.match(page, at)
            token, done = match.groups(""), match.end()
            if _unended(token):
                yield from _marks_of(tokens(page[at:]))
                return
            mark, text = _mark(token), page[done:after]
            if token[7]:
                yield mark, token[7]
                mark = _NOTHING
            elif end and token[6] and "'" not in head and '"' not in head and len(head) <= _LONGEST_KNOWN and len(known) < _MOST_KNOWN:
                known[head] = mark
        yield mark, text


def _attribute(text: str, name: str) -> str | None:
    if name == "href" and text[:7] == ' href="' and text.find('"', 7) == len(text) - 1:
        value = text[7:-1]
        return unescape(value) if "&" in value else value
    if one := _ONE_ATTRIBUTE.fullmatch(text):
        key, value = one.groups()
        return (unescape(value) if "&" in value else value) if key.lower() == name else None
    if name not in text.lower():
        return None
    for key, value in _ATTRIBUTE.findall(text):
        if key.lower() == name:
            return unescape(value[1:-1] if value[:1] in ("'", '"') else value)
    return None


class Page:
    """The flat lists of one page. An element is six numbers: texts from, to, links from, to, parts from, to."""

    def __init__(self) -> None:
        self.title: str | None = None
        self.pieces: list[str] = []
        self.hrefs: list[str | None] = []
        self.anchors: list[int] = []                       # two numbers a link: texts from, to
        self.elements: list[list[int]] = [[], [], [], []]  # tables, rows, cells, centred parts
        self.tags: list[str] = []                          # of the cells, as are the tooltips
        self.tooltips: list[str | None] = []
        self.deep: list[list[int]] = [[], [], [], []]      # elements that hold another of their kind, by place in their list

    def read(self, found: Iterable[tuple[tuple, str]]) -> None:
        """Take the marks of a page, each with the text behind it."""
        pieces, hrefs, anchors, elements, stops = self.pieces, self.hrefs, self.anchors, self.elements, _STOP
        opened: list[int] = []                             # kinds of the open elements, and where their numbers start
        starts: list[int] = []
        places: list[list[int]] = [[], [], [], []]         # of each kind, where its open elements are among these
        parts = [elements[_ROW], elements[_CELL], elements[_CENTER], []]
        in_link = False

        def end(at: int) -> None:
            """End the open elements from place ``at`` on."""
            text, links = len(pieces), len(hrefs)
            while len(opened) > at:
                kind, node = opened.pop(), starts.pop()
                places[kind].pop()
                numbers = elements[kind]
                numbers[node + 1] = text
                numbers[node + 3] = links
                numbers[node + 5] = len(parts[kind]) // _WIDTH

        for (kind, slash, tag, inside), text in found:
            if kind == _LINK:
                if in_link:
                    anchors[-1] = len(pieces)
                in_link = not slash
                if in_link:
                    hrefs.append(_attribute(inside, "href"))
                    anchors += (len(pieces), len(pieces))
            elif kind >= 0:
                if slash:
                    close = kind
                else:
                    close = _ROW if kind in (_ROW, _SECTION) else _CELL if kind == _CELL and opened and opened[-1] != _ROW else None
                if close is not None and places[close]:
                    at, stop = places[close][-1], stops[close]
                    if stop is None or not places[stop] or at > places[stop][-1]:
                        if in_link:
                            anchors[-1] = len(pieces)
                            in_link = False
                        end(at)
                if not slash and kind != _SECTION:
                    if kind == _CELL:
                        self.tags.append(tag)
                        self.tooltips.append(_attribute(inside, "onmouseover") if inside else None)
                    numbers = elements[kind]
                    if places[kind]:
                        self.deep[kind].append(starts[places[kind][-1]] // _WIDTH)
                    places[kind].append(len(opened))
                    opened.append(kind)
                    starts.append(len(numbers))
                    numbers += (len(pieces), 0, len(hrefs), 0, len(parts[kind]) // _WIDTH, 0)
            elif kind == _TITLE and self.title is None:
                self.title = unescape(inside)
            if text:
                pieces.append(unescape(text) if "&" in text else text)
        if in_link:
            anchors[-1] = len(pieces)
        end(0)


def note_lines(found: list[tuple]) -> list[str]:
    """Texts of the siblings behind the first bold notes heading, up to a rule or a table.

    A heading is a bold element that holds one string and nothing else, however deep.
    """
    for i, token in enumerate(found):
        string = token[0]
        if not string or not token[3] or "notes" not in (unescape(string) if "&" in string else string).lower():
            continue
        opened, at = [], i - 1                      # the tags that open right before the string, innermost first
        while at >= 0 and found[at][4] and not found[at][3] and found[at][4].lower() not in _VOID:
            opened.append(found[at][4].lower())
            if opened[-1] == "b" or found[at][0]:
                break
            at -= 1
        end = i + len(opened)
        closed = [t[4].lower() for t in found[i:end] if t[3] and (t is token or not t[0])]
        if opened and opened[-1] == "b" and closed == opened:
            return _lines(found[end:])
    return []


def _lines(found: list[tuple]) -> list[str]:
    lines, depth = [[]], 0
    for text, _, _, slash, tag, _, _, lone in found:
        lines[-1].append(text + lone)
        tag = tag.lower()
        if slash:
            depth -= 1
            if depth < 0:
                break
        elif depth == 0 and tag in ("hr", "table"):
            break
        if depth == 0 and tag:
            lines.append([])
        if tag and not slash and tag not in _VOID:
            depth += 1
    return [unescape("".join(line)) for line in lines]


#: numbers of an element in ``Page.elements`` and of a link in ``Page.anchors``
_WIDTH, _LINK_WIDTH = 6, 2
#: what ranges of an element's last two numbers point into
_BELOW = {"tables": "rows", "rows": "cells", "cells": "centers"}


def _strings(pages: list[list[str]]) -> pa.ListArray:
    offsets, flat = [0], []
    for page in pages:
        flat += page
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.string()))


def _cut(data: np.ndarray, start: np.ndarray, end: np.ndarray, none: np.ndarray | None = None) -> pa.StringArray:
    """Stretches of some bytes as texts, NULL where ``none`` says so."""
    if none is not None:
        end = np.where(none, start, end)
    sizes = end - start
    offsets = np.append(0, np.cumsum(sizes))
    gather = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], sizes)
    valid = pa.py_buffer(np.packbits(~none, bitorder="little")) if none is not None and none.any() else None
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[gather]), valid)


class Lists:
    """The flat lists of some pages, each behind the other.

    ``firsts``: of every list, the place of the first element of each page, and one more. ``numbers``: the numbers of the elements, in the page.
    ``deep``: the elements that hold another of their kind. A text is kept for the others only, so that no part of a page is kept more than twice.
    """

    firsts: dict[str, np.ndarray]
    numbers: dict[str, list[np.ndarray]]
    deep: dict[str, np.ndarray]
    pieces: pa.StringArray

    def hrefs(self) -> pa.StringArray:
        raise NotImplementedError

    def tooltips(self) -> pa.StringArray:
        raise NotImplementedError

    def headings(self) -> np.ndarray:
        """Which cells are headings."""
        raise NotImplementedError

    def _global(self, name: str, numbers: np.ndarray, of: str) -> np.ndarray:
        """Numbers of elements of one list that point into another, counted over all pages."""
        return numbers + np.repeat(self.firsts[of][:-1], np.diff(self.firsts[name]))

    def _texts(self, name: str, deep: bool = True) -> pa.StringArray:
        """Text below each element, NULL for those that hold another of their kind."""
        starts, ends = (self._global(name, n, "pieces") for n in self.numbers[name][:2])
        return self._joined(starts, ends, self.deep[name] if deep else None)

    def _joined(self, starts: np.ndarray, ends: np.ndarray, none: np.ndarray | None) -> pa.StringArray:
        _, offsets, data = self.pieces.buffers()
        first = self.pieces.offset
        offsets = np.frombuffer(offsets, np.int32)[first:first + len(self.pieces) + 1].astype(np.int64) if len(self.pieces) else np.zeros(1, np.int64)
        return _cut(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets[starts], offsets[ends], none)

    def _headers(self) -> pa.StringArray:
        """Text of the first row of each table, NULL if there is none or it holds other rows."""
        first, end = (self._global("tables", n, "rows") for n in self.numbers["tables"][4:])
        if not len(self.numbers["rows"][0]):
            return pa.nulls(len(first), pa.string())
        none = (end <= first)
        first = np.where(none, 0, first)
        starts, ends = (self._global("rows", n, "pieces")[first] for n in self.numbers["rows"][:2])
        return self._joined(starts, ends, none | self.deep["rows"][first])

    def column(self, name: str, kind: pa.ListType) -> pa.ListArray:
        """One list a page."""
        if name == "pieces":
            return pa.ListArray.from_arrays(pa.array(self.firsts[name].astype(np.int32)), self.pieces)
        source, firsts = name, self.firsts.get(name)
        if name == "data":
            source = "cells"
            chosen = np.flatnonzero(~self.headings())
            firsts = np.searchsorted(chosen, self.firsts["cells"])
        fields = list(kind.value_type)
        numbers = iter(self.numbers[source])
        arrays = []
        for field in fields:
            if field.name == "href":
                value = self.hrefs()
            elif field.name == "tag":
                value = pa.array(["td", "th"]).take(pa.array(self.headings().astype(np.int32)))
            elif field.name == "tooltip":
                value = self.tooltips()
            elif field.name == "text":
                value = self._texts(source, source != "links")
            elif field.name == "header":
                value = self._headers()
            elif field.name in ("d0", "d1", "deep"):
                start, end = (self._global("rows", n, "cells") for n in self.numbers["rows"][4:])
                if field.name == "deep":
                    before = np.append(0, np.cumsum(self.deep["cells"]))
                    value = pa.array(before[end] > before[start])
                else:
                    before = np.append(0, np.cumsum(~self.headings()))
                    first = np.repeat(before[self.firsts["cells"][:-1]], np.diff(self.firsts["rows"]))
                    value = pa.array((before[start if field.name == "d0" else end] - first).astype(np.int32))
            else:
                value = pa.array(next(numbers).astype(np.int32, copy=False))
            arrays.append(value.take(pa.array(chosen)) if name == "data" else value)
        return pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.StructArray.from_arrays(arrays, fields=fields))


class PageLists(Lists):
    """The lists of pages that were read one by one."""

    def __init__(self, pages: list[Page]) -> None:
        self._pages = pages
        self.pieces = pa.array([t for p in pages for t in p.pieces], pa.string())
        kept = {"pieces": [p.pieces for p in pages], "links": [p.hrefs for p in pages], "cells": [p.tags for p in pages]}
        self.firsts = {name: np.cumsum([0, *map(len, of)]) for name, of in kept.items()}
        self.numbers = {"links": self._flat([p.anchors for p in pages], _LINK_WIDTH)}
        self.deep = {}
        for at, name in enumerate(("tables", "rows", "cells", "centers")):
            self.firsts[name] = np.cumsum([0, *(len(p.elements[at]) // _WIDTH for p in pages)])
            self.numbers[name] = self._flat([p.elements[at] for p in pages], _WIDTH)
            self.deep[name] = np.zeros(self.firsts[name][-1], bool)
            for first, page in zip(self.firsts[name].tolist(), pages):
                if page.deep[at]:
                    self.deep[name][first + np.array(page.deep[at])] = True

    @staticmethod
    def _flat(pages: list[list[int]], width: int) -> list[np.ndarray]:
        return list(np.array([n for page in pages for n in page], dtype=np.int32).reshape(-1, width).T)

    def hrefs(self) -> pa.StringArray:
        return pa.array([h for p in self._pages for h in p.hrefs], pa.string())

    def tooltips(self) -> pa.StringArray:
        return pa.array([t for p in self._pages for t in p.tooltips], pa.string())

    def headings(self) -> np.ndarray:
        return np.array([t == "th" for p in self._pages for t in p.tags], bool)


def read_page(content: bytes | str | None) -> tuple[Page, str | None, list[str]]:
    """(lists, title that a script sets, note lines) of one page."""
    text = _text(content)
    page = Page()
    page.read(marks(text))
    return page, script_title(text), note_lines(tokens(text)) if "notes" in text.lower() else []


def _text(content: bytes | str | None) -> str:
    return content.decode("utf-8", errors="ignore") if isinstance(content, bytes) else content or ""


def script_title(text: str) -> str | None:
    """The title that a page's script sets."""
    script = _SCRIPT_TITLE.search(text) if "document.title" in text else None
    return script[1] if script else None


def title_of(found: list[tuple]) -> str | None:
    """A page's title, as ``Page.read`` finds it."""
    return next((unescape(t[2]) for t in found if t[1] and not t[4] and t[1].lower() == "title"), None)


def table_count(found: list[tuple]) -> int:
    """How many tables a page opens, as ``Page.read`` counts them."""
    return sum(1 for t in found if t[4] and not t[3] and t[4].lower() == "table" and t[5][:1] not in ("'", '"'))


# ---------------------------------------------------------------- pages of a batch at once

#: what ends a tag's name so that the tag keeps its kind
_ENDS_NAME = np.zeros(256, bool)
_ENDS_NAME[list(b" \t\n\r\f\v/>")] = True
#: what may follow the "<" of a token that is no text
_STARTS_TAG = np.zeros(256, bool)
_STARTS_TAG[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ/!?")] = True
_LT, _GT, _DOUBLE, _SINGLE, _STRANGE = 1, 2, 3, 4, 5
#: bytes that tokens are made of. Spaces beyond ASCII and letters that fold into ASCII ones are strange: a tag with them is left to ``Page``.
_BYTE = np.zeros(256, np.uint8)
_BYTE[[60, 62, 34, 39]] = _LT, _GT, _DOUBLE, _SINGLE
_BYTE[[0x1c, 0x1d, 0x1e, 0x1f, *range(0x80, 0x100)]] = _STRANGE
_LOWER = np.uint64(0x2020202020202020)
_TOKEN_BYTES = re.compile(_TOKENS.replace("{inside}", _QUOTED).encode(), re.S | re.I)
_KINDS_OF_BYTES = {name.encode(): kind for name, kind in _KINDS.items()}
_PAD = b"\0" * 16


def _word(name: bytes) -> tuple[np.uint64, np.uint64]:
    """A name as the low bytes of a number, and a mask for them."""
    return np.uint64(int.from_bytes(name, "little")), np.uint64((1 << 8 * len(name)) - 1)


_WORDS = [(name, kind, *_word(name.encode())) for name, kind in _KINDS.items()]
_RAW_WORDS = [_word(name) for name in (b"script", b"style", b"title")]


class Pages(Lists):
    """The flat lists of many pages, as ``Page`` makes them of each, worked out for all of them at once.

    ``odd`` tells the pages that are left to ``Page``: nested tables or centred parts, elements outside of those they belong to, lone "<",
    tags that never end, and tags with characters beyond ASCII. Their lists are not to be used.
    """

    def __init__(self, content: pa.StringArray) -> None:
        offsets = np.frombuffer(content.buffers()[1], np.int32)[content.offset:content.offset + len(content) + 1].astype(np.int64)
        data = content.buffers()[2]
        self.raw = (data[int(offsets[0]):int(offsets[-1])].to_pybytes() if data is not None else b"") + _PAD
        self.bytes = np.frombuffer(self.raw, np.uint8)
        self.starts, self.ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        self.count = len(content)
        self.odd = np.zeros(self.count, bool)
        self.titles: list[str | None] = [None] * self.count
        self._tokens()
        self._elements()
        self.pieces = self._unescaped(_cut(self.bytes, *self.text_at))

    # every token is a "<" that belongs to no other; the first one of a page stands for its start
    def _tokens(self) -> None:
        found = np.flatnonzero(_BYTE[self.bytes[:-len(_PAD)]])
        kinds = _BYTE[self.bytes[found]]
        at = np.flatnonzero(kinds == _LT)
        lt = found[at]
        page = np.repeat(np.arange(self.count), np.diff(np.searchsorted(lt, np.append(self.starts, self.ends[-1:]))))
        last = self.ends[page]
        # the next ">" of each, and what lies between
        next_gt = np.minimum.accumulate(np.where(kinds == _GT, np.arange(len(kinds)), len(kinds))[::-1])[::-1][at]
        ended = next_gt < len(kinds)
        to = np.where(ended, next_gt, at)
        close = found[to]
        ended &= close < last
        between = lambda kind: (total := np.cumsum(kinds == kind))[to] - total[at]
        quotes = between(_DOUBLE)
        hard = ~ended | (quotes % 2 == 1) | (between(_SINGLE) > 0) | (between(_LT) > 0)
        self.odd[page[(between(_STRANGE) > 0) & ended]] = True
        words = np.ndarray(len(self.raw) - 8, "<u8", self.raw, 0, (1,))[lt + 1]
        slash = (words & np.uint64(0xff)) == 0x2f
        names = np.where(slash, words >> np.uint64(8), words) | _LOWER
        ends = np.where(slash, 2, 1)
        kind = np.full(len(lt), _OTHER, np.int8)
        for name, code, word, mask in _WORDS:
            fits = np.flatnonzero((names & mask) == word)
            fits = fits[_ENDS_NAME[self.bytes[lt[fits] + ends[fits] + len(name)]]]
            kind[fits] = code
        kind[(kind == _SECTION) & slash] = _OTHER
        hard |= (words & np.uint64(0xffffff)) == int.from_bytes(b"!--", "little")
        for word, mask in _RAW_WORDS:
            hard |= ~slash & ((names & mask) == word)
        end = close + 1
        lone = ~_STARTS_TAG[self.bytes[lt + 1]] | (lt + 1 >= last)
        quotes[hard] = -1
        dropped, done = np.zeros(len(lt), bool), 0
        for i in np.flatnonzero(hard & ~lone).tolist():
            start = int(lt[i])
            if start < done:
                continue
            p = int(page[i])
            if not ended[i] and self.raw[start + 1:start + 4] != b"!--":
                self.odd[p], done = True, int(self.ends[p])
                continue
            match = _TOKEN_BYTES.match(self.raw, start, int(self.ends[p]))
            _, raw, inner, closes, tag, rest, gt, _ = match.groups(b"")
            end[i] = done = match.end()
            if not gt and (closes or tag or rest):
                self.odd[p], done = True, int(self.ends[p])
            code = _KINDS_OF_BYTES.get(tag.lower(), _OTHER)                 # as _mark() has it
            kind[i] = _OTHER if rest[:1] in (b"'", b'"') or (code == _SECTION and closes) else code
            slash[i] = bool(closes)
            if raw and self.titles[p] is None and raw.lower() == b"title":
                self.titles[p] = unescape(inner.decode())
            behind = i + 1
            while behind < len(lt) and lt[behind] < done:
                dropped[behind] = True
                behind += 1
        kept = np.flatnonzero(~dropped)
        self.odd[page[kept[lone[kept]]]] = True
        lt, end, kind, slash, page = lt[kept], end[kept], kind[kept], slash[kept], page[kept]
        # the starts of the pages come in between
        where = np.arange(len(lt)) + page + 1
        total = len(lt) + self.count
        self.heads = np.searchsorted(page, np.arange(self.count)) + np.arange(self.count)
        self.lt, self.end = np.empty(total, np.int64), np.empty(total, np.int64)
        self.kind, self.slash, self.head = np.full(total, _OTHER, np.int8), np.zeros(total, bool), np.zeros(total, bool)
        self.lt[where], self.end[where], self.kind[where], self.slash[where] = lt, end, kind, slash
        self.lt[self.heads], self.end[self.heads], self.head[self.heads] = self.starts, self.starts, True
        self.page = np.empty(total, np.int64)
        self.page[where], self.page[self.heads] = page, np.arange(self.count)
        self.quotes = np.full(total, -1, np.int64)
        self.quotes[where] = quotes[kept]
        text_end = np.append(self.lt[1:], self.ends[-1:])
        filled = text_end > self.end
        self.pieces_before = np.append(0, np.cumsum(filled))
        self.text_at = self.end[filled], text_end[filled]

    def _is_open(self, kind: int) -> np.ndarray:
        return (self.kind == kind) & ~self.slash

    def _next(self, among: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens that start an element, the next token of a set that has them too). Behind the last page stands one more token."""
        places = np.flatnonzero(among)
        which = np.flatnonzero(starts[places])
        return places[which], np.append(places, len(among))[which + 1]

    def _last(self, among: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The last token of a set before each of some others."""
        return np.maximum.accumulate(np.where(among, np.arange(len(among)), 0))[at - 1]

    def _elements(self) -> None:
        kind, slash, head, odd, page = self.kind, self.slash, self.head, self.odd, self.page
        opens = {k: self._is_open(k) for k in (_TABLE, _ROW, _CELL, _CENTER, _LINK, _SECTION)}
        of_table = (kind == _TABLE) | head
        start, end = self._next(of_table, opens[_TABLE])
        shut = np.append(kind == _TABLE, False)
        odd[page[start[shut[end] & ~np.append(slash, False)[end]]]] = True                     # a table in a table
        stray = np.flatnonzero((kind == _TABLE) & slash)
        odd[page[stray[~opens[_TABLE][self._last(of_table, stray)]]]] = True
        tables = start, end
        # a row ends with the next row, section or end of either
        of_row = of_table | (kind == _ROW) | opens[_SECTION]
        rows = start, end = self._next(of_row, opens[_ROW])
        odd[page[start[~opens[_TABLE][self._last(of_table, start)]]]] = True
        of_cell = of_row | (kind == _CELL)
        cells = start, end = self._next(of_cell, opens[_CELL])
        odd[page[start[~opens[_ROW][self._last(of_row, start)]]]] = True
        # centred parts of a cell end with it at the latest; those outside of all tables may hold tables
        centred = np.flatnonzero(kind == _CENTER)
        before = self._last(of_cell, centred)
        in_cell = opens[_CELL][before]
        outside = head[before] | ((kind[before] == _TABLE) & slash[before])
        odd[page[centred[~in_cell & ~outside]]] = True
        inner, outer = np.zeros(len(kind), bool), np.zeros(len(kind), bool)
        inner[centred[in_cell]] = True
        outer[centred[outside]] = True
        opens[_CENTER] &= inner | outer                          # those of odd pages may be neither
        found = [self._next(of_cell | inner, opens[_CENTER] & inner), self._next(head | outer, opens[_CENTER] & outer)]
        again = np.append(opens[_CENTER], False)
        for start, end in found:
            odd[page[start[again[end]]]] = True
        start, end = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(start, kind="stable")
        centers = start[order], end[order]
        # a link ends with the next one, its own end, or the end of any element
        stops = np.append((kind == _LINK) | head, True)
        for _, end in (tables, rows, cells, centers):
            stops[end] = True
        links = self._next(stops[:-1], opens[_LINK])
        of_kind = {"tables": (tables, _TABLE), "rows": (rows, _ROW), "cells": (cells, _CELL), "centers": (centers, _CENTER), "links": (links, _LINK)}
        # how many of each there are before a token
        before = {name: np.append(0, np.cumsum(opens[k])) for name, (_, k) in of_kind.items()}
        before["pieces"] = self.pieces_before
        self.firsts = {name: numbers[np.append(self.heads, len(kind))] for name, numbers in before.items()}
        self.numbers = {}
        for name, ((start, end), _) in of_kind.items():
            first = self.heads[page[start]]
            lists = ["pieces"] if name == "links" else ["pieces", "links", *([_BELOW[name]] if name in _BELOW else [])]
            self.numbers[name] = [(before[b][at] - before[b][first]).astype(np.int32) for b in lists for at in (start, end)]
        self.deep = {name: np.zeros(len(start), bool) for name, ((start, _), _) in of_kind.items()}
        self.cells, self.links = cells[0], links[0]

    def _unescaped(self, texts: pa.StringArray) -> pa.StringArray:
        escaped = pc.match_substring(texts, "&")
        if not pc.any(escaped).as_py():
            return texts
        return pc.replace_with_mask(texts, escaped, pa.array([unescape(t) for t in texts.filter(escaped).to_pylist()], pa.string()))

    def _attributes(self, tokens: np.ndarray, name_size: int, name: str, plain: np.ndarray | None = None) -> dict[int, str | None]:
        """An attribute of the tags that have any attributes, but of those where it has been read already; by place."""
        start = self.lt[tokens] + 1 + name_size
        asked = self.end[tokens] - 1 > start
        if plain is not None:
            asked &= ~plain
        out = {}
        for i in np.flatnonzero(asked).tolist():
            out[i] = _attribute(self.raw[int(start[i]):int(self.end[tokens[i]]) - 1].decode(errors="replace"), name)
        return out

    def hrefs(self) -> pa.StringArray:
        tokens = self.links
        start, end = self.lt[tokens] + 9, self.end[tokens] - 2          # <a href="...">
        words = np.ndarray(len(self.raw) - 8, "<u8", self.raw, 0, (1,))
        plain = (words[np.minimum(start - 7, len(words) - 1)] & np.uint64(0xffffffffffffff)) == int.from_bytes(b' href="', "little")
        plain &= (self.quotes[tokens] == 2) & (self.bytes[end] == 34) & (end >= start)
        texts = self._unescaped(_cut(self.bytes, start, np.where(plain, end, start)))
        if plain.all():
            return texts
        found = self._attributes(tokens, 1, "href", plain)
        return pc.replace_with_mask(texts, pa.array(~plain), pa.array([found.get(i) for i in np.flatnonzero(~plain).tolist()], pa.string()))

    def tooltips(self) -> pa.StringArray:
        tokens = self.cells
        found = self._attributes(tokens, 2, "onmouseover")
        out = pa.nulls(len(tokens), pa.string())
        told = np.zeros(len(tokens), bool)
        told[list(found)] = True
        return pc.replace_with_mask(out, pa.array(told), pa.array([found[i] for i in np.flatnonzero(told).tolist()], pa.string())) if found else out

    def headings(self) -> np.ndarray:
        return (self.bytes[self.lt[self.cells] + 2] | 0x20) == ord("h")

    def per_page(self, holding: bytes | re.Pattern, value: Callable, other):
        """``value`` of the text of the pages that hold some bytes, ``other`` of the rest."""
        out = [other] * self.count
        pattern = re.compile(re.escape(holding)) if isinstance(holding, bytes) else holding
        found = np.array([m.start() for m in pattern.finditer(self.raw)], np.int64)
        for p in np.unique(np.searchsorted(self.ends, found, side="right")).tolist():
            if p < self.count:
                out[p] = value(self.raw[int(self.starts[p]):int(self.ends[p])].decode())
        return out


#: columns of pages that are lists of elements
_LISTS = {"pieces", "links", "centers", "cells", "data", "rows", "tables"}


def _content(column: pa.Array) -> pa.StringArray:
    """Pages as text; bytes that are not UTF-8 are dropped."""
    try:
        return column.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([_text(content) for content in column.to_pylist()], pa.string())


def _one_by_one(doc_ids: pa.Array, content: pa.StringArray, schema: pa.Schema) -> pa.RecordBatch:
    """Pages that are read each on its own."""
    names = set(schema.names)
    has_elements = not names.isdisjoint(_LISTS)
    pages: list[Page] = []
    titles, scripts, notes, counts = [], [], [], []
    for text in content.to_pylist():
        text = text or ""
        noted = "notes" in names and "notes" in text.lower()
        found = tokens(text) if noted or (names & {"title", "n_tables"} and not has_elements) else []
        if has_elements:
            page = Page()
            page.read(marks(text))
            pages.append(page)
        if "title" in names:
            titles.append(pages[-1].title if has_elements else title_of(found))
        if "script_title" in names:
            scripts.append(script_title(text))
        if "notes" in names:
            notes.append(note_lines(found) if noted else [])
        if "n_tables" in names:
            counts.append(len(pages[-1].elements[0]) // _WIDTH if has_elements else table_count(found))
    columns = {"doc_id": doc_ids}
    if "title" in names:
        columns["title"] = pa.array(titles, pa.string())
    if "script_title" in names:
        columns["script_title"] = pa.array(scripts, pa.string())
    if "notes" in names:
        columns["notes"] = _strings(notes)
    if "n_tables" in names:
        columns["n_tables"] = pa.array(counts, pa.int32())
    if has_elements:
        lists = PageLists(pages)
        columns |= {name: lists.column(name, kind) for name, kind in zip(schema.names, schema.types) if name in _LISTS}
    return _as_batch(columns, schema)


def _as_batch(columns: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[n].cast(t) for n, t in zip(schema.names, schema.types)], schema=schema)


def _at_once(doc_ids: pa.Array, content: pa.StringArray, schema: pa.Schema) -> tuple[pa.RecordBatch, np.ndarray]:
    """Pages that are read together, and which of them have to be read each on its own."""
    found = Pages(content)
    columns = {"doc_id": doc_ids}
    for name, kind in zip(schema.names, schema.types):
        if name == "title":
            columns[name] = pa.array(found.titles, pa.string())
        elif name == "script_title":
            columns[name] = pa.array(found.per_page(b"document.title", script_title, None), pa.string())
        elif name == "notes":
            noted = lambda text: note_lines(tokens(text)) if "notes" in text.lower() else []
            columns[name] = _strings(found.per_page(re.compile(b"notes", re.I), noted, []))
        elif name == "n_tables":
            columns[name] = pa.array(np.diff(found.firsts["tables"]).astype(np.int32))
        elif name != "doc_id":
            columns[name] = found.column(name, kind)
    return _as_batch(columns, schema), found.odd


def batch_reader(schema: pa.Schema, rows_per_batch: int = 256) -> Callable:
    """Function for ``mapInArrow``: batches of (doc_id, content) to batches of parsed pages with the columns of ``schema``."""
    has_elements = not _LISTS.isdisjoint(schema.names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows_per_batch):
                part = batch.slice(start, rows_per_batch)
                doc_ids, content = part.column(0), _content(part.column(1))
                if not has_elements:
                    yield _one_by_one(doc_ids, content, schema)
                    continue
                pages, odd = _at_once(doc_ids, content, schema)
                if odd.any():
                    rest = _one_by_one(doc_ids.filter(pa.array(odd)), content.filter(pa.array(odd)), schema)
                    order = np.arange(len(odd))
                    order[odd] = len(odd) + np.arange(rest.num_rows)
                    pages = pa.concat_batches([pages, rest]).take(pa.array(order))
                yield pages

    return read
