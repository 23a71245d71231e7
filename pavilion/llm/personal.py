"""Personal data: patterns propose spans, checksums confirm them, words nearby move their score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

#: Kinds in the order in which spans with the same start are listed. The first four are the base: confirmed
#: by form and checksum alone. The others need a score of THRESHOLD.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone", "secret")
THRESHOLD = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# a match can't start inside a run of digits: what fails at the run's first digit fails at the others
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?![A-Za-z0-9+/_-])")

#: Score without context, and words within CONTEXT characters before a span (or after it) that move it.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.8, "iban": 0.9, "ssn": 0.35, "local_phone": 0.3, "secret": 0.2}
CONTEXT, UP, DOWN = 48, 0.35, 0.35
WORDS_FOR = {
    "email": "mail email contact write", "ip": "ip address host server login",
    "card": "card visa mastercard amex credit debit payment", "phone": "phone tel telephone mobile call cell fax",
    "iban": "iban account bank transfer konto cuenta compte", "ssn": "ssn social security number",
    "local_phone": "phone tel telephone mobile call cell fax telefon teléfono téléphone",
    "secret": "token secret password passwd api key apikey api_key bearer credential",
}
WORDS_AGAINST = {"ip": "version release build", "ssn": "part model order isbn", "card": "isbn order tracking", "local_phone": "isbn order part",
                 "secret": "checksum sha md5 commit digest"}
_WORD = re.compile(r"[^\W\d]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    code = "".join(str(int(c, 36)) for c in iban[4:] + iban[:4])
    return int(code) % 97 == 1


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` finds them, in linear time: from each @ outwards."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
        done = match.end() if match else at + 1
        at = text.find("@", done)


def _digits(text: str, start: int, end: int) -> str:
    return "".join(c for c in text[start:end] if "0" <= c <= "9")


def _base(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in _emails(text):
        yield "email", start, end
    for m in _IP.finditer(text):
        if all(map(_byte, m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(text, *m.span())) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(text, *m.span())) <= 15:
                yield "phone", m.start(), m.end()


def _added(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _IBAN.finditer(text):
        # capitals may follow in the same line, so shorter readings that end at a blank are tried as well
        groups, end = m[0].split(" "), len(m[0])
        while groups and not (15 <= len("".join(groups)) <= 34 and mod97("".join(groups))):
            end -= len(groups.pop()) + 1
        if groups:
            yield "iban", m.start(), m.start() + end
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", m.start(), m.end()
    for m in _LOCAL_PHONE.finditer(text):
        yield "local_phone", m.start(), m.end()
    for m in _SECRET.finditer(text):
        if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
            yield "secret", m.start(), m.end()


_FOR = {kind: frozenset(words.split()) for kind, words in WORDS_FOR.items()}
_AGAINST = {kind: frozenset(words.split()) for kind, words in WORDS_AGAINST.items()}


def score(kind: str, text: str, start: int, end: int) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - CONTEXT):start]) + _WORD.findall(text[end:end + CONTEXT])}
    up, down = bool(near & _FOR[kind]), bool(near & _AGAINST.get(kind, frozenset()))
    return min(1.0, max(0.0, PRIOR[kind] + UP * up - DOWN * down))


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score) of a text in code points, by start, then by kind as listed.

    Base spans stay whatever their score; an added one needs THRESHOLD and must not overlap a base span or an earlier added one.
    """
    if not text:
        return []
    found = [(kind, start, end, score(kind, text, start, end)) for kind, start, end in _base(text)]
    taken = bytearray()
    for kind, start, end in _added(text):
        if (value := score(kind, text, start, end)) < THRESHOLD:
            continue
        if not taken:
            taken = bytearray(len(text))
            for _, a, b, _ in found:
                taken[a:b] = b"\1" * (b - a)
        if taken.find(1, start, end) < 0:
            found.append((kind, start, end, value))
            taken[start:end] = b"\1" * (end - start)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str | None, found: list[tuple[str, int, int, float]]) -> str | None:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    if not found:
        return text
    parts, done, last = [], 0, None
    for kind, start, end, _ in found:
        if start >= done or last is None:
            parts += [text[done:start], f"<{kind.upper()}>"]
        done, last = max(done, end), kind
    return "".join([*parts, text[done:]])


def _listing(found: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end, _ in found)


FOUND = pa.schema([*[(f"n_{kind}", pa.int64()) for kind in BASE], ("base_sha256", pa.string()), ("spans", pa.string()),
                   ("scores", pa.list_(pa.float64()))])


def detect(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores (a score a span).

    Null and empty texts have no spans: counts 0, empty ``spans``. doc_id is passed through, so null and repeated ids keep their rows.
    Time is linear in a text's length. Empty table: no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows: list[list] = [[] for _ in FOUND]
                for text in part.column("text").to_pylist():
                    found = spans(text)
                    base = [s for s in found if s[0] in BASE]
                    values = [*[sum(s[0] == kind for s in base) for kind in BASE],
                              hashlib.sha256(_listing(base).encode()).hexdigest(), _listing(found), [s[3] for s in found]]
                    for column, value in zip(rows, values):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(rows, FOUND)]],
                                                 names=["doc_id", *FOUND.names])

    counts = ", ".join(f"n_{kind} long" for kind in BASE)
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id long, {counts}, base_sha256 string, spans string, scores array<double>")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``text`` replaced by their kinds, and n_chars, if there is such a column, counted again.

    No document is dropped; a text without spans, null or empty, and its n_chars stay as they are.
    """
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                columns = {name: part.column(name) for name in names}
                old = part.column("text").to_pylist()
                new = [redacted(text, spans(text)) for text in old]
                columns["text"] = pa.array(new, part.column("text").type)
                if "n_chars" in columns:
                    chars = [n if a is b else len(b) for n, a, b in zip(part.column("n_chars").to_pylist(), old, new)]
                    columns["n_chars"] = pa.array(chars, part.column("n_chars").type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return small_batches(docs).mapInArrow(run, schema)
