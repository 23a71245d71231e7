"""Personal data: the base as the plain patterns find it, checksums, context, redaction."""

import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from pavilion.llm import personal
from pavilion.llm.common import table

from .edge import empty_documents, odd_documents, rows

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits)
                    or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], list(PLAIN).index(s[0])))


def test_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = rows(personal.detect(docs))
    assert len(found) == len(texts) and sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in found) > 0
    for r in found:
        want = base(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in want) for k in PLAIN]
        listing = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(listing.encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(listing.split(",") if listing else []) <= set(spans) and len(r["scores"]) == len(spans)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("a1.@%+-_ ()0259\né")), max_size=60))
def test_base_is_the_plain_patterns(text):
    assert [s[:3] for s in personal.spans(text) if s[0] in personal.BASE] == base(text)


def test_checksums_and_context():
    def kinds(text):
        return [(k, text[a:b]) for k, a, b, _ in personal.spans(text)]

    assert ("card", "4111 1111 1111 1111") in kinds("pay 4111 1111 1111 1111 now")
    assert kinds("pay 4111 1111 1111 1112 now") == []
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32 AND MORE") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 33") == []
    assert kinds("call (659) 555-3949 today") == [("local_phone", "(659) 555-3949")] and kinds("item (659) 555-3949") == []
    assert kinds("SSN 123-45-6789") == [("ssn", "123-45-6789")] and kinds("part 123-45-6789") == []
    low, high = (personal.spans(t)[0][3] for t in ("version 1.2.3.4", "host 1.2.3.4"))
    assert low < high


def test_long_texts_take_linear_time():
    for text in ("a" * 500_000, "1" * 500_000, "a@" * 200_000, "1." * 200_000, "+1 " * 150_000, "1 " * 200_000, "A1 " * 150_000, "12-" * 150_000):
        start = time.time()
        personal.spans(text)
        assert time.time() - start < 5


def test_redaction(spark):
    text = "mail jo@x.org or +1 (659) 555-3949"
    assert personal.redacted(text, personal.spans(text)) == "mail <EMAIL> or <PHONE>"
    docs = odd_documents(spark)
    out = personal.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    sort = lambda df: sorted(map(str, df.collect()))
    assert sort(out) == sort(docs)  # nothing to redact: rows stay as they are
    found = rows(personal.detect(docs))
    assert len(found) == docs.count() and all(r["spans"] == "" for r in found)
    assert personal.detect(empty_documents(spark)).count() == personal.redact(empty_documents(spark)).count() == 0
