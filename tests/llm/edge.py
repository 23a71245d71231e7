"""Small tables with every odd case: nulls in any column, empty and long texts, ties, repeated rows, columns with clashing names."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside; a table may have them as well.
CLASHING = ("size", "n", "node", "component", "label", "key", "digest", "taken", "anchor", "position", "rank", "share", "copies", "place", "tag", "words",
            "features", "score", "first", "sha", "payload", "block", "other", "wide", "_text", "_letters", "_lang", "_bits",
            "_kept_0", "_kept_5", "_score", "_unseen", "digest", "kind", "row", "turns", "tie", "ids", "runs", "collapsed", "w", "g", "p", "a")


def with_clashes(df, of="documents"):
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHING if c not in df.columns})


def documents(spark, rows):
    return with_clashes(spark.createDataFrame(rows, DOCS))


def odd_documents(spark):
    words = " ".join(f"word{i}" for i in range(400))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n ", None, None, 4), (None, "no id here at all today", "en", "b", 5),
        (4, words, "en", "a", None), (5, words, "en", None, len(words)), (5, words, "en", None, len(words)), (6, "one", None, "b", 3),
        (7, "x" * 200_000, "de", "b", 200_000), (8, "many words " * 20_000, "fr", "b", 1), (None, None, None, None, None), (None, words, "en", "c", 2),
        (9, "Ärger über Öl 　 und 東京\x00 end", "de", "c", 9), (-3, "negative id with five words here", "en", "a", 1),
    ]
    return documents(spark, rows)


def empty_documents(spark):
    return documents(spark, [])


def rows(df):
    return [r.asDict() for r in df.collect()]
