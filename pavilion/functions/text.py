"""Text, numbers read from text, and keys."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed

#: every Unicode space, and the separators \x1c to \x1f
_SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\x1c\x1d\x1e\x1f"
_NUMBER = r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^[+-]?(nan|inf|infinity)$"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Trim every Unicode space, not only blanks. Most texts start and end with a visible ASCII character, which is seen far faster than
    that none of the spaces is there."""
    value = as_col(value)
    end = F.substring(value, -1, 1)
    visible = (value >= "!") & (value < "\x7f") & (end >= "!") & (end < "\x7f")
    return F.when(visible, value).otherwise(F.btrim(value, F.lit(_SPACES)))


def clean_text(value: Column | str) -> Column:
    """Trimmed text, non-breaking spaces made plain, NULL made empty."""
    return F.coalesce(F.replace(strip(value), F.lit("\u00a0"), F.lit(" ")), F.lit(""))


def blank_default(*values: Column | str) -> Column:
    """First value that is neither NULL nor empty; the last one is taken as it is."""
    *tried, last = [as_col(v) for v in values]
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in tried], last)


def is_blank(value: Column | str) -> Column:
    return F.coalesce(as_col(value).cast("string") == "", F.lit(True))


def first_group(value: Column | str, pattern: str, group: int = 1) -> Column:
    """Group of the first match, NULL when there is none."""
    return F.nullif(F.regexp_extract(as_col(value), pattern, group), F.lit(""))


def contains_any(value: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [value.contains(w) for w in words])


def has_word(value: Column, word: str) -> Column:
    """Does ``value`` hold ``word``, which is lower-case, in any case? What holds it as it stands needs no more; only what may hold it is lowered, which is slow."""
    return value.contains(word) | (value.rlike(f"(?iu){re.escape(word)}") & F.contains(F.lower(value), F.lit(word)))


def strip_tags(value: Column | str) -> Column:
    """P20: text without markup."""
    return F.regexp_replace(as_col(value), "<[^>]+>", "")


def _digits(value: Column | str) -> Column:
    return strip(F.replace(F.replace(as_col(value), F.lit("-"), F.lit("")), F.lit(","), F.lit("")))


def lenient_int(value: Column | str) -> Column:
    """``-`` and ``,`` dropped; anything that is not a whole number is 0. A failing cast costs an exception, so empty cells are not cast."""
    return F.coalesce(F.nullif(_digits(value), F.lit("")).try_cast("int"), F.lit(0))


def lenient_double(value: Column | str) -> Column:
    """As :func:`lenient_int`, for decimals."""
    text = _digits(value)
    return F.coalesce(F.when(text.rlike(_NUMBER), text.try_cast("double")), F.lit(0.0))


def _cell_text(value: Column | str) -> Column:
    text = as_col(value).cast("string")
    for noise in ("*", "-", "DNB"):
        text = F.replace(text, F.lit(noise), F.lit(""))
    return strip(text)


def cell_double(value: Column | str, default: float = 0.0) -> Column:
    """Number in a leaderboard cell; ``*``, ``-`` and DNB are noise."""
    text = _cell_text(value)
    number = F.when(text.rlike(_NUMBER) & (F.lower(text) != "nan"), text.try_cast("double"))
    return F.coalesce(number, F.lit(float(default)))


def cell_int(value: Column | str, default: int = 0) -> Column:
    """Whole part of a leaderboard cell."""
    text = _cell_text(value)
    number = F.when(text.rlike(_NUMBER) & (F.lower(text) != "nan"), text.try_cast("double"))
    return F.coalesce(number.try_cast("int"), F.lit(int(default)))


def round2(value: Column | str) -> Column:
    """Two decimals, rounded on the exact binary value with ties to even.

    Spark's own ``round`` works on the shortest decimal text of the double and rounds
    ties away from zero, which gives 2.68 for 2.675; the exact value gives 2.67. Only values
    that come close to a tie need the exact text, the others are rounded arithmetically.
    Infinity and NaN stay as they are.
    """
    value = as_col(value).cast("double")
    cents = value * 100.0
    near = F.rint(cents)
    plain = (near + 0.0) / 100.0  # no negative zero
    # what has no such text is infinite or NaN
    exact = F.coalesce(F.call_function("format_number", value, F.lit("0.00")).try_cast("double"), value)
    return F.when((F.abs(value) < 1e7) & (F.abs(cents - near) < 0.5 - 1e-6), plain).otherwise(exact)


def sql_text(value) -> str:
    """A fixed value as SQL; one parse is cheaper than a call per literal of a table."""
    if isinstance(value, dict):
        return f"map({', '.join(sql_text(x) for item in value.items() for x in item)})"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(sql_text(x) for x in value)})"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value}D" if isinstance(value, float) else str(value)


def literal_lookup(table: dict, key: Column | str) -> Column:
    """Value of ``key`` in a small fixed table, NULL when it is not listed."""
    return F.try_element_at(F.expr(sql_text(table)), as_col(key))


def lookup(table: dict, key: Column | str, default) -> Column:
    """Dictionary lookup with a default."""
    other = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(literal_lookup(table, key), other)


def row_key(*values: Column | str) -> Column:
    """P25: key that depends on the row alone, so a second load gives the same keys."""
    texts = [F.coalesce(as_col(v).cast("string"), F.lit("\u0000")) for v in values]
    return F.sha2(F.concat_ws("\u001f", *texts), 256)


def prefix_id(prefix: str, value: Column | str) -> Column:
    """Id marked with its source."""
    return F.concat(F.lit(prefix), as_col(value).cast("string"))


def shard(value: Column | str) -> Column:
    """Directory shard of an id."""
    value = as_col(value)
    return F.when(F.length(value) > 4, F.substring(value, 1, 4)).otherwise(F.substring(value, 1, 3))


def numeric_rank(value: Column | str) -> Column:
    """L3: numeric order of a text id, 0 when it is not made of digits."""
    value = as_col(value)
    return F.when(value.rlike(r"^\d+\z"), value.try_cast("decimal(38,0)")).otherwise(F.lit(0))


def url_entity_id(url: Column | str, kind: str) -> Column:
    """Id of the player, team, tournament or ground a link points to."""
    return F.coalesce(*[first_group(url, p) for p in fixed.ENTITY_URL_PATTERNS[kind]])


def slug(name: Column | str, team: Column | str) -> Column:
    """Readable player id with the team as suffix."""
    base = F.regexp_replace(F.replace(F.lower(as_col(name)), F.lit(" "), F.lit("_")), "[^a-z0-9_]", "")
    return F.concat(base, F.lit("_"), F.lower(as_col(team)))
