"""Periodic runs: stretches of a text in which a phrase is said several times in a row.

The suffixes of a text's words are sorted by doubling, their common prefixes follow from those few that the preceding word doesn't
already give, and the intervals of the LCP table are walked with a stack that holds no more than open intervals. In an interval of depth d
every suffix i outside the largest child asks the inverse suffix array whether i + d or i - d lies in the interval as well: two
neighbours that part ways after 2d words are a square that can't be moved to the right. Every run ends in one such square. Rotating
the squares to the left gives the runs, and those of one place merge into the one of the smallest period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, slices, small_batches
from .words import Words

#: A run has so many words at least, and so many times its period.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Comparisons of this many words are made for all pairs together; what is still equal then goes on pair by pair in growing blocks.
TOGETHER = 16
#: Bytes of text whose suffixes are sorted together (a longer text is on its own).
SORTED_BYTES = 1 << 20


def suffix_array(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, place of each) of many texts at once: text i is ``symbols[bounds[i]:bounds[i + 1]]``, symbols from 0.

    Texts follow one another; within a text a suffix that ends comes before one that goes on. Only suffixes that are still
    tied are sorted again when the compared length doubles.
    """
    n = len(symbols)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = bounds[1:][owner] if n else np.zeros(0, dtype=np.int64)
    key = owner * (int(symbols.max()) + 1 if n else 1) + symbols
    order = np.argsort(key, kind="stable")
    places = np.arange(n)

    def heads(sorted_keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        new = np.ones(len(at), dtype=bool)
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        return np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))

    first = heads(key[order], places)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = first
    tied = np.zeros(n, dtype=bool)
    tied[1:] = first[1:] == first[:-1]
    tied[:-1] |= tied[1:].copy()
    slots, step = places[tied], 1
    while len(slots):
        some = order[slots]
        after = some + step
        inside = after < end[some]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        keys = rank[some] * (n + 1) + second
        by = np.argsort(keys, kind="stable")
        some, keys = some[by], keys[by]
        order[slots] = some
        group = heads(keys, slots)
        rank[some] = slots[group]
        tied = np.zeros(len(slots), dtype=bool)
        tied[1:] = group[1:] == group[:-1]
        tied[:-1] |= tied[1:].copy()
        slots, step = slots[tied], step * 2
    return order, rank


def _agree(symbols: np.ndarray, a: int, b: int, limit: int) -> int:
    """Number of equal symbols from a and b on (backwards for a negative ``limit``), ``limit`` at most, in growing blocks."""
    done, block, total = 0, 64, abs(limit)
    while done < total:
        size = min(block, total - done)
        if limit > 0:
            differ = symbols[a + done:a + done + size] != symbols[b + done:b + done + size]
        else:
            differ = (symbols[a - done - size:a - done] != symbols[b - done - size:b - done])[::-1]
        if differ.any():
            return done + int(differ.argmax())
        done, block = done + size, block * 2
    return total


def _extend(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray, sign: int) -> np.ndarray:
    """For every pair of places, how many symbols agree from there on (``sign`` 1) or before them (-1), ``room`` at most."""
    out = np.zeros(len(a), dtype=np.int64)
    alive = np.flatnonzero(room > 0)
    for k in range(TOGETHER):
        if not len(alive):
            return out
        shift = k if sign > 0 else -k - 1
        same = symbols[a[alive] + shift] == symbols[b[alive] + shift]
        out[alive[same]] += 1
        alive = alive[same]
        alive = alive[room[alive] > k + 1]
    for i in alive.tolist():
        left = int(room[i]) - TOGETHER
        out[i] += _agree(symbols, int(a[i]) + sign * TOGETHER, int(b[i]) + sign * TOGETHER, sign * left)
    return out


def common_prefixes(symbols: np.ndarray, bounds: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length that each suffix shares with the one before it in ``order`` (0 for the first of a text).

    Where the words before both agree, it is one less than that of the suffix one word earlier; the others are compared, which is
    O(n log n) work in all.
    """
    n = len(symbols)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    before = np.full(n, -1, dtype=np.int64)
    if n:
        before[order[1:]] = order[:-1]
    valid = before >= 0
    valid[valid] = owner[before[valid]] == owner[valid]
    at = np.arange(n)
    start, end = (bounds[:-1][owner], bounds[1:][owner]) if n else (at, at)
    follows = valid & (at > start) & (before > start)
    follows[follows] = symbols[at[follows] - 1] == symbols[before[follows] - 1]
    asked = np.flatnonzero(valid & ~follows)
    own = np.zeros(n, dtype=np.int64)
    own[asked] = _extend(symbols, asked, before[asked], end[asked] - np.maximum(asked, before[asked]), 1)
    source = np.maximum.accumulate(np.where(follows, 0, at)) if n else at
    return (own[source] - (at - source))[order]


def intervals(lcp: list[int]) -> tuple[np.ndarray, ...]:
    """LCP intervals (depth, low, high, largest child's low, its high), ends exclusive; only open intervals are held."""
    out: list[tuple[int, int, int, int, int]] = []
    stack: list[list[int]] = []  # depth, low, low of the open child, largest closed child's low, its high
    for j, shared in enumerate(lcp):
        if not shared and not stack:
            continue
        low = j - 1
        while stack and stack[-1][0] > shared:
            depth, low, child, best, best_end = stack.pop()
            out.append((depth, low, j, child, j) if j - child > best_end - best else (depth, low, j, best, best_end))
        if not shared:
            continue
        if stack and stack[-1][0] == shared:
            top = stack[-1]
            if j - top[2] > top[4] - top[3]:
                top[3], top[4] = top[2], j
            top[2] = j
        else:
            stack.append([shared, low, j, low, j])
    n = len(lcp)
    while stack:
        depth, low, child, best, best_end = stack.pop()
        out.append((depth, low, n, child, n) if n - child > best_end - best else (depth, low, n, best, best_end))
    return tuple(np.array(out, dtype=np.int64).reshape(-1, 5).T)


def squares(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all squares that can't be moved one word to the right, each once."""
    order, rank = suffix_array(symbols, bounds)
    depth, low, high, big, big_end = intervals(common_prefixes(symbols, bounds, order).tolist())
    n = len(symbols)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts, periods = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    # suffixes outside the largest child: those before it and those after it
    lows, sizes = np.concatenate([low, big_end]), np.concatenate([big - low, high - big_end])
    which = np.concatenate([np.arange(len(depth))] * 2) if len(depth) else np.zeros(0, dtype=np.int64)
    which = np.repeat(which, sizes)
    places = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lows, sizes)
    suffix, d = order[places], depth[which]
    for first in (suffix, suffix - d):
        partner = np.where(first == suffix, first + d, first)  # the one that isn't the asking suffix
        inside = (partner >= 0) & (partner < n)
        inside[inside] = owner[partner[inside]] == owner[suffix[inside]]
        inside[inside] = (rank[partner[inside]] >= low[which[inside]]) & (rank[partner[inside]] < high[which[inside]])
        i, p = first[inside], d[inside]
        past = i + 2 * p
        differ = past >= bounds[1:][owner[i]]
        differ[~differ] = symbols[past[~differ]] != symbols[past[~differ] - p[~differ]]
        starts.append(i[differ])
        periods.append(p[differ])
    both = np.unique(np.stack([np.concatenate(starts), np.concatenate(periods)], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def runs_of(symbols: np.ndarray, bounds: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows (text, start in it, length, smallest period), by text, start and period; ``least_exponent`` is 2 or more."""
    start, period = squares(symbols, bounds)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = start + 2 * period
    by = np.lexsort((period, end))
    start, period, end = start[by], period[by], end[by]
    found = [np.zeros((0, 4), dtype=np.int64)]
    while len(start):
        head = np.ones(len(end), dtype=bool)
        head[1:] = end[1:] != end[:-1]
        s, p, e = start[head], period[head], end[head]
        text = owner[s]
        s = s - _extend(symbols, s, s + p, s - bounds[:-1][text], -1)
        long = (e - s >= least_length) & (e - s >= least_exponent * p)
        found.append(np.stack([text, s - bounds[:-1][text], e - s, p], axis=1)[long])
        # squares of a multiple of the period that lie inside the run are the run itself
        group = np.cumsum(head) - 1
        left = ~head & ((period % p[group] != 0) | (start < s[group]))
        start, period, end = start[left], period[left], end[left]
    rows = np.concatenate(found)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def rejoined(words: Words, gone: np.ndarray) -> pa.StringArray:
    """For every text its words, but those ``gone``, joined by one blank."""
    kept = np.flatnonzero(~gone)
    owner = np.searchsorted(words.first, kept, side="right")
    joins = np.zeros(len(kept), dtype=bool)
    joins[:-1] = owner[1:] == owner[:-1]
    edge = np.zeros(len(words.data) + 1, dtype=np.int8)
    edge[words.start[kept]] += 1
    edge[words.end[kept]] -= 1
    stays = np.cumsum(edge[:-1], dtype=np.int8) > 0
    blank = words.end[kept[joins]]  # another word of the text follows, so the byte after this one is white space of the text
    stays[blank] = True
    data = words.data.copy()
    data[blank] = 0x20
    offsets = np.concatenate([[0], np.cumsum(stays)])[words.offsets]
    text = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[stays].tobytes()))
    return text.cast(pa.string())


def find_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """One row a document: doc_id, n_words, runs (array of start, length, period, in that order), collapsed.

    A run is a stretch of words in which words ``period`` apart are the same, with ``period`` the smallest such number, that no neighbouring word
    continues; it has ``least_length`` words and ``least_exponent`` (2 or more) periods at least. ``collapsed`` is the text's words joined by one blank
    without those that a run says again, that is, all that lie in a run after its first period.

    No shuffle: a document is worked on where it lies, whole. Null and empty texts have no words, no runs and an empty ``collapsed``. Runs of different
    periods may overlap. Repeated rows and null doc_ids are documents of their own. Empty table: no rows. Words are compared by 64-bit hashes.
    """
    if least_exponent < 2:
        raise ValueError("a run says its period twice at least")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SORTED_BYTES):
                words = Words(part.column("text"))
                symbols = np.unique(words.hashes, return_inverse=True)[1].astype(np.int64)
                found = runs_of(symbols, words.first, least_length, least_exponent)
                change = np.zeros(len(words) + 1, dtype=np.int64)
                at = words.first[found[:, 0]] + found[:, 1]
                np.add.at(change, at + found[:, 3], 1)
                np.add.at(change, at + found[:, 2], -1)
                offsets = np.searchsorted(found[:, 0], np.arange(part.num_rows + 1))
                items = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in (1, 2, 3)], fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(words.first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), items),
                     rejoined(words, np.cumsum(change[:-1]) > 0)], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document (by crc32 of its id) says one of its own phrases again and again up to its end.

    With g = crc32 // 10 and n words, the words from g % n on repeat the first 1 + (n - g % n) // (3 + g % 8) of them. A null doc_id is never chosen.
    """
    crc = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    g, n = F.floor(crc / 10).cast("long"), F.size("w").cast("long")
    a = F.pmod(F.col("g"), n)
    chosen = rows.where(F.pmod(crc, F.lit(10)) == 0).select("doc_id", words.alias("w"), g.alias("g"), "text").where("w IS NOT NULL AND size(w) > 0")
    chosen = chosen.select("doc_id", "w", a.alias("a"), (F.lit(1) + F.floor((n - a) / (F.col("g") % 8 + 3))).cast("long").alias("p"))
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.size("w").cast("long") - 1),
                        lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int")))
    chosen = chosen.select("doc_id", F.array_join(again, " ").alias("text"))
    plain = rows.where(F.coalesce(F.pmod(crc, F.lit(10)) != 0, F.lit(True)) | F.col("text").isNull() | ~F.col("text").rlike(WORD))
    return plain.unionByName(chosen)
