"""Recurring passages across documents, located by sharded Aho-Corasick automata.

A window is WINDOW consecutive words. Every window is filed under its anchor, the run of ANCHOR words in it with the least hash (the first of
equals), so equal windows have equal anchors, and neighbouring windows mostly share theirs: one anchor stands for several windows. Only
anchors that occur in two documents or more can hold a recurring window; that keeps all other text out of the exchange.

The windows below the remaining anchors are dealt to shards by anchor. A shard confirms which of its windows recur, compiles them into an automaton
over words and streams all its passages through it; each hit names the first document that has the window. Windows that a document repeats
itself are found inside the document, and documents with the same words throughout are found by a digest before all that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import partitions, slices, small_batches
from .words import U, Words, grams, mix

WINDOW, ANCHOR = 20, 7
#: Passages of a shard that are compiled together, at the end of an anchor.
SHARD = 4_000
#: An anchor in more documents than this is not gathered in a shard; its windows are confirmed by Spark's aggregation.
HOT = 20_000
#: Stands for a null doc_id.
LAST = (1 << 63) - 1
#: Words of a shard are numbered from here on; the number below separates passages.
FIRST_WORD = 0x10001


def anchored(words: Words, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, hash of its anchor, number of its text) for all windows of all texts."""
    h, n = words.hashes, len(words) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    runs = grams(h, anchor)
    least = runs[:n].copy()
    for k in range(1, window - anchor + 1):
        np.minimum(least, runs[k:k + n], out=least)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    at = np.flatnonzero(text[:n] == text[window - 1:])
    return at, least[at], text[at]


def repeated(at: np.ndarray, hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether a window's hash occurs earlier in its own text."""
    out = np.zeros(len(at), dtype=bool)
    key = hashes ^ mix(text.astype(np.uint64) + U(1))
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if len(twice):  # few windows, as a rule
        some = np.flatnonzero(np.isin(key, twice))
        order = some[np.argsort(key[some], kind="stable")]
        out[order[1:]] = key[order[1:]] == key[order[:-1]]
    return out


def changes(*columns: np.ndarray) -> np.ndarray:
    """Rows at which any of the columns differs from the row before."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = False
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def joined(words: Words, gone: np.ndarray | None = None) -> list[str]:
    """For every text the SHA-256, in hexadecimal, of its words (but those ``gone``) joined by one blank."""
    start, end = (words.start, words.end) if gone is None else (words.start[~gone], words.end[~gone])
    inner = end[~np.isin(end, words.offsets)]  # these are followed by a byte of their own text, which becomes the blank
    edge = np.zeros(len(words.data) + 1, dtype=np.int8)
    edge[start] += 1
    edge[end] -= 1
    kept = np.cumsum(edge[:-1], dtype=np.int8) > 0
    kept[inner] = True
    data = words.data.copy()
    data[inner] = 0x20
    at = np.concatenate([[0], np.cumsum(kept)])[words.offsets].tolist()
    data = data[kept].tobytes()
    return [hashlib.sha256(data[a:b].rstrip(b" ")).hexdigest() for a, b in zip(at, at[1:])]


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"))
            first = words.first.tolist()
            at, anchor, text = anchored(words)
            own = repeated(at, grams(words.hashes, WINDOW)[at], text)
            own_text = text[own]
            some = changes(text, anchor)
            anchor, text = anchor[some], text[some]
            order = np.lexsort((anchor, text))
            anchor, text = anchor[order], text[order]
            some = changes(text, anchor)
            anchor, text = anchor[some], text[some]
            offsets = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
            digests = [hashlib.md5(words.hashes[a:b].tobytes()).digest() for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("tag"), pa.array(np.diff(words.first).astype(np.int64)), pa.array(joined(words)),
                pa.array(digests, pa.binary()), pa.array(np.bincount(own_text, minlength=part.num_rows) > 0),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(anchor.view(np.int64)))],
                names=["doc_id", "tag", "n_words", "sha", "digest", "repeats", "anchors"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows below one recurring anchor: (anchor, doc_id, tag, start, words as 32-bit hashes, hot, window hashes of hot ones)."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"))
            at, anchor, text = anchored(words)
            hashes = grams(words.hashes, WINDOW)[at]
            fresh = ~repeated(at, hashes, text)
            # a text and an anchor as one number; a chance meeting would only add a passage that is not confirmed
            column = part.column("anchors")
            of = np.repeat(np.arange(part.num_rows), column.value_lengths().to_numpy(zero_copy_only=False))
            known = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ mix(of.astype(np.uint64) + U(1))
            hot = np.asarray(part.column("hot").flatten().to_numpy(zero_copy_only=False), dtype=bool)
            order = np.argsort(known)
            known, hot = known[order], hot[order]
            some = changes(text, anchor)
            place = np.searchsorted(known, anchor[some] ^ mix(text[some].astype(np.uint64) + U(1)))
            place[place == len(known)] = 0
            found = known[place] == anchor[some] ^ mix(text[some].astype(np.uint64) + U(1)) if len(known) else np.zeros(len(some), dtype=bool)
            sizes = np.diff(np.append(some, len(at)))
            keep = np.repeat(found, sizes) & fresh
            at, anchor, text, hashes = at[keep], anchor[keep], text[keep], hashes[keep]
            hot = np.repeat(hot[place], sizes)[keep] if len(known) else keep[keep]
            begin = changes(text, anchor, at - np.arange(len(at)))
            end = np.append(begin[1:], len(at))[:len(begin)]
            hot, text = hot[begin], text[begin]
            words_in = np.where(hot, 0, end - begin + WINDOW - 1)
            windows_in = np.where(hot, end - begin, 0)
            yield pa.RecordBatch.from_arrays([
                pa.array(anchor[begin].view(np.int64)), part.column("doc_id").take(pa.array(text)), part.column("tag").take(pa.array(text)),
                pa.array(at[begin] - words.first[text]), _lists(words.hashes.astype(np.uint32), at[begin], words_in, binary=True, null=hot),
                _lists(hashes.view(np.int64), begin, windows_in, binary=False, null=~hot)],
                names=["anchor", "doc_id", "tag", "start", "words", "windows"])


def _lists(values: np.ndarray, begin: np.ndarray, sizes: np.ndarray, binary: bool, null: np.ndarray) -> pa.Array:
    """values[b:b + n] for every b and n, as binaries or lists."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    flat = values[np.repeat(begin - offsets[:-1], sizes) + np.arange(offsets[-1])]
    if binary:
        valid = pa.array(~null).buffers()[1]
        width = values.dtype.itemsize
        return pa.Array.from_buffers(pa.binary(), len(begin), [valid, pa.py_buffer((offsets * width).astype(np.int32)), pa.py_buffer(flat)])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat), mask=pa.array(null))


def locate(anchors: list[int], docs: list[int], starts: list[int], words: list[bytes], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """Occurrences of recurring windows that are not in their first document: (passage, first and last start of a run of windows).

    Passages come by anchor, then by doc_id. Equal passages are one; a passage of two documents is confirmed as a whole, and a window
    is confirmed by itself if different passages share it. What is confirmed is compiled, with the first document that has it, and all passages are streamed.
    """
    import ahocorasick

    number, kinds, owner, several, of_anchor = {}, [], [], [], {}
    for anchor, doc, passage in zip(anchors, docs, words):
        k = number.setdefault(passage, len(kinds))
        if k == len(kinds):
            owner.append(doc)
            several.append(False)
            of_anchor.setdefault(anchor, []).append(k)
            kinds.append(k)
        elif owner[k] != doc:
            several[k] = True
    passages = list(number)
    sizes = np.array([len(p) // 4 for p in passages])
    _, code = np.unique(np.frombuffer(b"".join(passages), dtype=np.uint32), return_inverse=True)
    stops = np.cumsum(sizes + 1) - 1
    text = np.full(int(stops[-1]) + 1, FIRST_WORD - 1, dtype="<u4")
    inside = np.ones(len(text), dtype=bool)
    inside[stops] = False
    text[inside] = code + FIRST_WORD
    text = text.tobytes().decode("utf-32-le")
    begins, ends = (stops - sizes).tolist(), stops.tolist()
    automaton = ahocorasick.Automaton()
    for k, more in enumerate(several):
        if more:
            automaton.add_word(text[begins[k]:ends[k]], (owner[k], int(sizes[k]) - window + 1))
    for group in of_anchor.values():
        first: dict[str, int] = {}
        for k in group if len(group) > 1 else ():
            for i in range(begins[k], ends[k] - window + 1):
                key = text[i:i + window]
                if (one := first.setdefault(key, k)) != k:
                    automaton.add_word(key, (owner[one], 1))
    if not len(automaton):
        return []
    automaton.make_automaton()
    # the first document of every window of every different passage
    slots = np.concatenate([[0], np.cumsum(sizes - window + 1)])
    least = np.full(int(slots[-1]), LAST, dtype=np.int64)
    hits = [(end, doc, n) for end, (doc, n) in automaton.iter(text)]
    end, doc, n = (np.array(c) for c in zip(*hits))
    kind = np.searchsorted(stops, end)
    last = slots[kind] + end - (stops - sizes)[kind] - (window - 1)
    np.minimum.at(least, np.repeat(last - n + 1 - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())), np.repeat(doc, n))
    kind = np.array([number[p] for p in words])
    n = (sizes - window + 1)[kind]
    before = np.cumsum(n) - n
    piece = np.repeat(np.arange(len(kind)), n)
    nth = np.arange(len(piece)) - before[piece]
    gone = np.array(docs)[piece] > least[slots[kind][piece] + nth]
    piece, start = piece[gone], (np.array(starts)[piece] + nth)[gone]
    begin = changes(piece, start - np.arange(len(start)))
    return list(zip(piece[begin].tolist(), start[begin].tolist(), start[np.append(begin[1:], len(start))[:len(begin)] - 1].tolist()))


RUNS = "doc_id long, tag long, low long, high long"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, doc_id): compile and stream them a few thousand passages at a time, whole anchors each."""
    def result(held: list[tuple]) -> pa.RecordBatch:
        anchors, docs, tags, starts, words = map(list, zip(*held)) if held else [[]] * 5
        found = [(docs[i], tags[i], low, high) for i, low, high in (locate(anchors, docs, starts, words) if len(held) > 1 else [])]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], names=["doc_id", "tag", "low", "high"])

    held, anchor = [], None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("anchor", "doc_id", "tag", "start", "words")]
        for row in zip(*columns):
            if row[0] != anchor and len(held) >= SHARD:
                yield result(held)
                held = []
            anchor = row[0]
            held.append(row)
    yield result(held)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the words that repeated windows cover: those found elsewhere (runs of starts) and those the text repeats itself."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"))
            at, _, text = anchored(words)
            own = repeated(at, grams(words.hashes, WINDOW)[at], text)
            covered = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(covered, at[own], 1)
            np.add.at(covered, at[own] + WINDOW, -1)
            for i, runs in enumerate(part.column("runs").to_pylist()):
                for run in runs or ():
                    covered[words.first[i] + run["low"]] += 1
                    covered[words.first[i] + run["high"] + WINDOW] -= 1
            gone = np.cumsum(covered)[:-1] > 0
            counts = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tag"), pa.array(counts.astype(np.int64)), pa.array(joined(words, gone))],
                                             names=["doc_id", "tag", "removed", "kept"])


def remove_repeated(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256.

    A word is removed if a window of 20 words that covers it also starts earlier, in a document of smaller doc_id or earlier in its own; all windows are
    judged on the input. Texts of fewer than 20 words lose nothing; null and empty texts have no words (the hash is that of the empty text). A null doc_id
    sorts last. Rows that repeat a doc_id are neither earlier nor later than one another. Empty table: no rows.

    Windows are compared as sequences of 32-bit word hashes below a 64-bit anchor. Memory: a task holds one batch, or the passages of
    ``SHARD`` and one anchor of at most ``HOT`` documents.
    """
    n = partitions(docs.sparkSession)
    name = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id")
    texts = small_batches(docs).select(name, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    profile = texts.mapInArrow(_profile, "doc_id long, tag long, n_words long, sha string, digest binary, repeats boolean, anchors array<long>")
    profile = materialise(profile, "profile")
    profile = profile.join(profile.groupBy("digest").agg(F.min("doc_id").alias("first")), "digest")
    heads = profile.where(f"doc_id = first AND n_words >= {WINDOW}")
    under = heads.select("doc_id", "tag", F.explode("anchors").alias("anchor"))
    common = under.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    found = under.join(common, "anchor").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("anchor", (F.col("n") > HOT).alias("hot"))).alias("found"))
    chosen = heads.select("doc_id", "tag", "repeats").join(found, ["doc_id", "tag"], "left").where("repeats OR found IS NOT NULL")
    chosen = chosen.select("doc_id", "tag", F.coalesce("found.anchor", F.array().cast("array<long>")).alias("anchors"),
                           F.coalesce("found.hot", F.array().cast("array<boolean>")).alias("hot"))
    chosen = materialise(texts.join(chosen, ["doc_id", "tag"]), "chosen")
    kinds = "anchor long, doc_id long, tag long, start long, words binary, windows array<long>"
    cold = chosen.mapInArrow(_passages, kinds).where("words IS NOT NULL").drop("windows")
    runs = cold.repartition(n, "anchor").sortWithinPartitions("anchor", "doc_id", "start").mapInArrow(_shards, RUNS)
    heat = chosen.where(F.exists("hot", lambda h: h)).mapInArrow(_passages, kinds).where("windows IS NOT NULL").select("doc_id", "tag", "start", F.posexplode("windows").alias("k", "window"))
    owners = heat.groupBy("window").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    hits = heat.join(owners, "window").where("doc_id > owner").select("doc_id", "tag", (F.col("start") + F.col("k")).alias("low"))
    runs = runs.unionByName(hits.withColumn("high", F.col("low")))
    by_doc = runs.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    cleaned = chosen.select("doc_id", "tag", "text").join(by_doc, ["doc_id", "tag"], "left").mapInArrow(
        _cleaned, "doc_id long, tag long, removed long, kept string").distinct()
    rows = profile.join(cleaned, ["doc_id", "tag"], "left")
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= WINDOW)
    return rows.select(F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "n_words",
                       F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
                       F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))
