"""Packing documents into training windows by order-preserving dynamic programming.

The documents stay in the order that is asked for, by default that of doc_id. Possible cuts are the ends of documents and sentences, and
in long stretches without any, every STRIDE-th token. A window costs its padding plus a penalty for what
its end cuts through. With f(j) the least cost of everything up to cut j, the padded windows that end at j give
f(i) + size - (j - i) over all cuts i within reach: a sliding minimum of f(i) + i, kept in a monotone queue.
Windows of exactly a power of two tokens need no padding and are looked up directly.
"""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, slices, small_batches
from .words import GOLD, Words, mix

SIZE = 2048
#: Cost of a window's end: at a document's end, at a sentence's end, anywhere else; in tokens of padding.
AT_DOCUMENT, AT_SENTENCE, ANYWHERE = 0, 16, 256
#: Every window costs this much, so that short powers of two are no way around padding; none shorter than LEAST is tried.
PER_WINDOW, LEAST = 24, 64
#: Cuts in stretches without an end of a sentence lie so many tokens apart.
STRIDE = 64
#: Tokens that are planned together; the last windows of a plan, which its end has shaped, are planned again with what follows.
HORIZON, AGAIN = 1 << 18, 4 * SIZE
END_OF_DOCUMENT = 1
#: Entries of a worker's table of encoded words; a full table is started anew.
KNOWN_WORDS = 1_000_000


class KnownWords:
    """Ids of words by a 64-bit hash, in sorted arrays: some 40 bytes a word."""

    def __init__(self) -> None:
        self.keys, self.start, self.size = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids, self.used = np.zeros(1 << 20, dtype="<u4"), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each key, whether it is known)."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        return at, known

    def add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """New keys, ascending, with their ids one after the other."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), dtype="<u4")])
        self.ids[self.used:self.used + len(ids)] = ids
        at = np.searchsorted(self.keys, keys)
        start = self.used + np.cumsum(size) - size
        self.keys, self.start, self.size = (np.insert(own, at, new) for own, new in ((self.keys, keys), (self.start, start), (self.size, size)))
        self.used += len(ids)


class Encoder:
    """Ids of whole texts by a byte-level BPE file of ``tokenizers``.

    The pre-tokens of such a file never run across the place before a single blank or around a single line end between
    non-blanks, so the ids of a text are those of its words, each led by its blank or line end. Every different word goes through the
    tokenizer once; a batch is then put together from the ids of its different words, found by a 64-bit hash. Texts with any other
    white space or with the string of an added token, which is a single id wherever it stands, go through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        # kept by the worker process, so the next task of the same worker knows the words already
        kept = vars(sys.modules.setdefault("known_words_of_worker", types.ModuleType("known_words_of_worker")))
        if path not in kept:
            # a task has one core; the tokenizer's own threads would each keep a heap of their own
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            sentence = [bool(re.search(r"[.!?\n][\"')\]]*$", tokenizer.decode([i], skip_special_tokens=False))) for i in range(tokenizer.get_vocab_size())]
            added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
            kept[path] = {"tokenizer": tokenizer, "sentence": np.array(sentence), "added": re.compile("|".join(map(re.escape, added)) or "(?!)"),
                          "spaced": any(re.search(r"\s", t) for t in added)}
        self.kept = kept[path]
        self.tokenizer, self.sentence = self.kept["tokenizer"], self.kept["sentence"]
        self.line_end, = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and how many each has; words are encoded in runs, a line a word, and the runs taken apart at their line ends."""
        runs = ["\n".join([lead + w for w in words[i:i + 500]]) + "\n" for i in range(0, len(words), 500)]
        ids = np.concatenate([*self._ids(runs), np.zeros(0, dtype="<u4")])
        ends = np.flatnonzero(ids == self.line_end)
        return ids[ids != self.line_end], np.diff(ends, prepend=-1) - 1

    def _lookup(self, words: Words, keys: np.ndarray, at: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size) in the table's ids of different words (``keys``, one place ``at`` of each), and those with white space inside."""
        known = self.kept.get("known")
        if known is None or len(known.keys) > KNOWN_WORDS:
            known = self.kept["known"] = KnownWords()
        new = np.flatnonzero(~known.find(keys)[1])
        odd = np.zeros(0, dtype=np.int64)
        for lead, some in ((" ", new[~line[at[new]]]), ("", new[line[at[new]]])):
            places = zip(words.start[at[some]].tolist(), words.end[at[some]].tolist())
            found = [words.data[a:b].tobytes().decode() for a, b in places]
            added, joined = self.kept["added"], "\n".join(found)
            if re.search(r"[^\S\n]", joined) or added.search(joined):  # other white space than a byte's, or an added token
                bad = np.array([w.split() != [w] or added.search(w) is not None for w in found])
                odd, some, found = np.concatenate([odd, some[bad]]), some[~bad], [w for w, b in zip(found, bad) if not b]
            if found:
                ids, size = self._words(found, lead)
                known.add(keys[some], ids, size)
        place, there = known.find(keys)
        place[~there] = 0
        return known.start[place] if len(known.keys) else place, np.where(there, known.size[place] if len(known.keys) else 0, 0), odd

    def __call__(self, texts: pa.StringArray) -> list[np.ndarray]:
        if self.kept["spaced"]:  # an added token may run across words
            return self._ids(texts.to_pylist())
        words = Words(texts)
        n, offsets, first = len(texts), words.offsets, words.first
        count = np.diff(first)
        owner = np.repeat(np.arange(n), count)
        begins = first[:-1][count > 0]
        lead = words.data[words.start - 1] if len(words) else np.zeros(0, dtype=np.uint8)
        fits = np.ones(len(words), dtype=bool)
        fits[1:] = (words.start[1:] - words.end[:-1] == 1) & ((lead[1:] == 0x20) | (lead[1:] == 0x0A))
        fits[begins] = words.start[begins] == offsets[:-1][count > 0]
        line = lead == 0x0A
        line[begins] = True
        whole = np.diff(offsets) > 0
        whole[count > 0] = words.end[first[1:][count > 0] - 1] != offsets[1:][count > 0]
        whole[owner[~fits]] = True
        keys, at, which = np.unique(mix(words.hashes + line * GOLD), return_index=True, return_inverse=True)
        start, size, odd = self._lookup(words, keys, at, line)
        if len(odd):
            whole[owner[np.isin(which, odd)]] = True
        # words that a line end leads have its id before their own, but for the first of a text
        ends_line = line.copy()
        ends_line[begins] = False
        start, size = start[which], size[which]
        ends = np.cumsum(size + ends_line)
        flat = np.full(int(ends[-1]) if len(ends) else 0, self.line_end, dtype="<u4")
        here = np.ones(len(flat), dtype=bool)
        here[(ends - size - 1)[ends_line]] = False
        here = np.flatnonzero(here)
        flat[here] = self.kept["known"].ids[np.repeat(start - (ends - size), size) + here]
        bounds = np.concatenate([[0], ends])[first].tolist()
        out = [flat[a:b] for a, b in zip(bounds, bounds[1:])]
        some = np.flatnonzero(whole).tolist()
        for i, ids in zip(some, self._ids(texts.take(pa.array(some, pa.int64())).to_pylist()) if some else ()):
            out[i] = ids
        return out


def cuts(ends: np.ndarray, sentence: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (ascending, from 0 to ``total``) where a window may end, and their penalties."""
    penalty = np.full(total + 1, -1, dtype=np.int64)
    penalty[sentence] = AT_SENTENCE
    penalty[ends] = AT_DOCUMENT
    penalty[[0, total]] = AT_DOCUMENT
    at = np.flatnonzero(penalty >= 0)
    gaps = np.flatnonzero(np.diff(at) > 2 * STRIDE)
    if len(gaps):
        extra = np.concatenate([np.arange(at[g] + STRIDE, at[g + 1], STRIDE) for g in gaps])
        penalty[extra] = ANYWHERE
        at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def plan(at: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> list[int]:
    """Window ends (indexes into ``at``, ascending) of least cost; ``at`` starts with 0 and no gap exceeds ``size``."""
    spots, costs = at.tolist(), penalty.tolist()
    index = [-1] * (spots[-1] + 1)
    for k, spot in enumerate(spots):
        index[spot] = k
    powers, power = [], LEAST
    while power <= size:
        powers.append(power)
        power *= 2
    best, back = [0] * len(spots), [0] * len(spots)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f(i) + position of i, i), ascending
    for j in range(1, len(spots)):
        spot = spots[j]
        while spot - spots[queue[0][1]] > size:
            queue.popleft()
        least, source = queue[0]
        least += size - spot
        for power in powers:
            if power > spot:
                break
            k = index[spot - power]
            if k >= 0 and best[k] < least:
                least, source = best[k], k
        least += costs[j] + PER_WINDOW
        best[j], back[j] = least, source
        key = least + spot
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], len(spots) - 1
    while j > 0:
        out.append(j)
        j = back[j]
    return out[::-1]


class Packer:
    """Plans windows over a stream of encoded documents and hands out their pieces."""

    def __init__(self, sentence: np.ndarray, size: int, first_id: int) -> None:
        self.sentence, self.size, self.next_id = sentence, size, first_id
        self.docs: list[tuple[int | None, np.ndarray, int]] = []  # doc_id, ids, ids that are placed already
        self.waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, ids, 0))
        self.waiting += len(ids)
        if self.waiting >= HORIZON:
            yield from self.flush(AGAIN)

    def flush(self, keep: int = 0) -> Iterator[tuple]:
        """Pieces (doc_id, start, ids, doc_tokens, sequence_id, offset) of all windows but those that end in the last ``keep`` tokens."""
        if not self.waiting:
            return
        stream = np.concatenate([ids[done:] for _, ids, done in self.docs])
        ends = np.cumsum([len(ids) - done for _, ids, done in self.docs])
        at, penalty = cuts(ends, np.flatnonzero(self.sentence[stream]) + 1, len(stream))
        starts = [0, *(int(at[j]) for j in plan(at, penalty, self.size))]
        windows = [(a, b) for a, b in zip(starts, starts[1:]) if b <= len(stream) - keep]
        doc = place = 0
        for a, b in windows:
            offset = 0
            while a + offset < b:
                doc_id, ids, done = self.docs[doc]
                take = min(b - a - offset, len(ids) - done - place)
                yield doc_id, done + place, ids[done + place:done + place + take], len(ids), self.next_id, offset
                offset, place = offset + take, place + take
                if done + place == len(ids):
                    doc, place = doc + 1, 0
            self.next_id += 1
        rest = self.docs[doc:]
        if rest and place:
            rest[0] = (rest[0][0], rest[0][1], rest[0][2] + place)
        self.docs, self.waiting = rest, sum(len(ids) - done for _, ids, done in rest)


def pack(docs: DataFrame, tokenizer_path: str | None = None, size: int = SIZE, ids: bool = False, order: Sequence[Column] = ()) -> DataFrame:
    """Pieces of all documents in windows of at most ``size`` tokens.

    Returns one row a piece: doc_id, start (the document's tokens before it), length, ids_crc32 (of its ids as little-endian 32-bit
    integers), doc_tokens (all of the document's, with the end-of-document id 1), sequence_id, offset (place in the sequence), and with ``ids`` the ids themselves.
    A sequence is padded to ``size`` unless its length is a power of two.

    Documents are range-partitioned by ``order`` (columns of ``docs``; doc_id unless given) and packed in that order in every partition; sequence ids rise with it. A partition plans some
    hundred thousand tokens at a time and carries the last windows over, so memory doesn't grow with it. The last window of a partition
    is the only one that its end cuts short. Null and empty texts are the end-of-document id alone. Nulls come first in the order, repeated rows are packed each; ties
    lie by a hash of the text. Empty table: no rows.
    """
    spark = docs.sparkSession
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    tie = F.col("_tie")
    places = [c.alias(f"_place_{i}") for i, c in enumerate(order)]
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *places)
    # equal rows lie by their place in the input, so many of them are dealt to several ranges
    rows = rows.withColumns({"_tie": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    by = [*(F.col(f"_place_{i}") for i in range(len(places)))] if places else [F.col("doc_id")]
    by += [tie, F.col("_row")]
    rows = rows.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by).select("doc_id", "text")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
              ("sequence_id", pa.int64()), ("offset", pa.int64()), *([("ids", pa.list_(pa.int32()))] if ids else [])]

    def batch(pieces: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*pieces))
        arrays = [columns[0], columns[1], [len(x) for x in columns[2]], [zlib.crc32(x.tobytes()) for x in columns[2]], *columns[3:6]]
        arrays = [pa.array(a, pa.int64()) for a in arrays]
        if ids:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in columns[2]])]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(columns[2]).astype(np.int32))))
        return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = packer = None
        pieces: list[tuple] = []
        for part in (part for b in batches for part in slices(b, "text", 1 << 20)):
            if packer is None:
                encode = Encoder(tokenizer_path)
                packer = Packer(encode.sentence, size, TaskContext.get().partitionId() << 40)
            for doc_id, found in zip(part.column("doc_id").to_pylist(), encode(part.column("text"))):
                pieces += packer.add(doc_id, np.append(found, np.uint32(END_OF_DOCUMENT)))
                if len(pieces) >= 2000:
                    yield batch(pieces)
                    pieces = []
        if packer is not None:
            pieces += packer.flush()
        if pieces:
            yield batch(pieces)
        pa.default_memory_pool().release_unused()  # the worker stays, its next task may be another operator's

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, kinds + (", ids array<int>" if ids else ""))
