"""Language identification by prediction by partial matching over bytes, with frozen statistics.

A language is a tree of byte contexts of up to ORDER bytes. A byte's code length in a context is -log2 of its count's share
(method C: distinct followers count as escapes); a byte that never followed the context costs the escape and
is looked up in the next shorter one, and after the empty context all 256 bytes are alike. The statistics are frozen after learning, so
the code length of a byte depends on its last ORDER bytes alone. That makes the trees tables: for every gram that some language knows,
its code length in each language is worked out once, and a text is scored with one look-up a byte in all languages at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches
from .words import text_bytes

#: Bytes of context.
ORDER = 3
#: Documents a language that the trees are learned from, at most about so many (a hash of doc_id and text chooses).
SAMPLE = 3_000
#: Share of remainders of crc32(doc_id) modulo HELD_OF that is never learned from.
HELD_OF, HELD = 3, 1
UNKNOWN = "und"
#: So many labels are learned at most, those with the most rows (ties: the first by name); a label of the others is as good as none.
MOST_LABELS = 256
#: A text is in none of the languages if more than this share of its letters was never learned from: another script.
MOST_UNSEEN = 0.5


def held_out(doc_id: Column) -> Column:
    """Whether a document is held out; a null doc_id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(HELD_OF)) == HELD, F.lit(False))


def keys(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For every byte, it and the ``order`` bytes before it as one number; texts begin after zero bytes."""
    out = data.astype(np.uint32)
    at = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets)) if order else None
    for k in range(1, order + 1):
        before = np.zeros(len(data), dtype=np.uint32)
        before[k:] = data[:-k] if len(data) > k else 0
        before[at < k] = 0
        out |= before << np.uint32(8 * k)
    return out


class Table:
    """Rows of values found by 32-bit keys: an open-addressed table, searched for whole arrays at once."""

    def __init__(self, known: np.ndarray, rows: np.ndarray) -> None:
        self.rows = rows
        self.bits = max(4, int(len(known) * 2).bit_length())
        self.key, self.row = np.zeros(1 << self.bits, dtype=np.uint32), np.full(1 << self.bits, -1, dtype=np.int32)
        todo, step = np.arange(len(known)), 0
        self.steps = 0
        while len(todo):
            slot = self._slot(known[todo], step)
            free = np.flatnonzero(self.row[slot] < 0)
            self.row[slot[free]] = todo[free]  # the last of those that meet stays
            self.key[slot[free]] = known[todo[free]]
            won = self.row[slot] == todo
            self.key[slot[won]] = known[todo[won]]
            todo, step = todo[~won], step + 1
        self.steps = step

    def _slot(self, key: np.ndarray, step: int) -> np.ndarray:
        return ((key * np.uint32(0x9E3779B1) >> np.uint32(32 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 if unknown."""
        slot = self._slot(key, 0)
        out = np.where(self.key[slot] == key, self.row[slot], -1)
        todo = np.flatnonzero((out < 0) & (self.row[slot] >= 0))
        for step in range(1, self.steps):
            if not len(todo):
                break
            slot = self._slot(key[todo], step)
            hit = (self.key[slot] == key[todo]) & (self.row[slot] >= 0)
            out[todo[hit]] = self.row[slot[hit]]
            todo = todo[~hit & (self.row[slot] >= 0)]
        return out


@dataclass
class Model:
    """Frozen trees: ``levels[k]`` finds grams of k context bytes, ``escapes[k]`` contexts of k bytes; rows hold a value a language."""

    languages: list[str]
    levels: list[Table]
    escapes: list[Table]

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths (bytes x languages)."""
        order = len(self.levels) - 1
        full = keys(data, offsets, order)
        at = self.levels[order].find(full)
        out = self.levels[order].rows[at]
        rest = np.flatnonzero(at < 0)
        if len(rest):
            out[rest] = self._shorter(full[rest], order)
        return out

    def _shorter(self, full: np.ndarray, order: int) -> np.ndarray:
        """Code lengths of grams of ``order`` context bytes that no language knows: the escape, then the shorter context."""
        if order == 0:
            return np.full((len(full), len(self.languages)), 8.0, dtype=np.float32) + self._escape(full, 0)
        key = full & np.uint32((1 << 8 * order) - 1)
        at = self.levels[order - 1].find(key)
        out = self.levels[order - 1].rows[at]
        rest = np.flatnonzero(at < 0)
        if len(rest):
            out[rest] = self._shorter(key[rest], order - 1)
        return out + self._escape(full, order)

    def _escape(self, full: np.ndarray, order: int) -> np.ndarray:
        at = self.escapes[order].find(full >> np.uint32(8))
        return np.where((at < 0)[:, None], np.float32(0), self.escapes[order].rows[at])


def learn(languages: list[str], grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Model:
    """Trees from counts: for the order k of a gram, ``grams[k]`` is (keys, language numbers, counts)."""
    n = len(languages)
    model = Model(languages, [], [])
    for order in sorted(grams):
        key, lang, count = grams[order]
        known, row = np.unique(key, return_inverse=True)
        table = np.zeros((len(known), n))
        np.add.at(table, (row, lang), count)
        contexts, context = np.unique(known >> np.uint32(8), return_inverse=True)
        total, distinct = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
        np.add.at(total, context, table)
        np.add.at(distinct, context, table > 0)
        weight = np.maximum(total + distinct, 1)
        escape = np.where(total > 0, -np.log2(np.maximum(distinct, 1) / weight), 0.0).astype(np.float32)
        model.escapes.append(Table(contexts, escape))
        model.levels.append(Table(known, np.zeros((0, n), dtype=np.float32)))
        with np.errstate(divide="ignore"):
            own = -np.log2(table / weight[context])
        if order:
            # for languages that don't know the gram: escape, then the shorter gram, which every known gram has in some language
            below = model.levels[order - 1]
            short = below.rows[below.find(known & np.uint32((1 << 8 * order) - 1))]
        else:
            short = np.full((len(known), n), 8.0)
        model.levels[order].rows = np.where(table > 0, own, short + escape[context]).astype(np.float32)
    return model


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.asarray(batch.column("lang").to_pylist(), dtype=object)
        for lang in sorted(set(langs)):
            part = batch.filter(pa.array(langs == lang))
            for some in slices(part, "text"):
                data, offsets = text_bytes(some.column("text"))
                for order in range(ORDER + 1):
                    known, count = np.unique(keys(data, offsets, order), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(known), pa.string()), pa.array(np.full(len(known), order), pa.int32()),
                                                      pa.array(known.astype(np.int64)), pa.array(count.astype(np.int64))],
                                                     names=["lang", "depth", "gram", "n"])


def train(docs: DataFrame, sample: int = SAMPLE, most_labels: int = MOST_LABELS) -> Model | None:
    """Trees of the languages among the labelled rows that aren't held out; None if there are none.

    The ``most_labels`` labels with the most rows are learned, about ``sample`` documents each, whole. The counts of their grams are summed
    up by Spark; what comes to the driver is bounded by the two.
    """
    rows = small_batches(docs).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("doc_id"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_labels).collect()}
    if not sizes:
        return None
    grain = 1 << 20
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(grain, sample * grain // n + 1))])
    rows = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(grain)) < share[F.col("lang")])
    counts = rows.select("lang", F.lower("text").alias("text")).mapInArrow(_counted, "lang string, depth int, gram long, n long")
    counts = counts.groupBy("lang", "depth", "gram").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(sizes)
    number = {lang: i for i, lang in enumerate(languages)}
    lang = np.array([number[x] for x in counts.column("lang").to_pylist()], dtype=np.int64)
    depth, gram, n = (counts.column(c).to_numpy() for c in ("depth", "gram", "n"))
    return learn(languages, {k: (gram[depth == k].astype(np.uint32), lang[depth == k], n[depth == k]) for k in range(ORDER + 1)})


def unseen(trees: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For every text the share of its letters that no language has learned; characters of one byte count as learned.

    A character of several bytes is learned if it is a gram of that many bytes. Texts with no other are not decoded.
    """
    out = np.zeros(len(offsets) - 1)
    head = np.flatnonzero(data >= 0xC0)
    size = 2 + (data[head] >= 0xE0) + (data[head] >= 0xF0)
    full = keys(data, offsets, 3) if len(head) else np.zeros(0, dtype=np.uint32)
    new = np.zeros(len(head), dtype=bool)
    for n in (2, 3, 4):
        some = np.flatnonzero(size == n)
        if len(some) and n <= len(trees.levels):
            gram = full[head[some] + n - 1] & np.uint32((1 << 8 * n) - 1)
            new[some] = trees.levels[n - 1].find(gram) < 0
    strange = {data[a:a + n].tobytes().decode() for a, n in zip(head[new].tolist(), size[new].tolist())}
    for i in np.unique(np.searchsorted(offsets, head[new], side="right") - 1).tolist():
        letters = [c for c in data[offsets[i]:offsets[i + 1]].tobytes().decode() if c.isalpha()]
        out[i] = sum(c in strange for c in letters) / max(len(letters), 1)
    return out


def classify(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs``, named _kept_0, _kept_1 and so on, with _lang (UNKNOWN without text or letter), _score and _unseen (unseen()) added."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(model))  # by value, so executors need not have the package
    kept = [F.col(c).alias(f"_kept_{i}") for i, c in enumerate(keep)]
    rows = small_batches(docs).select(*kept, F.lower(F.col("text").cast("string")).alias("_text"), F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = pickle.loads(shared.value)
        for batch in batches:
            for part in slices(batch, "_text", 1 << 20):
                lang, score, strange = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows)
                data, offsets = text_bytes(part.column("_text"))
                asked = np.flatnonzero(np.array(part.column("_letters").to_pylist(), dtype=bool) & (np.diff(offsets) > 0))
                if trees is not None and len(asked):
                    sums = np.add.reduceat(trees.bits(data, offsets), np.minimum(offsets[:-1][np.diff(offsets) > 0], len(data) - 1), axis=0, dtype=np.float64)
                    sums = sums[np.searchsorted(np.flatnonzero(np.diff(offsets) > 0), asked)]
                    best = sums.argmin(axis=1)
                    least = sums[np.arange(len(asked)), best]
                    score[asked] = 1 / np.exp2(np.maximum(least[:, None] - sums, -1000)).sum(axis=1)
                    strange = unseen(trees, data, offsets)
                    for i, b in zip(asked, best):
                        lang[i] = trees.languages[b]
                columns = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score), pa.array(strange)],
                                                 names=[*part.schema.names[:len(keep)], "_lang", "_score", "_unseen"])

    schema = rows.select(*rows.columns[:len(keep)]).schema.add("_lang", "string").add("_score", "double").add("_unseen", "double")
    return rows.mapInArrow(run, schema)


def predict(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score.

    ``lang_pred`` is the language whose trees give the whole lower-cased text the shortest code, ``score`` its share of the posterior under equal priors. Only
    texts are looked at; labels of documents that aren't held out are learned from. Null texts and those without a letter are ``und`` with score 0, as is
    everything where nothing can be learned. Ties go to the first language by name. A null doc_id is not held out. Repeated rows stay. Empty table: no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = classify(rows, train(docs, sample), ["doc_id"]).withColumnRenamed("_kept_0", "doc_id")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def keep_known(docs: DataFrame, most_unseen: float = MOST_UNSEEN) -> DataFrame:
    """``docs`` without texts that have no letter, or most of whose letters are of a script that no learned text is written in.

    How long a text's code is rejects nothing: prose on other subjects, code, tables of numbers or a rare language cost more bits than what was
    learned from, however well they are written. The columns of ``docs`` are returned as they are, lang included: the label is the
    source's, the prediction only rejects. Where nothing can be learned, nothing is known and all rows go.
    """
    found = classify(docs, train(docs), docs.columns)
    kept = [F.col(f"_kept_{i}").alias(c) for i, c in enumerate(docs.columns)]
    return found.where((F.col("_lang") != UNKNOWN) & (F.col("_unseen") <= most_unseen)).select(*kept)
