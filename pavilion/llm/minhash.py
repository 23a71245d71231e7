"""Near-duplicate documents: fast similarity sketching, banding, exact verification.

The sketch of a set has ``BINS`` bins. In round i every element falls into one bin chosen by the round's hash; a bin keeps
the least (round, hash) it has seen, so it's settled in the first round that reaches it. Rounds end when all bins are filled;
after BINS rounds, round BINS + b sends every element to bin b, so each bin is filled for sure. Two
sets agree in a bin with the probability of their similarity, and the number of agreements is as concentrated as with independent draws.

Bands of the sketch propose pairs; links are confirmed on full shingle sets only. Equal sets are one class,
represented by its smallest doc_id, so copies meet in one row before anything is compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import components, partitions, slices, small_batches
from .words import GOLD, U, Words, grams, mix

#: Bins of a band, and the probability with which a pair right at the threshold may share no band: 28 bands for 0.85, 42 for 0.8.
ROWS, MISSED = 5, 7.5e-8
WORDS = 5
#: Numerator of the link condition 100 * intersection >= at_least * union, unless told otherwise.
AT_LEAST = 85
#: Stands for a null doc_id.
LAST = (1 << 63) - 1
#: Rows of a block: of sketches that share a bucket, and of documents of a cluster with their texts. Two blocks meet in a group.
BLOCK, GROUP = 1024, 256
#: So often each cluster of more than a block is first compared with one of its documents.
ROUNDS = 2


def n_bands(at_least: int = AT_LEAST) -> int:
    """Bands that miss a pair of similarity ``at_least`` hundredths with a probability of MISSED at most."""
    return math.ceil(math.log(MISSED) / math.log(max(1 - (at_least / 100) ** ROWS, MISSED)))


BINS = n_bands() * ROWS


def close(at_least: int, bins: int) -> int:
    """Bins of ``bins`` in which a pair of similarity ``at_least`` hundredths agrees at least: 6.4 standard deviations below the mean.

    For 85: 119 of 140 on average with a standard deviation of 4.2.
    """
    mean = bins * at_least / 100
    return round(mean - 6.4 * (mean * (1 - at_least / 100)) ** 0.5)


def shingle_sets(words: Words, n: int = WORDS) -> list[np.ndarray]:
    """For every text the sorted hashes of its distinct runs of ``n`` words; of all its words if there are fewer."""
    runs, out = grams(words.hashes, n), []
    first = words.first.tolist()
    for a, b in zip(first, first[1:]):
        if b - a >= n:
            out.append(np.unique(runs[a:b - n + 1]))
        elif b > a:
            out.append(grams(words.hashes[a:b], b - a) ^ U(b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def sketch(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Sketches (sets x bins) of non-empty sets."""
    out = np.full((len(sets), bins), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat, active = out.reshape(-1), np.arange(len(sets))
    values, owner = np.concatenate(sets), np.repeat(active, [len(s) for s in sets])
    low = U(0xFFFFFFFF)
    for i in range(2 * bins):
        h = mix(values + U((i + 1) * int(GOLD) % (1 << 64)))
        bin_of = ((h >> U(32)) * U(bins) >> U(32)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(flat, owner * bins + bin_of, (U(i) << U(32)) | (h & low))
        open_sets = (out[active] == np.iinfo(np.uint64).max).any(axis=1)
        if not open_sets.any():
            break
        if not open_sets.all():
            active = active[open_sets]
            keep = np.isin(owner, active)
            values, owner = values[keep], owner[keep]
    return out


def bands(sketches: np.ndarray) -> np.ndarray:
    """A key for each band of each sketch; keys of different bands differ."""
    parts = sketches.reshape(len(sketches), -1, ROWS)
    keys = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * GOLD, parts.shape[:2]).copy()
    for r in range(ROWS):
        keys = mix(keys * GOLD + mix(parts[:, :, r]))
    return keys


def similar(a: np.ndarray, b: np.ndarray, at_least: int = AT_LEAST) -> bool:
    """Whether two sorted sets have 100 * intersection >= at_least * union."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < at_least * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= at_least * (len(a) + len(b) - both)


def _sketched(batches: Iterator[pa.RecordBatch], per_set: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(Words(part.column("text"), lower=True))
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = np.zeros((len(sets), per_set), dtype=np.int64)
            low = np.zeros((len(sets), per_set * ROWS), dtype=np.uint8)
            if full:
                drawn = sketch([sets[i] for i in full], per_set * ROWS)
                keys[full], low[full] = bands(drawn).view(np.int64), drawn.astype(np.uint8)
            some = pa.array([len(s) == 0 for s in sets])
            offsets = pa.array(np.arange(0, (len(sets) + 1) * per_set, per_set, dtype=np.int32))
            digests = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)), mask=some),
                pa.array([r.tobytes() for r in low], pa.binary())], names=["doc_id", "n_shingles", "digest", "bands", "bins"])


def sketches(docs: DataFrame, per_set: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, ``per_set`` band keys and the low byte of every bin; the last three null or empty without words."""
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_sketched, per_set=per_set), "doc_id long, n_shingles long, digest binary, bands array<long>, bins binary")


class Forest:
    """Union-find over the rows of one group."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, x: int, y: int) -> None:
        self.parent[self.find(x)] = self.find(y)

    def edges(self, nodes: list[int]) -> list[tuple[int, int]]:
        return [(node, nodes[root]) for i, node in enumerate(nodes) if (root := self.find(i)) != i]


def close_rows(bins: np.ndarray, blocks: np.ndarray, at_least: int) -> Iterator[tuple[int, np.ndarray]]:
    """For every row i the later rows whose sketches are close; of two different blocks, pairs across only."""
    cross, enough = blocks[0] != blocks[-1], close(at_least, bins.shape[1])
    for i in range(len(bins) - 1):
        at = np.flatnonzero(blocks[i + 1:] != blocks[i]) + i + 1 if cross else np.arange(i + 1, len(bins))
        if len(at):
            yield i, at[(bins[at] == bins[i]).sum(axis=1) >= enough]


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], text: bool) -> Iterator[list[tuple]]:
    """Rows (block, node, bins or text and bins) of each (key, low, high), which come sorted."""
    group, held = None, []
    names = ["key", "low", "high", "block", "node", "bins", *(["text"] if text else [])]
    for batch in batches:
        for key, low, high, *row in zip(*(batch.column(c).to_pylist() for c in names)):
            if (key, low, high) != group:
                if len(held) > 1:
                    yield sorted(held, key=lambda r: r[0])
                group, held = (key, low, high), []
            held.append(row)
    if len(held) > 1:
        yield sorted(held, key=lambda r: r[0])


def _look_alike(batches: Iterator[pa.RecordBatch], at_least: int) -> Iterator[pa.RecordBatch]:
    """Of the rows of a bucket, a forest over the pairs with close sketches: a row a node at most, never the pairs."""
    found: list[tuple[int, int]] = []
    for held in _groups(batches, text=False):
        nodes = [r[1] for r in held]
        bins = np.frombuffer(b"".join(r[2] for r in held), dtype=np.uint8).reshape(len(held), -1)
        if len(held) == 2:
            if (bins[0] == bins[1]).sum() >= close(at_least, bins.shape[1]):
                found.append((nodes[0], nodes[1]))
        else:
            forest = Forest(len(held))
            for i, at in close_rows(bins, np.array([r[0] for r in held]), at_least):
                for j in at.tolist():
                    forest.union(i, j)
            found += forest.edges(nodes)
        if len(found) >= 10_000:
            yield _edges(found)
            found = []
    yield _edges(found)


def _verified(batches: Iterator[pa.RecordBatch], at_least: int) -> Iterator[pa.RecordBatch]:
    """Of the documents of a group, a forest over the links confirmed on full sets."""
    for held in _groups(batches, text=True):
        nodes = [r[1] for r in held]
        bins = np.frombuffer(b"".join(r[2] for r in held), dtype=np.uint8).reshape(len(held), -1)
        sets, forest = shingle_sets(Words(pa.array([r[3] for r in held]), lower=True)), Forest(len(held))
        for i, at in close_rows(bins, np.array([r[0] for r in held]), at_least):
            for j in at.tolist():
                if forest.find(i) != forest.find(j) and similar(sets[i], sets[j], at_least):
                    forest.union(i, j)
        yield _edges(forest.edges(nodes))


def blocked(rows: DataFrame, size: int) -> DataFrame:
    """Rows (key, node, n, ...) dealt to groups (key, low, high) of two blocks of about ``size``, sorted; each pair of rows of a key meets in one group.

    n is the number of rows of the key. A key of any size is many groups, so no task gathers it.
    """
    blocks = rows.withColumn("blocks", F.ceil(F.col("n") / size).cast("int"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks", "n")
    keys = ["key", "low", "high"]
    return blocks.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def _hits(batches: Iterator[pa.RecordBatch], at_least: int) -> Iterator[pa.RecordBatch]:
    """Whether each document is linked with its cluster's pivot."""
    pivot, of = None, np.zeros(0, dtype=np.uint64)
    for batch in batches:
        for part in slices(batch, "text"):
            hits = []
            for mine, at, other in zip(shingle_sets(Words(part.column("text"), lower=True)), part.column("pivot").to_pylist(), part.column("pivot_text")):
                if at != pivot:
                    pivot, of = at, shingle_sets(Words(pa.array([other.as_py()]), lower=True))[0]
                hits.append(similar(mine, of, at_least))
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("pivot"), pa.array(hits)], names=["node", "pivot", "hit"])


def stars(members: DataFrame, at_least: int = AT_LEAST) -> DataFrame:
    """(node, pivot, hit): documents of clusters (key, node, text) compared with the smallest of their cluster, one comparison a document."""
    pivots = members.groupBy("key").agg(F.min("node").alias("pivot"))
    heads = members.select("node", F.col("text").alias("pivot_text")).join(pivots, F.col("node") == F.col("pivot")).drop("node")
    pairs = members.select("key", "node", "text").join(heads, "key").select("node", "pivot", "text", "pivot_text")
    return pairs.mapInArrow(partial(_hits, at_least=at_least), "node long, pivot long, hit boolean")


def apart(rows: DataFrame, size: int) -> DataFrame:
    """Rows (key, node, star, ...) dealt to groups (key, low, high) of two blocks of about ``size``, sorted.

    ``star`` is 0 for a row of its own and a number that the rows of a key share that are known to hang together. Two rows of a
    key meet in one group unless they are of one star: its blocks meet all others but each other, so a key whose rows are nearly all of one star
    costs its few others times its rows.
    """
    kinds = rows.groupBy("key", "star").agg(F.ceil(F.count("*") / size).cast("long").alias("blocks"))
    kinds = kinds.groupBy(F.col("key").alias("of")).agg(F.collect_list(F.struct("star", "blocks")).alias("kinds"))  # ROUNDS + 1 at most
    dealt = rows.join(kinds, rows["key"] == kinds["of"]).drop("of")
    mine = F.element_at(F.filter("kinds", lambda k: k["star"] == F.col("star")), 1)["blocks"]
    base = 1 << 40
    dealt = dealt.withColumn("block", F.col("star") * base + F.pmod(F.xxhash64("node"), mine))
    others = F.filter("kinds", lambda k: (k["star"] != F.col("star")) | (k["star"] == 0))
    places = F.flatten(F.transform(others, lambda k: F.transform(F.sequence(F.lit(0).cast("long"), k["blocks"] - 1), lambda b: k["star"] * base + b)))
    dealt = dealt.withColumn("other", F.explode(places)).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    keys = ["key", "low", "high"]
    return dealt.drop("other", "kinds", "star").repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def near_duplicates(docs: DataFrame, at_least: int = AT_LEAST) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Words are runs of other characters than blank and \\t to \\r, A-Z in lower case; a document's set is its distinct runs of five words, with fewer words
    all of them as one run. Documents with 100 * intersection >= ``at_least`` * union are linked; component_id is the smallest doc_id that links reach, kept
    says whether it is the document's own. Null and empty texts and those of white space have no shingles and link with nothing.
    A null doc_id sorts last and is reported as null; rows that repeat a doc_id are one name, so with different texts they share their links. Empty table: no rows.

    Documents that share a bucket and whose sketches agree often enough for a link make up clusters. The full sets of a cluster's documents are then compared
    where sketches allow it. Buckets and clusters are met in blocks, and each group of blocks returns a forest, a row a document at
    most: no link that banding proposes is lost, and nobody lists the pairs of a group. A cluster of more than a block is first compared with one of its
    documents, ROUNDS times; those that are linked with it need not meet each other any more.
    """
    name = F.coalesce("doc_id", F.lit(LAST))
    drawn = materialise(sketches(docs, n_bands(at_least)).withColumn("doc_id", name), "sketches")
    classes = materialise(drawn.where("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("bins").alias("bins")), "classes")
    # keys alone are exchanged; few of them are shared, and only those rows get their sketches
    keys = classes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    alike = blocked(keys.join(shared, "key").join(classes.select("node", "bins"), "node"), BLOCK).mapInArrow(partial(_look_alike, at_least=at_least), "a long, b long")
    clusters = materialise(components(alike).withColumnRenamed("component", "key"), "clusters")
    sizes = clusters.groupBy("key").agg(F.count("*").alias("n"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("node"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    members = clusters.join(sizes, "key").join(classes.select("node", "bins"), "node").join(texts, "node").withColumn("star", F.lit(0).cast("long"))
    links, large = None, F.col("n") > GROUP
    if not sizes.where(large).isEmpty():
        members = materialise(members, "members")
        for k in range(1, ROUNDS + 1):
            found = materialise(stars(members.where(large & (F.col("star") == 0)), at_least).where("hit").select(F.col("node").alias("b"), F.col("pivot").alias("a")), "stars")
            links = found if links is None else links.unionByName(found)
            members = members.join(found.select(F.col("b").alias("node"), F.lit(k).cast("long").alias("found")), "node", "left")
            members = members.withColumn("star", F.coalesce("found", "star")).drop("found")
    verified = apart(members.drop("n"), GROUP).mapInArrow(partial(_verified, at_least=at_least), "a long, b long")
    links = verified if links is None else verified.unionByName(links)
    labels = components(links)
    classes = classes.join(labels, "node", "left").select(F.col("digest").alias("of"), F.coalesce("component", "node").alias("component"))
    out = drawn.join(classes, drawn["digest"] == classes["of"], "left").withColumn("component", F.coalesce("component", "doc_id"))
    return out.select(F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "n_shingles", F.nullif("component", F.lit(LAST)).alias("component_id"),
                      (F.col("doc_id") == F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, at_least: int = AT_LEAST) -> DataFrame:
    """``docs`` without the documents that a smaller doc_id of their group stands for; of rows that repeat a doc_id and a text, one stays.

    The columns of ``docs`` are returned as they are.
    """
    kept = near_duplicates(docs, at_least).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_kept"]), "left_semi")
    ids = docs.agg(F.count("*").alias("n"), F.countDistinct(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).alias("d")).first()
    return rows if ids["n"] == ids["d"] else rows.dropDuplicates(["doc_id", "text"])
