"""Mixing sources to target weights along a curriculum, in DataFrame operations only.

A source's share of the mix is fixed by its weight; when its words come is fixed by its schedule, a
piecewise linear weight over training time 0 to 1. The schedule is integrated once (a few constants a
schedule), each document's place in its source's stream is turned into a share of the source's demand,
and the integral is inverted there: that is the training position by which documents are range-sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise
from .common import WORD

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A schedule a weight class: (time, relative weight) knots, linear between them.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 0.75), (1.0, 2.25)))
#: No document is taken more often than this.
MOST_EPOCHS = 3
#: Documents of a source are summed up in stretches of about so many, and so many stretches in a section.
STRETCH = SECTION = 1_000

Schedule = Sequence[tuple[float, float]]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Words to take from each source: (source, source_size, n_docs, ordinal, target).

    ``sizes``: one row (source, source_size, n_docs) a source. Shares follow the weights and sum up to all
    sizes. A source stops at ``most`` times its size; what it can't take goes to the others by weight until none
    is above. Sources are met in the order of size by weight: those that stop come first, so the level
    that the others reach follows from running sums, without rounds. Only the table of sources, one row
    a source, goes through one task.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*[F.lit(int(w)) for w in weights])
    rows = sizes.withColumn("ordinal", (F.row_number().over(by_name) - 1).cast("long"))
    rows = rows.withColumn("weight", F.element_at(weight, (F.col("ordinal") % n + 1).cast("int")).cast("long"))
    by_ratio = Window.orderBy((F.col("source_size") * F.lit(1.0) / F.col("weight")).asc(), F.col("ordinal").asc())
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (rows.withColumn("total", F.sum("source_size").over(whole))
            .withColumn("left_words", F.col("total") - most * (F.sum("source_size").over(upto) - F.col("source_size")))
            .withColumn("left_weight", F.sum("weight").over(whole) - F.sum("weight").over(upto) + F.col("weight"))
            .withColumn("stops", most * F.col("source_size") * F.col("left_weight")
                        <= F.col("left_words") * F.col("weight")))
    first_free = F.min(F.when(~F.col("stops"), F.struct("ratio_rank", "left_words", "left_weight"))).over(whole)
    rows = rows.withColumn("ratio_rank", F.row_number().over(by_ratio)).withColumn("level", first_free)
    # from the first source that doesn't stop on, none stops
    free = F.col("ratio_rank") >= F.col("level.ratio_rank")
    target = F.when(F.coalesce(free, F.lit(False)), (F.col("level.left_words") * F.col("weight")).cast("double")
                    / F.col("level.left_weight")).otherwise((most * F.col("source_size")).cast("double"))
    return rows.select("source", "source_size", "n_docs", "ordinal", target.alias("target"))


def cumulative(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """Pieces (time, length, weight at the start, slope, share of the demand before) of a schedule."""
    pieces, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        pieces.append([t0, t1 - t0, w0, (w1 - w0) / (t1 - t0), before])
        before += (w0 + w1) / 2 * (t1 - t0)
    return [(t, d, w / before, s / before, b / before) for t, d, w, s, b in pieces]


def invert(share: Column, schedule: Schedule) -> Column:
    """Training time at which ``schedule`` has asked for ``share`` (0 to 1) of its demand."""
    position = None
    for t, length, w, slope, before in reversed(cumulative(schedule)):
        rest = F.greatest(share - F.lit(before), F.lit(0.0))
        root = F.lit(w) + F.sqrt(F.greatest(F.lit(w * w) + F.lit(2 * slope) * rest, F.lit(0.0)))
        here = F.lit(t) + F.least(F.when(root > 0, F.try_divide(F.lit(2.0) * rest, root)).otherwise(F.lit(0.0)), F.lit(length))
        position = here if position is None else F.when(share < F.lit(after), here).otherwise(position)
        after = before
    return position


def place(doc_id: Column, text: Column) -> Column:
    """A hash that orders the documents of a source; different texts of one doc_id, or of none, lie far apart."""
    name = F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))
    return F.md5(F.concat(name, F.lit(":"), F.md5(F.coalesce(text.cast("string"), F.lit("")))))


def running(sums: DataFrame, section: int) -> DataFrame:
    """Rows (ordinal, stretch, words) with ``words_before``, the words of the source's stretches before.

    Stretches are summed up in sections and these in turn, so a task orders ``section`` rows, or one row a section of a source.
    """
    sums = sums.withColumn("section", F.floor(F.col("stretch") / section))
    whole = sums.groupBy("ordinal", "section").agg(F.sum("words").alias("all"))
    over = Window.partitionBy("ordinal").orderBy("section").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = whole.select(F.col("ordinal").alias("o"), F.col("section").alias("s"), (F.sum("all").over(over) - F.col("all")).alias("far"))
    inside = Window.partitionBy("ordinal", "section").orderBy("stretch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = sums.withColumn("near", F.sum("words").over(inside) - F.col("words"))
    joined = near.join(whole, (F.col("ordinal") == F.col("o")) & (F.col("section") == F.col("s")))
    return joined.select("ordinal", "stretch", "words", (F.col("far") + F.col("near")).alias("words_before"))


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: Sequence[Schedule] = SCHEDULES,
         most: int = MOST_EPOCHS, keep: Sequence[str] = ()) -> DataFrame:
    """What the mix takes of every document.

    Returns one row a document: doc_id, size, source_size, target, taken, copies (whole passes), cut (words of
    one more, unfinished pass), position (training time of its first words; NULL if nothing is taken), step
    (distance of two passes as a share of the source's demand), share (place of its first words) and the columns ``keep``.

    A source is a stream of its documents in the order of a hash of doc_id and text, run through again until the target is reached;
    the document at the end is cut there, so the taken words of a source are its target, rounded down.
    Running sums have three levels: documents of a source are dealt to ranges of the hash, so a source with a
    third of all rows is many stretches, and stretches are many sections. Null text: size 0, taken 0. Null source: a source of its own, the last.
    Null doc_id sorts as the empty text. Repeated rows are documents of their own. Empty table: no rows.
    """
    kept = [F.col(c).alias(f"_kept_{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       word_count(F.col("text")).alias("size"), place(F.col("doc_id"), F.col("text")).alias("place"), *kept)
    if not keep:  # narrow: the texts are read once
        rows = materialise(rows, "sizes")
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, most)
    goal = materialise(goal, "targets")  # its size is known then, so texts aren't exchanged to meet a small table
    # md5 is even, so its leading 32 bits deal a source's documents evenly to ranges in the order of the hash
    goal = goal.withColumn("stretches", F.ceil(F.col("n_docs") / STRETCH))
    rows = rows.join(goal.select(F.col("source").alias("s"), "source_size", "target", "ordinal", "stretches"),
                     F.col("source").eqNullSafe(F.col("s"))).drop("s")
    at = F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * F.col("stretches") / F.lit(float(1 << 32)))
    rows = rows.withColumn("stretch", at.cast("long"))
    sums = rows.groupBy("ordinal", "stretch").agg(F.sum("size").alias("words"))
    before = running(materialise(sums, "sums"), SECTION)
    sums = before.select(F.col("ordinal").alias("o"), F.col("stretch").alias("r"), "words_before")
    inside = Window.partitionBy("ordinal", "stretch").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("before", F.sum("size").over(inside) - F.col("size"))
    rows = rows.join(sums, (F.col("ordinal") == F.col("o")) & (F.col("stretch") == F.col("r")))
    before = F.col("words_before") + F.col("before")
    goal_words, full = F.floor("target"), F.col("source_size")
    epochs = F.coalesce(F.floor(F.try_divide(goal_words, full)), F.lit(0)).cast("long")
    rest = goal_words - epochs * full
    cut = F.least(F.greatest(rest - before, F.lit(0)), F.col("size"))
    copies = epochs + F.when((cut == F.col("size")) & (cut > 0), 1).otherwise(0)
    share = F.try_divide(before, goal_words)
    rank = (F.col("ordinal") % len(weights)).cast("int")
    position = invert(share, schedules[0])
    for k in range(1, len(schedules)):
        position = F.when(rank == k, invert(share, schedules[k])).otherwise(position)
    rows = rows.withColumns({"taken": epochs * F.col("size") + cut, "copies": copies, "share": share, "step": F.try_divide(full, goal_words),
                             "cut": F.when(cut < F.col("size"), cut).otherwise(F.lit(0)), "rank": rank})
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, position))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "copies", "cut", "position", "share", "step", "rank",
                       *[F.col(f"_kept_{i}") for i in range(len(keep))])


def by_position(rows: DataFrame) -> DataFrame:
    """Range-sort by training position; untaken documents, which have none, are dealt by a hash of doc_id."""
    tie = F.xxhash64("doc_id")
    return rows.repartitionByRange(F.col("position").asc_nulls_last(), tie).sortWithinPartitions(
        F.col("position").asc_nulls_last(), tie)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: Sequence[Schedule] = SCHEDULES,
        most: int = MOST_EPOCHS) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for every pass over a document, in training order.

    A document that is taken twice is there twice; the one at the end of its source's target is cut after its last taken
    word, and n_chars, if there is such a column, follows. Documents without words have nothing to train on and are left out.
    """
    columns = docs.columns
    rows = plan(docs, weights, schedules, most, keep=columns)
    text_at, chars_at = f"_kept_{columns.index('text')}", columns.index("n_chars") if "n_chars" in columns else None
    passes = F.sequence(F.lit(1).cast("long"), F.col("copies") + F.when(F.col("cut") > 0, 1).otherwise(0))
    rows = rows.where("taken > 0").withColumn("turn", F.explode(passes))
    share = F.col("share") + (F.col("turn") - 1) * F.col("step")
    position = invert(share, schedules[0])
    for k in range(1, len(schedules)):
        position = F.when(F.col("rank") == k, invert(share, schedules[k])).otherwise(position)
    rows = rows.withColumn("position", position)
    words = F.regexp_extract_all(F.col(text_at), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    short = F.array_join(F.slice(words, F.lit(1), F.col("cut").cast("int")), "")
    last = F.col("turn") > F.col("copies")
    rows = rows.withColumn(text_at, F.when(last, short).otherwise(F.col(text_at)))
    if chars_at is not None:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn(f"_kept_{chars_at}", F.when(last, F.length(text_at).cast(kind)).otherwise(F.col(f"_kept_{chars_at}")))
    return by_position(rows).select(*[F.col(f"_kept_{i}").alias(c) for i, c in enumerate(columns)])
