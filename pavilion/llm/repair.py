"""Repair of conversations: the cheapest edits after which roles alternate, by a checkpointed dynamic program.

The roles of a good conversation read ``(s?(ua)+)?`` by their initials. A turn is kept, given another role or deleted; turns without text may be
inserted. Backward, every place of a conversation has four costs, one for each state of that pattern; they are stored at every
root-of-n-th place only. Walking forward, the costs between two checkpoints are worked out again, and of the edits that lie on a cheapest path the one
with the least letter is taken, which makes the whole sequence of letters the least.

Turns are range-sorted by conversation and turn, so a conversation of any length is many rows of many tasks. One that lies whole in a task is repaired
there. The others are cut into blocks, and the same costs go from block to block: a block is a min-plus matrix of four by four costs, these
are chained backward, which gives the costs at every block's end; a block then says for each state it may be entered in how it is left, these are chained
forward, and every block is walked on its own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import partitions, small_batches

#: Costs of edits, and of a truncated turn that stays.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: States: nothing yet, after the system turn, after a user's, after an assistant's. The first and the last may end a conversation.
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 40
#: Costs at the end of a conversation: what has to be inserted.
AT_END = (0, 2 * INSERT, INSERT, 0)
#: State after another turn is inserted or a turn gets the role that fits, and that role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
#: State after a turn is kept, by its role's initial (s, u, a, any other) and the state; None where it doesn't fit.
KEPT = ((SYSTEM, None, None, None), (USER, USER, None, USER), (None, None, ASSISTANT, None), (None,) * 4)
#: A turn's fault.
FINE, SHORT, GONE = range(3)
#: Pairs of neighbouring initials (as numbered in KEPT) that are legal.
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: A block of a long conversation has at most so many turns, and is closed beyond so many bytes.
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
SPACES = " \t\n\x0b\x0c\r"

Costs = tuple[int, int, int, int]


def back(code: int, ahead: Costs) -> Costs:
    """Costs before a turn from those after it; inserted turns before it are counted."""
    initial, fault = divmod(code, 3)
    costs = [DELETE + c for c in ahead]
    if fault != GONE:
        stays = TRUNCATED if fault == SHORT else 0
        kept = KEPT[initial]
        for s in range(4):
            cost = REROLE + stays + ahead[NEXT[s]]
            if kept[s] is not None and stays + ahead[kept[s]] < cost:
                cost = stays + ahead[kept[s]]
            if cost < costs[s]:
                costs[s] = cost
    user, assistant = costs[USER], costs[ASSISTANT]
    costs[USER], costs[ASSISTANT] = min(user, INSERT + assistant), min(assistant, INSERT + user)
    costs[START] = min(costs[START], INSERT + costs[USER])
    costs[SYSTEM] = min(costs[SYSTEM], INSERT + costs[USER])
    return tuple(costs)


def checkpoints(codes: bytes, ahead: Costs) -> tuple[int, list[Costs]]:
    """(distance, costs before every ``distance``-th turn and, last, at the end)."""
    step = max(1, math.isqrt(len(codes)))
    kept = [ahead]
    for i in range(len(codes) - 1, -1, -1):
        ahead = back(codes[i], ahead)
        if i % step == 0:
            kept.append(ahead)
    return step, kept[::-1]


def walk(codes: bytes, ahead: Costs, state: int, last: bool) -> tuple[str, list[tuple[int, str | None]], int, int]:
    """(letters, turns, state at the end, cost) of the edits from ``state`` on, where ``ahead`` are the costs after the codes.

    Letters: Delete, Insert, Keep, Rerole. Turns: (index of the turn, or -1 for an inserted one, new role or None). With ``last``
    the conversation ends here and is completed.
    """
    step, kept = checkpoints(codes, ahead)
    letters: list[str] = []
    turns: list[tuple[int, str | None]] = []
    cost = 0
    for number, low in enumerate(range(0, len(codes), step)):
        high = min(low + step, len(codes))
        block = [kept[number + 1]]
        for i in range(high - 1, low, -1):
            block.append(back(codes[i], block[-1]))
        block.append(kept[number])
        block.reverse()
        i = low
        while i < high:
            here, after = block[i - low], block[i - low + 1]
            initial, fault = divmod(codes[i], 3)
            least = here[state]
            if DELETE + after[state] == least:
                letters.append("D")
                cost += DELETE
                i += 1
            elif INSERT + here[NEXT[state]] == least:
                letters.append("I")
                turns.append((-1, ROLE[state]))
                state, cost = NEXT[state], cost + INSERT
            else:
                stays = TRUNCATED if fault == SHORT else 0
                keeps = KEPT[initial][state]
                if keeps is not None and stays + after[keeps] == least:
                    letters.append("K")
                    turns.append((i, None))
                    state, cost = keeps, cost + stays
                else:
                    letters.append("R")
                    turns.append((i, ROLE[state]))
                    state, cost = NEXT[state], cost + REROLE + stays
                i += 1
    while last and state not in (START, ASSISTANT):
        letters.append("I")
        turns.append((-1, ROLE[state]))
        state, cost = NEXT[state], cost + INSERT
    return "".join(letters), turns, state, cost


def matrix(codes: bytes) -> list[int]:
    """Least cost from each state before a block to each state after it, row by row."""
    columns = []
    for goal in range(4):
        costs: Costs = tuple(0 if s == goal else NEVER for s in range(4))
        for code in reversed(codes):
            costs = back(code, costs)
        columns.append(costs)
    return [min(columns[goal][s], NEVER) for s in range(4) for goal in range(4)]


def _codes(kinds: list[int], again: set[int]) -> bytes:
    """Codes for back(): ``kinds`` are 4 * initial + 0 (fine), 1 (truncated) or 2 (blank); ``again`` are the places of duplicates."""
    return bytes(3 * (k >> 2) + (GONE if k & 3 == 2 or i in again else k & 3) for i, k in enumerate(kinds))


def _faults(kinds: list[int], again: set[int]) -> tuple[int, int, int, int]:
    """Blank, duplicate, truncated turns by their first fault, and illegal neighbours."""
    blank = sum(k & 3 == 2 for k in kinds)
    duplicate = sum(kinds[i] & 3 != 2 for i in again)
    truncated = sum(k & 3 == 1 and i not in again for i, k in enumerate(kinds))
    return blank, duplicate, truncated, sum((a >> 2, b >> 2) not in LEGAL for a, b in zip(kinds, kinds[1:]))


def _apply(turns: list[tuple[int, str | None]], roles: list[str], texts: list[str]) -> list[dict]:
    return [{"role": role if role is not None else roles[i], "text": texts[i] if i >= 0 else ""} for i, role in turns]


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_SOLVED = [("conv_id", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("low", pa.int64()), ("high", pa.int64()), ("distinct", pa.int64()),
           ("initial", pa.int32()), ("final", pa.int32()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
           ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("turns", _TURNS)]
SOLVED = ("conv_id long, block long, whole boolean, low long, high long, distinct long, initial int, final int, blank long, duplicate long, truncated long, "
          "illegal long, cost long, audit string, turns array<struct<role: string, text: string>>")


def _batch(rows: list[dict], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in fields], names=[n for n, _ in fields])


def _flushed(rows: Iterator[tuple[dict, int]], fields: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Rows with their bytes, put into batches of some megabytes."""
    held, size = [], 0
    for row, weight in rows:
        held.append(row)
        size += weight + 100
        if size > 4 << 20:
            yield _batch(held, fields)
            held, size = [], 0
    if held:
        yield _batch(held, fields)


def _blocks(batches: Iterator[pa.RecordBatch], block_rows: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns: conversations that begin and end in this partition are repaired, what may go on elsewhere is put into blocks."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() << 32

    def facts(rows: list[tuple], number: int) -> dict:
        turns = [r[0] for r in rows if r[0] is not None]
        return {"block": part + number, "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "distinct": len(set(turns)),
                "initial": rows[0][3] >> 2, "final": rows[-1][3] >> 2}

    def closed(conv: int | None, rows: list[tuple], number: int, whole: bool) -> tuple[dict, int]:
        _, roles, texts, kinds, digests = map(list, zip(*rows))
        out = {"conv_id": conv, "whole": whole, **facts(rows, number)}
        if whole:
            seen: set[str] = set()
            again = set()
            for i, d in enumerate(digests):
                if d in seen:
                    again.add(i)
                seen.add(d)
            letters, turns, _, cost = walk(_codes(kinds, again), AT_END, START, True)
            names = ("blank", "duplicate", "truncated", "illegal")
            out |= {"cost": cost, "audit": letters, "turns": _apply(turns, roles, texts), **dict(zip(names, _faults(kinds, again)))}
        else:
            out |= {"roles": roles, "texts": texts, "kinds": bytes(kinds), "digests": digests}
        return out, sum(map(len, texts))

    def rows() -> Iterator[tuple[dict, int]]:
        held: list[tuple] = []
        conv, size, number, whole = None, 0, 0, False
        for batch in batches:
            names = ("conv_id", "turn", "role", "text", "kind", "digest")
            for this, *row in zip(*(batch.column(c).to_pylist() for c in names)):
                if held and this != conv:
                    yield closed(conv, held, number, whole)
                    held, size, number, whole = [], 0, number + 1, True
                elif len(held) >= block_rows or size >= block_bytes:
                    yield closed(conv, held, number, False)
                    held, size, number, whole = [], 0, number + 1, False
                conv = this
                held.append(tuple(row))
                size += len(row[2])
        if held:
            yield closed(conv, held, number, False)

    more = [("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("kinds", pa.binary()), ("digests", pa.list_(pa.string()))]
    yield from _flushed(rows(), _SOLVED + more)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [_codes(list(k), set(a or ())) for k, a in zip(batch.column("kinds").to_pylist(), batch.column("again").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), batch.column("again"), pa.array(codes, pa.binary()),
                                          pa.array([matrix(c) for c in codes], pa.list_(pa.int64()))], names=["conv_id", "block", "again", "codes", "matrix"])


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from its last to its first: the costs after each."""
    conv, costs = object(), AT_END
    for batch in batches:
        out = []
        for this, block, cells in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "matrix"))):
            last = this != conv
            if last:
                conv, costs = this, AT_END
            out.append({"block": block, "ahead": costs, "last": last})
            costs = tuple(min(cells[4 * s + t] + costs[t] for t in range(4)) for s in range(4))
        yield _batch(out, [("block", pa.int64()), ("ahead", pa.list_(pa.int64())), ("last", pa.bool_())])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[walk(codes, tuple(ahead), s, False)[2] for s in range(4)] for codes, ahead in zip(batch.column("codes").to_pylist(), batch.column("ahead").to_pylist())]
        names = ("conv_id", "block", "ahead", "last")
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.list_(pa.int32()))], names=[*names, "exits"])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from its first to its last: the state in which each is entered."""
    conv, state = object(), START
    for batch in batches:
        entries = []
        for this, exits in zip(batch.column("conv_id").to_pylist(), batch.column("exits").to_pylist()):
            if this != conv:
                conv, state = this, START
            entries.append(state)
            state = exits[state]
        names = ("block", "ahead", "last")
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(entries, pa.int32())], names=[*names, "entry"])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[dict, int]]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, = batch.slice(i, 1).to_pylist()
                letters, turns, _, cost = walk(row["codes"], tuple(row["ahead"]), row["entry"], row["last"])
                found = dict(zip(("blank", "duplicate", "truncated", "illegal"), _faults(list(row["kinds"]), set(row["again"] or ()))))
                yield {**row, **found, "cost": cost, "audit": letters, "turns": _apply(turns, row["roles"], row["texts"])}, sum(map(len, row["texts"]))

    yield from _flushed(rows(), _SOLVED)


def _solve(cut: DataFrame) -> DataFrame:
    """Blocks of conversations that lie in several: the rows of SOLVED."""
    n = partitions(cut.sparkSession)
    said = cut.select("conv_id", "block", F.posexplode("digests").alias("at", "digest"))
    first = said.groupBy("conv_id", "digest").agg(F.min(F.struct("block", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    again = said.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))).where("struct(block, at) <> first")
    again = again.groupBy("block").agg(F.collect_list("at").alias("again"))  # of one block, which is bounded
    codes = cut.select("conv_id", "block", "kinds").join(again, "block", "left").select("conv_id", "block", "kinds", "again")
    codes = materialise(codes.mapInArrow(_matrices, "conv_id long, block long, again array<int>, codes binary, matrix array<long>"), "codes")
    ahead = codes.select("conv_id", "block", "matrix").repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("block").desc())
    ahead = ahead.mapInArrow(_backward, "block long, ahead array<long>, last boolean")
    exits = codes.select("conv_id", "block", "codes").join(ahead, "block")
    exits = exits.mapInArrow(_exits, "conv_id long, block long, ahead array<long>, last boolean, exits array<int>")
    entries = exits.repartition(n, "conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_forward, "block long, ahead array<long>, last boolean, entry int")
    names = [f for f, _ in _SOLVED if f in ("conv_id", "block", "whole", "low", "high", "distinct", "initial", "final")]
    rows = cut.select(*names, "roles", "texts", "kinds").join(codes.select("block", "codes", "again"), "block").join(entries, "block")
    return rows.mapInArrow(_walked, SOLVED)


def repair(conversations: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Repaired conversations (conv_id, turn, role, text), a row a block: blocks of a conversation follow each other by ``block``.

    Columns: conv_id, block, whole (whether the conversation is this block), low, high and distinct (its turn numbers, nulls left out), initial and final (class of
    its first and last role), blank, duplicate, truncated (turns by their first fault), illegal (neighbours within the block whose roles don't follow
    each other), cost, audit (letters of the edits) and turns (role and text after the repair, in order).

    Turns lie by number, nulls first; equal numbers by a hash of role and text. A null role or text is one space. A turn without any character but white space is
    blank, one whose role and text came before is a duplicate; both are deleted. One whose last such character is none of ``.!?`` is truncated. A
    null conv_id is a conversation. Repeated rows are turns. Empty table: no rows. Of a conversation that is cut, no task holds more than a block,
    and what is chained is a few numbers a block.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = small_batches(conversations).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    ends = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(ends == "", 2).when(F.substring(ends, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    rows = rows.withColumns({"kind": number * 4 + fault, "digest": F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")),
                             "row": F.monotonically_increasing_id()})
    by = ("conv_id", "turn", "digest", "row")  # equal rows are dealt to several ranges as well
    rows = rows.repartitionByRange(partitions(conversations.sparkSession), *by).sortWithinPartitions(*by).drop("row")
    cells = f"{SOLVED}, roles array<string>, texts array<string>, kinds binary, digests array<string>"
    blocks = materialise(rows.mapInArrow(lambda batches: _blocks(batches, block_rows, block_bytes), cells), "blocks")
    names = [n for n, _ in _SOLVED]
    return blocks.where("whole").select(*names).unionByName(_solve(blocks.where("NOT whole")).select(*names))


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation in order, one at a time: its numbers and the hash of its text."""
    def rows() -> Iterator[tuple[dict, int]]:
        conv, held = object(), None
        for batch in batches:
            for i in range(batch.num_rows):
                row, = batch.slice(i, 1).to_pylist()
                if held is None or row["conv_id"] != conv:
                    if held is not None:
                        yield done(held), 0
                    conv = row["conv_id"]
                    held = {"conv_id": conv, "low": None, "high": None, "distinct": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0,
                            "letters": [], "sha": hashlib.sha256(), "any": False, "final": None}
                if row["low"] is not None:
                    held["distinct"] += row["distinct"] - (row["low"] == held["high"])
                    held["low"], held["high"] = row["low"] if held["low"] is None else held["low"], row["high"]
                for name in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    held[name] += row[name]
                held["illegal"] += held["final"] is not None and (held["final"], row["initial"]) not in LEGAL
                held["final"] = row["final"]
                held["letters"].append(row["audit"])
                for turn in row["turns"]:
                    held["sha"].update((("\n" if held["any"] else "") + turn["role"] + ":" + turn["text"]).encode())
                    held["any"] = True
        if held is not None:
            yield done(held), 0

    def done(held: dict) -> dict:
        gaps = 0 if held["low"] is None else held["high"] - held["low"] + 1 - held["distinct"]
        return {**held, "gaps": gaps, "audit": "".join(held["letters"]), "repaired_sha256": held["sha"].hexdigest()}

    yield from _flushed(rows(), _REPORT)


_REPORT = [("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
           ("audit", pa.string()), ("repaired_sha256", pa.string())]
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(blocks: DataFrame) -> DataFrame:
    """One row a conversation of repair(): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    gaps: turn numbers left out between the first and the last; repaired_sha256: of the lines ``role:text``. A conversation of several blocks is
    read block by block in one task, since its hash is one sequence; all other work on it is done by then.
    """
    names = [n for n, _ in _REPORT]
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = blocks.where("whole").withColumns({"gaps": F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0).cast("long")),
                                               "repaired_sha256": F.sha2(line, 256)})
    cut = blocks.where("NOT whole").repartition(partitions(blocks.sparkSession), "conv_id").sortWithinPartitions("conv_id", "block")
    return whole.select(*names).unionByName(cut.mapInArrow(_told, REPORT).select(*names))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of turns damaged by a checksum of their numbers: dropped, emptied, unpunctuated, repeated or made a user's.

    Nulls are one space, in the checksum as well; a null turn number stays null.
    """
    space = F.lit(" ")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                *(F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("damage", F.pmod(F.crc32(name.cast("binary")), F.lit(20))).where("damage <> 0")
    damage = F.col("damage")
    text = F.when(damage == 1, "").when(damage == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(damage == 4, "user").otherwise(F.col("role"))
    copies = F.when(damage == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def report_all(conversations: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """report() of the damaged turns, with a row of zeros for a conversation that lost them all."""
    found = report(repair(damaged(conversations), block_rows, block_bytes))
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    rows = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select(F.col("id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
