"""Conversation structure repair: the cheapest edits that make role initials read ``(s?(ua)+)?``.

A dynamic program over turns and grammar states. A row's first fault counts: blank (nothing but white space), duplicate
(role and text stand earlier in the conversation), truncated (its last character that is no white space is none of
``.!?``). Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty user or assistant turn, anywhere) 2; a
truncated row that stays costs 1 more; blank and duplicate rows must go. From every state the grammar takes one role of
user and assistant only, so an edit's initial tells the edit, and the least audit string among the cheapest is found by
taking the least initial at each step whose cost is tight.

Rows are dealt by range of (conversation, turn, role, text), so a long conversation lies in many tasks. Each task cuts its
rows into blocks and sums a block up as a matrix: the least cost from each state before to each state after it (min-plus).
The cost-to-go after each block comes from the blocks' matrices alone, last block first; the forward walk then reads each
block once, with the cost-to-go beside it. Only this walk takes a conversation's rows one after the other, in a stream
that holds one block: SHA-256 of the repaired turns has to read them in order. Equal rows are one row with a count from
the first shuffle on, so copies are summed before they are moved.

Defined results: a null role or text is one space, and blank; a null turn comes first and has no part in gaps; rows of one
turn are in the order of role, then text; a null conv_id is a conversation of its own; an empty role, or one whose initial
is none of s, u and a, can't be kept; a conversation without rows gives zeros, an empty audit and the hash of an empty
string; an empty table gives an empty table. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from vigilstream.llm.shared import is_small, written
from vigilstream.llm.textblocks import release

#: Rows of a block; rows of a table that is broadcast.
BLOCK, HELD = 512, 200_000
#: Grammar states: nothing yet, after system, after user, after assistant. What each expects, and its cost at the end.
START, SYSTEM, USER, ASSISTANT = range(4)
EXPECTED = (USER, USER, ASSISTANT, USER)
AT_END = (0, 4, 2, 0)
NAME = {USER: "user", ASSISTANT: "assistant"}
#: By role initial (none of them, s, u, a) and state: the state after the row is kept, -1 where it can't be.
KEPT = ((-1, -1, -1, -1), (SYSTEM, -1, -1, -1), (USER, USER, -1, USER), (-1, -1, ASSISTANT, -1))
LEGAL = {(1, 2), (2, 3), (3, 2)}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
FAR = 1 << 60
#: Where a block stands among the others.
PLACE = (StructField("part", IntegerType()), StructField("block", LongType()))


def _step(role: int, truncated: bool) -> np.ndarray:
    """Least cost from each state to each over one row that may stay, with what is inserted before it."""
    insert = np.full((4, 4), FAR)
    for q in range(4):
        insert[q, q] = 0
        once = EXPECTED[q]
        insert[q, once] = min(insert[q, once], 2)
        insert[q, EXPECTED[once]] = min(insert[q, EXPECTED[once]], 4)
    edit = np.full((4, 4), FAR)
    for q in range(4):
        edit[q, q] = 3
        edit[q, EXPECTED[q]] = min(edit[q, EXPECTED[q]], 2 + truncated)
        if KEPT[role][q] >= 0:
            edit[q, KEPT[role][q]] = min(edit[q, KEPT[role][q]], int(truncated))
    return np.minimum((insert[:, :, None] + edit[None]).min(axis=1), FAR)


#: By 2 * role + truncated.
STEPS = np.stack([_step(role, cut) for role in range(4) for cut in (False, True)])


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text and copies: rows dropped (0 copies), emptied, unpunctuated, repeated (2) or made a user's, by the crc32 of conversation and turn."""
    said = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv), F.lit(":"), said(turn)).cast("binary")) % 20
    new = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(said(text), "[.!?]", "")).otherwise(said(text))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long")
    return rows.select(rows[conv].alias("conv_id"), rows[turn].cast("long").alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(said(role)).alias("role"), new.alias("text"), copies.alias("copies"))


def _marked(rows: DataFrame) -> DataFrame:
    """Distinct rows with copies, initial (0 to 3) and fault; a conversation's dropped rows are one row without a role."""
    gone = F.col("copies") == 0
    null = F.lit(None)
    rows = rows.select("conv_id", F.when(gone, null).otherwise(F.col("turn")).alias("turn"), F.when(gone, null).otherwise(F.col("role")).alias("role"), F.when(gone, null).otherwise(F.col("text")).alias("text"), "copies")
    rows = written(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("digest", F.sha2(F.col("text"), 256)), "turns")
    at = F.struct(F.col("turn").isNotNull().alias("told"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = rows.where("role is not null").groupBy("conv_id", "role", "digest").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = written(first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"), "repeats")
    held = F.broadcast(first) if is_small(first, HELD) else first
    rows = rows.join(held, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
        .when(F.col("first") < at, DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED)
        .otherwise(FINE)
    )
    return rows.select("conv_id", "turn", "role", "text", "copies", code.cast("int").alias("initial"), F.coalesce(fault, F.lit(FINE)).cast("int").alias("fault"))


def _matrices(first: np.ndarray, initial: np.ndarray, fault: np.ndarray, copies: np.ndarray, there: np.ndarray) -> np.ndarray:
    """One 4 x 4 matrix a block; blocks begin at ``first``. All blocks are walked along side by side."""
    stays = there & ((fault == FINE) | (fault == TRUNCATED))
    size = np.diff(np.append(first, len(fault)))
    out = np.full((len(first), 4, 4), FAR)
    out[:, range(4), range(4)] = 0
    step = 2 * initial + (fault == TRUNCATED)
    for j in range(int(size.max(initial=0))):
        here = np.flatnonzero(size > j)
        here = here[stays[first[here] + j]]
        if len(here):
            out[here] = np.minimum((out[here][:, :, :, None] + STEPS[step[first[here] + j]][:, None]).min(axis=2), FAR)
    forced = 3 * np.where(there, copies - stays, 0)
    sums = np.concatenate([[0], np.cumsum(forced)])
    return np.minimum(out + (sums[np.append(first[1:], len(fault))] - sums[first])[:, None, None], FAR)


def _blocks(rows: DataFrame) -> DataFrame:
    """conv_id, part, block, matrix, and the block's rows as lists; parts and blocks are in the rows' order."""
    lists = [StructField(f.name, ArrayType(f.dataType)) for f in rows.schema.fields[1:]]
    schema = StructType([rows.schema["conv_id"], *PLACE, StructField("matrix", ArrayType(LongType())), *lists])
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            conv = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            new = np.ones(n, bool)
            new[1:] = conv[1:] != conv[:-1]
            head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            first = np.flatnonzero((np.arange(n) - head) % BLOCK == 0)
            copies, initial, fault = (batch.column(k).to_numpy() for k in (4, 5, 6))
            matrix = _matrices(first, initial, fault, copies, ~batch.column(2).is_null().to_numpy(zero_copy_only=False))
            ends = pa.array(np.append(first, n), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, c) for c in batch.columns[1:]]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * 16, pa.int32()), pa.array(matrix.ravel()))
            columns = [batch.column(0).take(pa.array(first)), pa.array([part] * len(first)), pa.array(done + np.arange(len(first))), flat, *lists]
            done += len(first)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        release()

    order = ["conv_id", "turn", "role", "text"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(work, schema)


def _to_go(blocks: DataFrame) -> DataFrame:
    """conv_id, part, block, after: what is least to pay after each block, from each state. Reads the matrices only."""
    schema = StructType([blocks.schema["conv_id"], *PLACE, StructField("after", ArrayType(LongType()))])
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cost, begun = None, None, False
        for batch in batches:
            out = []
            matrices = np.array(batch.column(3).flatten()).reshape(-1, 4, 4)
            for conv, m in zip(batch.column(0).to_pylist(), matrices, strict=True):
                if not begun or conv != now:
                    now, cost, begun = conv, np.array(AT_END), True
                out.append(cost.tolist())
                cost = np.minimum((m + cost).min(axis=1), FAR)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, arrow.field(3).type)], schema=arrow)

    rows = blocks.select("conv_id", "part", "block", "matrix").repartition("conv_id")
    return rows.sortWithinPartitions("conv_id", F.desc("part"), F.desc("block")).mapInArrow(work, schema)


class _Conversation:
    """The walk through one conversation: its counts, its audit, and the hash of its repaired turns."""

    def __init__(self, conv: object):
        self.conv, self.state, self.cost = conv, START, 0
        self.counts = [0, 0, 0, 0]
        self.illegal, self.before = 0, None
        self.least = self.most = self.turn = None
        self.turns = 0
        self.audit: list[str] = []
        self.hash, self.said = hashlib.sha256(), 0

    def _say(self, role: str, text: str) -> tuple[int, str, str]:
        self.hash.update((("\n" if self.said else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.said += 1
        return self.said, role, text

    def _insert(self) -> tuple[int, str, str, str]:
        self.state = EXPECTED[self.state]
        self.cost += 2
        self.audit.append("I")
        return (*self._say(NAME[self.state], ""), "I")

    def walk(self, rows: list[tuple], after: list[int]) -> Iterator[tuple[int, str, str, str]]:
        """position, role, text and edit of the turns that are left of a block."""
        rows = [r for r in rows if r[1] is not None]
        to_go = [after]
        for _, _, _, copies, initial, fault in reversed(rows):
            c = to_go[-1]
            if fault in (BLANK, DUPLICATE):
                to_go.append([x + 3 * copies for x in c])
                continue
            base = [3 * (copies - 1) + min(3 + c[q], 2 + (fault == TRUNCATED) + c[EXPECTED[q]], (fault == TRUNCATED) + c[KEPT[initial][q]] if KEPT[initial][q] >= 0 else FAR) for q in range(4)]
            for _ in range(2):
                base = [min(base[q], 2 + base[EXPECTED[q]]) for q in range(4)]
            to_go.append(base)
        to_go.reverse()
        for k, (turn, role, text, copies, initial, fault) in enumerate(rows):
            if turn is not None:
                self.least = turn if self.least is None else self.least
                self.most, self.turns, self.turn = turn, self.turns + (turn != self.turn), turn
            self.illegal += self.before is not None and (self.before, initial) not in LEGAL
            self.illegal += copies - 1
            self.before = initial
            forced = fault in (BLANK, DUPLICATE)
            self.counts[fault] += copies if forced else 1
            self.counts[DUPLICATE] += 0 if forced else copies - 1
            repeats = copies if forced else copies - 1
            if not forced:
                c, rest = to_go[k + 1], 3 * repeats
                cut = int(fault == TRUNCATED)
                while True:
                    left, q = to_go[k][self.state], self.state
                    if 3 + rest + c[q] == left:
                        self.audit.append("D")
                        self.cost += 3
                    elif 2 + to_go[k][EXPECTED[q]] == left:
                        yield self._insert()
                        continue
                    elif KEPT[initial][q] >= 0 and cut + rest + c[KEPT[initial][q]] == left:
                        self.audit.append("K")
                        self.cost += cut
                        self.state = KEPT[initial][q]
                        yield (*self._say(role, text), "K")
                    else:
                        self.audit.append("R")
                        self.cost += 2 + cut
                        self.state = EXPECTED[q]
                        yield (*self._say(NAME[self.state], text), "R")
                    break
            if repeats:
                self.audit.append("D" * repeats)
                self.cost += 3 * repeats

    def end(self) -> Iterator[tuple[int, str, str, str]]:
        while AT_END[self.state]:
            yield self._insert()

    def summary(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.conv, gaps, *self.counts[1:], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


SUMMARY = StructType([*(StructField(x, LongType()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), StructField("audit", StringType()), StructField("repaired_sha256", StringType())])
TURN = StructType([StructField("position", LongType()), StructField("role", StringType()), StructField("text", StringType()), StructField("edit", StringType())])
#: Rows put out at once.
OUT = 1024


def _repaired(rows: DataFrame, turns: bool) -> DataFrame:
    blocks = written(_blocks(_marked(rows)), "blocks")
    after = _to_go(blocks)
    payload = blocks.columns[4:]
    none = [F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in payload]
    both = blocks.select("conv_id", "part", "block", F.lit(1).alias("kind"), F.lit(None).cast("array<long>").alias("after"), *payload)
    both = both.union(after.select("conv_id", "part", "block", F.lit(0).alias("kind"), "after", *none))
    schema = StructType([blocks.schema["conv_id"], *(TURN if turns else SUMMARY).fields])
    arrow = to_arrow_schema(schema)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, cost = None, None
        for b in batches:
            for at in range(len(b)):
                conv, _, _, kind, to_go, *lists = (c[at].as_py() for c in b.columns)
                if not kind:  # comes before its block
                    cost = to_go
                    continue
                if now is None or conv != now.conv:
                    if now is not None:
                        yield from finished(now)
                    now = _Conversation(conv)
                for said in now.walk(list(zip(*lists, strict=True)), cost):
                    if turns:
                        yield (conv, *said)
        if now is not None:
            yield from finished(now)

    def finished(now: _Conversation) -> Iterator[tuple]:
        for said in now.end():
            if turns:
                yield (now.conv, *said)
        if not turns:
            yield now.summary()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row in walked(batches):
            out.append(row)
            if len(out) == OUT:
                yield batch(out)
                out = []
        yield batch(out)
        release()

    return both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block", "kind").mapInArrow(work, schema)


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation of rows (conv_id, turn, role, text, copies): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return _repaired(rows, False)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The turns that are left: conv_id, position (from 1), role, text, and the edit that left them (K, R or I)."""
    return _repaired(rows, True)
