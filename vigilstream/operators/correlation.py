"""Windows that a key's first event opens and that last so long, whatever follows: the next event after opens another.

Which event opens a window depends on the window before, back to the key's first event, so the windows of a key are found
by composing functions. Time is cut into blocks of ``BLOCK`` windows. Within a block, whatever came before, the first
window opens at an event of the block's first window length, or at the first event after that; for each of these, the
windows that follow in the block and the time at which the last of them ends are the block's own affair, and are found for
all blocks of a key at once. A walk over the blocks, with the end that one hands to the next, then picks one of these.

What travels are distinct (key, millisecond) pairs, so a key with a third of all events is spread over its blocks, and a
block has no more of them than it has milliseconds. Events meet their window by key and time cell, each touched by two
windows at most, and the first and last event and the count are aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Windows that fit a block.
BLOCK = 16


def _chains(t: np.ndarray, head: np.ndarray, block: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Of times in order by key and block, ``head`` telling the first of each: the rows at which a block's first window may
    open, the end of the block's last window for each, and the starts of all its windows in the block."""
    n = len(t)
    size = np.diff(np.append(head, n))
    own = np.repeat(np.arange(len(head)), size)
    stop = np.repeat(head + size, size)
    # The row at which the next window opens: times go on from block to block, so that one search serves all.
    low = int(t.min()) if n else 0
    span = int(t.max()) - low + width + 1 if n else 1
    place = own * span + (t - low)
    after = np.minimum(np.searchsorted(place, place + width), stop)
    early = t < block * (width * BLOCK) + width
    first_late = np.minimum(head + np.add.reduceat(early.astype(np.int64), head), head + size - 1) if n else head
    early[first_late] = True
    chosen = np.flatnonzero(early)
    starts, last, now, which = [], t[chosen].copy(), chosen, np.arange(len(chosen))
    rows = []
    while len(now):
        starts.append(t[now]), rows.append(which)
        last[which] = t[now]
        on = after[now] < stop[now]
        now, which = after[now][on], which[on]
    row, start = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, starts))
    order = np.argsort(row, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(chosen)))])
    return chosen, last + width, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(start[order]))


def opened(times: DataFrame, seconds: int = 60) -> DataFrame:
    """key and window_start (milliseconds) of the windows that times (key, t) open; times may repeat."""
    width = seconds * 1000
    length = width * BLOCK
    block = F.expr(f"(t - pmod(t, {length}L)) div {length}L")
    times = times.where("key IS NOT NULL AND t IS NOT NULL").select("key", block.alias("block"), "t").distinct()
    key = times.schema["key"]
    found = StructType([key, *StructType.fromDDL("block long, t long, ends long, starts array<long>").fields])
    names = found.names

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A block of a key may lie in several batches: the last one of a batch waits for the next.
        held: pa.Table | None = None
        for more in batches:
            if not len(more):
                continue
            table = pa.Table.from_batches([more]) if held is None else pa.concat_tables([held, pa.Table.from_batches([more])]).combine_chunks()
            head = _heads(table)
            if head[-1]:
                yield from answer(table.slice(0, head[-1]), head[:-1])
            held = table.slice(head[-1])
        if held is not None:
            yield from answer(held, np.zeros(1, np.int64))

    def answer(table: pa.Table, head: np.ndarray) -> Iterator[pa.RecordBatch]:
        block, t = (table.column(k).to_numpy() for k in (1, 2))
        at, ends, starts = _chains(t, head, block, width)
        rows = table.take(pa.array(at)).combine_chunks()
        yield from pa.Table.from_arrays([*rows.columns, pa.array(ends), starts], names).to_batches()

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, end, open_ = None, None, None, True
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for k, (key, block, t, ends) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)):
                if key != now or end is None:
                    now, end, last = key, t, None
                if block != last:
                    last, open_ = block, True
                if open_ and t >= end:
                    keep[k], end, open_ = True, ends, False
            rows = batch.filter(pa.array(keep))
            starts = rows.column(4)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pc.list_parent_indices(starts)), starts.flatten()], ["key", "window_start"])

    rows = times.repartition("key", "block").sortWithinPartitions("key", "block", "t").mapInArrow(chains, found)
    rows = rows.repartition("key").sortWithinPartitions("key", "block", "t")
    return rows.mapInArrow(picked, StructType([key, *StructType.fromDDL("window_start long").fields]))


def _heads(table: pa.Table) -> np.ndarray:
    """The first rows of blocks."""
    key, block = table.column(0), table.column(1).to_numpy()
    new = block[1:] != block[:-1]
    if len(key) > 1:
        new |= pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy()
    return np.append(0, np.flatnonzero(new) + 1)


def correlation(events: DataFrame, seconds: int = 60, key: str = "ip_hash_key", time: str = "event_time", columns: tuple[str, ...] | None = None) -> DataFrame:
    """Per window: key, window_start (milliseconds), first_event and last_event, and repeat_count. ``columns``: what is told of an event, by default all.

    Events of the sensor itself, and those without a key or a time, are left out. Events at one time are in the order of
    seq_num, nulls first.
    """
    width = seconds * 1000
    own = events.where(~F.coalesce(F.col("self"), F.lit(False))).where(F.col(key).isNotNull() & F.col(time).isNotNull())
    stamp = F.unix_millis(F.col(time).cast("timestamp"))
    # Names that no caller's column has: an event travels as one struct.
    rows = own.select(F.col(key).alias("key"), stamp.alias("t"), F.col("seq_num").alias("n"), F.struct(*[F.col(c) for c in columns or events.columns]).alias("event"))
    cell = lambda c: F.expr(f"({c} - pmod({c}, {width}L)) div {width}L")
    starts = opened(own.select(F.col(key).alias("key"), stamp.alias("t")), seconds)
    starts = starts.select(F.col("key").alias("of"), "window_start", F.explode(F.array(cell("window_start"), cell("window_start") + 1)).alias("touched"))
    met = rows.join(starts, (F.col("key") == F.col("of")) & (cell("t") == F.col("touched")) & (F.col("t") >= F.col("window_start")) & (F.col("t") < F.col("window_start") + width))
    order = F.struct("t", "n")
    return met.groupBy("key", "window_start").agg(F.min_by("event", order).alias("first_event"), F.max_by("event", order).alias("last_event"), F.count("*").alias("repeat_count"))
