"""Keys of many texts met in buckets and answered to where they came from, packed.

A chunk of texts sends each bucket (key modulo the number of buckets) its distinct keys as one row: some bytes of
the key, its place in the chunk as a gap to the one before, and a byte or a few beside. A bucket sees every chunk's
keys, so it can count or compare them, and answers each chunk in one row. A key that a chunk has several times is
sent once; the other places go to the chunk's own next step, not through the bucket, so a key with a third of all
rows reaches its bucket once for each chunk. Rows for a bucket or chunk are gathered by ``groupBy``.

The number of buckets follows the number of keys (``KEYS`` a bucket), so a bucket stays as large whatever the table.
Chunks send at most as many rows as they have keys; beyond about ``KEYS`` buckets a row carries a key or two, which is
a plain shuffle of keys.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vigilstream.llm.textblocks import release

#: ``to``: the bucket; ``chunk``: the chunk; ``kind``: what the row is; the rest depends on it.
SCHEMA = "to long, chunk long, kind int, a binary, b binary, c binary, d binary, e binary"
NAMES = ["to", "chunk", "kind", "a", "b", "c", "d", "e"]
ASK, ANSWER, REPEATS, META, OUT = range(5)
#: Keys that a bucket holds on average at most; working on them takes about 100 bytes each.
KEYS = 1_000_000
U64 = np.uint64


def buckets(df: DataFrame, keys: int) -> int:
    """For so many keys; as many as there are shuffle partitions at least."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keys // KEYS))


def by_bucket(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket, places kept in order, and the bounds of each bucket."""
    to = (keys % U64(n)).astype(np.uint32 if n > 65_536 else np.uint16)
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(n + 1))


def pack_keys(keys: np.ndarray, n: int, width: int = 7) -> bytes:
    """What is left of each key within one of ``n`` buckets, cut to ``width`` bytes."""
    return np.ascontiguousarray((keys // U64(n)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_keys(raw: bytes, width: int = 7) -> np.ndarray:
    """Keys within their bucket."""
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def pack_places(places: np.ndarray) -> bytes:
    """Ascending places as gaps of a byte; larger gaps follow as four bytes."""
    gap = np.diff(places, prepend=-1)
    large = gap >= 255
    return np.where(large, 255, gap).astype(np.uint8).tobytes() + gap[large].astype("<u4").tobytes()


def unpack_places(raw: bytes, n: int) -> np.ndarray:
    gap = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    large = gap == 255
    gap[large] = np.frombuffer(raw, "<u4", offset=n)
    return np.cumsum(gap) - 1


def row(to: int, chunk: int, kind: int, a: bytes = b"", b: bytes = b"", c: bytes = b"", d: bytes = b"", e: bytes = b"") -> tuple:
    return to, chunk, kind, a, b, c, d, e


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
    columns = zip(*rows, strict=True) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)], NAMES)


def _views(column: pa.ChunkedArray) -> list[memoryview]:
    """Each value of a binary column without nulls, as a view of Arrow's own memory."""
    out = []
    for part in column.chunks:
        _, where, raw = part.buffers()
        at = np.frombuffer(where, np.int32)[part.offset : part.offset + len(part) + 1].tolist() if len(part) else []
        body = memoryview(raw if raw is not None else b"")
        out += [body[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
    return out


def views(table: pa.Table) -> list[dict]:
    """The rows of a group; their bytes are not copied."""
    columns = [table.column(n).to_pylist() for n in NAMES[:3]] + [_views(table.column(n)) for n in NAMES[3:]]
    return [dict(zip(NAMES, x, strict=True)) for x in zip(*columns, strict=True)]


def dealt(df: DataFrame, key: str, n: int) -> DataFrame:
    """Spread over ``n`` partitions by ``key`` where that is more than a shuffle makes by itself."""
    return df.repartition(n, key) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def grouped(df: DataFrame, key: str, work: Callable[[list[dict]], list[tuple]], n: int = 0) -> DataFrame:
    """``work`` on all rows of each ``to`` or ``chunk``, dealt to ``n`` partitions."""

    def each(table: pa.Table) -> pa.Table:
        out = pa.Table.from_batches([batch(work(views(table)))])
        release()
        return out

    return dealt(df, key, n).groupBy(key).applyInArrow(each, SCHEMA)


def distinct(keys: np.ndarray, rank: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First places of distinct keys (of equal ones the place of least rank, then the first), other places, and theirs.

    ``other``: a second part of the keys.

    Returns the places to send, the places that repeat one, and the place that each of those repeats.
    """
    order = np.lexsort((rank, keys) if other is None else (rank, other, keys))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if other is not None:
        new[1:] |= other[order][1:] != other[order][:-1]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))] if len(k) else order
    return np.sort(order[new]), order[~new], head[~new]
