"""Vectorised work on the bytes of many texts at once: words, their hashes, windows of words."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Bytes of text worked on at once; a longer text is a chunk of its own.
CHUNK = 2 << 20


def _libc(name: str, *arguments: int) -> None:
    try:
        getattr(ctypes.CDLL(None), name)(*arguments)
    except (OSError, AttributeError):  # another C library
        pass


#: Arrays of a megabyte or more are mapped by themselves, so that they go back to the system when they are freed (glibc's
#: M_MMAP_THRESHOLD); left to itself the library keeps what it once had up to 32 MB, in many workers to a machine.
_libc("mallopt", -3, 1 << 20)


def release() -> None:
    """Gives freed memory back to the system; Python workers live on and are many to a machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    _libc("malloc_trim", 0)


@dataclass
class Chunk:
    """Some rows of a record batch. ``offsets`` has one entry more than there are rows."""

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def _whole(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together while they have less than ``size`` bytes of text."""
    waiting, total = [], 0
    for batch in batches:
        if not len(batch):
            continue
        waiting.append(batch)
        total += batch.column(batch.schema.get_field_index(column)).nbytes
        if total >= size:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting, total = [], 0
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK) -> Iterator[Chunk]:
    """Rows of the batches with about ``size`` bytes of text, or one text; a null text has no bytes."""
    for batch in _whole(batches, column, size):
        text = batch.column(batch.schema.get_field_index(column))
        if not pa.types.is_large_string(text.type):
            text = text.cast(pa.large_string())
        at, n = text.offset, len(text)
        _, where, raw = text.buffers()
        offsets = np.frombuffer(where, dtype=np.int64)[at : at + n + 1]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
        start = 0
        while start < n:
            # What is left over goes with the last chunk rather than into one of its own.
            stop = n if offsets[n] - offsets[start] <= size + size // 2 else int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
            stop = min(max(stop, start + 1), n)
            base = offsets[start]
            yield Chunk(batch.slice(start, stop - start), data[base : offsets[stop]], offsets[start : stop + 1] - base)
            start = stop
        del batch, text, raw, where, data, offsets
        pa.default_memory_pool().release_unused()
    release()


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit (splitmix64)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


#: Bytes of a word that are hashed in steps of eight side by side with all others; longer words are hashed one by one.
_STEPWISE = 64


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of words: eight bytes at a time go through ``_mix``, from the length and the seed on.

    Every step is a bijection of the state that is no polynomial, so neither patterns within words nor one seed's
    collisions carry over to another seed.
    """
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    h = _mix(size.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + U64(seed) * U64(0xC2B2AE3D27D4EB4F) + U64(1))
    for at in range(0, min(_STEPWISE, int(size.max(initial=0))), 8):
        here = np.flatnonzero(size > at) if at else slice(None)
        x, left = eight[start[here] + at], size[here] - at
        part = left < 8
        x[part] &= (U64(1) << (left[part] * 8).astype(np.uint64)) - U64(1)
        h[here] = _mix(h[here] ^ x)
    for k in np.flatnonzero(size > _STEPWISE).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]], seed)
    return h


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a chunk: byte spans, 64-bit hashes, and the first word of each row."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def per_row(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_row)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return Words(none, none, none.astype(np.uint64), np.zeros(len(offsets), np.int64))
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(start, end, word_hashes(data, start, end), np.searchsorted(start, offsets))


def windows(word_hash: np.ndarray, width: int) -> np.ndarray:
    """The hash of the ``width`` words from each word on, row ends not looked at."""
    n = len(word_hash) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = word_hash[:n].copy()
    for j in range(1, width):
        h *= U64(0xD6E8FEB86659FD93)
        h ^= h >> U64(32)
        h += word_hash[j : j + n]
    return _mix(h)


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """The words from which ``width`` words of the same row go on."""
    n = int(first[-1])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return np.flatnonzero(left >= width)
