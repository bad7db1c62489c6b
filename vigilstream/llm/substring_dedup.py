"""Substring dedup: words that stand in a window of words which also starts in an earlier document are removed.

Windows of ``width`` words are compared over the corpus; windows repeated at one length alone are extended to twice
that length (two repeated halves, side by side), until no candidates survive. The first length decides what is
removed; the longer ones tell how far repetition goes (``longest``: the largest length, width times a power of two, of
which a window of the document stands in another document too).

Documents with the same word sequence are classes, found by its SHA-256; only the one of least doc_id takes part, the
others are removed whole. The windows of the rest meet in buckets (``exchange``) twice. First by short keys, as long as
the number of windows needs to leave few strangers together: what meets nobody is done with. The windows left, of texts
read again, meet by two hashes of independent seeds, 120 bits and more, which stand for the words. A repeated window goes
once from each chunk of texts to its bucket, so copies don't gather in a task, and only repeated windows come back.
Longer lengths are made of two halves' hashes (64 bits; they decide ``longest`` alone).

Defined results: a null text has no words; fewer than ``width`` words are never removed; a null doc_id neither loses
words nor takes them from others; documents of equal doc_id don't take words from each other, and are told apart by
their texts; each input row gives one row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilstream.llm import exchange as ex
from vigilstream.llm import textblocks as tb
from vigilstream.llm.shared import forget, is_small, written

CHUNK = 4 << 20
#: A broadcast may have this many rows, of about 40 bytes each, and this many bytes of packed places.
HELD, HELD_BYTES = 500_000, 64 << 20
#: Bits of a short key beyond those that number the windows: a window meets a stranger once in 2**SPARE times.
SPARE = 10
U64 = np.uint64
_JOIN = U64(0xD6E8FEB86659FD93)


def joined(data: np.ndarray, words: tb.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words with a space between those of a row, and the rows' bounds among them."""
    start, end, row = words.start[keep], words.end[keep], words.row()[keep]
    later = np.zeros(len(start), bool)
    later[1:] = row[1:] == row[:-1]
    # The byte before a later word of a row is white space of that row, and is taken as the space.
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start - later] += 1
    edge[end] -= 1
    out = data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    size = end - start + later
    to = np.cumsum(size) - size
    out[to[later]] = 32
    bounds = np.concatenate([to, [len(out)]])[np.searchsorted(row, np.arange(len(words.first)))]
    return out, bounds


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, tk, n_words, and the SHA-256 of the words joined by spaces."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in tb.chunks(batches, size=CHUNK):
            w = tb.words(c.data, c.offsets)
            text, at = joined(c.data, w, np.ones(len(w.start), bool))
            raw = memoryview(text)
            sha = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([c.rows.column(0), c.rows.column(1), pa.array(w.per_row.astype(np.int64)), pa.array(sha, pa.binary())], ["doc_id", "tk", "n_words", "sha"])

    return docs.mapInArrow(work, "doc_id long, tk long, n_words long, sha binary")


def _held(df: DataFrame, packed: str | None = None) -> DataFrame:
    """To be broadcast, if its rows, and the bytes of a packed column, are few."""
    small = is_small(df, HELD) and (packed is None or (df.agg(F.sum(F.length(packed))).first()[0] or 0) <= HELD_BYTES)
    return F.broadcast(df) if small else df


@dataclass
class _Windows:
    """Windows of a chunk: hashes, places (the word's, one more for each document before, so that windows of two
    documents are never side by side), and rows; with the ids of the rows, their text keys, and their first places."""

    key: np.ndarray
    other: np.ndarray | None
    place: np.ndarray
    doc: np.ndarray
    ids: np.ndarray
    tks: np.ndarray
    start: np.ndarray

    def sent(self, chunk: int, buckets: int, size: int, ids: bool) -> list[tuple]:
        """The rows that go to buckets (distinct windows) and to the chunk itself (repeats, and what it is made of)."""
        rank = np.unique(self.ids, return_inverse=True)[1][self.doc]
        send, repeat, of = ex.distinct(self.key, rank, self.other)
        elsewhere = np.zeros(len(self.key), bool)
        elsewhere[of[rank[repeat] != rank[of]]] = True
        order, bounds = ex.by_bucket(self.key[send], buckets)
        rows = []
        for to in range(buckets):
            at = send[order[bounds[to] : bounds[to + 1]]]
            if len(at):
                head = b""
                if ids:  # places ascend, and with them documents, so ids are sent once for each run
                    doc = self.ids[self.doc[at]]
                    runs = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1))
                    head = doc[runs].astype("<i8").tobytes() + np.diff(runs, append=len(at)).astype("<u4").tobytes()
                second = b"" if self.other is None else self.other[at].astype("<u8").tobytes()
                rows.append(ex.row(to, chunk, ex.ASK, ex.pack_keys(self.key[at], buckets, size), ex.pack_places(self.place[at]), head, np.packbits(elsewhere[at]).tobytes(), second))
        if len(repeat):
            first = (rank[repeat] > rank[of]).astype(np.uint8)
            rows.append(ex.row(chunk % buckets, chunk, ex.REPEATS, self.place[repeat].astype("<i8").tobytes(), self.place[of].astype("<i8").tobytes(), first.tobytes()))
        rows.append(ex.row(chunk % buckets, chunk, ex.META, *(x.astype("<i8").tobytes() for x in (self.ids, self.tks, self.start))))
        return rows


def _sending(width: int, buckets: int, size: int, chosen: bool):
    """Sends a chunk's windows: all of them by short keys, or the ``chosen`` ones of a fourth column by two hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for c in tb.chunks(batches, size=CHUNK):
            chunk += 1
            w = tb.words(c.data, c.offsets)
            at = tb.window_starts(w.first, width)
            if chosen:
                at = np.concatenate([first + unpacked(p) for first, p in zip(w.first[:-1], c.rows.column(3), strict=True)])
            if not len(at):
                continue
            doc = np.searchsorted(w.first, at, side="right") - 1
            other = tb.windows(tb.word_hashes(c.data, w.start, w.end, 1), width)[at] if chosen else None
            ids, tks = (c.rows.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            found = _Windows(tb.windows(w.hash, width)[at], other, at + doc, doc, ids, tks, w.first[:-1] + np.arange(len(ids)))
            yield ex.batch(found.sent(chunk, buckets, size, chosen))

    return work


def packed(places: np.ndarray) -> bytes:
    return len(places).to_bytes(8, "little") + ex.pack_places(places)


def unpacked(raw: pa.BinaryScalar) -> np.ndarray:
    raw = raw.as_buffer()
    return ex.unpack_places(memoryview(raw)[8:], int.from_bytes(memoryview(raw)[:8], "little"))


def _groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys in parts (the last one first in order): the order, the first of each group in it, and each key's group."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    head = np.flatnonzero(new)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, head, group


def _flags(rows: list[dict], sizes: list[int]) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(r["d"], np.uint8), count=n) for r, n in zip(rows, sizes, strict=True)])


def _met(size: int):
    """In a bucket: which short keys come from two chunks, or from two documents of one."""

    def work(rows: list[dict]) -> list[tuple]:
        out = [ex.row(r["to"], r["chunk"], r["kind"], r["a"], r["b"], r["c"]) for r in rows if r["kind"] != ex.ASK]
        rows = [r for r in rows if r["kind"] == ex.ASK]
        if not rows:
            return out
        keys = [ex.unpack_keys(r["a"], size) for r in rows]
        sizes = [len(k) for k in keys]
        order, head, group = _groups([np.concatenate(keys)])
        several = np.diff(head, append=len(order)) > 1
        several |= np.maximum.reduceat(_flags(rows, sizes)[order], head) > 0
        met, bounds = several[group], np.cumsum([0, *sizes])
        for r, lo, hi in zip(rows, bounds[:-1], bounds[1:], strict=True):
            at = np.flatnonzero(met[lo:hi])
            if len(at):
                out.append(ex.row(r["to"], r["chunk"], ex.ANSWER, packed(ex.unpack_places(r["b"], hi - lo)[at])))
        return out

    return work


def _suspects(rows: list[dict]) -> list[tuple]:
    """In a chunk: the windows of each document that met another, by their first words."""
    meta = next((r for r in rows if r["kind"] == ex.META), None)
    answers = [r for r in rows if r["kind"] == ex.ANSWER]
    if meta is None or not answers:
        return []
    ids, tks, start = (np.frombuffer(meta[x], "<i8") for x in "abc")
    place = np.sort(np.concatenate([ex.unpack_places(r["a"][8:], int.from_bytes(r["a"][:8], "little")) for r in answers]))
    for r in rows:
        if r["kind"] == ex.REPEATS:
            again, of = np.frombuffer(r["a"], "<i8"), np.frombuffer(r["b"], "<i8")
            i = np.minimum(np.searchsorted(place, of), len(place) - 1)
            place = np.sort(np.concatenate([place, again[place[i] == of]]))
    doc = np.searchsorted(start, place, side="right") - 1
    edges = np.flatnonzero(np.diff(doc, prepend=-1, append=-2))
    return [ex.row(int(ids[doc[lo]]), int(tks[doc[lo]]), ex.OUT, packed(place[lo:hi] - start[doc[lo]])) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


def _compare(wide: bool):
    """In a bucket: which windows stand in two documents, and which of them in one of smaller id."""

    def work(rows: list[dict]) -> list[tuple]:
        out = [ex.row(r["to"], r["chunk"], r["kind"], r["a"], r["b"], r["c"]) for r in rows if r["kind"] != ex.ASK]
        rows = [r for r in rows if r["kind"] == ex.ASK]
        if not rows:
            return out
        keys = [ex.unpack_keys(r["a"]) for r in rows]
        sizes = [len(k) for k in keys]
        bounds = np.cumsum([0, *sizes])
        key, ids = np.concatenate(keys), []
        for r in rows:
            n = len(r["c"]) // 12
            ids.append(np.repeat(np.frombuffer(r["c"], "<i8", n), np.frombuffer(r["c"], "<u4", offset=8 * n)))
        doc = np.concatenate(ids)
        other = np.concatenate([np.frombuffer(r["e"], "<u8") for r in rows]) if wide else None
        order, head, group = _groups([other, key] if wide else [key])
        least, most = np.minimum.reduceat(doc[order], head), np.maximum.reduceat(doc[order], head)
        some = np.maximum.reduceat(_flags(rows, sizes)[order], head)
        repeated = ((least != most) | (some > 0))[group]
        smaller = (least[group] < doc).astype(np.uint8)
        whole = tb._mix(key ^ tb._mix(U64(rows[0]["to"] + 1) + (other if wide else U64(0))))
        for r, lo, hi in zip(rows, bounds[:-1], bounds[1:], strict=True):
            at = np.flatnonzero(repeated[lo:hi])
            if len(at):
                place = ex.unpack_places(r["b"], hi - lo)[at]
                out.append(ex.row(r["to"], r["chunk"], ex.ANSWER, whole[lo:hi][at].astype("<u8").tobytes(), ex.pack_places(place), smaller[lo:hi][at].tobytes()))
        return out

    return work


def _extend(length: int, width: int, buckets: int):
    """In a chunk: words to remove (at the first length), documents that reach the length, and windows of twice the length."""

    def work(rows: list[dict]) -> list[tuple]:
        answers = [r for r in rows if r["kind"] == ex.ANSWER]
        meta = next((r for r in rows if r["kind"] == ex.META), None)
        if meta is None or not answers:
            return []
        ids, tks, start = (np.frombuffer(meta[x], "<i8") for x in "abc")
        place = np.concatenate([ex.unpack_places(r["b"], len(r["c"])) for r in answers])
        key, small = (np.concatenate([np.frombuffer(r[x], t) for r in answers]) for x, t in (("a", "<u8"), ("c", np.uint8)))
        order = np.argsort(place)
        place, key, small = place[order], key[order], small[order]
        for r in rows:
            if r["kind"] == ex.REPEATS:
                again, of = np.frombuffer(r["a"], "<i8"), np.frombuffer(r["b"], "<i8")
                i = np.minimum(np.searchsorted(place, of), len(place) - 1)
                there = place[i] == of
                i = i[there]
                place = np.concatenate([place, again[there]])
                small = np.concatenate([small, small[i] | np.frombuffer(r["c"], np.uint8)[there]])
                key = np.concatenate([key, key[i]])
        order = np.argsort(place)
        place, key, small = place[order], key[order], small[order]
        out = []
        doc = np.searchsorted(start, place, side="right") - 1
        if length == width:
            gone = small > 0
            spans = (place - start[doc])[gone]
            of = doc[gone]
            edges = np.flatnonzero(np.diff(of, prepend=-1, append=-2)) if len(of) else []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                at = spans[lo:hi]
                new = np.concatenate([[True], np.diff(at) > width])
                begin, end = at[new], at[np.concatenate([new[1:], [True]])] + width
                out.append(ex.row(int(ids[of[lo]]), int(tks[of[lo]]), ex.OUT, np.stack([begin, end]).astype("<i8").tobytes()))
        for d in np.unique(doc).tolist():
            out.append(ex.row(int(ids[d]), int(tks[d]), ex.OUT, b""))
        # Two repeated windows side by side are a candidate of twice the length.
        i = np.minimum(np.searchsorted(place, place + length), len(place) - 1)
        both = place[i] == place + length
        if both.any():
            twice = _Windows(tb._mix(key[both] * _JOIN + key[i[both]]), None, place[both], doc[both], ids, tks, start)
            out += twice.sent(meta["chunk"], buckets, 7, True)
        return out

    return work


def suspects(docs: DataFrame, width: int, n: int) -> DataFrame:
    """doc_id, tk and packed places of the windows that may stand in another document; ``n``: how many windows there are."""
    buckets = ex.buckets(docs, n)
    size = min(7, max(4, math.ceil((math.log2(n + 1) + SPARE - math.log2(buckets)) / 8)))
    asked = docs.select("doc_id", "tk", "text").mapInArrow(_sending(width, buckets, size, False), ex.SCHEMA)
    found = ex.grouped(ex.grouped(asked, "to", _met(size), buckets), "chunk", _suspects, buckets)
    found = found.select(F.col("to").alias("doc_id"), F.col("chunk").alias("tk"), F.col("a").alias("places"))
    # Repeated rows of one document have the same suspects.
    return written(found.dropDuplicates(["doc_id", "tk"]), "suspects")


def repeats(docs: DataFrame, width: int, n: int) -> list[DataFrame]:
    """Written tables of doc_id, tk, spans (begins then ends of word ranges to remove; empty for mere lengths) and length."""
    marked = suspects(docs, width, n)
    windows = marked.agg(F.sum(F.length("places"))).first()[0] or 0
    buckets = ex.buckets(docs, windows)
    texts = docs.join(_held(marked, "places"), ["doc_id", "tk"]).select("doc_id", "tk", "text", "places")
    asked = texts.mapInArrow(_sending(width, buckets, 7, True), ex.SCHEMA)
    out, length, before = [], width, marked
    while True:
        answered = ex.grouped(asked, "to", _compare(length == width), buckets)
        found = written(ex.grouped(answered, "chunk", _extend(length, width, buckets), buckets), f"windows-{length}")
        some = found.where(F.col("kind") == ex.OUT).select(F.col("to").alias("doc_id"), F.col("chunk").alias("tk"), F.col("a").alias("spans"), F.lit(length).cast("long").alias("length"))
        out.append(written(some.groupBy("doc_id", "tk").agg(F.max("spans").alias("spans"), F.max("length").alias("length")), f"repeats-{length}"))
        forget(before)
        asked, before = found.where(F.col("kind") != ex.OUT), found
        if is_small(asked, 0):
            forget(found)
            return out
        length *= 2


def substring_dedup(docs: DataFrame, width: int = 13, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and longest."""
    text = docs[text_column].cast("string")
    docs = docs.select(docs[id_column].cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text"))
    base = written(profiles(docs), "profiles")
    members = base.where(f"n_words >= {width} and doc_id is not null")
    classes = members.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    classes = written(classes.where("rep <> last").drop("last"), "classes")
    profiled = base
    base = written(base.join(_held(classes), "sha", "left").select("doc_id", "tk", "n_words", "rep", "sha"), "marked")
    forget(profiled), forget(classes)
    copies = base.where("rep < doc_id").select("doc_id", "tk").distinct()
    active = docs.where("doc_id is not null").join(_held(copies), ["doc_id", "tk"], "left_anti")
    n = base.where(f"n_words >= {width} and doc_id is not null and (rep is null or rep = doc_id)").agg(F.sum("n_words")).first()[0] or 0
    levels = repeats(active, width, n)
    found = reduce(DataFrame.unionByName, levels).groupBy("doc_id", "tk").agg(F.max("spans").alias("spans"), F.max("length").alias("length"))
    found = written(found, "found")
    for level in levels:
        forget(level)
    cut = _cut(docs.join(_held(found.where("length(spans) > 0").select("doc_id", "tk", "spans"), "spans"), ["doc_id", "tk"]))
    cut = written(cut.dropDuplicates(["doc_id", "tk"]), "cut")
    lengths = found.select("doc_id", "tk", "length")
    out = base.join(_held(cut), ["doc_id", "tk"], "left").join(_held(lengths), ["doc_id", "tk"], "left")
    copy = F.coalesce(F.col("rep") < F.col("doc_id"), F.lit(False))
    whole = F.when(F.col("rep").isNotNull(), _largest(F.col("n_words"), width))
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", zero)).alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.coalesce(F.greatest(whole, F.col("length")), zero).alias("longest"),
    )


def _largest(n, width: int):
    """The largest width * 2**k up to n."""
    return (F.lit(width) * F.pow(F.lit(2.0), F.floor(F.log2(n / F.lit(width)) + 1e-12))).cast("long")


def _cut(marked: DataFrame) -> DataFrame:
    """doc_id, tk, removed and kept_sha256 of texts with spans to remove."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in tb.chunks(batches, size=CHUNK):
            w = tb.words(c.data, c.offsets)
            change = np.zeros(len(w.start) + 1, np.int64)
            for first, spans in zip(w.first[:-1], c.rows.column(3).to_pylist(), strict=True):
                begin, end = np.frombuffer(spans, "<i8").reshape(2, -1)
                change[first + begin] += 1
                np.subtract.at(change, first + end, 1)
            gone = np.cumsum(change)[:-1] > 0
            text, at = joined(c.data, w, ~gone)
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
            sha = [hashlib.sha256(memoryview(text)[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([c.rows.column(0), c.rows.column(1), pa.array(removed.astype(np.int64)), pa.array(sha, pa.string())], ["doc_id", "tk", "removed", "kept_sha256"])

    return marked.select("doc_id", "tk", "text", "spans").mapInArrow(work, "doc_id long, tk long, removed long, kept_sha256 string")
