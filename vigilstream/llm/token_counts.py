"""Token counts: pieces are counted once per distinct pre-token, then weighted by each document's frequencies.

A chunk of texts sends its distinct pre-tokens to buckets (``exchange``), where each distinct pre-token of all chunks is
counted once by the tokenizer; the counts join the documents' pre-token frequencies, which went to the chunk's own next
step, and are summed there. The ids of a text are never made, and neither is a row for each pre-token of a document:
frequencies are packed, about a byte or two each.

Defined results: a null or empty text has 0 bytes and 0 tokens; a null doc_id stays null; each input row gives one
row, repeated rows included; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilstream.llm import exchange as ex
from vigilstream.llm import textblocks as tb

CHUNK = 4 << 20
#: Pre-tokens of a text that are listed at once.
LISTED = 200_000
#: The split of a byte-level tokenizer; white space is Unicode's White_Space.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_LOADED: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """Counts of the tokens that the tokenizer file's library gives, without begin, end or other added tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path}: only byte-level tokenizers without normaliser or prefix space are supported")
        added = spec.get("added_tokens") or []
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens that take in their surroundings are not supported")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.pretoken = regex.compile(PRETOKEN)

    def pretokens(self, text: str) -> Iterator[list[str]]:
        """A text's pre-tokens, in lists of ``LISTED`` at most; special strings are left out."""
        for part in self.special.split(text) if self.special is not None else [text]:
            found = self.pretoken.finditer(part)
            while block := [m[0] for m in islice(found, LISTED)]:
                yield block

    def specials(self, text: str) -> int:
        """How many special strings a text has; each is one token."""
        return sum(1 for _ in self.special.finditer(text)) if self.special is not None else 0

    def pieces(self, pretokens: list[str]) -> np.ndarray:
        out = [np.empty(0, np.int64)]
        for k in range(0, len(pretokens), 4096):
            out.append(np.array([len(e) for e in self.tokenizer.encode_batch_fast(pretokens[k : k + 4096], add_special_tokens=False)], np.int64))
        return np.concatenate(out)


class _Numbers(dict):
    """Numbers for strings, in the order in which they come up."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def counter(path: str) -> PieceCounter:
    if path not in _LOADED:
        _LOADED[path] = PieceCounter(path)
    return _LOADED[path]


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers below 2**32, the small ones common: byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _asked(rows: DataFrame, path: str, buckets: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        chunk = TaskContext.get().partitionId() << 32
        for c in tb.chunks(batches, "text", CHUNK):
            chunk += 1
            number = _Numbers()
            ids, times, size, special = [], [], [], []
            for text in c.rows.column(1).to_pylist():
                found = np.zeros(0, np.int64)
                for block in count.pretokens(text or ""):
                    at = np.bincount(np.fromiter(map(number.__getitem__, block), np.int64, len(block)), minlength=len(found))
                    at[: len(found)] += found
                    found = at
                there = np.flatnonzero(found)
                ids.append(there), times.append(found[there]), size.append(len(there))
                special.append(count.specials(text or ""))
            raw = [p.encode() for p in number]
            length = np.array([len(p) for p in raw], np.int64)
            end = np.cumsum(length)
            key = tb.word_hashes(np.frombuffer(b"".join(raw), np.uint8), end - length, end)
            order, bounds = ex.by_bucket(key, buckets)
            out = []
            for to in range(buckets):
                at = order[bounds[to] : bounds[to + 1]]
                if len(at):
                    out.append(ex.row(to, chunk, ex.ASK, b"".join([raw[k] for k in at.tolist()]), _packed(length[at])))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            # A document's pre-tokens are in the order of their places, told as gaps.
            gaps, ordered = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, n in zip(ids, times, strict=True):
                p = place[i]
                by = np.argsort(p)
                gaps.append(np.diff(p[by], prepend=-1)), ordered.append(n[by])
            doc = c.rows.column(0)
            known = doc.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes() + doc.is_null().to_numpy(zero_copy_only=False).astype("<i8").tobytes()
            sizes = np.stack([np.diff(c.offsets), size, special]).astype("<i8").tobytes()
            out.append(ex.row(chunk % buckets, chunk, ex.META, known, sizes, _packed(np.concatenate(gaps)), _packed(np.concatenate(ordered))))
            yield ex.batch(out)

    return rows.mapInArrow(work, ex.SCHEMA)


def _counted(path: str):
    """In a bucket: the pieces of each distinct pre-token, told to each chunk that has it."""

    def work(rows: list[dict]) -> list[tuple]:
        out = [ex.row(r["to"], r["chunk"], r["kind"], r["a"], r["b"], r["c"], r["d"]) for r in rows if r["kind"] != ex.ASK]
        rows = [r for r in rows if r["kind"] == ex.ASK]
        number, asked = _Numbers(), []
        for r in rows:
            end = np.cumsum(_unpacked(r["b"])).tolist()
            asked.append(np.array([number[bytes(r["a"][x:y])] for x, y in zip([0, *end[:-1]], end, strict=True)], np.int64))
        pieces = counter(path).pieces([p.decode() for p in number])
        for r, at in zip(rows, asked, strict=True):
            out.append(ex.row(r["to"], r["chunk"], ex.ANSWER, _packed(pieces[at])))
        return out

    return work


def _summed(table: pa.Table, limit: int) -> pa.Table:
    rows = sorted(ex.views(table), key=lambda r: r["to"])
    meta = next(r for r in rows if r["kind"] == ex.META)
    pieces = np.concatenate([np.empty(0, np.int64), *(_unpacked(r["a"]) for r in rows if r["kind"] == ex.ANSWER)])
    number, null = np.frombuffer(meta["a"], "<i8").reshape(2, -1)
    size, n, special = np.frombuffer(meta["b"], "<i8").reshape(3, -1)
    gap, times = _unpacked(meta["c"]), _unpacked(meta["d"])
    first = np.cumsum(n) - n
    # Places are sums of gaps from each document's first one on.
    so_far = np.concatenate([[0], np.cumsum(gap)])
    place = so_far[1:] - np.repeat(so_far[first], n) - 1
    tokens = np.bincount(np.repeat(np.arange(len(n)), n), times * pieces[place], len(n)).astype(np.int64) + special
    return pa.table({"doc_id": pa.array(number, mask=null > 0), "n_bytes": pa.array(size), "n_tokens": pa.array(tokens), "over_limit": pa.array(tokens > limit)})


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    # A chunk's distinct pre-tokens are a small part of its bytes.
    buckets = ex.buckets(docs, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 32)
    answered = ex.grouped(_asked(rows, tokenizer_path, buckets), "to", _counted(tokenizer_path), buckets)

    def work(table: pa.Table) -> pa.Table:
        out = _summed(table, limit)
        tb.release()
        return out

    return ex.dealt(answered, "chunk", buckets).groupBy("chunk").applyInArrow(work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
