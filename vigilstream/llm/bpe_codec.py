"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts over ``LONG`` characters are split before they reach the library: a white-space character after one that is
none starts a new match of the pattern whatever stands around it, so the ids of the parts are the ids of the text.
A white-space run over ``RUN`` characters, on which the library's backtracking would fail, is matched here.

Defined results: a null or empty text has no ids and decodes to nothing; a null doc_id stays null; each input row
gives one row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

LONG = 100_000
RUN = 10_000
_BOUNDARY = regex.compile(r"(?<=\P{White_Space})\p{White_Space}")
_LOADED: dict[tuple[str, str], "Codec"] = {}


def runs(length: int) -> regex.Pattern:
    """White space of so many characters or more."""
    return regex.compile(r"\p{White_Space}{%d,}" % length)


_RUN = runs(RUN)


class Codec:
    """Ids of texts by a rank file, and the bytes of ids."""

    def __init__(self, rank_path: str, pattern: str):
        import tiktoken

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts of about ``LONG`` characters, cut only where a match starts in any case."""
        at = 0
        while len(text) - at > LONG:
            cut = _BOUNDARY.search(text, at + LONG)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def _plain(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def _runs(self, text: str) -> Iterator[np.ndarray]:
        at = 0
        for m in _RUN.finditer(text):
            yield self._plain(text[at : m.start()])
            # The pattern takes a run but for its last character, which goes with what follows.
            at = m.end() if m.end() == len(text) else m.end() - 1
            yield np.asarray(self.encoding._encode_single_piece(text[m.start() : at]), np.uint32)
        yield self._plain(text[at:])

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if len(text) <= RUN:
            return self._plain(text).astype("<u4", copy=False)
        parts = [ids for part in self.parts(text) for ids in (self._runs(part) if _RUN.search(part) else (self._plain(part),))]
        return np.concatenate(parts).astype("<u4", copy=False)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())


def codec(rank_path: str, pattern: str) -> Codec:
    key = (rank_path, pattern)
    if key not in _LOADED:
        _LOADED[key] = Codec(rank_path, pattern)
    return _LOADED[key]


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))


def encode(docs: DataFrame, rank_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_path, pattern)
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                ids = [c.encode(t.as_py()) for t in part.column(1)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"])

    return _rows(docs, id_column, text_column).mapInArrow(work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id and the raw bytes (``decoded``) of each row's ids; null ids decode to nothing."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_path, pattern)
        for batch in batches:
            raw = [c.decode(np.asarray(ids.as_py() or [], np.uint32)) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, rank_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: n_tokens, and SHA-256 of the ids (little-endian unsigned 32 bits) and of the decoded bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_path, pattern)
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for text in batch.column(1):
                ids = c.encode(text.as_py())
                n.append(len(ids))
                of_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
                of_bytes.append(hashlib.sha256(c.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs, id_column, text_column).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
