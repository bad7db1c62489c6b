"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from its code point. A trigram's vector binds (multiplies) its
letters' vectors, each permuted (rotated) by its place. A text's vector bundles (adds) the vectors of its trigrams; a
language's prototype bundles those of its training texts, each weighted to the same total. A text goes to the
language whose prototype has the largest cosine with the text's vector.

All training documents count: sums of weighted trigram frequencies per language are bundled within each task and
merged in two steps of aggregation, so that one language with a third of all rows is no large task. Only one vector
a language reaches the driver (``MAX_LANGUAGES`` at most, checked).

Defined results: a null text, or one without a letter, is ``und`` with score 0; ties go to the language first in
alphabetical order; with no training text everything is ``und`` with score 0; a null doc_id counts as held out from
training (its remainder is null) and keeps held_out null; each input row gives one row. A long text is worked on in
pieces, with the same result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from vigilstream.llm.textblocks import release

DIMENSIONS = 1024
MAX_LANGUAGES = 1000
#: Code points, and documents, worked on at once; columns (distinct trigrams) multiplied at once.
BLOCK, ROWS, COLUMNS = 1 << 20, 256, 8192
_LETTER: list[np.ndarray] = []
_VECTOR: dict[int, np.ndarray] = {}


def _letters() -> np.ndarray:
    """By code point: the lower-case letter's code point, 0 for what is no letter."""
    if not _LETTER:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if unicodedata.category(x)[0] == "L":
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTER.append(table)
    return _LETTER[0]


def _vectors(points: np.ndarray) -> np.ndarray:
    """The random vectors of letters (0: between words)."""
    if len(_VECTOR) > 50_000:
        _VECTOR.clear()
    for c in points.tolist():
        if c not in _VECTOR:
            _VECTOR[c] = np.random.Generator(np.random.Philox(key=c)).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1
    return np.stack([_VECTOR[c] for c in points.tolist()])


def _blocks(texts: list[str | None]) -> Iterator[list[int]]:
    """Texts of ``BLOCK`` characters together at most; a longer one is alone."""
    group, size = [], 0
    for k, t in enumerate(texts):
        if group and (size + len(t or "") > BLOCK or len(group) == ROWS):
            yield group
            group, size = [], 0
        group.append(k)
        size += len(t or "")
    if group:
        yield group


def _points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters' code points, with a 0 between words and at both ends of a text, and the text of each."""
    padded = [f" {t or ''} " for t in texts]
    points = _letters()[np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)]
    row = np.repeat(np.arange(len(texts)), [len(t) for t in padded])
    keep = points > 0
    keep[1:] |= (points[:-1] > 0) | (row[1:] != row[:-1])
    keep[:1] = True
    return points[keep], row[keep]


def _pieces(text: str) -> Iterator[np.ndarray]:
    """The same of one long text, ``BLOCK`` characters at a time; each piece begins with the two points before it."""
    last = np.zeros(1, np.uint32)
    for at in range(0, len(text) + 1, BLOCK):
        part = text[at : at + BLOCK] + (" " if at + BLOCK > len(text) else "")
        points = np.concatenate([last, _letters()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]])
        keep = points > 0
        keep[1:] |= points[:-1] > 0
        keep[: len(last)] = True
        points = points[keep]
        yield points
        last = points[-2:]


def _sums(texts: list[str | None], group: list[int], of: np.ndarray, rows: int, weighted: bool) -> np.ndarray:
    """The sums of the vectors of the texts' trigrams, by ``of`` each text; ``weighted``: each text with the same total."""
    if len(group) == 1 and len(texts[group[0]] or "") > BLOCK:
        out, n = np.zeros((rows, DIMENSIONS)), 0
        for points in _pieces(texts[group[0]]):
            found = _trigrams(points, np.zeros(len(points), np.int64))
            out[of[0]] += _bundle(*found, 1)[0]
            n += len(found[2])
        return out / max(n, 1) if weighted else out
    alphabet, distinct, row, at = _trigrams(*_points([texts[k] for k in group]))
    size = np.maximum(np.bincount(row, minlength=len(group)), 1)
    return _bundle(alphabet, distinct, of[row], at, rows, 1 / size[row] if weighted else None)


def _trigrams(points: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """alphabet; distinct trigrams as codes; and for each trigram of the texts its text and its place among the codes."""
    alphabet = np.flatnonzero(np.bincount(points))
    place = np.zeros(int(alphabet[-1]) + 1, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    letter, a = place[points], len(alphabet)
    code = (letter[:-2] * a + letter[1:-1]) * a + letter[2:]
    inside = row[:-2] == row[2:]
    code, row = code[inside], row[:-2][inside]
    if a**3 <= 1 << 22:
        there = np.bincount(code, minlength=a**3)
        distinct = np.flatnonzero(there)
        at = np.zeros(a**3, np.int64)
        at[distinct] = np.arange(len(distinct))
        return alphabet, distinct, row, at[code]
    distinct, at = np.unique(code, return_inverse=True)
    return alphabet, distinct, row, at


def _bundle(alphabet: np.ndarray, distinct: np.ndarray, row: np.ndarray, at: np.ndarray, rows: int, weight: np.ndarray | None = None) -> np.ndarray:
    """The sums of the trigrams' vectors by row."""
    out = np.zeros((rows, DIMENSIONS), np.float32)
    if not len(distinct):
        return out
    first, second, third = (np.roll(_vectors(alphabet), k, axis=1) for k in (2, 1, 0))
    a = len(alphabet)
    for k in range(0, len(distinct), COLUMNS):
        codes = distinct[k : k + COLUMNS]
        vectors = (first[codes // (a * a)] * second[codes // a % a] * third[codes % a]).astype(np.float32)
        if len(distinct) <= COLUMNS:
            cells, w = row * len(codes) + at, weight
        else:
            here = (at >= k) & (at < k + len(codes))
            cells, w = row[here] * len(codes) + (at[here] - k), None if weight is None else weight[here]
        out += np.bincount(cells, w, rows * len(codes)).reshape(rows, -1).astype(np.float32) @ vectors
    return out


def _summed(table: pa.Table) -> pa.Table:
    """One row from the rows of a group; in the order of their parts, so that a rerun gives the same sums."""
    table = table.sort_by("part")
    total = np.sum([np.frombuffer(v, "<f8") for v in table.column("vector").to_pylist()], axis=0)
    first = table.select(["lang", "shard", "part"]).slice(0, 1)
    n = sum(table.column("n").to_pylist())
    return first.append_column("n", pa.array([n], pa.int64())).append_column("vector", pa.array([total.tobytes()], pa.binary()))


def prototypes(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> dict[str, np.ndarray]:
    """One unit vector a language, from all rows with a text and a language."""
    train = docs.select(docs[lang_column].cast("string").alias("lang"), docs[text_column].cast("string").alias("text")).where("lang is not null and text is not null")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for group in _blocks(texts):
                names = sorted({langs[k] for k in group})
                of = np.array([names.index(langs[k]) for k in group])
                sums = _sums(texts, group, of, len(names), True)
                for name, v in zip(names, sums, strict=True):
                    total[name] = total.get(name, 0) + v.astype(np.float64)
                for k in group:
                    n[langs[k]] = n.get(langs[k], 0) + 1
        release()
        part = TaskContext.get().partitionId()
        names = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([part % 64] * len(names), pa.int32()), pa.array([part] * len(names), pa.int32()), pa.array([n[x] for x in names], pa.int64()), pa.array([total[x].tobytes() for x in names], pa.binary())], ["lang", "shard", "part", "n", "vector"])

    kind = "lang string, shard int, part int, n long, vector binary"
    parts = train.mapInArrow(work, kind)
    sums = parts.groupBy("lang", "shard").applyInArrow(_summed, kind).groupBy("lang").applyInArrow(_summed, kind)
    found = sums.select("lang", "vector").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out = {}
    for r in sorted(found, key=lambda r: r.lang):
        v = np.frombuffer(r.vector, "<f8")
        if (size := np.linalg.norm(v)) > 0:
            out[r.lang] = v / size
    return out


class _Judge:
    """Languages and cosines of texts by prototypes."""

    def __init__(self, known: dict[str, np.ndarray]):
        self.names = list(known)
        self.matrix = np.stack([known[x] for x in self.names]).astype(np.float32).T if known else np.zeros((DIMENSIONS, 0), np.float32)

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        letters = _letters()
        pred, score = ["und"] * len(texts), np.zeros(len(texts))
        for group in _blocks(texts):
            vectors = _sums(texts, group, np.arange(len(group)), len(group), False)
            size = np.linalg.norm(vectors, axis=1)
            for i, k in enumerate(group):
                if self.names and size[i] > 0 and _lettered(texts[k], letters):
                    cosine = (vectors[i] @ self.matrix) / size[i]
                    best = int(np.argmax(cosine))
                    pred[k], score[k] = self.names[best], min(1.0, max(0.0, float(cosine[best])))
        return pred, score


def classify(docs: DataFrame, known: dict[str, np.ndarray], text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``keep``, then lang_pred and score (the cosine, 0 where it is below)."""
    judge = _Judge(known)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = judge.judge(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[1:], "lang_pred", "score"])
        release()

    out = docs.select(*[docs[c] for c in keep])
    rows = docs.select(docs[text_column].cast("string"), *[docs[c] for c in keep])
    return rows.mapInArrow(work, StructType([*out.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def recognised(docs: DataFrame, known: dict[str, np.ndarray], least: float = 0.0, letters: int = 1, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, whose text has a letter and, if it has ``letters`` of them, a cosine of ``least`` or more with its language."""
    judge, at = _Judge(known), docs.columns.index(text_column)
    long = lambda t: sum(1 for _ in islice(filter(str.isalpha, t), letters)) == letters

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            rows = zip(texts, *judge.judge(texts), strict=True)
            yield batch.filter(pa.array([x != "und" and (s >= least or not long(t)) for t, x, s in rows], pa.bool_()))
        release()

    return docs.mapInArrow(work, docs.schema)


def _lettered(text: str | None, letters: np.ndarray) -> bool:
    """Whether a letter is among the first characters, or else anywhere."""
    return bool(text) and (any(c.isalpha() for c in text[:64]) or any(letters[ord(c)] for c in text))


def remainder(doc_id: Column, modulus: int = 5) -> Column:
    """crc32 of the id as text, by ``modulus``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def language_id(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score; learns from documents whose remainder is not 0."""
    left = remainder(docs[id_column])
    known = prototypes(docs.where(left != 0), text_column, lang_column)
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), (left == 0).alias("held_out"), docs[text_column].alias("text"))
    return classify(rows, known, keep=("doc_id", "held_out"))
