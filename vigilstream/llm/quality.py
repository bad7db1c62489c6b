"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of n-grams: every three bytes in a row, and one, two and three words in a row by their
shape (case, last character, and whether the word repeats the one before). Each indicator is scaled by the log ratio of
its smoothed share among the n-grams of good texts to that among bad texts (the log-count ratio), a text's vector is
brought to length 1, and a linear model with hinge loss is fitted by dual coordinate descent. A score is the logistic
function of twice the margin.

The counts behind the ratios are over all labelled training rows: each task counts in an array, tasks' counts are added by
n-gram. The number of n-grams is bounded by their kind (``FEATURES``), so counts, ratios and weights fit a worker whatever
the corpus. The model is fitted, in one task, on at most ``FIT_ROWS`` labelled rows of each class, drawn by a hash of
their ids; everything else covers all rows.

Defined results: a null or empty text has no n-gram and gets the score of the intercept alone; a null label is none; a
document with several labels has the least of them, and one that isn't 0 counts as 1; a null doc_id has no remainder, is
not learned from and keeps held_out null; each input row gives one row; without training rows of both classes every score
is 0.5. A long text is worked on in pieces, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from vigilstream.llm.language_id import remainder
from vigilstream.llm.shared import is_small
from vigilstream.llm.textblocks import chunks, release, words

#: Rows of each class that the model is fitted on, and rows of a table that is broadcast.
FIT_ROWS, HELD = 5_000, 500_000
SMOOTHING, COST, EPOCHS = 1.0, 1.0, 30
#: Bytes of one text worked on at once.
PIECE = 4 << 20
#: N-grams of three bytes, then of one, two and three shapes.
SHAPES = 64
FEATURES = (1 << 24) + SHAPES + SHAPES**2 + SHAPES**3


def _shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray, hash_: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1 to 50 for each word: five kinds of case, five of the last character, and whether the word before is the same."""
    n = len(data)
    upper, lower = (data >= 65) & (data <= 90), ((data >= 97) & (data <= 122)) | (data >= 128)
    sums = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int32)]) if n else np.zeros(1, np.int32)
    up, low = (s[end] - s[start] for s in (sums(upper), sums(lower)))
    head = upper[start] if n else np.zeros(0, bool)
    case = np.select([up + low == 0, up == 0, head & (up == 1), low == 0], [0, 1, 2, 3], 4)
    last = data[end - 1] if n else np.zeros(0, np.uint8)
    alike = ((last >= 48) & (last <= 57)) | ((last >= 65) & (last <= 90)) | ((last >= 97) & (last <= 122)) | (last >= 128)
    tail = np.select([alike, (last == 44) | (last == 58) | (last == 59), last == 46, (last == 33) | (last == 63)], [0, 1, 2, 3], 4)
    again = np.zeros(len(start), bool)
    again[1:] = hash_[1:] == hash_[:-1]
    again[first[:-1][first[:-1] < len(start)]] = False
    return 1 + case * 10 + tail * 2 + again


def _shape_grams(shape: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Three codes a word: of itself, with the one before, with the two before (0: none)."""
    place = np.arange(len(shape)) - np.repeat(first[:-1], np.diff(first))
    one = np.where(place >= 1, np.roll(shape, 1), 0)
    two = np.where(place >= 2, np.roll(shape, 2), 0)
    base = 1 << 24
    return np.stack([base + shape, base + SHAPES + one * SHAPES + shape, base + SHAPES + SHAPES**2 + (two * SHAPES + one) * SHAPES + shape], axis=1).astype(np.int32)


def _bytes(data: np.ndarray) -> np.ndarray:
    """Codes of all three bytes in a row."""
    if len(data) < 3:
        return np.zeros(0, np.int32)
    x = data.astype(np.int32)
    return (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]


def _long(data: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of one long text, piece by piece; pieces end at white space and share three words, which are coded once."""
    lo, skip = 0, 0
    blank = np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))
    while lo < len(data):
        hi, w = lo, None
        while w is None or len(w.start) < 4 and hi < len(data):  # longer, where words are longer than a piece
            at = int(np.searchsorted(blank, hi + PIECE))
            hi = int(blank[at]) if at < len(blank) else len(data)
            part = data[lo:hi]
            w = words(part, np.array([0, len(part)]))
        yield _bytes(part)
        yield _shape_grams(_shapes(part, w.start, w.end, w.hash, w.first), w.first)[skip:].ravel()
        if hi == len(data):
            return
        # The next piece begins three words back: their codes are known, and the words after them have their whole past.
        lo, skip = lo + int(w.start[-3]), 3


def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[np.ndarray]]]]:
    """Batches of rows, and for each row its codes in some arrays, with repeats. The column ``text`` must be there."""
    for chunk in chunks(batches):
        if len(chunk) == 1 and len(chunk.data) > PIECE:
            yield chunk.rows, [list(_long(chunk.data))]
            continue
        at = chunk.offsets
        w = words(chunk.data, at)
        grams = _shape_grams(_shapes(chunk.data, w.start, w.end, w.hash, w.first), w.first)
        triple = _bytes(chunk.data)
        yield chunk.rows, [[triple[at[k] : max(at[k], at[k + 1] - 2)], grams[w.first[k] : w.first[k + 1]].ravel()] for k in range(len(chunk))]


class Distinct:
    """Tells the first of equal codes, by marks in an array of all of them."""

    def __init__(self, codes: int):
        self.mark = np.zeros(codes, np.int32)

    def __call__(self, parts: list[np.ndarray]) -> np.ndarray:
        codes = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        place = np.arange(len(codes), dtype=np.int32)
        self.mark[codes] = place
        return codes[self.mark[codes] == place]


@dataclass(frozen=True)
class Model:
    """Codes in order; the log-count ratio of each and its weight, times the ratio; the intercept."""

    codes: np.ndarray
    ratio: np.ndarray
    weight: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        """The place of each code among the known ones, one more than the last where it isn't known."""
        out = np.full(FEATURES, len(self.codes), np.int32)
        out[self.codes] = np.arange(len(self.codes), dtype=np.int32)
        return out


def labelled(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str) -> DataFrame:
    """doc_id, text and y (0 or 1) of the rows that are learned from."""
    y = labels.where(labels[label_column].isNotNull() & labels[id_column].isNotNull()).groupBy(labels[id_column].cast("long").alias("doc_id")).agg(F.min(label_column).alias("y"))
    y = y.select("doc_id", F.when(F.col("y") == 0, 0).otherwise(1).alias("y"))
    rows = docs.where(remainder(docs[id_column], 3) != 1).select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return rows.join(F.broadcast(y) if is_small(labels, HELD) else y, "doc_id")


def counted(rows: DataFrame) -> tuple[pa.Table, list[int]]:
    """code, bad, good: how many rows of either class have an n-gram; and how many rows the classes have (code -1)."""
    schema = StructType([StructField("code", IntegerType()), StructField("bad", LongType()), StructField("good", LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sizes, distinct = [None, None], [0, 0], None
        for rows, codes in coded(batches):
            if distinct is None:
                distinct, counts = Distinct(FEATURES), [np.zeros(FEATURES, np.int32) for _ in range(2)]
            for y, parts in zip(rows.column(0).to_pylist(), codes, strict=True):
                counts[y][distinct(parts)] += 1
                sizes[y] += 1
        if distinct is not None:
            there = np.flatnonzero(counts[0] | counts[1])
            columns = [np.append(there, -1).astype(np.int32), *(np.append(c[there], n).astype(np.int64) for c, n in zip(counts, sizes, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["code", "bad", "good"])
        del counts, distinct
        release()

    found = rows.select("y", "text").mapInArrow(work, schema).groupBy("code").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    codes = found.column("code").to_numpy()
    own = np.flatnonzero(codes < 0)
    sizes = [int(found.column(c).to_numpy()[own].sum()) for c in ("bad", "good")]
    return found.filter(pa.array(codes >= 0)), sizes


def ratios(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Codes in order, and the log-count ratio of each."""
    codes, bad, good = (found.column(c).to_numpy() for c in ("code", "bad", "good"))
    order = np.argsort(codes)
    bad, good = bad[order] + SMOOTHING, good[order] + SMOOTHING
    return codes[order].astype(np.int32), np.log(good / good.sum()) - np.log(bad / bad.sum())


def descend(first: np.ndarray, places: np.ndarray, values: np.ndarray, y: np.ndarray, size: int, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and intercept of the least of |w|^2 / 2 + COST * sum of hinge losses, one dual variable at a time.

    Rows are ``places`` and ``values`` from ``first[k]`` to ``first[k + 1]``, with the intercept as one more value of 1;
    y is +1 or -1.
    """
    w, b, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    rnd = np.random.Generator(np.random.PCG64(1))
    norm = 1.0 + np.array([values[i:j] @ values[i:j] for i, j in zip(first[:-1], first[1:], strict=True)])
    for _ in range(epochs):
        worst = 0.0
        for k in rnd.permutation(len(y)).tolist():
            at, x = places[first[k] : first[k + 1]], values[first[k] : first[k + 1]]
            slope = y[k] * (w[at] @ x + b) - 1.0
            new = min(max(alpha[k] - slope / norm[k], 0.0), COST)
            if (step := new - alpha[k]) != 0.0:
                alpha[k] = new
                w[at] += step * y[k] * x
                b += step * y[k]
                worst = max(worst, abs(step) * norm[k])
        if worst < 1e-3:
            break
    return w, b


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Model | None:
    """The model of the rows that are learned from; none where a class has no row."""
    rows = labelled(docs, labels, id_column, text_column, label_column)
    found, sizes = counted(rows)
    if not all(sizes):
        return None
    codes, ratio = ratios(found)
    table = Model(codes, ratio, ratio, 0.0).table

    # Rows of either class are drawn by a hash of their ids; the limit holds where an id is repeated very often.
    share = F.when(F.col("y") == 0, FIT_ROWS / sizes[0]).otherwise(FIT_ROWS / sizes[1])
    drawn = rows.where((F.xxhash64("doc_id") % (1 << 20) + (1 << 20)) / float(1 << 21) < share)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, distinct = None, None
        for rows, parts in coded(batches):
            if known is None:
                known, distinct = table(), Distinct(len(codes) + 1)
            own = [distinct([known[p] for p in x]) for x in parts]
            packed = pa.array([np.sort(x[x < len(codes)]).astype("<i4").tobytes() for x in own], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), packed], ["y", "places"])
        release()

    packed = drawn.select("y", "text").mapInArrow(places, "y int, places binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((y, p) for b in batches for y, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        if not held:
            return
        y = np.array([1.0 if y else -1.0 for y, _ in held])
        first = np.concatenate([[0], np.cumsum([len(p) // 4 for _, p in held])])
        place = np.frombuffer(b"".join(p for _, p in held), "<i4")
        del held
        values = ratio[place].astype(np.float32)
        size = np.sqrt(np.array([values[i:j] @ values[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]))
        values /= np.repeat(np.maximum(size, 1e-12), np.diff(first)).astype(np.float32)
        w, b = descend(first, place, values, y, len(codes))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f8").tobytes()], pa.binary()), pa.array([b])], ["w", "b"])
        release()

    got = packed.limit(4 * FIT_ROWS).repartition(1).mapInArrow(work, "w binary, b double").collect()
    if not got:
        return None
    return Model(codes, ratio, np.frombuffer(got[0].w, "<f8") * ratio, got[0].b)


def classify(docs: DataFrame, model: Model | None, text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``keep``, then score and predicted."""
    rows = docs.select(*[docs[c] for c in keep], docs[text_column].cast("string").alias("text"))
    schema = StructType([*rows.schema.fields[:-1], StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for rows, parts in coded(batches):
            margin = np.zeros(len(parts))
            if model is not None:
                if known is None:
                    known, distinct = model.table(), Distinct(len(model.codes) + 1)
                    weight, square = np.append(model.weight, 0.0), np.append(model.ratio**2, 0.0)
                for k, x in enumerate(parts):
                    own = distinct([known[p] for p in x])
                    margin[k] = weight[own].sum() / max(np.sqrt(square[own].sum()), 1e-12) + model.intercept
            score = 1.0 / (1.0 + np.exp(-2.0 * margin))
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], schema.names)
        release()

    return rows.mapInArrow(work, schema)


def quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted; learns from labelled rows whose remainder is not 1."""
    model = fit(docs, labels, id_column, text_column, label_column)
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), (remainder(docs[id_column], 3) == 1).alias("held_out"), docs[text_column].alias("text"))
    return classify(rows, model, keep=("doc_id", "held_out"))
