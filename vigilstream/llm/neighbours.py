"""Exact nearest neighbours of a stated query set by a block matrix join.

Vectors and queries are packed into blocks, one row a block, and written once. Their int8 codes, an eighth of the
vectors, go to a grid of tasks: a query block to ``across`` groups of vector blocks by an equi-join on the group's
number. A task multiplies it with the tiles of its group; the products of codes give each inner product with an error
bound, of which each query's heap keeps what may still be among its k best. Of equal vectors only the k + 1 least ids can be
nearest to anything, so no more of them are candidates. Over all groups, a query's k-th largest
lower bound is the least that an upper bound must reach; only the pairs that do are recomputed in double precision, by
way of their blocks, and ranked. No pair leaves a task unless it may be among a group's k best.

The products of codes are whole numbers; components are taken ``SLICE`` at a time, so that a tile is multiplied as
float32 without error. Bounds that overflow tell nothing, and their pairs are recomputed.

Defined results: vectors that are null, empty, zero, or with null or non-finite components take no part; neither do
null ids; vectors of different lengths are no candidates for each other; ties go to the smaller id. Products that
overflow are infinite, and rank so; undefined ones (of two infinities) rank before all others, as SQL sorts them. Ids are
taken as unique: each row of a repeated id is a candidate of its own, and repeated queries share one list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilstream.llm.shared import is_small, written

#: Rows of a block of vectors, and of queries, at most; fewer where vectors are long, for blocks of about ``BLOCK`` components.
TILE, QUERIES = 4096, 512
BLOCK = 1 << 20
#: Components of tiles, and of queries, that one task holds on average at most (a byte each).
HELD = 1 << 25
#: Components multiplied at once: products of codes of so many add up to less than 2**24.
SLICE = 1024
#: Classes of equal vectors that are broadcast at most (40 bytes each).
CLASSES = 1_000_000
#: Pairs that a block's heaps keep before those that can't be among the best are taken out again.
PAIRS = 1 << 18
_PACKED = "block long, ids binary, vectors binary, codes binary, bounds binary, size int"


def _valid(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By number of components: ids and vectors that take part."""
    there = pc.and_(ids.is_valid(), vectors.is_valid())
    ids, vectors = ids.filter(there), vectors.filter(there)
    length = vectors.value_lengths().to_numpy(zero_copy_only=False)
    start = np.cumsum(length) - length
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null: NaN
    ids = ids.to_numpy(zero_copy_only=False)
    for d in np.unique(length[length > 0]).tolist():
        at = np.flatnonzero(length == d)
        x = flat[start[at][:, None] + np.arange(d)]
        good = np.isfinite(x).all(axis=1) & x.any(axis=1)
        if good.any():
            yield d, ids[at[good]], x[good]


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """Valid vectors in blocks of at most ``size`` rows, with codes, and scales, lengths and errors; ``block`` numbers are unique."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def blocks(d: int, least: int) -> Iterator[pa.RecordBatch]:
            nonlocal made
            ids, x = (np.concatenate(c) for c in zip(*waiting[d], strict=True))
            most = max(1, min(size, BLOCK // d))
            while len(ids) >= min(least, most) and len(ids):
                made += 1
                codes, *bounds = quantised(x[:most])
                values = [[ids[:most].astype("<i8").tobytes()], [x[:most].astype("<f8").tobytes()], [codes.tobytes()], [np.stack(bounds).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array([part * 2**32 + made], pa.int64()), *(pa.array(v, pa.binary()) for v in values), pa.array([d], pa.int32())], ["block", "ids", "vectors", "codes", "bounds", "size"])
                ids, x = ids[most:], x[most:]
            waiting[d] = [(ids, x)]

        for batch in batches:
            for d, ids, x in _valid(batch.column(0), batch.column(1)):
                waiting.setdefault(d, []).append((ids, x))
                if sum(len(i) for i, _ in waiting[d]) >= min(size, BLOCK // d):
                    yield from blocks(d, size)
        for d in list(waiting):
            yield from blocks(d, 1)

    return rows.mapInArrow(work, _PACKED)


def _nearest_of_equals(rows: DataFrame, k: int) -> DataFrame:
    """Without the vectors that no query can have among its k nearest: of equal ones all but the k + 1 least ids (one may be the query's own).

    Equal vectors have equal products with any query, and ties go to the smaller id, so this leaves no result out. Vectors
    are told apart by 128 bits of hash; only hashes and ids travel, counted before they are moved.
    """
    same = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.col("v")).alias("h2")]
    light = rows.where("id is not null and v is not null").select(*same, "id")
    large = light.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).drop("n")
    large = written(large, "equals")
    if is_small(large, 0):
        return rows
    held = lambda t: F.broadcast(t) if is_small(t, CLASSES) else t
    own = light.join(held(large), ["h1", "h2"], "left_semi").distinct()
    at = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    last = own.withColumn("at", at).where(F.col("at") <= k + 1).groupBy("h1", "h2").agg(F.max("id").alias("last"), F.max("at").alias("at")).where(F.col("at") == k + 1)
    last = written(last.select(F.col("h1").alias("l1"), F.col("h2").alias("l2"), "last"), "last")
    met = rows.select("*", *same).join(held(last), (F.col("h1") == F.col("l1")) & (F.col("h2") == F.col("l2")), "left")
    return met.where("last is null or id <= last").select("id", "v")


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the lengths of what the codes stand for and of the error, rounded up a little."""
    largest = np.abs(x).max(axis=1)
    largest[largest == 0] = 1
    unit = x / largest[:, None]  # lengths of large components can't overflow this way
    codes = np.rint(unit * 127).astype(np.int8)
    near = codes / 127.0
    up = 1 + 1e-9
    return codes, largest / 127, np.linalg.norm(near, axis=1) * largest * up, (np.linalg.norm(unit - near, axis=1) + 1e-15 * np.sqrt(x.shape[1])) * largest * up


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added in the order of the components: equal vectors get equal scores in any block."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


class Heaps:
    """For each query of a block: the pairs that may be among its k best, by bounds, and the k-th largest lower bound so far."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, bounds: np.ndarray, k: int):
        self.ids, self.codes, self.bounds, self.k = ids, codes, bounds, k
        self.lower = np.full((len(ids), k), -np.inf)  # the k largest lower bounds, unordered
        self.kept: list[list[np.ndarray]] = []
        self.size, self.room = 0, PAIRS

    def merge(self, ids: np.ndarray, codes: np.ndarray, bounds: np.ndarray, block: int) -> None:
        product = np.zeros((len(self.ids), len(ids)))
        for at in range(0, codes.shape[1], SLICE):
            product += self.codes[:, at : at + SLICE].astype(np.float32) @ codes[:, at : at + SLICE].astype(np.float32).T
        (scale, length, error), (s, n, e) = self.bounds, bounds
        with np.errstate(over="ignore", invalid="ignore"):
            product *= scale[:, None] * s
            bound = length[:, None] * e + error[:, None] * n + error[:, None] * e
            bound = bound * (1 + 1e-9) + np.abs(product) * 1e-12 + 1e-300
            lower, upper = product - bound, product + bound
        unknown = ~(np.isfinite(lower) & np.isfinite(upper))
        lower[unknown], upper[unknown] = -np.inf, np.inf
        own = self.ids[:, None] == ids
        lower[own] = -np.inf
        both = np.concatenate([self.lower, lower], axis=1)
        self.lower = np.partition(both, both.shape[1] - self.k, axis=1)[:, both.shape[1] - self.k :]
        q, at = np.nonzero((upper >= self.lower.min(axis=1)[:, None]) & ~own)
        self.kept.append([q, np.full(len(q), block), at, lower[q, at], upper[q, at]])
        self.size += len(q)
        if self.size > self.room:
            self.kept = [self.pairs()]
            self.size = len(self.kept[0][0])
            self.room = max(PAIRS, 2 * self.size)

    def pairs(self) -> list[np.ndarray]:
        """Query, block, place in it, lower and upper bound of each pair that may be among the query's k best."""
        q, block, at, lower, upper = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        good = upper >= self.lower.min(axis=1)[q]
        return [x[good] for x in (q, block, at, lower, upper)]


def nearest(vectors: DataFrame, is_query: str, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (int, from 1), vec_id and score: each query's k candidates of largest inner product, its own id left out.

    ``is_query`` is a SQL condition on ``id``. Both sides are dealt to a grid of tasks by their components, so that a task
    holds ``HELD`` of each side on average, whatever the size of the table.
    """
    rows = vectors.select(vectors[id_column].cast("long").alias("id"), vectors[vector_column].alias("v"))
    tiles, asked = written(_pack(_nearest_of_equals(rows, k), TILE), "tiles"), written(_pack(rows.where(is_query), QUERIES), "queries")
    total, several = (t.agg(F.coalesce(F.sum(F.length("codes")), F.lit(0))).first()[0] for t in (tiles, asked))
    across = max(2, vectors.sparkSession.sparkContext.defaultParallelism, -(-total // HELD))
    down = max(1, -(-several // HELD))
    number = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    light = ("block", "ids", "codes", "bounds", "size")
    right = tiles.select(*light).withColumn("across", number(across)).withColumn("down", every(down))
    left = asked.select(*light).withColumn("down", number(down)).withColumn("across", every(across))
    pairs = left.groupBy("down", "across").cogroup(right.groupBy("down", "across")).applyInArrow(_bounded(k), "query_id long, q_block long, q_at long, block long, at long, low double, high double")
    pairs = written(pairs, "bounds")
    # The k-th largest lower bound of all groups; none if there are fewer pairs.
    whole = Window.partitionBy("query_id", "q_block", "q_at").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pairs = written(pairs.withColumn("least", F.nth_value("low", k).over(whole)).where("least is null or high >= least").select("query_id", "q_block", "q_at", "block", "at"), "pairs")
    with_query = pairs.groupBy("q_block").cogroup(asked.select(F.col("block").alias("q_block"), "vectors", "size").groupBy("q_block")).applyInArrow(_with_query, "query_id long, block long, at long, vector binary")
    found = with_query.groupBy("block").cogroup(tiles.select("block", "ids", "vectors", "size").groupBy("block")).applyInArrow(_recomputed, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _array(table: pa.Table, name: str, row: int, kind: str) -> np.ndarray:
    return np.frombuffer(table.column(name)[row].as_buffer(), kind)


def _bounded(k: int):
    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[] for _ in range(7)]
        for q in range(len(left)):
            size, ids = left.column("size")[q].as_py(), _array(left, "ids", q, "<i8")
            heaps = Heaps(ids, _array(left, "codes", q, "i1").reshape(-1, size), _array(left, "bounds", q, "<f8").reshape(3, -1), k)
            for t in range(len(right)):
                if right.column("size")[t].as_py() == size:
                    heaps.merge(_array(right, "ids", t, "<i8"), _array(right, "codes", t, "i1").reshape(-1, size), _array(right, "bounds", t, "<f8").reshape(3, -1), right.column("block")[t].as_py())
            if heaps.kept:
                at, *rest = heaps.pairs()
                for column, x in zip(out, [ids[at], np.full(len(at), left.column("block")[q].as_py()), at, *rest], strict=True):
                    column.append(x)
        kinds = {"query_id": "i8", "q_block": "i8", "q_at": "i8", "block": "i8", "at": "i8", "low": "f8", "high": "f8"}
        return pa.table({name: pa.array(np.concatenate([np.empty(0, kind), *column]).astype(kind)) for (name, kind), column in zip(kinds.items(), out, strict=True)})

    return work


def _with_query(key: tuple, pairs: pa.Table, blocks: pa.Table) -> pa.Table:
    """Pairs with the query's vector."""
    raw = pa.array([], pa.binary())
    if len(pairs):
        x = _array(blocks, "vectors", 0, "<f8").reshape(-1, blocks.column("size")[0].as_py())
        raw = pa.array([x[k].tobytes() for k in pairs.column("q_at").to_pylist()], pa.binary())
    return pa.table({"query_id": pairs.column("query_id"), "block": pairs.column("block"), "at": pairs.column("at"), "vector": raw})


def _recomputed(key: tuple, pairs: pa.Table, blocks: pa.Table) -> pa.Table:
    ids, score = np.empty(0, np.int64), np.empty(0)
    if len(pairs):
        size = blocks.column("size")[0].as_py()
        y, at = _array(blocks, "vectors", 0, "<f8").reshape(-1, size), pairs.column("at").to_numpy()
        ids = _array(blocks, "ids", 0, "<i8")[at]
        parts = [np.empty(0)]
        for lo in range(0, len(at), 4096):
            x = np.frombuffer(b"".join(v.as_buffer() for v in pairs.column("vector").slice(lo, 4096)), "<f8").reshape(-1, size)
            with np.errstate(over="ignore", invalid="ignore"):
                parts.append(dots(x, y[at[lo : lo + 4096]]))
        score = np.concatenate(parts)
    return pa.table({"query_id": pairs.column("query_id"), "vec_id": pa.array(ids), "score": pa.array(score)})
