"""Jaccard self-join of documents' n-gram sets by a prefix tree.

Documents with the same set are one class. A class can link with another only if they share one of the first
``n - ceil(t n) + 1`` n-grams in a global order; the order is by how many documents have the n-gram, then by its hash,
so the first ones are those that nobody else has, and a class with enough of them is alone. Frequencies come from one
exchange of packed hashes (``exchange``), where an n-gram that a chunk of texts has many times goes once.

Classes that share a first n-gram, and are of similar size, form candidate groups (components of stars, not pairs). In
a group the sets are stored in a trie: n-grams in one order, common beginnings once, runs without branching as one node.
A set is looked up by going down the trie level by level with the overlap so far; a subtree is left where the overlap and
what can still be had (the least of both sides' remainders) falls short of what its smallest set needs.

A group of more than ``BLOCK`` n-grams is cut into blocks. Each class goes by its home, the least of its first n-grams,
so that sets that are alike mostly share a block; a home that is itself too large is cut again. Two blocks are joined,
as a task of their own, only if they have a first n-gram in common in classes of similar size. So no group is bound to
one task, and a group that merely chains together many small ones costs no more than they do. A task returns the links
that join what it hasn't joined yet, whose components are those of all links, and for each class the number of all links
that it found.

N-grams are told apart by 64-bit hashes (60 bits when counted, which only sets the order).

Defined results: a null text or one without words has an empty set and is linked with nothing; a text with fewer than
n words has its whole sequence as one n-gram; component_id is the least doc_id of the component (null if all are
null); n_links is the number of other rows, copies among them, whose set is similar enough, so that its sum is twice the
number of links; each input row gives one row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilstream.llm import exchange as ex
from vigilstream.llm import textblocks as tb
from vigilstream.llm.components import components
from vigilstream.llm.shared import forget, is_small, written

CHUNK = 2 << 20
#: N-grams in a block of a candidate group.
BLOCK = 2_000_000
HELD = 500_000
U64 = np.uint64


def sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each row's distinct n-grams, in order of both; A-Z count as a-z."""
    w = tb.words(tb.lower_ascii(data), offsets)
    at = tb.window_starts(w.first, width)
    row, h = [w.row()[at]], [tb.windows(w.hash, width)[at] if len(at) else np.empty(0, np.uint64)]
    for k in range(1, width):
        short = np.flatnonzero(w.per_row == k)
        if len(short):
            row.append(short)
            h.append(tb._mix(tb.windows(w.hash, k)[w.first[short]] + U64(k)))
    row, h = np.concatenate(row), np.concatenate(h)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def _classes(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of each row's set and a hash of the set."""
    bounds = np.searchsorted(row, np.arange(rows + 1))
    size = np.diff(bounds)
    total = []
    for seed in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A35):
        sums = np.concatenate([[U64(0)], np.cumsum(tb._mix(h ^ U64(seed)), dtype=np.uint64)])
        total.append(sums[bounds[1:]] - sums[bounds[:-1]])
    return size, tb._mix(total[0] ^ tb._mix(total[1] + size.astype(np.uint64))).view(np.int64)


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, tk, n_shingles and node (the class)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in tb.chunks(batches, size=CHUNK):
            size, node = _classes(*sets(c.data, c.offsets, width), len(c))
            yield pa.RecordBatch.from_arrays([c.rows.column(0), c.rows.column(1), pa.array(size.astype(np.int64)), pa.array(node)], ["doc_id", "tk", "n_shingles", "node"])

    return docs.mapInArrow(work, "doc_id long, tk long, n_shingles long, node long")


def _asked(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for c in tb.chunks(batches, size=CHUNK):
            chunk += 1
            row, h = sets(c.data, c.offsets, width)
            if not len(h):
                continue
            size, node = _classes(row, h, len(c))
            send, repeat, of = ex.distinct(h, row)
            times = np.ones(len(h), np.int64)
            np.add.at(times, of, 1)
            times = np.minimum(times, 255).astype(np.uint8)
            rows = []
            order, bounds = ex.by_bucket(h[send], buckets)
            for to in range(buckets):
                at = send[order[bounds[to] : bounds[to + 1]]]
                if len(at):
                    rows.append(ex.row(to, chunk, ex.ASK, ex.pack_keys(h[at], buckets), ex.pack_places(at), b"", times[at].tobytes()))
            if len(repeat):
                rows.append(ex.row(chunk % buckets, chunk, ex.REPEATS, repeat.astype("<i8").tobytes(), of.astype("<i8").tobytes()))
            rows.append(ex.row(chunk % buckets, chunk, ex.META, node.astype("<i8").tobytes(), size.astype("<i8").tobytes()))
            yield ex.batch(rows)

    return docs.mapInArrow(work, ex.SCHEMA)


def _counted(rows: list[dict]) -> list[tuple]:
    """In a bucket: how many documents have each n-gram, told where there is more than one."""
    out = [ex.row(r["to"], r["chunk"], r["kind"], r["a"], r["b"]) for r in rows if r["kind"] != ex.ASK]
    rows = [r for r in rows if r["kind"] == ex.ASK]
    if not rows:
        return out
    keys = [ex.unpack_keys(r["a"]) for r in rows]
    bounds = np.cumsum([0, *map(len, keys)])
    key = np.concatenate(keys)
    times = np.frombuffer(b"".join(r["d"] for r in rows), np.uint8)
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]] ^ U64(1)))
    sums = np.add.reduceat(times[order].astype(np.int64), head)
    total = np.empty(len(key), np.int64)
    total[order] = np.repeat(sums, np.diff(head, append=len(key)))
    for r, lo, hi in zip(rows, bounds[:-1], bounds[1:], strict=True):
        at = np.flatnonzero(total[lo:hi] > 1)
        if len(at):
            place = ex.unpack_places(r["b"], hi - lo)[at]
            number = np.minimum(total[lo:hi][at], 2**32 - 1).astype("<u4")
            out.append(ex.row(r["to"], r["chunk"], ex.ANSWER, ex.pack_keys(key[lo:hi][at], 1), ex.pack_places(place), number.tobytes()))
    return out


def _first(percent: int, buckets: int):
    """In a chunk: the first n-grams of each class that are anyone else's too."""

    def work(table: pa.Table) -> pa.Table:
        rows = ex.views(table)
        answers = [r for r in rows if r["kind"] == ex.ANSWER]
        meta = next((r for r in rows if r["kind"] == ex.META), None)
        none = pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "token": pa.array([], pa.int64())})
        if meta is None or not answers:
            return none
        node, size = np.frombuffer(meta["a"], "<i8"), np.frombuffer(meta["b"], "<i8")
        places, keys, numbers = [], [], []
        for r in answers:
            k = ex.unpack_keys(r["a"])
            places.append(ex.unpack_places(r["b"], len(k)))
            keys.append(k * U64(buckets) + U64(r["to"]))
            numbers.append(np.frombuffer(r["c"], "<u4"))
        place, key, number = np.concatenate(places), np.concatenate(keys), np.concatenate(numbers)
        order = np.argsort(place)
        place, key, number = place[order], key[order], number[order]
        for r in rows:
            if r["kind"] == ex.REPEATS:
                again, of = np.frombuffer(r["a"], "<i8"), np.frombuffer(r["b"], "<i8")
                i = np.searchsorted(place, of)
                place, key, number = np.concatenate([place, again]), np.concatenate([key, key[i]]), np.concatenate([number, number[i]])
        doc = np.searchsorted(np.cumsum(size), place, side="right")
        own = size - np.bincount(doc, minlength=len(size))
        left = size - (percent * size + 99) // 100 + 1 - own
        order = np.lexsort((key, number, doc))
        doc, key = doc[order], key[order]
        first = np.searchsorted(doc, np.arange(len(size)))
        take = np.arange(len(doc)) - first[doc] < left[doc]
        return pa.table({"node": node[doc[take]], "n": size[doc[take]], "token": key[take].view(np.int64)})

    return work


class Trie:
    """Sets of ascending whole numbers; common beginnings are stored once, unbranched runs as one node."""

    def __init__(self, members: list[np.ndarray]):
        packed = [m.astype(">u4").tobytes() for m in members]
        self.order = sorted(range(len(members)), key=packed.__getitem__)
        seqs = [members[k] for k in self.order]
        starts = np.cumsum([0, *map(len, seqs)])
        self.flat = np.concatenate(seqs)
        begin, end, parent, depth, low, high, least, most = ([] for _ in range(8))
        stack: list[int] = []
        self.ends: dict[int, list[int]] = {}
        last = None
        for k, seq in enumerate(seqs):
            shared = 0
            if last is not None:
                n = min(len(last), len(seq))
                differ = np.flatnonzero(last[:n] != seq[:n])
                shared = int(differ[0]) if len(differ) else n
            while stack and depth[stack[-1]] - (end[stack[-1]] - begin[stack[-1]]) >= shared:
                stack.pop()
            if stack and depth[stack[-1]] > shared:  # the run branches inside: its upper part becomes a node
                v = stack.pop()
                cut = depth[v] - shared
                begin.append(begin[v]), end.append(end[v] - cut), parent.append(parent[v]), depth.append(shared)
                low.append(low[v]), high.append(k), least.append(0), most.append(0)
                u = len(begin) - 1
                begin[v], parent[v] = end[v] - cut, u
                stack.append(u)
            if len(seq) > shared:
                begin.append(int(starts[k]) + shared), end.append(int(starts[k + 1])), parent.append(stack[-1] if stack else -1), depth.append(len(seq))
                low.append(k), high.append(k + 1), least.append(0), most.append(0)
                stack.append(len(begin) - 1)
            self.ends.setdefault(stack[-1], []).append(k)
            last = seq
        n = len(begin)
        self.begin, self.end, self.parent, self.depth = (np.array(x, np.int64) for x in (begin, end, parent, depth))
        self.size = np.array([len(s) for s in seqs], np.int64)
        self.least, self.most, self.high = np.full(n, 2**62), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for v, ks in self.ends.items():
            self.least[v] = self.most[v] = self.depth[v]
            self.high[v] = max(ks) + 1
        for v in np.argsort(-self.depth, kind="stable").tolist():
            p = parent[v]
            if p >= 0:
                self.least[p] = min(self.least[p], self.least[v])
                self.most[p] = max(self.most[p], self.most[v])
                self.high[p] = max(self.high[p], self.high[v])
        self.children = np.argsort(self.parent, kind="stable")
        bounds = np.searchsorted(self.parent[self.children], np.arange(-1, n + 1))
        self.first, self.after = bounds[:-1], bounds[1:]  # of node v at v + 1
        self.ending = np.zeros(n, bool)
        self.ending[list(self.ends)] = True

    def links(self, query: np.ndarray, marked: np.ndarray, percent: int, after: int = -1) -> list[int]:
        """Sorted places of sets beyond ``after`` whose Jaccard similarity with the query is at least ``percent``.

        ``marked`` says for each number whether the query has it.
        """
        a, found = len(query), []
        nodes = self.children[self.first[0] : self.after[0]]
        overlap = np.zeros(len(nodes), np.int64)
        while len(nodes):
            fits = (self.most[nodes] * 100 >= percent * a) & (self.least[nodes] * percent <= 100 * a) & (self.high[nodes] > after + 1)
            nodes, overlap = nodes[fits], overlap[fits]
            if not len(nodes):
                break
            size = self.end[nodes] - self.begin[nodes]
            to = np.cumsum(size) - size
            at = np.arange(int(size.sum())) + np.repeat(self.begin[nodes] - to, size)
            overlap = overlap + np.add.reduceat(marked[self.flat[at]].astype(np.int64), to)
            rest = np.minimum(a - np.searchsorted(query, self.flat[self.end[nodes] - 1], side="right"), self.most[nodes] - self.depth[nodes])
            need = (percent * (a + self.least[nodes]) + 99 + percent) // (100 + percent)
            good = overlap + rest >= need
            nodes, overlap = nodes[good], overlap[good]
            done = self.ending[nodes] & ((100 + percent) * overlap >= percent * (a + self.depth[nodes]))
            for v in nodes[done].tolist():
                found += [k for k in self.ends[v] if k > after]
            n = self.after[nodes + 1] - self.first[nodes + 1]
            to = np.cumsum(n) - n
            overlap = np.repeat(overlap, n)
            nodes = self.children[np.arange(int(n.sum())) + np.repeat(self.first[nodes + 1] - to, n)]
        return found


def join_sets(nodes: list[int], members: list[np.ndarray], rows: list[int], sides: list[int] | None, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links between sets, without those that join what is joined already, and how many rows all links of each set reach.

    ``rows`` says how many rows have each set; with sides, links are those from side 0 to side 1.
    """
    size = np.array([len(m) for m in members])
    token, at = np.unique(np.concatenate(members), return_inverse=True)
    # The most frequent come first, so that near copies share long beginnings.
    often = np.bincount(at)
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, -often))] = np.arange(len(token))
    ranked = [np.sort(x) for x in np.split(rank[at], np.cumsum(size)[:-1])]
    marked = np.zeros(len(token), bool)
    rows, reached = np.array(rows, np.int64), np.zeros(len(nodes), np.int64)
    up = list(range(len(nodes)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    stored = [k for k in range(len(nodes)) if sides is None or sides[k] == 1]
    asked = [k for k in range(len(nodes)) if sides is None or sides[k] == 0]
    if not stored or not asked:
        return [], reached
    trie = Trie([ranked[k] for k in stored])
    place = {stored[k]: i for i, k in enumerate(trie.order)}
    out = []
    for q in asked:
        marked[ranked[q]] = True
        found = [stored[trie.order[i]] for i in trie.links(ranked[q], marked, percent, place[q] if sides is None else -1)]
        reached[q] += rows[found].sum()
        reached[found] += rows[q]
        for k in found:
            x, y = top(q), top(k)
            if x != y:
                up[x] = y
                out.append((nodes[q], nodes[k]))
        marked[ranked[q]] = False
    return out, reached


def _held(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df, HELD) else df


def _packed(docs: DataFrame, width: int) -> DataFrame:
    """node and its n-grams, packed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in tb.chunks(batches, size=CHUNK):
            row, h = sets(c.data, c.offsets, width)
            at = np.searchsorted(row, np.arange(len(c) + 1))
            yield pa.RecordBatch.from_arrays([c.rows.column(0), pa.array([h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["node", "grams"])

    return docs.select("node", "text").mapInArrow(work, "node long, grams binary")


def _links(group: DataFrame, percent: int) -> DataFrame:
    def work(table: pa.Table) -> pa.Table:
        members = [np.frombuffer(g, "<u8") for g in table.column("grams").to_pylist()]
        sides = None if table.column("i")[0] == table.column("j")[0] else table.column("side").to_pylist()
        nodes = table.column("node").to_pylist()
        found, reached = join_sets(nodes, members, table.column("members").to_pylist(), sides, percent)
        told = np.flatnonzero(reached)
        a, b = [x for x, _ in found] + [nodes[k] for k in told], [y for _, y in found] + [None] * len(told)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "reached": pa.array([0] * len(found) + reached[told].tolist(), pa.int64())})

    return group.groupBy("component", "i", "j").applyInArrow(work, "a long, b long, reached long")


def _tasks(first: DataFrame, reps: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidate groups, cut into blocks: component, block, node, n, doc_id, tk, members; and the blocks to join: component, i, j."""
    # Sets that can be linked are of one band of sizes or of two neighbouring ones.
    width = math.log(100 / percent) * 1.0001 if percent < 100 else 1e-6
    banded = first.withColumn("band", F.floor(F.log("n") / F.lit(width)))
    heads = banded.groupBy("token", "band").agg(F.min("node").alias("head"), F.count("*").alias("k"))
    heads = written(heads, "heads")
    stars = banded.join(_held(heads.where("k > 1").drop("k")), ["token", "band"]).where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    above = heads.select("token", (F.col("band") - 1).alias("band"), F.col("head").alias("above"))
    bridges = heads.join(_held(above), ["token", "band"]).where("head <> above").select(F.col("head").alias("a"), F.col("above").alias("b"))
    groups = components(stars.union(bridges)).select("node", "component")
    homes = first.groupBy("node").agg(F.min("token").alias("home"))
    groups = groups.join(reps, "node").join(homes, "node").select("component", "node", "home", "n", "doc_id", "tk", "members")
    groups = written(groups, "groups")
    # What is larger than a block is as many groups, or homes, as there are blocks in all at most.
    large = groups.groupBy("component").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).alias("blocks")).where("blocks > 1")
    hot = groups.groupBy("component", "home").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).alias("parts")).where("parts > 1")
    large, hot = written(large, "large"), written(hot, "hot")
    cut = groups.join(_held(large), "component", "left").join(_held(hot), ["component", "home"], "left")
    block = F.pmod(F.xxhash64("home"), F.coalesce("blocks", F.lit(1))) * (1 << 24) + F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    cut = written(cut.select("component", block.alias("block"), "node", "n", "doc_id", "tk", "members"), "blocks")
    of = cut.join(_held(large.select("component")), "component", "left_semi").select("component", "block", "node")
    has = banded.join(of, "node").groupBy("component", "token", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    has = written(has, "tokens")
    low = has.select("component", "token", F.col("block").alias("i"), F.col("least").alias("a"), F.col("most").alias("b"))
    high = has.select("component", "token", F.col("block").alias("j"), "least", "most")
    alike = (F.col("most") * 100 >= F.col("a") * percent) & (F.col("b") * 100 >= F.col("least") * percent)
    pairs = low.join(high, ["component", "token"]).where((F.col("i") < F.col("j")) & alike).select("component", "i", "j")
    own = cut.select("component", F.col("block").alias("i"), F.col("block").alias("j"))
    pairs = written(pairs.union(own).distinct(), "pairs")
    for table in (groups, heads, large, hot, has):
        forget(table)
    return cut, pairs


def jaccard_links(docs: DataFrame, base: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between classes, as many as tell the components, and, where b is null, how many rows of other classes
    all links of a class reach in a task. ``docs``: doc_id, tk, text."""
    reps = base.where("n_shingles > 0").groupBy("node", F.col("n_shingles").alias("n")).agg(F.min(F.struct("doc_id", "tk")).alias("rep"), F.count("*").alias("members"))
    reps = written(reps.select("node", "n", "rep.doc_id", "rep.tk", "members"), "classes")
    # Rows that aren't the chosen one of their class are left out; null ids are compared as equal.
    doubles = base.where("n_shingles > 0").join(_held(reps.where("members > 1").select("node", F.col("doc_id").alias("d"), F.col("tk").alias("t"))), "node")
    doubles = written(doubles.where(~(F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tk") == F.col("t")))).select("doc_id", "tk").distinct(), "copies")
    docs, doubles = docs.alias("x"), _held(doubles).alias("y")
    same = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & F.col("x.tk").eqNullSafe(F.col("y.tk"))
    buckets = ex.buckets(base, base.agg(F.sum("n_shingles")).first()[0] or 0)
    asked = _asked(docs.join(doubles, same, "left_anti"), width, buckets)
    first = ex.dealt(ex.grouped(asked, "to", _counted, buckets), "chunk", buckets)
    first = written(first.groupBy("chunk").applyInArrow(_first(percent, buckets), "node long, n long, token long").distinct(), "first")
    groups, pairs = _tasks(first, reps, percent)
    forget(first)
    left = groups.join(pairs.withColumn("block", F.col("i")), ["component", "block"]).withColumn("side", F.lit(0))
    right = groups.join(pairs.where("i < j").withColumn("block", F.col("j")), ["component", "block"]).withColumn("side", F.lit(1))
    tasks = left.union(right).select("component", "i", "j", "node", "side", "members")
    chosen = _held(groups.select("node", "doc_id", "tk")).alias("y")
    texts = docs.join(chosen, same).select("y.node", "x.text").dropDuplicates(["node"])
    return _links(tasks.join(_packed(texts, width), "node"), percent)


def _joined(docs: DataFrame, width: int, percent: int, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles of all rows, the links, and the component of each class that has a link."""
    text = docs[text_column].cast("string")
    docs = docs.select(docs[id_column].cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text"))
    base = written(profiles(docs, width), "sets")
    links = written(jaccard_links(docs, base, width, percent), "jaccard")
    return base, links, components(links)


def near_classes(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, tk (xxhash64 of the text) and component of every row that has n-grams; rows of one component are near duplicates."""
    base, _, found = _joined(docs, width, percent, id_column, text_column)
    return base.where("n_shingles > 0").join(_held(found), "node", "left").select("doc_id", "tk", F.coalesce("component", "node").alias("component"))


def ngram_join(docs: DataFrame, width: int = 3, percent: int = 90, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links and class_id (the same for equal sets)."""
    base, links, found = _joined(docs, width, percent, id_column, text_column)
    found = found.join(links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("reached").alias("reached")), "node", "left")
    least = base.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("members"))
    # Classes of one document without links are their own component, and need no join.
    least = least.join(found, "node", "left").where("members > 1 or component is not null").select("node", "least", F.coalesce("component", "node").alias("component"), (F.col("members") - 1 + F.coalesce("reached", F.lit(0))).alias("n_links"))
    of = least.groupBy("component").agg(F.min("least").alias("component_id"))
    least = written(least.join(of, "component").select("node", "component_id", "n_links"), "least")
    out = base.join(_held(least), "node", "left")
    linked = F.col("n_shingles") > 0
    return out.select("doc_id", "n_shingles", F.when(linked, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("node").alias("class_id"))
