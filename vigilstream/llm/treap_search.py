"""Ranked lexical search with an inverted treap for each term.

A term's postings form a binary tree that is a search tree by document id and a heap by impact (what the term adds to a
document's score), so the root of any part of the tree bounds all that its documents can get from the term. A query walks
the trees of its terms at once: a range of documents and, for each term, the root of the tree's part in that range. The
document of the largest root is scored, it splits the range in two, each tree's two parts are found by descent, and a part
of the range whose roots' impacts add up to less than the k-th best score so far is not looked at.

The corpus is read once: each chunk of texts gives its postings of the queries' terms, and counts; they are written, and
document frequencies added up. Then each task makes the trees of some thousand documents at a time and runs all queries
through them; the ranges of all queries are worked on side by side, those with the highest bounds first, and a task keeps
its best scores from one set of trees to the next. Only k documents a query leave a task.

Queries are taken in blocks of ``ITEMS``, so what tasks hold of them is bounded; terms are told apart by 128 bits of hash.
Depth stays logarithmic where impacts tie, as ties are broken by a hash of the place.

Defined results: a null text, or one without a term, is no document and never ranked; a query without a term, or whose
terms no document has, gives no row; equal rows of the queries are one query; equal rows of documents are ranked each;
equal scores go by ascending id, null ids last; empty tables give an empty table. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilstream.llm.shared import written
from vigilstream.llm.textblocks import Words, chunks, release, word_hashes, words

#: Queries of a block; postings and documents whose trees are made at once; cells (ranges times terms) of a round.
ITEMS, POSTINGS, DOCUMENTS, CELLS = 4096, 1_000_000, 32_768, 1 << 19
NO_ID = np.iinfo(np.int64).max
_SCHEMA = "docs array<long>, size array<int>, row array<int>, term array<int>, tf array<int>, n_docs long, n_terms long"


def _letters() -> np.ndarray:
    """By byte: ASCII letters in lower case, digits and bytes beyond ASCII as they are, a space for all others."""
    out = np.full(256, 32, np.uint8)
    for lo, hi in ((48, 58), (97, 123), (128, 256)):
        out[lo:hi] = np.arange(lo, hi)
    out[65:91] = np.arange(97, 123)
    return out


LETTERS = _letters()


@dataclass(frozen=True)
class Queries:
    """``first``: hashes of all terms, in order; ``second``: another hash of each. Query k has the terms ``terms[k]``, each ``times[k]`` times."""

    ids: list
    first: np.ndarray
    second: np.ndarray
    terms: list[np.ndarray]
    times: list[np.ndarray]

    @staticmethod
    def of(rows: list[tuple]) -> Queries:
        """rows: id and text."""
        texts = [(t or "").encode("utf-8", "surrogatepass") for _, t in rows]
        data = LETTERS[np.frombuffer(b"".join(texts), np.uint8)]
        w = words(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
        first, at, place = np.unique(w.hash, return_index=True, return_inverse=True)
        own = [np.unique(place[i:j], return_counts=True) for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
        return Queries([i for i, _ in rows], first, word_hashes(data, w.start[at], w.end[at], 1), [t for t, _ in own], [n for _, n in own])

    def find(self, data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and their numbers."""
        at = np.minimum(np.searchsorted(self.first, w.hash), len(self.first) - 1)
        hit = np.flatnonzero(self.first[at] == w.hash)
        sure = word_hashes(data, w.start[hit], w.end[hit], 1) == self.second[at[hit]]
        return hit[sure], at[hit[sure]]


def postings(docs: DataFrame, queries: Queries, id_column: str, text_column: str) -> DataFrame:
    """One row for each chunk of texts: the documents that have a query's term, their sizes, and (row, term, tf) in order; n_docs and n_terms count all documents of the chunk."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            data = LETTERS[chunk.data]
            w = words(data, chunk.offsets)
            hit, term = queries.find(data, w)
            cell, tf = np.unique(w.row()[hit] * len(queries.first) + term, return_counts=True)
            has, row = np.unique(cell // len(queries.first), return_inverse=True)
            size = w.per_row
            lists = [chunk.rows.column(0).take(pa.array(has)), pa.array(size[has].astype(np.int32)), *(pa.array(x.astype(np.int32)) for x in (row, cell % len(queries.first), tf))]
            rows = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            yield pa.RecordBatch.from_arrays([*rows, pa.array([int((size > 0).sum())]), pa.array([int(size.sum())])], ["docs", "size", "row", "term", "tf", "n_docs", "n_terms"])
        release()

    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return rows.mapInArrow(work, _SCHEMA)


def frequencies(table: DataFrame, n: int) -> np.ndarray:
    """The number of documents of each of the n terms."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(), minlength=n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "df"])

    out = np.zeros(n, np.int64)
    for r in table.select("term").mapInArrow(work, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


class Treaps:
    """The trees of all terms over some documents. Nodes are numbered by term, then document; the last one is no node."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, terms: int):
        n = len(term)
        self.size = int(doc.max(initial=-1)) + 1
        self.doc, self.impact = np.append(doc, -1), np.append(impact, 0)
        self.cell = term.astype(np.int64) * self.size + doc
        self.root = np.full(terms, n, np.int32)
        left, right, stack, now = [n] * (n + 1), [n] * (n + 1), [], -1
        # Equal impacts are told apart by a hash, or their documents would hang in a chain.
        key = (impact << 20) + (((np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64))
        for k, (t, x) in enumerate(zip(term.tolist(), key.tolist(), strict=True)):
            if t != now:
                if stack:
                    self.root[now] = stack[0][1]
                now, stack = t, []
            below = n
            while stack and stack[-1][0] < x:
                below = stack.pop()[1]
            left[k] = below
            if stack:
                right[stack[-1][1]] = k
            stack.append((x, k))
        if stack:
            self.root[now] = stack[0][1]
        self.left, self.right = np.array(left, np.int32), np.array(right, np.int32)

    def part(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """From each node down: the root of what lies between lo and hi, both left out."""
        node = node.copy()
        none = len(self.doc) - 1
        left = np.flatnonzero(node != none)
        while len(left):
            d = self.doc[node[left]]
            high, low = d >= hi[left], d <= lo[left]
            left, high = left[high | low], high[high | low]
            at = node[left]
            node[left] = np.where(high, self.left[at], self.right[at])
            left = left[node[left] != none]
        return node

    def at(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """What each term adds to each document."""
        cell = term.astype(np.int64) * self.size + doc
        place = np.minimum(np.searchsorted(self.cell, cell), max(len(self.cell) - 1, 0))
        return np.where(self.cell[place] == cell, self.impact[place], 0)


class Best:
    """The k best documents of each query so far: query, score, id, and whether the id is null."""

    def __init__(self, queries: int, k: int):
        self.k, self.n = k, queries
        self.rows = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        self.least, self.last = np.ones(queries, np.int64), np.full(queries, NO_ID)

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        keep = score >= self.least[query]
        if not keep.any():
            return
        rows = [np.concatenate([a, b[keep]]) for a, b in zip(self.rows, (query, score, doc, null), strict=True)]
        order = np.lexsort((rows[2], rows[3], -rows[1], rows[0]))
        q = rows[0][order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        self.rows = [x[order[rank < self.k]] for x in rows]
        full = order[rank == self.k - 1]
        self.least[rows[0][full]], self.last[rows[0][full]] = rows[1][full], np.where(rows[3][full], NO_ID, rows[2][full])


def search(treaps: Treaps, ids: np.ndarray, null: np.ndarray, queries: Queries, best: Best) -> int:
    """Walks all queries through the trees; ids are those of the documents, in order. Returns how many documents were scored."""
    none, scored = len(treaps.doc) - 1, 0
    by_size = sorted(range(len(queries.ids)), key=lambda k: len(queries.terms[k]))
    group: list[int] = []
    for k, after in zip(by_size, [*by_size[1:], None], strict=True):
        group.append(k)
        # Queries of about as many terms go together, as their ranges are rows of one matrix.
        if after is not None and len(queries.terms[after]) <= 2 * len(queries.terms[group[0]]) + 8 and len(group) * len(queries.terms[after]) < CELLS:
            continue
        wide = max(len(queries.terms[k]), 1)
        term, times = np.zeros((len(group), wide), np.int64), np.zeros((len(group), wide), np.int64)
        for i, q in enumerate(group):
            term[i, : len(queries.terms[q])], times[i, : len(queries.terms[q])] = queries.terms[q], queries.times[q]
        own, of = np.arange(len(group)), np.array(group)
        roots = np.where(times > 0, treaps.root[term], none)
        lo, hi = np.full(len(group), -1), np.full(len(group), treaps.size)
        bound = (times * treaps.impact[roots]).sum(axis=1)
        waiting = [own, lo, hi, bound, roots]
        while len(waiting[0]):
            own, lo, hi, bound, roots = waiting
            # A bound that equals the k-th best score is of use only to smaller ids.
            least, last = best.least[of[own]], best.last[of[own]]
            live = (bound > least) | ((bound == least) & (ids[np.minimum(lo + 1, len(ids) - 1)] <= last))
            own, lo, hi, bound, roots = (x[live] for x in waiting)
            room = max(1, CELLS // wide)
            if len(own) > room:
                order = np.argpartition(-bound, room)
                waiting = [x[order[room:]] for x in (own, lo, hi, bound, roots)]
                own, lo, hi, bound, roots = (x[order[:room]] for x in (own, lo, hi, bound, roots))
            else:
                waiting = [x[:0] for x in (own, lo, hi, bound, roots)]
            if not len(own):
                continue
            adds = times[own] * treaps.impact[roots]
            middle = treaps.doc[roots[np.arange(len(own)), adds.argmax(axis=1)]]
            row, column = np.nonzero(roots != none)
            node, mid = roots[row, column], middle[row]
            here = treaps.at(term[own[row], column], mid) * times[own[row], column]
            score = np.bincount(row, here, len(own)).astype(np.int64) if here.sum() < 1 << 52 else np.array([here[row == k].sum() for k in range(len(own))])
            best.add(of[own], score, ids[middle], null[middle])
            scored += len(own)
            for a, b in ((lo, middle), (middle, hi)):
                part = np.full(roots.shape, none, np.int32)
                part[row, column] = treaps.part(node, a[row], b[row])
                bound = (times[own] * treaps.impact[part]).sum(axis=1)
                some = bound >= best.least[of[own]]
                waiting = [np.concatenate([x, y[some]]) for x, y in zip(waiting, (own, a, b, bound, part), strict=True)]
        group = []
    return scored


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """ids, null, size, and doc, term and tf of some chunks together; documents are in the order of their ids, nulls last."""

    def together(parts: list) -> tuple[np.ndarray, ...]:
        docs = pa.chunked_array([p[0] for p in parts], pa.int64())
        null = docs.is_null().to_numpy()
        ids = np.where(null, NO_ID, docs.fill_null(NO_ID).to_numpy())
        base = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        row = np.concatenate([p[2].to_numpy() + b for p, b in zip(parts, base[:-1], strict=True)])
        size, term, tf = (np.concatenate([p[k].to_numpy() for p in parts]).astype(np.int64) for k in (1, 3, 4))
        order = np.lexsort((ids, null))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return ids[order], null[order], size[order], place[row], term, tf

    held, docs, nodes = [], 0, 0
    for b in batches:
        for k in range(len(b)):
            part = [c[k].values for c in b.columns]
            if held and (docs + len(part[0]) > DOCUMENTS or nodes + len(part[2]) > POSTINGS):
                yield together(held)
                held, docs, nodes = [], 0, 0
            if len(part[0]):
                held.append(part)
                docs, nodes = docs + len(part[0]), nodes + len(part[2])
    if held:
        yield together(held)


def _block(docs: DataFrame, queries: Queries, k: int, id_column: str, text_column: str) -> DataFrame:
    """query, item_id, doc_id, score: the k best documents of each query of each task."""
    table = written(postings(docs, queries, id_column, text_column), "postings")
    n_docs, n_terms = table.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    weight = weights(frequencies(table, len(queries.first)), n_docs or 0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries.ids), k)
        for ids, null, size, doc, term, tf in _sets(batches):
            m = np.array([75 + 25 * n * n_docs // n_terms for n in size.tolist()], np.int64)
            order = np.lexsort((doc, term))
            doc, term, tf = doc[order], term[order], tf[order]
            impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
            search(Treaps(term, doc, impact, len(weight)), ids, null, queries, best)
        query, score, found, none = best.rows
        items = pa.array([queries.ids[q] for q in query.tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(query), items, pa.array(found, mask=none), pa.array(score)], ["query", "item_id", "doc_id", "score"])
        release()

    return table.select("docs", "size", "row", "term", "tf").mapInArrow(work, "query long, item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", query_column: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest scores above 0 for each item."""
    spark = docs.sparkSession
    rows = items.select(items[item_column].cast("long").alias("item_id"), items[query_column].cast("string").alias("text")).where("text is not null").distinct()
    n = -(-rows.count() // ITEMS)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    for block in range(n):
        own = rows.where(F.expr(f"pmod(xxhash64(item_id, text), {n}) = {block}")).collect()
        queries = Queries.of(sorted(((r.item_id, r.text) for r in own), key=lambda r: (r[0] is None, r[0] or 0, r[1])))
        if not len(queries.first):
            continue
        found = _block(docs, queries, k, id_column, text_column)
        found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        out = found.select("item_id", "rank", "doc_id", "score") if n == 1 else out.union(found.select("item_id", "rank", "doc_id", "score"))
    return out
