"""Ranked search against brute force; the trees' order, their parts, and how much a search leaves out."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vigilstream.llm import treap_search

SCHEMA = "doc_id long, text string, lang string, score long, rank int, query long, term string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, k=20):
    found = [(d, Counter(terms(t))) for d, t, *_ in rows if terms(t)]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in set((i, t) for i, t, *_ in items if t is not None):
        scored = []
        for d, c in found:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return out


def corpus(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"W{k}" for k in range(80)] + ["é", "straße", "Été", "x9"]
    some = lambda most: " ".join(rnd.choice(vocabulary[: rnd.choice([5, 30, 84])]) + rnd.choice(["", ",", "."]) for _ in range(rnd.randrange(1, most)))
    texts = [some(60) for _ in range(n)]
    texts += [None, "", " .,!", "\x00w1\x7fw2", "w1 " * 3000, "W3_w3-w3"] + [texts[0]] * 50
    rows = [(None if k % 23 == 4 else k * 37 % 1009, t, "en", 1, 2, 3, "t") for k, t in enumerate(texts)]
    items = [(k, some(40), 1) for k in range(25)] + [(100, None, 1), (101, "", 1), (102, "nowhere", 1), (103, texts[0], 1), (103, texts[0], 1), (103, "w1 W1", 1), (None, "é W2", 1)]
    return rows + rows[:4], items


@pytest.mark.parametrize("block", [7, 4096])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(treap_search, "ITEMS", block)
    rows, items = corpus(block, 300)
    docs, asked = spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(items, "item_id long, text string, rank int")
    found = treap_search.ranked(docs, asked)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, brute(rows, items)))


def test_empty_tables(spark):
    rows, items = corpus(3, 10)
    docs, asked = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string, rank int")
    assert treap_search.ranked(docs.limit(0), asked).collect() == []
    assert treap_search.ranked(docs, asked.limit(0)).collect() == []
    assert treap_search.ranked(docs.where("text is null"), asked).collect() == []


def postings(seed, docs=400, n_terms=12, most=50):
    rnd = np.random.default_rng(seed)
    there = rnd.random((n_terms, docs)) < rnd.random(n_terms)[:, None]
    term, doc = np.nonzero(there)
    return term, doc, rnd.integers(1, most, len(term))


def test_trees_are_heaps_in_the_order_of_documents():
    term, doc, impact = postings(1, most=4)
    t = treap_search.Treaps(term, doc, impact, 12)
    none = len(term)

    def walk(node, lo, hi, most):
        if node == none:
            return []
        assert lo < t.doc[node] < hi and t.impact[node] <= most
        return walk(t.left[node], lo, t.doc[node], t.impact[node]) + [node] + walk(t.right[node], t.doc[node], hi, t.impact[node])

    for k in range(12):
        assert walk(t.root[k], -1, t.size, 100) == np.flatnonzero(term == k).tolist()
    rnd = random.Random(2)
    for _ in range(300):
        k, lo = rnd.randrange(12), rnd.randrange(-1, 400)
        hi = rnd.randrange(lo, 401)
        part = treap_search.Treaps.part(t, t.root[k : k + 1], np.array([lo]), np.array([hi]))[0]
        inside = impact[(term == k) & (doc > lo) & (doc < hi)]
        assert t.impact[part] == max(inside, default=0)
        assert part == none or lo < t.doc[part] < hi


def test_equal_impacts_give_no_chain():
    n = 20_000
    t = treap_search.Treaps(np.zeros(n, np.int64), np.arange(n), np.full(n, 7), 1)
    depth, level = 0, [t.root[0]]
    while level:
        depth, level = depth + 1, [c for x in level for c in (t.left[x], t.right[x]) if c != n]
    assert depth < 60


@pytest.mark.parametrize("cells", [1 << 19, 40])
def test_search_is_exact_and_leaves_documents_out(monkeypatch, cells):
    monkeypatch.setattr(treap_search, "CELLS", cells)
    term, doc, impact = postings(5, 3000, 30, 1000)
    impact = impact**2  # few are large
    dense = np.zeros((30, 3000), np.int64)
    dense[term, doc] = impact
    rnd = np.random.default_rng(9)
    ids, null = np.sort(rnd.integers(0, 2500, 3000)), np.zeros(3000, bool)
    own = [np.sort(rnd.choice(30, n, replace=False)) for n in (1, 2, 3, 8, 30)]
    times = [rnd.integers(1, 3, len(x)) for x in own]
    queries = treap_search.Queries(list(range(5)), None, None, own, times)
    best = treap_search.Best(5, 20)
    scored = treap_search.search(treap_search.Treaps(term, doc, impact, 30), ids, null, queries, best)
    assert scored < 0.6 * 5 * 3000
    found = sorted(zip(best.rows[0].tolist(), (-best.rows[1]).tolist(), best.rows[2].tolist(), strict=True))
    wanted = []
    for q, (x, n) in enumerate(zip(own, times, strict=True)):
        total = (dense[x] * n[:, None]).sum(axis=0)
        wanted += [(q, -s, d) for s, d in sorted(((s, d) for s, d in zip(total.tolist(), ids.tolist(), strict=True) if s), key=lambda r: (-r[0], r[1]))[:20]]
    assert found == sorted(wanted)


def test_sets_of_chunks(monkeypatch):
    monkeypatch.setattr(treap_search, "DOCUMENTS", 3)
    rows = [([5, None], [1, 2], [0, 0, 1], [0, 2, 1], [1, 1, 4]), ([3], [9], [0], [2], [6]), ([], [], [], [], []), ([1, 9, 2, 7], [1, 2, 3, 4], [3], [0], [1])]
    kinds = [pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 4]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(5)], ["docs", "size", "row", "term", "tf"])
    one, two = treap_search._sets(iter([batch]))
    assert one[0].tolist()[:2] == [3, 5] and one[1].tolist() == [False, False, True] and one[2].tolist() == [9, 1, 2]
    assert sorted(zip(*(x.tolist() for x in one[3:]), strict=True)) == [(0, 2, 6), (1, 0, 1), (1, 2, 1), (2, 1, 4)]
    assert two[0].tolist() == [1, 2, 7, 9] and two[3].tolist() == [2]
