"""The quality classifier: its n-grams and ratios by brute force, the duality gap of its fit, odd rows, held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vigilstream.llm import quality
from vigilstream.llm.queries import queries
from vigilstream.llm.textblocks import words

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, y int, quality string, score string"
ODD = [None, "", " ", "ab", "é", "Go Go go. GO! 12, 12, --- a\tb\n b", "x" * 9000, "\x00\x01 é\x1c\x1dß", "Été ÉTÉ eTé"]


def shape(word, before):
    up, low = sum(65 <= c <= 90 for c in word), sum(97 <= c <= 122 or c >= 128 for c in word)
    case = 0 if up + low == 0 else 1 if up == 0 else 2 if 65 <= word[0] <= 90 and up == 1 else 3 if low == 0 else 4
    c = word[-1]
    tail = 0 if c >= 128 or chr(c).isalnum() else 1 if chr(c) in ",:;" else 2 if chr(c) == "." else 3 if chr(c) in "!?" else 4
    return 1 + case * 10 + tail * 2 + (word == before)


def grams(text):
    raw = (text or "").encode()
    out = {raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2] for k in range(len(raw) - 2)}
    found = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    s = [0, 0] + [shape(w, found[k - 1] if k else None) for k, w in enumerate(found)]
    base, n = 1 << 24, quality.SHAPES
    for a, b, c in zip(s, s[1:], s[2:]):
        out |= {base + c, base + n + b * n + c, base + n + n * n + (a * n + b) * n + c}
    return out


def texts(n, seed=3):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        w = [rnd.choice(["erst", "than", "Ofin", "le", "Ünd"]) + rnd.choice(["", "", "er", "ou"]) for _ in range(rnd.randrange(1, 60))]
        bad = k % 3 == 0
        out.append((" ".join(x.upper() + "!!" if bad else x for x in w), 0 if bad else 1))
    return out


def tables(spark, n=90):
    rows = [(k, t, "en", 5, "q", "s") for k, (t, _) in enumerate(texts(n))] + [(n + k, t, None, 5, "q", "s") for k, t in enumerate(ODD)] + [(None, "than", "en", 5, "q", "s")]
    rows += rows[:2]
    labels = [(k, y, 0) for k, (_, y) in enumerate(texts(n))] + [(n + k, 1, 0) for k in range(4)] + [(3, 1, 0), (5, None, 0), (None, 0, 0), (10**9, 0, 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_codes_are_those_of_brute_force():
    odd = [*ODD, *(t for t, _ in texts(40))]
    batch = pa.RecordBatch.from_arrays([pa.array(odd, pa.string())], ["text"])
    found = [set(np.concatenate(p).tolist()) for _, parts in quality.coded(iter([batch])) for p in parts]
    assert found == [grams(t) for t in odd]


def test_pieces_of_a_long_text_give_the_same_codes(monkeypatch):
    rnd = random.Random(1)
    for piece in (16, 40, 200):
        monkeypatch.setattr(quality, "PIECE", piece)
        text = " ".join(rnd.choice(["a", "A", "bb.", "CC!", "dd dd", "e" * 90, "  ", "F" * 30]) for _ in range(400))
        data = np.frombuffer(text.encode(), np.uint8)
        assert set(np.concatenate(list(quality._long(data))).tolist()) == grams(text)
    assert len(words(data, np.array([0, len(data)])).start)


def test_distinct_codes():
    distinct = quality.Distinct(100)
    for _ in range(3):
        x = [np.random.default_rng(1).integers(0, 100, n).astype(np.int32) for n in (50, 0, 30)]
        assert sorted(distinct(x).tolist()) == sorted(set(np.concatenate(x).tolist()))


def test_ratios_against_brute_force(spark):
    docs, rows, labels, marks = tables(spark)
    y = {}
    for d, q, _ in marks:
        if d is not None and q is not None:
            y[d] = min(q, y.get(d, q))
    train = [(t, y[d]) for d, t, *_ in rows if d in y and zlib.crc32(str(d).encode()) % 3 != 1]
    count = [Counter(), Counter()]
    for t, label in train:
        count[label].update(grams(t))
    found, sizes = quality.counted(quality.labelled(docs, labels, "doc_id", "text", "quality"))
    assert sizes == [sum(label == k for _, label in train) for k in (0, 1)]
    assert {r["code"]: (r["bad"], r["good"]) for r in found.to_pylist()} == {c: (count[0][c], count[1][c]) for c in count[0] | count[1]}
    codes, ratio = quality.ratios(found)
    total = [sum(c.values()) + len(codes) for c in count]
    wanted = [math.log((count[1][c] + 1) / total[1]) - math.log((count[0][c] + 1) / total[0]) for c in codes.tolist()]
    assert np.allclose(ratio, wanted, rtol=0, atol=1e-12)


def test_scores_against_brute_force(spark):
    docs, rows, labels, _ = tables(spark)
    model = quality.fit(docs, labels)
    ratio, weight = dict(zip(model.codes.tolist(), model.ratio.tolist())), dict(zip(model.codes.tolist(), model.weight.tolist()))
    found = quality.quality(docs, labels).collect()
    assert len(found) == len(rows)
    wanted = []
    for d, t, *_ in rows:
        own = [c for c in grams(t) if c in ratio]
        margin = sum(weight[c] for c in own) / max(math.sqrt(sum(ratio[c] ** 2 for c in own)), 1e-12) + model.intercept
        wanted.append((d, None if d is None else zlib.crc32(str(d).encode()) % 3 == 1, 1 / (1 + math.exp(-2 * margin))))
    key = lambda r: (r[0] is None, r[0] or 0)
    for f, w in zip(sorted(found, key=key), sorted(wanted, key=key), strict=True):
        assert (f.doc_id, f.held_out, f.predicted) == (w[0], w[1], int(f.score >= 0.5))
        assert f.score == pytest.approx(w[2], abs=1e-9)


def test_the_fit_is_the_least():
    rnd = np.random.default_rng(5)
    n, size = 200, 40
    x = (rnd.random((n, size)) < 0.2) * rnd.normal(size=size)
    y = np.where(x @ rnd.normal(size=size) + 0.3 * rnd.normal(size=n) > 0, 1.0, -1.0)
    first = np.concatenate([[0], np.cumsum((x != 0).sum(axis=1))])
    w, b = quality.descend(first, np.nonzero(x)[1], x[x != 0], y, size, 5000)
    primal = lambda w, b: (w @ w + b * b) / 2 + quality.COST * np.maximum(0, 1 - y * (x @ w + b)).sum()
    best, at = primal(w, b), np.append(w, b)
    for _ in range(2000):
        step = at + rnd.normal(size=size + 1) * 10 ** rnd.uniform(-4, -1)
        assert primal(step[:-1], step[-1]) > best - 1e-3


def test_one_class_and_empty_tables(spark):
    docs, rows, labels, _ = tables(spark, 12)
    found = quality.quality(docs, labels.where("quality = 1")).collect()
    assert len(found) == len(rows) and {(r.score, r.predicted) for r in found} == {(0.5, 1)}
    assert quality.quality(docs.limit(0), labels).collect() == []
    assert quality.quality(docs, labels.limit(0)).count() == len(rows)


def test_labels_by_join_are_the_same(spark, monkeypatch):
    docs, _, labels, _ = tables(spark, 30)
    one = sorted(map(str, quality.labelled(docs, labels, "doc_id", "text", "quality").collect()))
    monkeypatch.setattr(quality, "HELD", 0)
    assert sorted(map(str, quality.labelled(docs, labels, "doc_id", "text", "quality").collect())) == one


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = [(r.score, labels[r.doc_id]) for r in queries()["op12_quality"](spark, SF).collect() if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in found if y], [s for s, y in found if not y]
    assert len(bad) > 10 and sum(g > b for g in good for b in bad) > 0.98 * len(good) * len(bad)
    assert sum((s >= 0.5) == y for s, y in found) > 0.97 * len(found)
