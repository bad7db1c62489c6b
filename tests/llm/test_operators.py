"""Operators against brute force, the libraries themselves, or held-out accuracy, on small tables with odd rows."""

import hashlib
import itertools
import math
import random
import re
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vigilstream.llm import bpe_codec, components, decontamination, exchange, language_id, line_dedup, lm_score, neighbours, ngram_join, secret_scan, substring_dedup, textblocks, token_counts
from vigilstream.llm.queries import oracle_sql, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, rank int, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "x", "Two words", "a<|endoftext|>b", "it's  IT'S 've  　x\x1c\x1d y", "é" * 300, " " * 3000 + "end", "1" * 2000]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def table(spark, texts, sources=("s1", "s2", None)):
    """Rows with repeated and null ids, and columns whose names operators use themselves."""
    rows = [(None if k % 17 == 5 else k * 7 % 101, t, ("en", "fr", None)[k % 3], sources[k % len(sources)], 1, 2, "z") for k, t in enumerate(texts)]
    rows += rows[:3]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(7)
    vocabulary = [f"W{k}" for k in range(60)]
    out = list(ODD)
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(15, 120))]
        for _ in range(rnd.choice([1, 2, 5])):
            x = list(base)
            for _ in range(rnd.choice([0, 0, 1, 3])):
                x[rnd.randrange(len(x))] = rnd.choice(vocabulary)
            out.append(rnd.choice([" ", "\n"]).join(x) + (f"\n{passage}" if rnd.random() < 0.3 else ""))
    return out


def same(found, wanted):
    assert sorted(map(str, found)) == sorted(map(str, wanted))


def test_substring_dedup(spark, texts):
    df, rows = table(spark, texts)
    width, first = 13, {}
    split = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    for d, w in split:
        for p in range(len(w) - width + 1) if d is not None else ():
            first[tuple(w[p : p + width])] = min(d, first.get(tuple(w[p : p + width]), d))
    wanted = []
    for d, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - width + 1) if d is not None else ():
            if first[tuple(w[p : p + width])] < d:
                gone[p : p + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        wanted.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    same([tuple(r)[:4] for r in substring_dedup.substring_dedup(df).collect()], wanted)


def morse(n, letters="ab"):
    """The Thue-Morse word and its complement: polynomials modulo 2**64 can't tell them apart from 1,024 letters on."""
    return tuple("".join(letters[bin(k).count("1") + c & 1] for k in range(n)) for c in (0, 1))


def test_substring_dedup_tells_thue_morse_words_apart(spark):
    a, b = morse(2048)
    same12 = " ".join(f"w{k}" for k in range(12))
    c, d = (" ".join(x) for x in morse(2048))
    docs = [(1, f"{same12} {a}"), (2, f"{same12} {b}"), (3, c), (4, d), (5, f"{same12} {a}")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    # Short windows of the sequences do repeat: all but the windows that the first one lacks.
    split = [c.split(" "), d.split(" ")]
    known = {tuple(split[0][p : p + 13]) for p in range(2036)}
    gone = {p + j for p in range(2036) if tuple(split[1][p : p + 13]) in known for j in range(13)}
    assert got == {1: (13, 0), 2: (13, 0), 3: (2048, 0), 4: (2048, len(gone)), 5: (13, 13)}


@pytest.mark.parametrize("keys", [2_000_000, 1000])
def test_substring_dedup_of_long_passages(spark, keys, monkeypatch):
    monkeypatch.setattr(exchange, "KEYS", keys)
    rnd = random.Random(3)
    word = lambda: f"q{rnd.randrange(10**6)}"
    passage = [word() for _ in range(70)]
    long = [word() for _ in range(3000)]
    docs = [(1, [*(word() for _ in range(20)), *passage]), (2, [*passage, *(word() for _ in range(5))]), (3, long), (4, [word(), *long[100:2000]]), (5, passage[:12])]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.longest) for r in substring_dedup.substring_dedup(df).collect()}
    assert got == {1: (0, 52), 2: (70, 52), 3: (0, 1664), 4: (1900, 1664), 5: (0, 0)}


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer

    df, rows = table(spark, texts)
    path = public_tokenizers.path("byte_bpe_50k.json")
    n = [len(e) for e in Tokenizer.from_file(path).encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]
    wanted = [(r[0], len((r[1] or "").encode()), k, k > 512) for r, k in zip(rows, n, strict=True)]
    same([tuple(r) for r in token_counts.token_counts(df, path).collect()], wanted)


@pytest.mark.parametrize("block", [2_000_000, 200])
def test_ngram_join(spark, texts, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    df, rows = table(spark, texts)
    sets = []
    for r in rows:
        w = WORD.findall(lower(r[1]))
        sets.append(frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[top(k)] = min(r[0], least.get(top(k), r[0]))
    wanted = [(r[0], len(s), least.get(top(k)) if s else r[0]) for k, (r, s) in enumerate(zip(rows, sets, strict=True))]
    same([tuple(r)[:3] for r in ngram_join.ngram_join(df).collect()], wanted)


def test_ngram_join_tells_thue_morse_words_apart(spark):
    a, b = morse(2048)
    c, d = (" ".join(x) for x in morse(2048, ["x1", "y2"]))
    docs = [(1, a), (2, b), (3, f"{a} {a} v"), (4, f"{b} {b} v"), (5, f"q {c}"), (6, f"q {d} {d}")]
    got = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join.ngram_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    # The sets of the two sequences differ by their first n-grams alone, of which there are few.
    sets = [{tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for _, t in docs[4:]]
    linked = 100 * len(sets[0] & sets[1]) >= 90 * len(sets[0] | sets[1])
    assert got == {**{k: (k, 0) for k in range(1, 5)}, 5: (5, int(linked)), 6: (5 if linked else 6, int(linked))}


@pytest.mark.parametrize("block", [2_000_000, 200])
def test_ngram_join_counts_every_link(spark, texts, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    near = [" ".join(f"n{j}" if j != 20 + k else f"other{k}" for j in range(120)) for k in range(9)]
    df, rows = table(spark, texts + near + near[:2])
    sets = []
    for r in rows:
        w = WORD.findall(lower(r[1]))
        sets.append(frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else []))
    linked = lambda a, b: a and 100 * len(a & b) >= 90 * len(a | b)
    wanted = [(r[0], len(a), sum(bool(linked(a, b)) for k, b in enumerate(sets) if k != at)) for at, (r, a) in enumerate(zip(rows, sets, strict=True))]
    assert max(n for *_, n in wanted) >= 10
    same([(r.doc_id, r.n_shingles, r.n_links) for r in ngram_join.ngram_join(df).collect()], wanted)


@pytest.mark.parametrize("held", [200_000, -1])
def test_line_dedup(spark, held, monkeypatch):
    monkeypatch.setattr(line_dedup, "HELD", held)
    rows = [(k, f"own {k}\n common line \n\nshared {k % 40}" if k else None, f"s{k % 14}" if k % 5 else None) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sites = {}
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if s is not None and x.strip(" \t\r"):
                sites.setdefault(x.strip(" \t\r"), set()).add(s)
    wanted = []
    for d, t, _ in rows:
        x = [] if t is None else t.split("\n")
        kept = [y for y in x if len(sites.get(y.strip(" \t\r"), ())) < 10]
        wanted.append((d, len(x), len(x) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    same([tuple(r) for r in line_dedup.digest(line_dedup.line_dedup(df)).collect()], wanted)


@pytest.mark.parametrize("held", [200_000, -1])
def test_line_dedup_counts_copies_once(spark, held, monkeypatch, tmp_path):
    import corpus_pipeline as cp

    monkeypatch.setattr(line_dedup, "HELD", held)
    copy = "one text in twenty sources\nits second line"
    texts = [(copy, f"s{k}") for k in range(20)]  # one text: its lines stay
    texts += [(f"own a{k}\nfooter", f"s{k}") for k in range(10)]  # goes
    texts += [(f"own b{k}\nevery text in every site", f"s{s}") for k in range(10) for s in range(10)]  # goes
    texts += [(f"own c{k}\nten texts of one site", "s0") for k in range(12)] + [("own c0\nten texts of one site", f"s{k}") for k in range(1, 15)]  # two sites: stays
    texts += [(f"own d{k}\nnine and the least site", s) for k in range(10) for s in ("a", f"s{k}")] + [(None, "s1"), ("", "s2"), ("own e\nfooter", None)]  # goes
    rows = [(k, t, "en", s, len(t or "")) for k, (t, s) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    gone = {"footer", "every text in every site", "nine and the least site"}
    wanted = [(k, t if t is None else "\n".join(x for x in t.split("\n") if x not in gone)) for k, t, *_ in rows]
    same([(r.doc_id, r.text) for r in cp.without_boilerplate(spark, docs, str(tmp_path)).collect()], wanted)


def test_line_matching():
    rnd = random.Random(11)
    for _ in range(300):
        pairs = list({(rnd.randrange(5), f"s{rnd.randrange(5)}") for _ in range(rnd.randint(1, 12))})
        most = max(n for n in range(6) for chosen in itertools.combinations(pairs, n) if len({a for a, _ in chosen}) == len({b for _, b in chosen}) == n)
        assert line_dedup.matched(pairs) == most


def secrets(rows):
    """What the scan returns, by regular expressions and plain counting. Rows: doc_id, text, source."""
    patterns = [*((re.compile(p, re.A), g, lambda v, n=n: len(v) >= n) for _, p, g, n in secret_scan.BASE), (re.compile(secret_scan.TOKEN), 0, lambda v: bool(re.search("[0-9]", v) and re.search("[A-Za-z]", v)))]
    every = []
    for _, t, _ in rows:
        spans = [(m.start(), k, m.end(), m[g]) for k, (p, g, good) in enumerate(patterns) for m in p.finditer(t or "") if good(m[g])]
        every.append(sorted(s for s in spans if s[1] < 3 or not any(b[1] < 3 and b[0] < s[2] and s[0] < b[2] for b in spans)))
    holders = {}
    for (_, t, source), spans in zip(rows, every, strict=True):
        by = ((source or "").split("/")[0], source or "")
        for *_, v in spans:
            texts = holders.setdefault(v, {})
            texts[t] = min(by, texts.get(t, by))
    live = {v for v, texts in holders.items() if len({o for o, _ in texts.values()}) <= 1 and len(set(texts.values())) <= 10}
    names = ["assign", "access", "hex", "owned"]
    out = []
    for (d, *_), spans in zip(rows, every, strict=True):
        text = lambda some: ",".join(f"{names[k]}:{a}:{b}" for a, k, b, _ in some)
        base = [s for s in spans if s[1] < 3]
        out.append((d, *(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(text(base).encode()).hexdigest(), text([s for s in spans if s[1] < 3 or s[3] in live]), sum(s[3] in live for s in spans), sum(s[3] not in live for s in spans)))
    return out


def test_secret_scan(spark):
    rnd = random.Random(9)
    one, live, copied = "glp_" + "b7C8" * 6, "ghp_" + "a1B2c3D4e5" * 3, "example0" * 4
    odd = ["password = hunter2hunter2 x", "API-key api_key: 'abc' token=secret=abcdefghij", "AKIAABCDEFGHIJKL12 AKIASHORT", "é" * 3 + "0123456789abcdef" * 3, "password=token:abcdefghij", None, "", f"use {one} here", f"use {one} here", f"try {copied}", f"try {copied} now", "token: " + "Zx9" * 8]
    parts = ["password=", "token: ", "secret = '", "AKIA", "0123456789abcdef" * 2, "é ", " ", "x", "Zq1" * 7, "A1b2" * 6, "ABCD" * 4, live, copied, ",", "\n", "=", "/" * 3]
    texts = odd + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25))) for _ in range(150)]
    rows = [(None if k % 23 == 3 else k, t, (None, f"org{k % 4}/repo{k % 3}", f"org{k % 9}/repo{k}", "plain")[k % 4]) for k, t in enumerate(texts)]
    rows[7:9] = [(7, odd[7], "org7/a"), (8, odd[8], "org8/b")]  # copies of a text have one owner
    rows += rows[:3] + [(900 + k, f"{k} use Tmpl9{'ab1' * 8}", f"org1/repo{k}") for k in range(12)]  # one owner, twelve repositories
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, source string, row long, kind string, hash long").repartition(3)
    got = [tuple(r) for r in secret_scan.secret_scan(df).collect()]
    same(got, secrets(rows))
    assert "owned" in got[[g[0] for g in got].index(7)][5]


def test_secret_scan_of_many_matches(spark):
    text = " ".join(f"{k:032x}" for k in range(64_000))
    began = time.time()
    (got,) = secret_scan.secret_scan(spark.createDataFrame([(1, text, "a/b")], "doc_id long, text string, source string")).collect()
    spans = ",".join(f"hex:{33 * k}:{33 * k + 32}" for k in range(64_000))
    assert (got.n_hex, got.spans) == (64_000, spans) and time.time() - began < 60


def test_bpe_round_trip(spark, texts, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    df, rows = table(spark, texts)
    library = bpe_codec.Codec(path, public_tokenizers.PATTERN).encoding
    wanted = []
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        wanted.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    same([tuple(r) for r in bpe_codec.round_trip(df, path, public_tokenizers.PATTERN).collect()], wanted)
    back = bpe_codec.decode(bpe_codec.encode(df, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    same([(r.doc_id, bytes(r.decoded)) for r in back.collect()], [(r[0], (r[1] or "").encode()) for r in rows])
    monkeypatch.setattr(bpe_codec, "LONG", 100)
    monkeypatch.setattr(bpe_codec, "RUN", 20)
    monkeypatch.setattr(bpe_codec, "_RUN", bpe_codec.runs(20))
    codec = bpe_codec.Codec(path, public_tokenizers.PATTERN)
    for t in [x for x in texts if x] + ["a" + "\n" * 50 + "b" + " " * 90, "\t" * 70]:
        assert codec.encode(t).tolist() == library.encode_ordinary(t)


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_language_id_by_brute_force(spark, texts, block, monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK", block)
    every = texts + ["1234 !!", "漢字かな交じり文" * 30, "x" * 7000, "ab1cd " * 900, "ÀÉ straße"]
    df, rows = table(spark, every)

    def profile(t):
        letters = [x.lower() if len(x.lower()) == 1 else x for x in t]
        kept = "".join(x if unicodedata.category(c)[0] == "L" else " " for x, c in zip(letters, t, strict=True))
        kept = " " + " ".join(kept.split()) + " " if kept.split() else " "
        return Counter(kept[k : k + 3] for k in range(len(kept) - 2))

    def vector(grams):
        out = np.zeros(language_id.DIMENSIONS)
        for g, n in grams.items():
            x = language_id._vectors(np.array([0 if c == " " else ord(c) for c in g])).astype(int)
            out += n * np.roll(x[0], 2) * np.roll(x[1], 1) * x[2]
        return out

    known = {}
    for d, t, lang, *_ in rows:
        if d is not None and zlib.crc32(str(d).encode()) % 5 and t is not None and lang is not None and profile(t):
            known[lang] = known.get(lang, 0) + vector(profile(t)) / sum(profile(t).values())
    got = sorted(map(tuple, language_id.language_id(df).collect()), key=str)
    wanted = []
    for d, t, *_ in rows:
        held = None if d is None else zlib.crc32(str(d).encode()) % 5 == 0
        v = vector(profile(t)) if t and profile(t) else np.zeros(1)
        if not v.any():
            wanted.append((d, held, "und", 0.0))
            continue
        cosine = {x: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for x, p in known.items()}
        best = max(sorted(cosine), key=cosine.get)
        wanted.append((d, held, best, min(1.0, max(0.0, cosine[best]))))
    for a, b in zip(got, sorted(wanted, key=str), strict=True):
        assert a[:2] == b[:2] and abs(a[3] - b[3]) < 1e-4
    assert Counter(x[:3] for x in got) == Counter(x[:3] for x in wanted)


def test_language_id_ties_and_no_training(spark):
    rows = [(k, "same words here", lang) for k, lang in enumerate(["fr", "en", "de"] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = language_id.prototypes(df)
    assert {r.lang_pred for r in language_id.classify(df, known).collect()} == {"de"}
    assert {tuple(r)[2:] for r in language_id.language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 8)).astype(np.float32)
    v[50:120] = v[50]
    rows = [(k, [float(x) for x in row]) for k, row in enumerate(v)]
    rows += [(1000, None), (1001, [0.0] * 8), (1020, [1.0, None] + [0.0] * 6), (1040, [float("nan")] * 8), (None, [1.0] * 8), (1060, [])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), "id % 20 = 0", 20).collect()
    exact = v.astype(float) @ v.astype(float).T
    wanted = []
    for q in range(0, 400, 20):
        score = neighbours.dots(np.repeat(v[q : q + 1].astype(float), 400, axis=0), v.astype(float))
        assert np.allclose(score, exact[q])
        best = [k for k in np.lexsort((np.arange(400), -score)) if k != q][:20]
        wanted += [(q, i + 1, int(k), float(score[k])) for i, k in enumerate(best)]
    same([tuple(r) for r in got], wanted)


def test_neighbours_of_large_and_long_vectors(spark):
    rows = [(20, [1e200, 0.0]), (1, [1e200, 1.0]), (2, [2e200, 0.0]), (3, [1e-200, 5.0]), (4, [-1e200, 3.0]), (5, [1.0, 2.0, 3.0]), (40, [1e200, -1e200])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2), "id % 20 = 0", 20).collect()
    inf, nan = float("inf"), float("nan")
    wanted = [(20, 1, 1, inf), (20, 2, 2, inf), (20, 3, 40, inf), (20, 4, 3, 1.0), (20, 5, 4, -inf)]
    wanted += [(40, 1, 1, inf), (40, 2, 2, inf), (40, 3, 20, inf), (40, 4, 3, 1.0 + -1e200 * 5.0), (40, 5, 4, -inf)]
    same([tuple(r) for r in got], wanted)
    rows = [(0, [1e200, -1e200]), (1, [1e200, 1e200]), (2, [1e200, 0.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id = 0", 20).collect()
    assert [(r.vec_id, str(r.score)) for r in got] == [(1, str(nan)), (2, "inf")]
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(size=(60, 4096)), np.ones((30, 4096)) * rng.choice([1, 100], size=(30, 1))])
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(3, v[3].tolist())], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in neighbours.nearest(df, "id % 20 = 0", 5).collect()}
    for q in range(0, 90, 20):
        score = neighbours.dots(np.repeat(v[q : q + 1], 91, axis=0), np.concatenate([v, v[3:4]]))
        ids = np.append(np.arange(90), 3)
        best = [k for k in np.lexsort((ids, -score)) if ids[k] != q][:5]
        assert [got[q, i + 1] for i in range(5)] == [(int(ids[k]), float(score[k])) for k in best]


@pytest.mark.parametrize("split", [False, True])
def test_lm_score(spark, texts, split, monkeypatch):
    if split:  # contexts of frequent words are split
        line = b" ".join(b"w%d" % k for k in range(40))
        hot = np.sort(textblocks.words(np.frombuffer(line, np.uint8), np.array([0, len(line)])).hash >> np.uint64(16))
        frequent = lm_score.frequent
        monkeypatch.setattr(lm_score, "frequent", lambda docs: (hot, frequent(docs)[1]))
    df, rows = table(spark, [*texts, *morse(1500)])
    tokens = [[*WORD.findall(lower(r[1])), None] for r in rows]
    held = [None if r[0] is None else zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows]
    c, c1, c2, c3 = Counter(), Counter(), Counter(), Counter()
    for t, h in zip(tokens, held, strict=True):
        if h is False:
            c.update(t)
            c1.update(["<"] + t[:-1])
            c2.update(zip(["<", "<"] + t, ["<"] + t, strict=False))
            c3.update(zip(["<", "<"] + t, ["<"] + t, t, strict=False))
    n, v = sum(c.values()), len(c)
    unigram = lambda x: (c[x] + 0.5) / (n + 0.5 * (v + 1))
    pair = lambda a, b: (c2[a, b] + lm_score.MU2 * unigram(b)) / (c1[a] + lm_score.MU2)
    wanted = []
    for r, t, h in zip(rows, tokens, held, strict=True):
        score = sum(math.log10((c3[x, a, b] + lm_score.MU3 * pair(a, b)) / (c2[x, a] + lm_score.MU3)) for x, a, b in zip(["<", "<"] + t, ["<"] + t, t, strict=False))
        wanted.append((r[0], h, len(t), sum(c[x] > 0 for x in t), n, sum(math.log10(unigram(x)) for x in t), score))
    got = sorted(map(tuple, lm_score.lm_score(df).collect()), key=str)
    for a, b in zip(got, sorted(wanted, key=str), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and abs(a[6] - b[6]) <= 0.03 * a[2]


def test_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(exchange, "KEYS", 10)
    docs = spark.createDataFrame([(" ".join(["the"] * 50 + [f"r{k}x{j}" for j in range(50)]),) for k in range(4)], "text string")
    hot, n = lm_score.frequent(docs)
    the = textblocks.words(np.frombuffer(b"the", np.uint8), np.array([0, 3])).hash[0] >> np.uint64(16)
    assert n == 4 * 104 and the in hot and len(hot) < 10


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (5, 3), (3000, 10**12), (50, 60)):
        v = np.unique(rng.integers(0, top, n).astype(np.uint64))
        ef = lm_score.EliasFano(v)
        ef.mapped(ef.arrays())
        assert (ef.get(np.arange(len(v))) == v).all()
        q = np.concatenate([v, rng.integers(0, 2 * top, 200).astype(np.uint64)])
        at = {int(x): k for k, x in enumerate(v)}
        assert ef.successor(q).tolist() == [at.get(int(x), -1) for x in q]


def test_decontamination(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    extra = [(9001, None, "s"), (9002, "", "s"), (None, items.first().text, "s"), (9003, "one two three", "s")]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    items = items.select("item_id", "text").unionByName(spark.createDataFrame([(500, "Two, three"), (501, None), (None, "x y")], "item_id long, text string"))
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    known = {r.item_id: words(r.text) for r in items.collect() if r.item_id is not None}
    wanted = []
    for r in docs.collect():
        w, hits = words(r.text), {}
        for i, x in known.items():
            k = min(5, len(x))
            grams = lambda y, k=k: Counter(tuple(y[j : j + k]) for j in range(len(y) - k + 1)) if k else Counter()
            a = grams(x)
            if not a.keys() & grams(w).keys():
                continue
            for s in range(max(1, len(w) - len(x) + 1)):
                b = grams(w[s : s + len(x)])
                if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    hits[i] = True
        wanted.append((r.doc_id, bool(hits), ",".join(map(str, sorted(hits)))))
    got = decontamination.decontaminate(docs, items)
    same([(r.doc_id, r.contaminated, r.item_ids) for r in got.collect()], wanted)
    kept = decontamination.clean(docs.withColumn("k", F.lit(1)).withColumn("__held", F.lit(2)), items)
    assert kept.columns[-2:] == ["k", "__held"] and kept.count() == sum(not c for _, c, _ in wanted)


def test_decontamination_of_edited_passages(spark):
    """Insertions, deletions and moved halves put the best window between the aligned starts, or far from all of them."""
    rnd = random.Random(5)
    plain = lambda tag, n: [f"{tag}{k}" for k in range(n)]
    items = {1: plain("a", 58), 2: plain("b", 120), 3: [f"c{rnd.randrange(12)}" for _ in range(70)], 4: plain("d", 200), 5: plain("e", 7), 6: ["f"] * 40}
    edited = [["y", *items[1][1:29], "x", "x", *items[1][29:57], "y"]]
    edited.append(["y"] * 3 + items[2][3:60] + ["x"] * 6 + items[2][60:117] + ["y"] * 3)
    edited.append(items[4][100:] + items[4][:100])
    edited += [items[4][:90] + items[4][96:], items[5][:6], ["f"] * 300, ["z"] * 9 + items[2][8:], items[2][:-8]]
    for _ in range(60):
        w = list(items[rnd.choice([1, 2, 3, 5])])
        for _ in range(rnd.randint(1, 4)):
            k = rnd.choice([0, len(w) // 2, len(w) - 1, rnd.randrange(len(w))])
            w[k : k + rnd.randint(0, 3)] = ["v"] * rnd.randint(0, 4)
        edited.append(w)
    texts = [" ".join(["u"] * rnd.choice([0, 3, 200]) + w + ["t"] * rnd.choice([0, 3, 200])) for w in edited]
    wanted = []
    for d, t in enumerate(texts):
        w, hits = t.split(), {}
        for i, x in items.items():
            grams = lambda y: Counter(tuple(y[j : j + 5]) for j in range(len(y) - 4))
            a = grams(x)
            for s in range(max(1, len(w) - len(x) + 1)):
                b = grams(w[s : s + len(x)])
                if (a | b) and (sim := sum((a & b).values()) / sum((a | b).values())) >= 0.8:
                    hits[i] = max(sim, hits.get(i, 0))
        wanted.append((d, ",".join(map(str, sorted(hits))), round(max(hits.values(), default=0.0), 9)))
    assert [x[1] for x in wanted[:3]] == ["1", "2", "4"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    same([(r.doc_id, r.item_ids, round(r.similarity, 9)) for r in decontamination.decontaminate(docs, known).collect()], wanted)


@pytest.mark.parametrize("held", [None, 0])
def test_decontamination_broadcasts_little(spark, monkeypatch, held):
    """What grows with the texts isn't broadcast, but for keys of a few bytes a text."""
    items = {1: [f"a{k}" for k in range(40)], 2: [f"b{k}" for k in range(25)]}
    texts = [" ".join([f"u{d}", *(items[1 + d % 2] if d % 3 else [f"v{d}x{k}" for k in range(30)]), f"t{d}"]) for d in range(300)]
    if held is not None:
        monkeypatch.setattr(decontamination, "HELD_BYTES", held)
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df) or broadcast(df))
    kept = decontamination.clean(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 300, 3))
    assert sent and max(df.toArrow().nbytes for df in sent) < (300 * 60 if held is None else 5000)


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(7, None), (999, 999)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if b is not None:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    same([tuple(r) for r in got], [(x, top(x)) for x in up])


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for name, query in queries().items():
        assert query(spark, str(tmp_path)).collect() == [], name


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = queries()[name](spark, "/root/testdata/sf0.001")
    rel = con.sql(oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    same([tuple(r[c] for c in names) for r in df.collect()], [tuple(dict(zip(rel.columns, r, strict=True))[c] for c in names) for r in rel.fetchall()])


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline as cp

    rnd = random.Random(4)
    clean = [" ".join(rnd.choice(["the", "house", "of", "river", "blue", "stone"]) + str(k) + chr(97 + rnd.randrange(26)) for _ in range(60)) for k in range(30)]
    item = " ".join(f"question{k}" for k in range(20))
    texts = clean + [clean[0], clean[1].replace("the1", "a1", 1), "1 2 3", None, clean[2] + "x " + item]
    rows = [(k, t, "en", f"s{k % 12}", len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    got = {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()}
    assert got == set(range(30))


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(1, " ".join(f"question{k}" for k in range(20)))], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


CLASHES = ["score", "lang_pred", "n_lines", "n_removed", "k", "__gone", "__a", "__b", "__k1", "__held", "row", "component_id", "class_id"]


def test_stages_take_odd_rows_and_clashing_columns(spark, odd_folder):
    import corpus_pipeline as cp

    rnd = random.Random(6)
    clean = [" ".join(f"{rnd.choice(['stone', 'river', 'house'])}{rnd.randrange(10**5)}" for _ in range(50)) for _ in range(12)]
    texts = [None, "", "\n\n", "1 2 3", clean[0], clean[0], *clean, "漢字かな交じり文" * 30, " ".join(f"stone{k} river" for k in range(20_000))]
    rows = [(None if k % 5 == 4 else k % 16, t, "en" if k % 3 else None, f"s{k}" if k % 4 else None, *(f"{k}" for _ in CLASHES)) for k, t in enumerate(texts)]
    rows += rows[4:7]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)).repartition(3)
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, odd_folder)
        assert docs.columns == columns, name
        docs = cp.written(docs, f"test-{name}")
    left = Counter(r.text for r in docs.collect())
    assert left == Counter([*clean, texts[-1]])
    assert cp.STAGES[-1][1](spark, docs, odd_folder).count() == len(clean) + 1


def test_stages_take_empty_tables(spark, odd_folder):
    import corpus_pipeline as cp

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, odd_folder).count() == 0


def test_one_of_each_keeps_clean_rows_of_the_same_id(spark, odd_folder):
    import corpus_pipeline as cp

    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(1, a), (2, a), (2, b), (None, a), (None, b), (None, None), (3, b + " c"), (4, ""), (4, "")]
    got = cp.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), odd_folder).collect()
    same([tuple(r) for r in got], [(1, a), (2, b), (None, None), (4, ""), (4, "")])


@pytest.mark.parametrize("classes", [1_000_000, 0])
def test_equal_vectors_make_few_candidates(spark, monkeypatch, classes):
    """A large group of equal vectors, some with repeated ids, beside others; candidates are few and results those of brute force."""
    monkeypatch.setattr(neighbours, "CLASSES", classes)
    rnd = np.random.default_rng(8)
    one, two = rnd.normal(size=8), rnd.normal(size=8)
    rows = [(k, (one if k % 3 else two if k % 2 else rnd.normal(size=8)).tolist()) for k in range(900)]
    rows += [(7, one.tolist()), (5000, None), (5001, [0.0] * 8), (None, one.tolist())] + [(6000 + k, None) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    left = neighbours._nearest_of_equals(df.toDF("id", "v"), 20).where("v is not null and id is not null").collect()
    assert sum(r.v == one.tolist() for r in left) <= 22 and sum(r.v == two.tolist() for r in left) <= 21
    x = [(k, np.array(v)) for k, v in rows if k is not None and v is not None and any(v)]
    wanted = []
    for q in {k for k, _ in x if k % 20 == 0}:
        (v,) = [v for k, v in x if k == q][:1]
        near = sorted((-float(neighbours.dots(v[None], w[None])[0]), k) for k, w in x if k != q)[:20]
        wanted += [(q, rank, k, -s) for rank, (s, k) in enumerate(near, 1)]
    found = [tuple(r) for r in neighbours.nearest(df, "id % 20 = 0", 20).collect()]
    assert sorted(found) == sorted(wanted)
