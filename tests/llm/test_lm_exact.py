"""The language model's sums without quantisation against plain counts, and quantisation by the bounds of its steps."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vigilstream.llm import lm_score, textblocks


def test_distinct_numbers_with_their_places():
    rng = np.random.default_rng(2)
    for n, top in ((0, 5), (1, 1), (1000, 50), (1000, 2**40), (5, 2**62)):
        codes = rng.integers(0, top, n)
        value, inverse = lm_score._distinct(codes)
        want = np.unique(codes, return_inverse=True)
        assert value.dtype == codes.dtype and (value == want[0]).all() and (inverse == want[1]).all()


def test_hashes_with_their_places():
    rng = np.random.default_rng(5)
    for n in (0, 1, 1000):
        h = rng.integers(0, 2**64, 300, dtype=np.uint64)[rng.integers(0, 300, n)]
        value, inverse = lm_score._coded(h)
        want = np.unique(h, return_inverse=True)
        assert value.dtype == h.dtype and (value == want[0]).all() and (inverse == want[1]).all()


def test_packed_bits():
    rng = np.random.default_rng(6)
    for n in (0, 1, 63, 64, 200):
        for bits in (0, 1, 7, 31, 33, 63, 64):
            values = rng.integers(0, 2**64, n, dtype=np.uint64)
            got = np.unpackbits(lm_score._packed_bits(values, bits).view(np.uint8), bitorder="little")
            want = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits].ravel()
            assert (got[: n * bits] == want).all() and not got[n * bits :].any() and len(got) >= n * bits + 64


def test_lookups_read_few_numbers(monkeypatch):
    """A number that is alone with its high bits is read once; of k that share them, about log2(k) are."""
    reads, low = [0], lm_score.EliasFano._low
    monkeypatch.setattr(lm_score.EliasFano, "_low", lambda self, i: reads.__setitem__(0, reads[0] + len(i)) or low(self, i))
    for values, most in ((np.arange(1, 4097, dtype=np.uint64) << np.uint64(20), 4096), (np.append(np.arange(1024, dtype=np.uint64), np.uint64(2**40)), 11 * 1024 + 1)):
        ef, reads[0] = lm_score.EliasFano(values), 0
        ef.mapped(ef.arrays())
        assert (ef.successor(values) == np.arange(len(values))).all() and reads[0] <= most
        assert (ef.successor(values + np.uint64(2**39)) == -1).all()


@pytest.mark.parametrize("split", [False, True])
def test_sums_without_quantisation(split):
    """One chunk, its exact counts in place of a bucket's answers: the sums are those of plain counts to nine digits."""
    rnd = random.Random(4)
    texts = [" ".join(f"w{min(rnd.randrange(40), rnd.randrange(40))}" for _ in range(rnd.randrange(0, 200))) for _ in range(30)] + ["", "one"]
    chunk = next(textblocks.chunks(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])))
    h, bounds = lm_score._tokens(chunk)
    word, ids = np.unique(h, return_inverse=True)
    hot = np.sort(textblocks.words(np.frombuffer(b"w0 w1 w2 w3", np.uint8), np.array([0, 11])).hash >> np.uint64(16)) if split else np.zeros(0, np.uint64)
    plan = lm_score._plan(ids, word >> np.uint64(16), bounds, hot, 16, 2)
    assert (plan.second >= 0).any() == split
    once = np.ones(len(ids), bool)
    once[bounds[:-1]] = once[bounds[1:] - 1] = False
    count = np.bincount(ids[once], minlength=len(word))
    times = np.bincount(plan.tri, minlength=len(plan.first))
    entry = np.bincount(plan.first, times, len(plan.successor))
    entry[plan.second[plan.second >= 0]] += times[plan.second >= 0]
    total = np.bincount(plan.of, entry, len(plan.context))
    mu = np.where(plan.context & np.uint64(1), 0.0, lm_score.MU3)
    token = (word != lm_score._BEGIN) & (word != lm_score._AFTER)
    whole = int(count[token].sum()), int((count[token] > 0).sum())
    n = len(texts)
    got = lm_score._table(np.arange(n), np.zeros(n, np.int64), np.diff(bounds), ids, bounds, plan, count, total, entry / (total + mu)[plan.of], whole)

    tokens = [[*t.split(), None] for t in texts]
    c, c1, c2, c3 = Counter(), Counter(), Counter(), Counter()
    for t in tokens:
        c.update(t)
        c1.update(["<"] + t[:-1])
        c2.update(zip(["<", "<"] + t, ["<"] + t, strict=False))
        c3.update(zip(["<", "<"] + t, ["<"] + t, t, strict=False))
    assert whole == (sum(c.values()), len(c))
    unigram = lambda x: (c[x] + 0.5) / (whole[0] + 0.5 * (whole[1] + 1))
    pair = lambda a, b: (c2[a, b] + lm_score.MU2 * unigram(b)) / (c1[a] + lm_score.MU2)
    for t, score in zip(tokens, got.column("score").to_pylist(), strict=True):
        want = sum(math.log10((c3[x, a, b] + lm_score.MU3 * pair(a, b)) / (c2[x, a] + lm_score.MU3)) for x, a, b in zip(["<", "<"] + t, ["<"] + t, t, strict=False))
        assert math.isclose(score, want, rel_tol=1e-9)


def test_quantised_probabilities_are_within_half_a_step():
    p = np.exp2(-np.random.default_rng(3).uniform(0, lm_score._BITS, 20_000))
    code = lm_score.quantise_probability(p)
    x = (code.astype(float) - 1) / 254
    most = np.maximum((x + 0.5 / 254) ** 2 - x**2, x**2 - np.maximum(x - 0.5 / 254, 0) ** 2) * lm_score._BITS
    assert (np.abs(np.log2(lm_score.probability(code)) - np.log2(p)) <= most + 1e-9).all() and most.max() < 0.18
    assert lm_score.probability(np.zeros(1, np.uint8))[0] == 0 and code.min() >= 1


def test_quantised_counts_are_within_half_a_step():
    n = np.unique(np.concatenate([np.arange(1000), np.exp(np.random.default_rng(4).uniform(0, math.log(1e13), 5000)).astype(np.int64)]))
    back = lm_score.counted(lm_score.quantise(n))
    small = n <= lm_score._EXACT
    assert (back[small] == n[small]).all()
    assert (np.abs(np.log(back[~small] / n[~small])) <= 0.5 / lm_score._STEPS + 1e-9).all()
