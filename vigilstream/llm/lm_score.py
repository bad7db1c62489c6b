"""Language-model scores from an n-gram trie of Elias-Fano levels, counted over the whole corpus.

The model is a trigram one. Training counts and lookups take the same way (``exchange``): a chunk of texts sends its
distinct words, and its distinct trigrams under their contexts (the two words before), with their training counts, to
buckets; a bucket adds up all chunks' counts, builds the trie of its contexts, looks up what each chunk has sent, and
answers it. So nothing is broadcast or collected, every n-gram of the corpus counts, and what is frequent reaches its
bucket once for each chunk.

A context stands in one bucket with all its successors. Where both its words are among the frequent ones (``hot``), it
has classes of third words for successors instead, and each class is a context of its own, in a bucket of its own, so no
context is larger than a bucket by much; the probability is that of the class times that within it.

A bucket's trie has two levels: contexts as an ascending Elias-Fano sequence, with monotone pointers to their successors,
and the successors within each context, an Elias-Fano sequence again, with quantised smoothed probabilities of a byte; a
context has its quantised count, of which the weight of the shorter n-gram follows. The levels are laid in one unlinked
file and memory-mapped; a trigram is found by looking for its context and then for the successor at or after its value
within the context's pointers. Words are 64-bit hashes where they are counted, and 48-bit ones in n-grams; contexts have 40
bits beside their bucket, successors 32 within their context, so that one lookup in a million may find another's.

What a chunk needs of its own for scoring (its words' numbers, text by text) goes from a second scan straight to where the
answers come together, as it would fill the way through the buckets. Both scans must cut the same rows into the same chunks, so what isn't
known to be a plain read of files is written first.

With a context's count c12, a trigram's c3, a pair's c2 (which is the count of the context that it makes), the count c1
of a pair's first word, and the exact unigram estimate u of the base score, the probability is
(c3 + MU3 p2) / (c12 + MU3) with p2 = (c2 + MU2 u) / (c1 + MU2). Counts up to 64 are exact, larger ones and probabilities
are quantised in steps of a few per cent.

Defined results: a null or empty text is its end token alone; a null doc_id is not learned from, and its held_out is
null; each input row gives one row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilstream.llm import exchange as ex
from vigilstream.llm import textblocks as tb
from vigilstream.llm.shared import written

CHUNK = 8 << 20
#: Weights of the pair's estimate in a trigram's, and of the word's in a pair's, in tokens.
MU3, MU2 = 1.0, 20.0
#: Words are frequent from this share of all tokens on at the least, so there are a million at most.
LEAST = 1e-6
U64 = np.uint64
_BEGIN, _END, _AFTER = U64(0xEB44ACCAB455D165), U64(0x1D8E4E27C47D124F), U64(0x5B0B1C5A7F3D9A21)
_SUCCESSOR, _CONTEXT = 32, 5
#: Counts up to here have a code of their own; beyond, codes are steps of the logarithm.
_EXACT = 64
_STEPS = (255 - _EXACT) / np.log(1e13 / _EXACT)
#: Bits of a probability (its negative logarithm) up to which there are codes, closer to each other for probable ones.
_BITS = 44.0


class EliasFano:
    """Ascending whole numbers: low bits packed side by side, high bits in unary."""

    def __init__(self, values: np.ndarray):
        n = self.n = len(values)
        top = int(values[-1]) if n else 0
        self.low_bits = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        self.low = _packed_bits(values, self.low_bits)
        high = (values >> U64(self.low_bits)).astype(np.int64)
        unary = np.zeros(-(-(n + (top >> self.low_bits) + 2) // 64) * 64, np.uint8)
        unary[high + np.arange(n)] = 1
        self.high = np.packbits(unary, bitorder="little").view("<u8")

    def arrays(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high}

    def mapped(self, arrays: dict[str, np.ndarray]) -> None:
        """Takes its bits from a memory map. Lookups come by the hundred thousand, so the places of ones and zeros are laid out once for all of them."""
        self.low, self.high = arrays["low"], arrays["high"]
        bits = np.unpackbits(np.asarray(self.high).view(np.uint8), bitorder="little").view(bool)
        self.ones, self.zeros = np.flatnonzero(bits), np.flatnonzero(~bits)

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Place of the k-th (from 0) one or zero."""
        return (self.ones if bit else self.zeros)[k]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * U64(self.low_bits)
        word, shift = (bit >> U64(6)).astype(np.int64), bit & U64(63)
        # The second word is shifted in two steps, as none may be by 64.
        both = (self.low[word] >> shift) | (self.low[word + 1] << U64(1) << (U64(63) - shift))
        return both & U64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, 1) - i).astype(np.uint64) << U64(self.low_bits)) | self._low(i)

    def successor(self, values: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Index of each value within [lo, hi), or -1: a search among the numbers with the value's high bits."""
        found = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return found
        high = (values >> U64(self.low_bits)).astype(np.int64)
        inside = np.flatnonzero(high <= (len(self.high) * 64 - self.n - 2))
        h = high[inside]
        start = np.where(h > 0, self._select(np.maximum(h - 1, 0), 0) - np.maximum(h - 1, 0), 0)
        stop = self._select(h, 0) - h
        if lo is not None:
            start, stop = np.maximum(start, lo[inside]), np.minimum(stop, hi[inside])
        # The numbers with these high bits may be many where values crowd, so their low bits are bisected for the last that isn't above.
        want, low = values[inside] & U64((1 << self.low_bits) - 1), start.copy()
        open_ = np.flatnonzero(stop - start > 1)
        at, end, of = start[open_], stop[open_], want[open_]
        while len(open_):
            middle = (at + end) >> 1
            right = self._low(middle) <= of
            at, end = np.where(right, middle, at), np.where(right, end, middle)
            more = end - at > 1
            low[open_[~more]] = at[~more]
            open_, at, end, of = open_[more], at[more], end[more], of[more]
        there = np.flatnonzero(start < stop)
        hit = there[self._low(low[there]) == want[there]]
        found[inside[hit]] = low[hit]
        return found


def _packed_bits(values: np.ndarray, bits: int) -> np.ndarray:
    """The lowest bits of each value, without gaps, in words of 64 bits and one word more."""
    words = -(-len(values) * bits // 64)
    if not words:
        return np.zeros(2, "<u8")
    # 64 values fill whole words, so the k-th of every 64 lie alike in theirs.
    rows = np.zeros((-(-len(values) // 64), 64), np.uint64)
    rows.ravel()[: len(values)] = values & U64((1 << bits) - 1)
    out = np.zeros((len(rows), bits), np.uint64)
    for k in range(64):
        at, shift = divmod(k * bits, 64)
        out[:, at] |= rows[:, k] << U64(shift)
        if shift + bits > 64:
            out[:, at + 1] |= rows[:, k] >> U64(64 - shift)
    return np.concatenate([out.ravel()[:words], np.zeros(2, np.uint64)]).astype("<u8", copy=False)


class Trie:
    """Contexts, pointers, successors, and quantised counts and probabilities, memory-mapped.

    ``context`` and ``successor`` of each n-gram ascend together, without repetitions. Contexts whose lowest bit is set are
    classes: probabilities within them are not smoothed.
    """

    def __init__(self, context: np.ndarray, successor: np.ndarray, counts: np.ndarray):
        first = np.flatnonzero(np.diff(context, prepend=context[:1] ^ U64(1)))
        size = np.diff(first, append=len(context))
        rank = np.repeat(np.arange(len(first)), size)
        total = np.add.reduceat(counts, first) if len(first) else np.empty(0, np.int64)
        mu = np.where(context[first] & U64(1), 0.0, MU3)
        self.contexts = EliasFano(context[first])
        self.pointers = EliasFano(np.append(first, len(context)).astype(np.uint64))
        self.successors = EliasFano((rank.astype(np.uint64) << U64(_SUCCESSOR)) | successor)
        self.totals = quantise(total)
        self.codes = quantise_probability(counts / (total + mu)[rank])
        self._map()

    def _map(self) -> None:
        levels = {"contexts": self.contexts, "pointers": self.pointers, "successors": self.successors}
        with tempfile.TemporaryFile() as f:
            at = {}
            for name, a in [*((f"{k}.{x}", y) for k, level in levels.items() for x, y in level.arrays().items()), ("totals", self.totals), ("codes", self.codes)]:
                f.seek(-f.tell() % 8, 1)
                at[name] = (f.tell(), a.dtype, len(a))
                f.write(a.tobytes())
            f.flush()
            look = lambda name: np.asarray(np.memmap(f, at[name][1], "r", at[name][0], (at[name][2],))) if at[name][2] else np.empty(0, at[name][1])
            for k, level in levels.items():
                level.mapped({x: look(f"{k}.{x}") for x in ("low", "high")})
            self.totals, self.codes = look("totals"), look("codes")

    def look(self, context: np.ndarray, of: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the counts of contexts (ascending), and of the probabilities of ``successor`` within context ``of`` each; 0 if never seen."""
        totals, codes = np.zeros(len(context), np.uint8), np.zeros(len(successor), np.uint8)
        if not self.successors.n or not len(context):
            return totals, codes
        rank = self.contexts.successor(context)
        seen = np.maximum(rank, 0)
        totals[rank >= 0] = self.totals[rank[rank >= 0]]
        lo, hi = (self.pointers.get(seen + k).astype(np.int64) for k in (0, 1))
        known = np.flatnonzero(rank[of] >= 0)
        at = of[known]
        place = self.successors.successor((seen[at].astype(np.uint64) << U64(_SUCCESSOR)) | successor[known], lo[at], hi[at])
        hit = place >= 0
        codes[known[hit]] = self.codes[place[hit]]
        return totals, codes


def quantise(counts: np.ndarray) -> np.ndarray:
    """Bytes for counts; 0 stays 0."""
    codes = np.minimum(counts, _EXACT).astype(np.uint8)
    large = np.flatnonzero(counts > _EXACT)
    codes[large] = np.minimum(_EXACT + np.rint(np.log(counts[large] / _EXACT) * _STEPS), 255)
    return codes


def counted(codes: np.ndarray) -> np.ndarray:
    code = codes.astype(np.float64)
    return np.where(code <= _EXACT, code, _EXACT * np.exp((code - _EXACT) / _STEPS))


def quantise_probability(p: np.ndarray) -> np.ndarray:
    """Bytes from 1 on for probabilities above 0."""
    return (1 + np.rint(254 * np.sqrt(np.minimum(-np.log2(np.minimum(p, 1.0)), _BITS) / _BITS))).astype(np.uint8)


def probability(codes: np.ndarray) -> np.ndarray:
    """0 for code 0."""
    return np.where(codes > 0, np.exp2(-_BITS * ((codes.astype(np.float64) - 1) / 254) ** 2), 0.0)


#: What each code stands for.
_COUNTS, _PROBABILITIES = counted(np.arange(256)), probability(np.arange(256))


def pack_numbers(x: np.ndarray, size: int = 4) -> bytes:
    """Whole numbers of ``size`` bytes at most, the small ones common: byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes())


def unpack_numbers(raw: bytes, size: int = 4) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(f"<u{size}").ravel().astype(np.int64)


def _squeezed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _bytes(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)


def _tokens(c: tb.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words, after two beginnings and before its end and what is after that; and the rows' bounds."""
    w = tb.words(tb.lower_ascii(c.data), c.offsets)
    bounds = np.concatenate([[0], np.cumsum(w.per_row + 4)])
    h = np.full(int(bounds[-1]), _BEGIN)
    h[bounds[1:] - 2], h[bounds[1:] - 1] = _END, _AFTER
    h[np.arange(len(w.hash)) + 4 * w.row() + 2] = w.hash
    return h, bounds


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and the place of each among them. Most repeat, so they are told apart by a hash table and few are sorted."""
    table = pa.array(values).dictionary_encode()
    distinct = table.dictionary.to_numpy()
    order = np.argsort(distinct)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return distinct[order], rank[table.indices.to_numpy()]


@dataclass
class _Plan:
    """What a chunk asks for, made anew of the same words when the answers come.

    ``scored``: places of tokens with two before them; ``tri``: the distinct trigram of each, and ``before`` the pair before
    it; per trigram its entries (``first``, and ``second`` or -1), and per context made by words (``pair`` of a trigram's own
    context) its place. Entries are in the order of ``to`` and context, contexts in that of ``to``.
    """

    scored: np.ndarray
    tri: np.ndarray
    before: np.ndarray
    first: np.ndarray
    second: np.ndarray
    pair: np.ndarray
    context_of_pair: np.ndarray
    to: np.ndarray
    context: np.ndarray
    of: np.ndarray
    successor: np.ndarray

    def pair_place(self, real: np.ndarray) -> np.ndarray:
        """Place among the contexts of the pair that each of these tokens ends; it is the pair before the next token."""
        return self.context_of_pair[self.before[np.flatnonzero(real) + 1]]


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and the place of each number among them. Numbers carry their places through one sort where both fit 64 bits."""
    bits = len(codes).bit_length()
    if not len(codes) or int(codes.max()) >> (64 - bits):
        return np.unique(codes, return_inverse=True)
    x = np.sort((codes.astype(np.uint64) << U64(bits)) | np.arange(len(codes), dtype=np.uint64))
    place = (x & U64((1 << bits) - 1)).astype(np.int64)
    x >>= U64(bits)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    inverse = np.empty(len(x), np.int64)
    inverse[place] = np.cumsum(new) - 1
    return x[new].astype(codes.dtype), inverse


def _plan(ids: np.ndarray, word: np.ndarray, bounds: np.ndarray, hot: np.ndarray, classes: int, buckets: int) -> _Plan:
    """``word`` and ``hot`` are 48-bit hashes."""
    bits = len(word).bit_length()
    low = (1 << bits) - 1
    later = np.ones(len(ids), bool)
    later[bounds[:-1]] = later[bounds[:-1] + 1] = False
    scored = np.flatnonzero(later)
    pairs, before = _distinct((ids[scored - 2] << bits) | ids[scored - 1])
    codes, tri = _distinct((before << bits) | ids[scored])
    pair, third = codes >> bits, word[codes & low]
    one, two = pairs >> bits, pairs & low
    key = tb._mix((tb._mix(word) * U64(0xD6E8FEB86659FD93))[one] + word[two]) & ~U64(1)
    value = third & U64((1 << _SUCCESSOR) - 1)
    first, second = np.arange(len(codes)), np.full(len(codes), -1)
    context = pair  # of each entry; trigrams are in the order of their pairs
    often = np.isin(word, hot)
    apart = (often[one] & often[two])[pair]
    split = np.flatnonzero(apart)
    if len(split):
        # A trigram of a frequent context is asked for twice: its class in the context, and the word in the class.
        kind = (third[split] >> U64(48 - (classes.bit_length() - 1))).astype(np.int64)
        of_class, at = _distinct(pair[split] * classes + kind)
        ordinary = np.flatnonzero(~apart)
        context = np.concatenate([pair[ordinary], of_class // classes, len(pairs) + at])
        value = np.concatenate([value[ordinary], (of_class % classes).astype(np.uint64), value[split]])
        key = np.concatenate([key, tb._mix(key[of_class // classes] + (of_class % classes).astype(np.uint64) + U64(1)) | U64(1)])
        first[ordinary] = np.arange(len(ordinary))
        first[split] = len(ordinary) + at
        second[split] = len(ordinary) + len(of_class) + np.arange(len(split))
    to = (key % U64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
    by_context = np.argsort(to, kind="stable")
    place = np.empty(len(to), np.int64)
    place[by_context] = np.arange(len(to))
    # Entries go by bucket and, within it, by context.
    by_entry = np.argsort(context, kind="stable") if len(split) else np.arange(len(context))
    by_entry = by_entry[np.argsort(to[context[by_entry]], kind="stable")]
    entry = np.empty(len(context), np.int64)
    entry[by_entry] = np.arange(len(context))
    second = np.where(second >= 0, entry[second], -1)
    return _Plan(scored, tri, before, entry[first], second, pair, place[: len(pairs)], to[by_context].astype(np.int64), key[by_context], place[context[by_entry]], value[by_entry])


def _chunks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[int, tb.Chunk, np.ndarray, np.ndarray, np.ndarray]]:
    """Number, texts, distinct words in the order of buckets, the tokens' numbers among them, and the rows' bounds of each chunk."""
    chunk = TaskContext.get().partitionId() << 32
    for c in tb.chunks(batches, size=CHUNK):
        chunk += 1
        h, bounds = _tokens(c)
        word, ids = _coded(h)
        order = np.argsort((word % U64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        yield chunk, c, word[order], place[ids], bounds
        tb.release()


def _asked(docs: DataFrame, hot: np.ndarray, classes: int, buckets: int) -> DataFrame:
    """What chunks send to buckets: words, contexts and successors, with their training counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, c, word, ids, bounds in _chunks(batches, buckets):
            train = np.repeat(c.rows.column(1).to_numpy(zero_copy_only=False).astype(bool), np.diff(bounds))
            once = train.copy()
            once[bounds[:-1]] = once[bounds[1:] - 1] = False  # a beginning counts once, what is after the end never
            times = np.bincount(ids[once], minlength=len(word))
            plan = _plan(ids, word >> U64(16), bounds, hot, classes, buckets)
            tri_times = np.bincount(plan.tri[train[plan.scored]], minlength=len(plan.first))
            count = np.bincount(plan.first, tri_times, len(plan.successor)).astype(np.int64)
            there = plan.second >= 0
            count[plan.second[there]] += tri_times[there]
            word_at = np.searchsorted((word % U64(buckets)).astype(np.int64), np.arange(buckets + 1))
            context_at = np.searchsorted(plan.to, np.arange(buckets + 1))
            entry_at = np.searchsorted(plan.of, context_at)
            size = np.bincount(plan.of, minlength=len(plan.context))
            rows = []
            for b in range(buckets):
                w, x, e = (slice(at[b], at[b + 1]) for at in (word_at, context_at, entry_at))
                if w.start == w.stop and x.start == x.stop:
                    continue
                # A class keeps its lowest bit.
                contexts = (plan.context[x] // U64(buckets) & ~U64(1)) | (plan.context[x] & U64(1))
                numbers = pack_numbers(np.concatenate([[w.stop - w.start], times[w], size[x], count[e]]))
                rows.append(ex.row(b, chunk, ex.ASK, word[w].astype("<u8").tobytes(), ex.pack_keys(contexts, 1, _CONTEXT), plan.successor[e].astype("<u4").tobytes(), numbers))
            yield ex.batch(rows)

    return docs.mapInArrow(work, ex.SCHEMA)


def _kept(docs: DataFrame, buckets: int) -> DataFrame:
    """What chunks keep for themselves: documents, the tokens' numbers, and the words' hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, c, word, ids, bounds in _chunks(batches, buckets):
            number = c.rows.column(0)
            flags = number.is_null().to_numpy(zero_copy_only=False) * 1 + c.rows.column(2).to_numpy(zero_copy_only=False).astype(np.int64) * 2
            known = number.fill_null(0).to_numpy(zero_copy_only=False)
            table = np.concatenate([known.astype("<i8"), flags.astype("<i8"), np.diff(bounds).astype("<i8")])
            yield ex.batch([ex.row(0, chunk, ex.META, table.tobytes(), pack_numbers(ids), ex.pack_keys(word >> U64(16), 1, 6))])

    return docs.mapInArrow(work, ex.SCHEMA)


def _counted(rows: list[dict]) -> list[tuple]:
    """In a bucket: the words' counts, the trie of its contexts, and what it says of each chunk's n-grams."""
    out = []
    words, word_times, contexts, successors, sizes, times = [], [], [], [], [], []
    for r in rows:
        words.append(np.frombuffer(r["a"], "<u8"))
        contexts.append(ex.unpack_keys(r["b"], _CONTEXT))
        successors.append(np.frombuffer(r["c"], "<u4").astype(np.uint64))
        n = unpack_numbers(r["d"])
        x, y = 1 + int(n[0]), 1 + int(n[0]) + len(contexts[-1])
        word_times.append(n[1:x]), sizes.append(n[x:y]), times.append(n[y:])
    word, inverse = _coded(np.concatenate(words))
    total = np.bincount(inverse, np.concatenate(word_times), len(word)).astype(np.int64)
    token = (word != _BEGIN) & (word != _AFTER)
    size, distinct = int(total[token].sum()), int((total[token] > 0).sum())
    context, of_context = _distinct(np.concatenate(contexts))
    of = np.repeat(of_context, np.concatenate(sizes))
    # Successors have numbers first, as those are short enough to be sorted with their contexts and places.
    successor, rank = _distinct(np.concatenate(successors))
    bits = len(successor).bit_length()
    entries, entry = _distinct((of << bits) | rank)
    of, successor = entries >> bits, successor[entries & ((1 << bits) - 1)]
    number = np.bincount(entry, np.concatenate(times), len(entries)).astype(np.int64)
    seen = number > 0
    totals, codes = Trie(context[of[seen]], successor[seen], number[seen]).look(context, of, successor)
    whole = np.array([size, distinct], "<i8").tobytes()
    w_at, x_at, e_at = (np.cumsum([0, *map(len, x)]) for x in (words, contexts, successors))
    for k, r in enumerate(rows):
        found = _squeezed(np.concatenate([totals[of_context[x_at[k] : x_at[k + 1]]], codes[entry[e_at[k] : e_at[k + 1]]]]))
        lengths = np.array([x_at[k + 1] - x_at[k]], "<i8").tobytes()
        out.append(ex.row(r["to"], r["chunk"], ex.ANSWER, pack_numbers(total[inverse[w_at[k] : w_at[k + 1]]], 8), found, lengths, whole))
    return out


def _scored(answers: pa.Table, kept: pa.Table, hot: np.ndarray, classes: int, buckets: int) -> pa.Table:
    if len(kept) != 1 or not len(answers):
        raise ValueError("two scans of the documents gave different chunks")
    answers, (meta,) = sorted(ex.views(answers), key=lambda r: r["to"]), ex.views(kept)
    number, flags, size = np.frombuffer(meta["a"], "<i8").reshape(3, -1)
    ids, word = unpack_numbers(meta["b"]), ex.unpack_keys(meta["c"], 6)
    bounds = np.concatenate([[0], np.cumsum(size)])
    plan = _plan(ids, word, bounds, hot, classes, buckets)
    count = np.concatenate([unpack_numbers(r["a"], 8) for r in answers])
    if len(count) != len(word):
        raise ValueError("two scans of the documents gave different chunks")
    contexts, entries = [], []
    for r in answers:
        found, n = _bytes(r["b"]), int(np.frombuffer(r["c"], "<i8")[0])
        contexts.append(found[:n]), entries.append(found[n:])
    contexts, entries = _COUNTS[np.concatenate(contexts)], _PROBABILITIES[np.concatenate(entries)]
    return _table(number, flags, size, ids, bounds, plan, count, contexts, entries, _whole(answers))


def _whole(answers: list[dict]) -> tuple[int, int]:
    train, distinct = np.sum([np.frombuffer(r["d"], "<i8") for r in answers], axis=0)
    return int(train), int(distinct)


def _table(number, flags, size, ids, bounds, plan: _Plan, count, contexts, entries, whole: tuple[int, int]) -> pa.Table:
    train, distinct = whole
    unigram = (count + 0.5) / (train + 0.5 * (distinct + 1))
    last = np.zeros(len(ids), bool)
    last[bounds[1:] - 1] = True
    real = ~last[plan.scored]  # what is after the end is no token
    at, tri = plan.scored[real], plan.tri[real]
    second, third = ids[at - 1], ids[at]
    c1 = count[second]
    c2 = np.minimum(contexts[plan.pair_place(real)], c1)
    p2 = (c2 + MU2 * unigram[third]) / (c1 + MU2)
    p = entries[plan.first] * np.where(plan.second >= 0, entries[plan.second], 1.0)
    left = MU3 / (contexts[plan.context_of_pair[plan.pair]] + MU3)
    p = p[tri] + left[tri] * p2
    doc = np.repeat(np.arange(len(size)), size - 3)  # a text's tokens, without its two beginnings and what is after its end
    add = lambda x: np.bincount(doc, x, len(size))
    held = pa.array((flags & 2) > 0, mask=(flags & 1) > 0)
    return pa.table(
        {
            "doc_id": pa.array(number, mask=(flags & 1) > 0),
            "held_out": held,
            "n_tokens": pa.array(size - 3),
            "n_known": pa.array(add(count[third] > 0).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(size), train)),
            "base_score": pa.array(add(np.log10(unigram)[third])),
            "score": pa.array(add(np.log10(p))),
        }
    )


def frequent(docs: DataFrame) -> tuple[np.ndarray, int]:
    """48-bit hashes of words that may stand in more contexts than a bucket holds, and the number of tokens.

    A word that is frequent in all is so in some chunk; a chunk tells those of half the share that matters. What is found
    only deals n-grams to buckets, in the same way for all chunks, so it changes no result.
    """
    tokens = docs.select(F.sum(F.octet_length("text") / 4 + 3)).first()[0] or 1
    share = max(LEAST, ex.KEYS / 2 / tokens)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in tb.chunks(batches, size=CHUNK):
            h, bounds = _tokens(c)
            word, ids = _coded(h)
            times = np.bincount(ids, minlength=len(word))
            often = times >= share / 2 * len(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(word[often], U64(0)).view(np.int64)), pa.array(np.append(times[often], len(h)))], ["word", "n"])

    told = docs.select("text").mapInArrow(work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # Tokens are at least a twentieth of what was guessed, or there are as many words as may be told anyway.
    found = told.where((F.col("word") == 0) | (F.col("n") >= share * tokens / 40)).collect()  # 40 / LEAST at most
    n = sum(r.n for r in found if r.word == 0)
    often = [r.word for r in found if r.word and r.n >= share / 2 * n] if n * share >= 2 else []
    return np.unique(np.array(often, np.int64).view(np.uint64) >> U64(16)), n


def lm_score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", modulus: int = 5, held: int = 1, files: bool = False) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    ``files``: ``docs`` is a plain read of files, which gives the same rows in the same partitions again.
    """
    number = docs[id_column].cast("long")
    left = F.crc32(number.cast("string").cast("binary")) % modulus == held
    rows = docs.select(number.alias("doc_id"), F.coalesce(~left, F.lit(False)).alias("learn"), F.coalesce(left, F.lit(False)).alias("held"), docs[text_column].cast("string").alias("text"))
    rows = rows if files else written(rows, "texts")
    hot, n = frequent(rows)
    buckets = ex.buckets(docs, 2 * n)
    classes = 1 << min(16, max(4, (n // ex.KEYS).bit_length()))
    answered = ex.grouped(_asked(rows, hot, classes, buckets), "to", _counted, buckets)
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def work(answers: pa.Table, kept: pa.Table) -> pa.Table:
        out = _scored(answers, kept, hot, classes, buckets)
        tb.release()
        return out

    sides = [ex.dealt(side, "chunk", buckets).groupBy("chunk") for side in (answered, _kept(rows, buckets))]
    return sides[0].cogroup(sides[1]).applyInArrow(work, kind)
