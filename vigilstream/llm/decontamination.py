"""Benchmark decontamination: SimHash fingerprints of item-sized windows, then exact weighted-shingle similarity.

Words are runs of letters and digits in lower case; shingles are five words (all words of a shorter item). A place of a
text whose shingle an item has too is shared, and the start at which item and text agree there is aligned. Windows of an
item's size are laid at every start from the least to the greatest aligned start of the shared places inside, if there
are enough of these for the similarity; they get a 64-bit SimHash of their shingles (each occurrence weighs one).
The laying misses no best window: beyond all aligned starts of its shared places, a window's outer shingle is not shared,
so a step towards them loses nothing.

Fingerprints meet in a multi-index of ``BLOCKS`` bit blocks: two fingerprints that differ in at most ``BLOCKS - 1`` bits
agree in a block, so all pairs within ``RADIUS`` are found. A window of similarity 0.8 differs in 10 of 64 bits on average
(standard deviation 3), far within the radius; blocks that guarantee such a radius are of two or three bits, on which alone
a third of all windows and items would meet. So each text has an index of its own, of the items of which it has as many
shingles as the similarity needs at the least: the blocks' keys carry the text, no key is common to many texts, and no
window meets an item that its text shares too little with. Pairs are then verified by the similarity of their shingle
multisets, sum of least counts over sum of greatest.

Everything is made of DataFrame functions. What is made of the items is broadcast while they have at most ``HELD``
shingles, and the keys of texts while they take at most ``HELD_BYTES``; windows, indices and pairs grow with the texts and
are shuffled. Copies of a text are worked on once, by its MD5; windows travel as places and fingerprints only.

Defined results: a null or empty text or item matches nothing; items with fewer than five words match as a whole; a
window that would reach over an end of the text is moved inside it; each input row gives one row; repeated items count
by their item_id; a null item_id is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilstream.llm.shared import is_small, written

WIDTH = 5
BLOCKS = 24
RADIUS = BLOCKS - 1
HELD = 200_000
#: Bytes of texts' keys to broadcast, and those of a key in the driver's hash table (217 were measured, of 77,000).
HELD_BYTES, KEY_BYTES = 16 << 20, 220
#: First bit and number of bits of each block: 64 bits, 16 blocks of three and 8 of two.
_BITS = [(3 * b, 3) for b in range(16)] + [(48 + 2 * b, 2) for b in range(8)]


def _words(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _shingles(words: Column, width: int) -> Column:
    """Hashes of ``width`` words from each place on; none if there are fewer words."""
    at = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - (width - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(width)]))


def fingerprint(shingles: Column) -> Column:
    def vote(b: Column) -> Column:
        # A negative sum of +1 and -1 by bit clears the bit; the lambda's variables are longs throughout.
        ones = F.aggregate(shingles, F.lit(0).cast("long"), lambda a, h: a + F.call_function("getbit", h, b).cast("long"))
        return F.when(2 * ones > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(vote(b)))


def _blocks(fp: str) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("b"), F.shiftrightunsigned(F.col(fp), at).bitwiseAND(F.lit((1 << n) - 1).cast("long")).alias("v")) for k, (at, n) in enumerate(_BITS)])


def _common(a: str, b: str) -> Column:
    """Size of the intersection of two multisets, as sorted arrays.

    Distinct values are intersected by hash. What is left of each multiset then, an occurrence less of each value, is
    empty unless shingles are repeated, and only what both have left is counted value by value.
    """
    rest = lambda xs: F.filter(xs, lambda x, i: (i > 0) & F.coalesce(x == F.get(F.col(xs), i - 1), F.lit(False)))
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    x, y = rest(a), rest(b)
    repeated = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda n, v: n + F.least(times(x, v), times(y, v)))
    both = F.size(F.array_intersect(a, b))
    return both + F.when((F.size(x) > 0) & (F.size(y) > 0), repeated).otherwise(0)


def _keyed(docs: DataFrame, text_column: str) -> DataFrame:
    """k (MD5 of the text) and text."""
    text = docs[text_column].cast("string")
    return docs.select(F.md5(text.cast("binary")).alias("k"), text.alias("text")).where("k is not null")


def _agree(fp: str, other: str) -> Column:
    """Whether two fingerprints agree, block by block."""
    differ = F.col(fp).bitwiseXOR(F.col(other))
    return F.array(*[F.shiftrightunsigned(differ, at).bitwiseAND(F.lit((1 << n) - 1).cast("long")) == 0 for at, n in _BITS])


def _held(df: DataFrame) -> DataFrame:
    """Rows of the items."""
    return F.broadcast(df) if is_small(df, HELD) else df


def _held_keys(df: DataFrame) -> DataFrame:
    """Keys of texts."""
    return F.broadcast(df) if is_small(df, HELD_BYTES // KEY_BYTES) else df


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, text_column: str = "text", item_id_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """k (the MD5 of a text), item_id and similarity of every item that a text holds."""
    items = benchmark.select(benchmark[item_id_column].alias("item_id"), _words(benchmark[item_text_column]).alias("words")).where("item_id is not null and size(words) > 0")
    # Items are told apart by their rows, as numbers may be repeated.
    items = items.withColumn("n", F.size("words")).withColumn("width", F.least("n", F.lit(WIDTH))).withColumn("row", F.monotonically_increasing_id())
    items = written(items, "items")
    keyed = _keyed(docs, text_column)
    parts = []
    for width in sorted(r.width for r in items.select("width").distinct().collect()):  # five at most
        some = items.where(F.col("width") == width).withColumn("shingles", _shingles(F.col("words"), width))
        parts.append(_matches(keyed, some, width, similarity))
    if not parts:
        return keyed.where("false").select("k", F.lit(None).cast(benchmark.schema[item_id_column].dataType).alias("item_id"), F.lit(0.0).alias("similarity"))
    return reduce(DataFrame.unionByName, parts).groupBy("k", "item_id").agg(F.max("similarity").alias("similarity"))


def _need(n: Column, width: int, similarity: float) -> Column:
    """Shared places that a window of n words needs at the least."""
    m = n - (width - 1)
    return F.greatest(F.lit(1), F.ceil(2 * m * F.lit(similarity) / (1 + F.lit(similarity)) - 1e-6).cast("int"))


def _starts(width: int, similarity: float) -> Column:
    """Starts of the windows to lay, of n (item's words), size (text's words) and p (shared places, ascending).

    Place by place, the starts after the place before: as far back as the window still has the places it needs.
    """
    p, n, end = F.col("p"), F.col("n"), F.col("size") - F.col("n")
    m = n - (width - 1)
    need = _need(n, width, similarity)
    inside = lambda x: F.greatest(F.lit(0), F.least(x, end))

    def of(i: Column) -> Column:
        at, last = F.get(p, i)["at"], F.get(p, i + need - 1)["at"]
        near = F.filter(F.slice(p, i + 1, m), lambda x: x["at"] < at + m)
        low = F.greatest(F.coalesce(F.get(p, i - 1)["at"] + 1, F.lit(0)), last - m + 1, inside(F.array_min(F.transform(near, lambda x: x["low"]))))
        high = F.least(at, inside(F.array_max(F.transform(near, lambda x: x["high"]))))
        enough = last.isNotNull() & (last < at + m)
        return F.when(enough, F.when(low <= high, F.sequence(low, high))).otherwise(F.array().cast("array<int>"))

    starts = F.flatten(F.filter(F.transform(F.sequence(F.lit(0), F.size(p) - 1), of), lambda x: x.isNotNull()))
    return F.when(end > 0, starts).otherwise(F.array(F.lit(0)))


def _matches(keyed: DataFrame, items: DataFrame, width: int, similarity: float) -> DataFrame:
    # The first and last place of a shingle in items of a size bound its aligned starts.
    laid = items.select("n", F.posexplode("shingles").alias("at", "h")).groupBy("n", "h").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    laid = written(laid, "laid")
    texts = keyed.select("k", _words(F.col("text")).alias("words"))
    places = texts.select("k", F.size("words").alias("size"), F.posexplode(_shingles(F.col("words"), width)).alias("at", "h"))
    shared = places.join(_held(laid), "h").select("k", "n", "size", "at", (F.col("at") - F.col("last")).alias("low"), (F.col("at") - F.col("first")).alias("high")).distinct()
    shared = shared.groupBy("k", "n", "size").agg(F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("p"))
    starts = written(shared.select("k", "n", F.explode(_starts(width, similarity)).alias("start")), "starts")
    # Tasks are few bytes and much work from here on, so their number is told.
    tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed.join(_held_keys(starts.select("k").distinct()), "k", "left_semi").repartition(tasks, "k").dropDuplicates(["k"])
    texts = written(texts.select("k", _words(F.col("text")).alias("words")), "texts")
    # Windows of a text go together in lists of so many starts at most.
    lists = starts.groupBy("k", F.floor(F.col("start") / 2048).alias("part")).agg(F.collect_list(F.struct("n", "start")).alias("windows"))
    window = lists.repartition(tasks, "k").join(texts.repartition(tasks, "k"), "k").select("k", "words", F.explode("windows").alias("w"))
    window = window.select("k", "w.n", "w.start", F.expr("slice(words, w.start + 1, w.n)").alias("words"))
    window = window.select("k", "n", "start", F.array_sort(_shingles(F.col("words"), width)).alias("shingles"))
    window = written(window.select("*", fingerprint(F.col("shingles")).alias("fp")), "prints")
    items = written(items.select("row", "item_id", "n", F.array_sort("shingles").alias("item_shingles"), fingerprint(F.col("shingles")).alias("item_fp")), "item-prints")
    # The items of each text's index.
    known = items.select("row", F.explode(F.array_distinct("item_shingles")).alias("h"))
    few = is_small(known, HELD)
    held = lambda t: F.broadcast(t) if few else t
    places = texts.select("k", F.explode(_shingles(F.col("words"), width)).alias("h"))
    index = places.join(held(known), "h").groupBy("k", "row").agg(F.count("*").alias("places"))
    index = index.join(held(items.select("row", "n", "item_fp")), "row").where(F.col("places") >= _need(F.col("n"), width, similarity))
    index = written(index.select("k", "row", "n", "item_fp"), "index")
    a = window.select("k", "n", "start", "fp", F.explode(_blocks("fp")).alias("x")).select("*", "x.b", "x.v").drop("x")
    b = index.select("k", "n", "row", "item_fp", F.explode(_blocks("item_fp")).alias("x")).select("*", "x.b", "x.v").drop("x")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
    # Of the blocks in which a pair agrees only the first goes on, so each pair is verified once.
    first = F.col("b") == F.array_position(_agree("fp", "item_fp"), True) - 1
    # Spark's estimate knows nothing of the rows that explode makes, so it would broadcast the blocks of a small index.
    pairs = written(a.join(b.hint("merge"), ["k", "n", "b", "v"]).where(near & first).select("k", "n", "start", "row"), "pairs")
    pairs = window.join(pairs, ["k", "n", "start"]).join(held(items.select("row", "item_id", "item_shingles")), "row")
    common = _common("shingles", "item_shingles")
    sim = common / (F.size("shingles") + F.size("item_shingles") - common)
    return pairs.select("k", "item_id", sim.alias("similarity")).where(F.col("similarity") >= similarity)


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, contaminated, n_items, item_ids (ascending, comma-joined) and the largest similarity."""
    found = matches(docs, benchmark, similarity, text_column)
    found = found.groupBy("k").agg(F.array_sort(F.collect_list("item_id")).alias("ids"), F.max("similarity").alias("similarity"))
    found = written(found, "found")
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), F.md5(docs[text_column].cast("string").cast("binary")).alias("k")).join(_held_keys(found), "k", "left")
    n = F.coalesce(F.size("ids"), F.lit(0))
    return rows.select("doc_id", F.col("ids").isNotNull().alias("contaminated"), F.greatest(n, F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("item_ids"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, text_column: str = "text") -> DataFrame:
    """The documents that hold no item, with their columns."""
    found = written(matches(docs, benchmark, similarity, text_column).select("k").distinct(), "found")
    found = _held_keys(found.select(F.struct("k").alias("__held")))
    key = F.struct(F.md5(docs[text_column].cast("string").cast("binary")).alias("k"))
    return docs.join(found, key == found["__held"], "left_anti")
