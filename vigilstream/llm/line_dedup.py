"""Removal of boilerplate lines by the number of distinct sites that carry them.

A line (without white space around it; blank lines are never removed) is boilerplate if at least ``min_sites``
distinct sites carry it. Lines that occur fewer times, or in one site, are ruled out by a plain count. For the others,
HyperLogLog sketches of the sites per line hash merge by aggregation; where the estimate is within ``band`` of the
threshold the distinct sites are counted exactly, so a decision never rests on an estimate that could be wrong.

With ``copies_once`` the copies of a whole text give one site together: a line is boilerplate if ``min_sites`` different
texts can be named that carry it, each in a site of its own (a matching of texts and sites). So a text copied into many
sites keeps its lines. Only texts that are equal as a whole are copies. For a matching of k, k sites of each text, k
texts of each site and k * k of the pairs left are enough, so no line's decision takes more than k * k pairs.

Only line hashes are grouped, with map-side aggregation, so a line with a third of all rows is no large task. The
hashes of boilerplate lines go to all tasks while there are at most ``HELD`` of them; beyond that they are joined.

Defined results: a null text has 0 lines and stays null; an empty one has 1 blank line; a null site counts as none;
a text that loses all lines becomes empty; each input row gives one row, whose other columns are unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vigilstream.llm.shared import is_small, written

#: Boilerplate hashes that each task may hold (8 bytes each, about 20 MB as a Python set).
HELD = 200_000
#: Precision of the sketches: 2**12 registers, a standard error of about 1.6 per cent.
PRECISION = 12
_BLANKS = " \t\r"
#: Spark's xxhash64 starts from this seed.
_SEED = 42


def _hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(_BLANKS)))


def _lines(docs: DataFrame, text: str, site: str) -> DataFrame:
    """site and h of every line that isn't blank, in documents with a site."""
    rows = docs.select(docs[site].cast("string").alias("site"), F.explode(F.split(docs[text], "\n")).alias("line"))
    return rows.where((F.btrim("line", F.lit(_BLANKS)) != "") & F.col("site").isNotNull()).select("site", _hash(F.col("line")).alias("h"))


def boilerplate(docs: DataFrame, min_sites: int = 10, text_column: str = "text", site_column: str = "source", band: float = 0.1) -> DataFrame:
    """Hashes (``h``) of the lines that at least ``min_sites`` sites carry."""
    lines = _lines(docs, text_column, site_column)
    often = lines.groupBy("h").agg(F.count("*").alias("n"), F.min(F.xxhash64("site")).alias("a"), F.max(F.xxhash64("site")).alias("b"))
    often = written(often.where((F.col("n") >= min_sites) & ((F.col("a") != F.col("b")) | F.lit(min_sites <= 1))).select("h"), "often")
    kept = written(lines.join(F.broadcast(often) if is_small(often, HELD) else often, "h", "left_semi"), "lines")
    spread = kept.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", PRECISION)).alias("sites"))
    spread = written(spread, "spread")
    low, high = min_sites * (1 - band) - 1, min_sites * (1 + band) + 1
    near = spread.where(F.col("sites").between(low, high)).select("h")
    exact = kept.join(near, "h", "left_semi").groupBy("h").agg(F.countDistinct("site").alias("sites"))
    return spread.where(F.col("sites") > high).select("h").union(exact.where(F.col("sites") >= min_sites).select("h"))


def matched(pairs: list[tuple[int, str]]) -> int:
    """The most pairs (text, site) in which no text and no site comes twice."""
    sites: dict[int, list[str]] = {}
    for text, site in pairs:
        sites.setdefault(text, []).append(site)
    holder: dict[str, int] = {}

    def place(text: int, seen: set[str]) -> bool:
        for site in sites[text]:
            if site not in seen:
                seen.add(site)
                if site not in holder or place(holder[site], seen):
                    holder[site] = text
                    return True
        return False

    return sum(place(text, set()) for text in sites)


def spread_over_texts(docs: DataFrame, found: DataFrame, min_sites: int, text_column: str, site_column: str) -> DataFrame:
    """Of the line hashes ``found`` those that ``min_sites`` different texts carry, each in a site of its own."""
    k = max(min_sites, 1)
    named = docs.select(docs[text_column].alias("text"), docs[site_column].cast("string").alias("site")).where("site is not null")
    lines = named.select(F.xxhash64("text").alias("tk"), "site", F.explode(F.split("text", "\n")).alias("line"))
    pairs = lines.where(F.btrim("line", F.lit(_BLANKS)) != "").select(_hash(F.col("line")).alias("h"), "tk", "site")
    pairs = written(pairs.join(F.broadcast(found) if is_small(found, HELD) else found, "h", "left_semi").distinct(), "pairs")
    # Spark limits the groups before it shuffles them, so a line with a third of all rows is no large task.
    for keys, order, most in ((["h", "tk"], ["site"], k), (["h", "site"], ["tk"], k), (["h"], ["tk", "site"], k * k)):
        pairs = pairs.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("at") <= most).drop("at")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            good = [h for h, xs in rows if len(xs) >= k * k or matched([(x["tk"], x["site"]) for x in xs]) >= k]
            yield pa.RecordBatch.from_arrays([pa.array(good, pa.int64())], ["h"])

    return pairs.groupBy("h").agg(F.collect_list(F.struct("tk", "site")).alias("pairs")).mapInArrow(work, "h long")


def line_dedup(docs: DataFrame, min_sites: int = 10, text_column: str = "text", site_column: str = "source", copies_once: bool = False) -> DataFrame:
    """The documents without boilerplate lines, with n_lines and n_removed (of the same names, columns are replaced)."""
    docs = docs.drop("n_lines", "n_removed")
    found = boilerplate_lines(docs, min_sites, text_column, site_column, copies_once)
    return _cleaned(docs, found, text_column)


def boilerplate_lines(docs: DataFrame, min_sites: int, text_column: str, site_column: str, copies_once: bool) -> DataFrame:
    found = written(boilerplate(docs, min_sites, text_column, site_column), "boilerplate")
    return written(spread_over_texts(docs, found, min_sites, text_column, site_column), "spread-over-texts") if copies_once else found


def without_lines(docs: DataFrame, min_sites: int = 10, text_column: str = "text", site_column: str = "source", copies_once: bool = False) -> DataFrame:
    """The documents without boilerplate lines, with the columns that they have."""
    found = boilerplate_lines(docs, min_sites, text_column, site_column, copies_once)
    others = [F.col(f"__{k}").alias(c) for k, c in enumerate(docs.columns)]
    at = docs.columns.index(text_column)
    renamed = docs.select(*[docs[c].alias(f"__{k}") for k, c in enumerate(docs.columns)])
    return _cleaned(renamed, found, f"__{at}").select(*others)


def _cleaned(docs: DataFrame, found: DataFrame, text_column: str) -> DataFrame:
    if is_small(found, HELD):
        return _removed(docs, frozenset(r.h for r in found.collect()), text_column)
    return _removed_by_join(docs, found, text_column)


def _removed(docs: DataFrame, hashes: frozenset[int], text_column: str) -> DataFrame:
    at = docs.columns.index(text_column)

    def clean(text: str | None) -> tuple[str | None, int, int]:
        if text is None:
            return None, 0, 0
        lines = text.split("\n")
        left = [x for x in lines if not ((t := x.strip(_BLANKS)) and _signed(xxhash.xxh64_intdigest(t.encode(), _SEED)) in hashes)]
        return "\n".join(left), len(lines), len(lines) - len(left)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [clean(t) for t in batch.column(at).to_pylist()]
            columns = [*batch.columns, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
            columns[at] = pa.array([r[0] for r in rows], batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "n_lines", "n_removed"])

    schema = StructType([*docs.schema.fields, StructField("n_lines", LongType()), StructField("n_removed", LongType())])
    return docs.mapInArrow(work, schema)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _removed_by_join(docs: DataFrame, found: DataFrame, text_column: str) -> DataFrame:
    """The same by joins, for any number of boilerplate lines: places of lines to remove are gathered by text."""
    # The documents travel as one column beside the keys, so none of their names can clash.
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).withColumn("k", F.md5(F.col("row")[text_column].cast("binary")))
    lines = F.split(F.col("row")[text_column], "\n")
    hits = keyed.select("k", F.posexplode(lines).alias("at", "line")).where(F.btrim("line", F.lit(_BLANKS)) != "").select("k", "at", _hash(F.col("line")).alias("h"))
    hits = hits.join(found, "h", "left_semi").groupBy("k").agg(F.array_sort(F.collect_set("at")).alias("gone"))
    out = keyed.join(hits, "k", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    # What is left of the lines, whose places are marked by a map of the gone ones' places only.
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col("row")[text_column].isNotNull(), text)
    columns = [text.alias(c) if c == text_column else F.col("row")[c].alias(c) for c in docs.columns]
    n = F.when(F.col("row")[text_column].isNotNull(), F.size(lines)).otherwise(0).cast("long")
    return out.select(*columns, n.alias("n_lines"), F.size("gone").cast("long").alias("n_removed"))


def digest(cleaned: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the text that is left."""
    left = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    return cleaned.select(F.col(id_column).alias("doc_id"), "n_lines", "n_removed", F.sha2(left, 256).alias("kept_sha256"))

