"""Secret scan: pattern matches, and credentials told from examples by who else has them.

Base spans are the matches of three patterns. Beside them, long tokens of letters and digits are candidates; every
candidate's hash is aggregated over the corpus by distinct repositories and owners, where the copies of a whole text
count as the one of the least owner and repository. A candidate of at most ``most_owners`` owners, in at most
``most_repositories`` repositories, looks live, and where it overlaps no base match it is added as a span of kind
``owned``; what more have is a widely copied example, and is only counted.

Everything is made of DataFrame functions. A text's matches are laid out as rows and their places are running sums of
the lengths of what stands between them, so the work is linear in the text. Rows of (hash, text) are made distinct before
owners are counted, so a candidate in a third of all rows reaches a counting task once for each text and task; the way
back is salted.

Defined results: a null text is an empty one; a null source is a repository and owner of its own name ''; each input
row gives one row, repeated rows included; other columns are ignored. Places are code points, the end exclusive; an
``assign`` span covers the whole match.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilstream.llm.shared import written

#: Kind, pattern, group of the value, least length of the value.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: Candidates besides: runs of this many characters with a letter and a digit.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
SALTS = 8
_SPAN = "array<struct<start:bigint,kind:int,stop:bigint>>"


def _matches(text: Column, pattern: str, group: int, good: Callable[[Column], Column], prefilter: str | None = None) -> Column:
    """All matches of a pattern in order: characters since the match before, the match's length, its value's hash, and whether it counts."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)), F.length)
    zipped = F.arrays_zip(between.alias("gap"), whole.alias("whole"), value.alias("value"))
    found = F.transform(zipped, lambda x: F.struct(x["gap"].alias("gap"), F.length(x["whole"]).alias("size"), F.xxhash64(x["value"]).alias("hash"), good(x["value"]).alias("good")))
    return F.when(text.rlike(prefilter or pattern), found)


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", repository_column: str = "source") -> DataFrame:
    """row, doc_id, repository, owner, tk (the text's key), and the matches of each kind, one row per document."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), F.coalesce(docs[repository_column].cast("string"), F.lit("")).alias("repository"), docs[text_column].cast("string").alias("__text"))
    kinds = []
    for k, (_, pattern, group, least) in enumerate(BASE):
        # Runs of one class that are too short fail at each of their places, so asking for the length skips them early.
        fast = {1: "AKIA[A-Z0-9]{12,}", 2: "[0-9a-f]{32,}"}.get(k, pattern)
        kinds.append(_matches(text, fast, group, lambda v, least=least: F.length(v) >= least))
    kinds.append(_matches(text, TOKEN, 0, lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")))
    owner = F.split("repository", "/")[0].alias("owner")
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repository", owner, F.xxhash64(text).alias("tk"), *[m.alias(f"kind{k}") for k, m in enumerate(kinds)])


def placed(found: DataFrame) -> DataFrame:
    """row, tk, owner, repository, kind, start, stop and hash of base matches, and of other candidates that overlap none."""
    parts = []
    for k in range(len(BASE) + 1):
        rows = found.where(F.col(f"kind{k}").isNotNull()).select("row", "tk", "owner", "repository", F.lit(k).alias("kind"), F.posexplode(f"kind{k}").alias("at", "m"))
        parts.append(rows.select("row", "tk", "owner", "repository", "kind", "at", "m.*"))
    # All windows are of a row or part of one, so they share one shuffle.
    rows = reduce(DataFrame.unionByName, parts).repartition("row")
    stop = F.sum(F.col("gap").cast("long") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("size")).where("good").drop("at", "gap", "size", "good")
    base = F.col("kind") < len(BASE)
    # In the order of starts (base matches first), a candidate meets the farthest stop before it and the next start after it.
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__stop", F.max(F.when(base, F.col("stop"))).over(before)).withColumn("__start", F.min(F.when(base, F.col("start"))).over(after))
    apart = (F.coalesce(F.col("__stop"), F.lit(-1)) <= F.col("start")) & (F.coalesce(F.col("__start"), F.col("stop")) >= F.col("stop"))
    return rows.where(base | apart).drop("__stop", "__start")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k, *_ in BASE], F.lit("owned"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def secret_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", repository_column: str = "source", most_owners: int = 1, most_repositories: int = 10) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, and how many candidates look live (n_live) or copied (n_copied)."""
    rows = written(candidates(docs, id_column, text_column, repository_column), "secrets")
    each = written(placed(rows), "spans")
    who = each.groupBy("hash", "tk").agg(F.min(F.struct("owner", "repository")).alias("by")).select("hash", "by.*").distinct()
    who = who.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    who = who.select("hash", ((F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)).alias("live"))
    salted = who.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = each.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["hash", "salt"])
    span, base = F.struct("start", "kind", "stop"), F.col("kind") < len(BASE)
    count = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)]
    found = each.groupBy("row").agg(*count, F.array_sort(F.collect_list(F.when(base, span))).alias("base"), F.array_sort(F.collect_list(F.when(base | F.col("live"), span))).alias("every"), F.count(F.when(F.col("live"), 1)).alias("n_live"), F.count(F.when(~F.col("live"), 1)).alias("n_copied"))
    out = rows.select("row", "doc_id").join(found, "row", "left")
    zero, none = F.lit(0).cast("long"), F.array().cast(_SPAN)
    numbers = [F.coalesce(f"n_{name}", zero).alias(f"n_{name}") for name, *_ in BASE]
    sha = F.sha2(_joined(F.coalesce("base", none)).cast("binary"), 256).alias("base_sha256")
    return out.select("doc_id", *numbers, sha, _joined(F.coalesce("every", none)).alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"))
