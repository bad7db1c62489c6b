"""Five stages from raw documents to tokens: language, boilerplate lines, near duplicates, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``documents``;
clean documents pass every stage, with the lines that aren't boilerplate.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilstream.llm import bpe_codec, decontamination, language_id, line_dedup, ngram_join
from vigilstream.llm.shared import is_small, ship, written

#: Similarity of word shingles for near duplicates and benchmark passages, and the shingles' words.
WORDS, PERCENT = 5, 80


#: The least cosine of a text of ``LETTERS`` letters or more with its language. Of 780 such held-out texts none was below
#: 0.23; of 800 texts of random letters nine in ten were below 0.1, and texts in another script were below 0.05. Shorter
#: texts tell too little: a clean one had 0.09.
LEAST_COSINE, LETTERS = 0.12, 30


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; those without a letter go, and those like none of the languages, if they are long enough to tell."""
    ship(spark)
    return language_id.recognised(docs, language_id.prototypes(docs), LEAST_COSINE, LETTERS)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sources carry in different texts; n_chars is counted anew."""
    ship(spark)
    kept = line_dedup.without_lines(docs, copies_once=True)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document, of the least doc_id (nulls last) and then the least content.

    Rows are told apart by doc_id and text, of rows that are equal in both one stays. Rows without a word are no
    duplicates of anything, and all stay.
    """
    ship(spark)
    found = ngram_join.near_classes(docs, WORDS, PERCENT)
    found = found.withColumn("first", F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "tk"))
    best = found.groupBy("component").agg(F.min("first").alias("best"), F.count("*").alias("n")).where("n > 1")
    best = written(best.drop("n"), "best")
    found = found.join(F.broadcast(best) if is_small(best, ngram_join.HELD) else best, "component")
    gone = written(found.where("first <> best").select("doc_id", "tk").distinct(), "gone")
    stays = written(found.where("first = best").groupBy("doc_id", "tk").count().where("count > 1").select("doc_id", "tk"), "twice")
    held = lambda t: F.broadcast(t) if is_small(t, ngram_join.HELD) else t
    # Rows travel as one column beside their keys, so none of their names can clash.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.withColumn("key", F.struct(F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("row.text").cast("string")).alias("tk")))
    as_key = lambda t: t.select(F.struct("doc_id", "tk").alias("other"))
    rows = rows.join(held(as_key(gone)), F.col("key").eqNullSafe(F.col("other")), "left_anti")
    if is_small(stays, 0):
        return rows.select("row.*")
    twice = rows.join(held(as_key(stays)), F.col("key").eqNullSafe(F.col("other")), "left_semi").dropDuplicates(["key"])
    return rows.join(held(as_key(stays)), F.col("key").eqNullSafe(F.col("other")), "left_anti").union(twice).select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.clean(docs, benchmark, PERCENT / 100)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of tokens, and digests of the ids and of the bytes that they decode to."""
    ship(spark)
    return bpe_codec.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", known_language),
    ("lines", without_boilerplate),
    ("near_duplicates", one_of_each),
    ("benchmark", without_benchmark),
    ("encoding", encoded),
]
#: Language profiles, the trie join and byte pairs are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
