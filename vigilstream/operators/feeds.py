"""Indicator files and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilstream.functions import net
from vigilstream.schema import IOC_TYPES

#: Bytes that the wire format keeps of a threat type, and of values and names.
THREAT, VALUE = 23, 95


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and text of every line; a file is read as one value, so that lines are numbered as they stand."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    return rows.select("file", (F.col("line") + 1).cast("long").alias("line"), "text").where("text <> ''")


def ioc_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Indicators and rejected lines, from file_id, line, text with text ``id,type,threat_type,ip,dns,value``.

    A line is rejected if fields are missing, the id is no number, or the type is unknown.
    """
    fields = F.split("text", ",", 6)
    part = [F.get(fields, F.lit(k)) for k in range(6)]  # conditions may be tried in any order, so no field is sure to be there
    kind = F.lower(F.trim(part[1]))
    good = (F.size(fields) == 6) & part[0].rlike("^[0-9]{1,18}$") & kind.isin(*IOC_TYPES)
    blank = lambda c: F.when(c != "", c)
    rows = lines.where(good).select("file_id", "line", part[0].try_cast("long").alias("id"), kind.alias("type"), F.substring(part[2], 1, THREAT).alias("threat_type"), blank(part[3]).alias("ip"), F.substring(part[4], 1, VALUE).alias("dns"), F.substring(part[5], 1, VALUE).alias("value"))
    return rows, lines.where(~F.coalesce(good, F.lit(False)))


def load_iocs(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """The indicators of some files, numbered in their order, and the lines that are none."""
    lines = None
    for k, path in enumerate(paths):
        rows = _lines(spark, path).withColumn("file_id", F.lit(k).cast("long"))
        lines = rows if lines is None else lines.unionByName(rows)
    return ioc_lines(lines.select("file_id", "line", "text"))


_DROP = "^([^;]+?) *;(.*)$"


def _drop_network() -> Column:
    return F.trim(F.regexp_extract("text", _DROP, 1))


def drop_list(lines: DataFrame) -> DataFrame:
    """``network ; comment`` lines: networks of either family, not to be reached as destinations."""
    rows = lines.where(~F.col("text").startswith(";")).select("line", _drop_network().alias("cidr"), F.trim(F.regexp_extract("text", _DROP, 2)).alias("comment"))
    return rows.where(net.network_parts(F.col("cidr")).isNotNull()).select(F.lit("cidr_dst").alias("type"), F.lit("drop").alias("report"), "line", "cidr", "comment")


def drop_rejects(lines: DataFrame) -> DataFrame:
    """The lines, comments apart, of which ``drop_list`` makes nothing."""
    return lines.where(~F.col("text").startswith(";") & net.network_parts(_drop_network()).isNull())


def cidr_list(lines: DataFrame) -> DataFrame:
    """A network of either family a line, ``;`` and ``#`` begin comments: networks not to be heard from."""
    rows = lines.where(~F.col("text").rlike("^[;#]")).select("line", F.trim("text").alias("cidr"))
    rows = rows.where(net.network_parts(F.col("cidr")).isNotNull())
    return rows.select(F.lit("cidr_src").alias("type"), F.lit("bogon").alias("report"), "line", "cidr", F.concat(F.lit("context-line-"), "line").alias("comment"))


def cidr_rejects(lines: DataFrame) -> DataFrame:
    """The lines, comments apart, of which ``cidr_list`` makes nothing."""
    return lines.where(~F.col("text").rlike("^[;#]") & net.network_parts(F.trim("text")).isNull())


def ranked_domains(lines: DataFrame) -> DataFrame:
    """``rank,domain[/path]`` lines: rank, domain and the reversed domain."""
    rows = lines.select(F.regexp_extract("text", "^([0-9]+),([^/,]+)", 1).alias("rank"), F.regexp_extract("text", "^([0-9]+),([^/,]+)", 2).alias("domain"))
    return rows.where("domain <> ''").select(F.col("rank").cast("int").alias("rank"), "domain", net.reverse_domain(F.col("domain")).alias("rdomain"))
