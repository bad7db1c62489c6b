"""Intermediate tables, written where every executor sees them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where that is unset a temporary folder serves local mode; elsewhere it must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='vigilstream-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder, which is deleted when the process ends."""
    path = f"{folder(spark)}/vigilstream-{tag}-{uuid.uuid4().hex}"
    _KEPT[path] = spark
    return path


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``df``, written and read again: what reads it several times computes it once, and a lost executor loses none of it."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _clear() -> None:
    for path, spark in _KEPT.items():
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is over; who owns the folder clears it
            pass


atexit.register(_clear)
