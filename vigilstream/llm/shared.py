"""Tables cut from their lineage, and the folder that every executor sees."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from vigilstream import shipping

#: Bytes of a batch that goes to a Python worker, so that long texts don't add up there.
BATCH_BYTES = 4 << 20

_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, a temporary folder in local mode, and elsewhere an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="vigilstream-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, reread: it survives lost executors and is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vigilstream-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(table: DataFrame) -> None:
    """Deletes a table of ``written``; everything made of it must be written itself, as nothing can be computed from it again."""
    _delete(table.written_at)


def _delete(path: str) -> None:
    spark = _WRITTEN.pop(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the workers, and bounds what they get at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return shipping.ship(spark)


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must to tell."""
    return df.limit(rows + 1).count() <= rows


def _delete_all() -> None:
    for path in list(_WRITTEN):
        try:
            _delete(path)
        except Exception:  # the session has gone; the folder's owner cleans it
            pass


atexit.register(_delete_all)
