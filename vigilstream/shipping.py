"""Sends this package to the executors' Python workers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package as a zip file, once a Spark application; returns the session."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent
        folder = Path(tempfile.mkdtemp())
        shutil.copytree(package, folder / "source" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(str(folder / package.name), "zip", folder / "source", package.name))
        shutil.rmtree(folder / "source")
        _SHIPPED.add(context.applicationId)
    return spark
