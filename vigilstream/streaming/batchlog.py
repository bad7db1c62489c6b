"""A log of the batches that a sink has had: one small file a batch, in a folder that a new driver sees."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class BatchLog:
    """What was true after each batch, by the batch's number.

    A streaming query gives a batch again, with the same number and rows, if it ended before the batch was over. What a
    batch builds on is the entry before its own, so that a batch given again comes to the same result.
    """

    #: Entries that are kept; a query never goes back by more than one batch.
    KEPT = 100

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        self._system = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Batches with an entry, in order."""
        if not self._system.exists(self._at("")):
            return []
        names = [f.getPath().getName() for f in self._system.listStatus(self._at(""))]
        return sorted(int(n) for n in names if n.isdigit())

    def has(self, number: int) -> bool:
        return bool(self._system.exists(self._at(str(number))))

    def read(self, number: int) -> dict:
        data = self.spark.read.text(f"{self.path}/{number}", wholetext=True).first()
        return json.loads(data.value)

    def before(self, number: int) -> dict:
        """The last entry of an earlier batch; empty if there is none."""
        earlier = [n for n in self.numbers() if n < number]
        return self.read(earlier[-1]) if earlier else {}

    def commit(self, number: int, **values) -> None:
        """Writes a batch's entry: it is there wholly or not at all."""
        part = self._at(f"_{number}.part")
        out = self._system.create(part, True)
        try:
            out.write(bytearray(json.dumps(values).encode()))
        finally:
            out.close()
        self._system.delete(self._at(str(number)), False)
        if not self._system.rename(part, self._at(str(number))):
            raise OSError(f"can't write the entry of batch {number} in {self.path}")
        for old in self.numbers()[: -self.KEPT]:
            self._system.delete(self._at(str(old)), False)
