"""Where reports go: a queue, a socket, or a table from which they are drained; all take a batch of reports as JSON.

A sink is a function for ``foreachBatch``. Batches are delivered at least once. ``Numbered`` keeps a log of the batches that a
sink has had, leaves those out that come again, and gives reports ids that go on from batch to batch and after a restart. A
driver that is lost between a sink's write and the log's entry has the batch written again: a table holds it once all the
same, as it is written over by its number; a queue or socket may get it twice.
"""

from __future__ import annotations

import json
import socket
import struct
from collections.abc import Callable, Iterator

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from vigilstream.operators.reports import numbered, to_json
from vigilstream.streaming.batchlog import BatchLog

Sink = Callable[[DataFrame, int], None]
#: Reports that wait to be drained at most; what comes beyond is dropped and counted.
QUEUED = 100_000


class QueueSink:
    """Reports to a queue (any format that Spark writes ``value`` rows to, as Kafka), without waiting for room.

    A batch puts at most ``room`` reports in; the others are dropped. ``sent``, ``sent_bytes`` and ``discards`` count. A batch
    with the number of one that it has had is left out; with ``log`` that is known after a restart too.
    """

    def __init__(self, format: str = "kafka", room: int | None = None, log: BatchLog | None = None, **options: str):
        self.format, self.room, self.log, self.options = format, room, log, options
        self.sent = self.sent_bytes = self.discards = 0
        self.last = -1

    def __call__(self, reports: DataFrame, number: int) -> None:
        if number <= self.last or self.log is not None and self.log.has(number):
            return
        rows = reports.select(F.col("json").alias("value")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            put = rows if self.room is None else rows.limit(self.room).persist(StorageLevel.MEMORY_AND_DISK)
            n, size = put.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()
            dropped = 0 if self.room is None else rows.count() - n
            put.write.format(self.format).options(**self.options).mode("append").save()
            if put is not rows:
                put.unpersist()
        finally:
            rows.unpersist()
        if self.log is not None:
            self.log.commit(number, sent=n, discards=dropped)
        self.last = number
        self.sent, self.sent_bytes, self.discards = self.sent + n, self.sent_bytes + size, self.discards + dropped


class Numbered:
    """Gives envelopes of reports ids and hands them to a sink as JSON, each batch once.

    The first id of a batch follows the last one of the batch before, which the log tells, so ids run on after a restart and a
    batch that is delivered again before its entry was made gets the ids that it had.
    """

    def __init__(self, sink: Sink, log: BatchLog, first: int = 0):
        self.sink, self.log, self.first = sink, log, first

    def __call__(self, envelopes: DataFrame, number: int) -> None:
        if self.log.has(number):
            return
        start = self.log.before(number).get("next", self.first)
        rows = numbered(envelopes, start).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.sink(to_json(rows), number)
            self.log.commit(number, next=start + rows.count())
        finally:
            rows.unpersist()


def framed(body: bytes) -> bytes:
    """A report on a stream socket: its length in four bytes, the largest first, and itself."""
    return struct.pack(">i", len(body)) + body


def socket_sink(host: str, port: int, kind: str = "tcp") -> Sink:
    """Reports to a socket, each partition's by a connection of its own: framed on TCP, one a datagram on UDP."""

    def send(rows: Iterator[Row]) -> None:
        with socket.socket(socket.AF_INET, socket.SOCK_STREAM if kind == "tcp" else socket.SOCK_DGRAM) as out:
            out.connect((host, port))
            for r in rows:
                body = r.json.encode()
                try:
                    out.sendall(framed(body)) if kind == "tcp" else out.send(body)
                except ConnectionRefusedError:  # nobody listens for datagrams
                    pass

    return lambda reports, number: reports.select("json").foreachPartition(send)


class ReportTable:
    """Reports in a folder: the latest of each statement, and all since the last drain."""

    def __init__(self, spark: SparkSession, path: str, most: int = QUEUED):
        self.spark, self.path, self.most = spark, path, most

    SCHEMA = "statement string, time string, at double, json string, batch long"

    def __call__(self, reports: DataFrame, number: int) -> None:
        rows = reports.select("statement", F.col("time").cast("string").alias("time"), F.col("time").cast("timestamp").cast("double").alias("at"), "json")
        rows.write.mode("overwrite").json(f"{self.path}/batch={number}")

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).option("basePath", self.path).json(f"{self.path}/batch=*")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.SCHEMA)  # no report yet

    def latest(self) -> DataFrame:
        """The last report of each statement."""
        return self._rows().groupBy("statement").agg(F.max_by(F.struct("time", "json"), F.struct("batch", "at")).alias("x")).select("statement", "x.*")

    def drain(self) -> tuple[DataFrame, int]:
        """The reports since the last drain, the first ``most`` of them, and how many were dropped."""
        since, rows = self._mark(), self._rows()
        rows = rows.where(F.col("batch") > since)
        last, n = rows.agg(F.max("batch"), F.count("*")).first()
        if last is not None:
            self.spark.createDataFrame([(json.dumps({"batch": last}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/drained")
        out = rows.where(F.col("batch") <= F.lit(last if last is not None else since)).orderBy("batch", "at", "statement").limit(self.most)
        return out.select("statement", "time", "json"), max(0, n - self.most)

    def _mark(self) -> int:
        try:
            return json.loads(self.spark.read.text(f"{self.path}/drained").first().value)["batch"]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return -1


def sink(kind: str, **options) -> Sink:
    """By the report mode: ``queue``, ``socket`` or ``table``."""
    kinds = {"queue": QueueSink, "socket": socket_sink, "table": ReportTable}
    if kind not in kinds:
        raise ValueError(f"unknown report mode {kind}")
    return kinds[kind](**options)


def fan_in(streams: list[DataFrame]) -> DataFrame:
    """Events of several inputs as one; columns that one lacks are null."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def measured(records: DataFrame, value: str = "value", name: str = "throughput") -> DataFrame:
    """Records whose number and bytes a batch's progress tells under ``name``: messages and bytes."""
    return records.observe(name, F.count("*").alias("messages"), F.coalesce(F.sum(F.octet_length(value)), F.lit(0)).alias("bytes"))


def sampled(events: DataFrame, every: int = 1000, number: str = "seq_num") -> DataFrame:
    """Every so-manieth event, for logs."""
    return events.where(F.col(number) % every == 0)


class Throughput(StreamingQueryListener):
    """Messages and megabytes a second of the queries whose records are ``measured``: of each batch, and since the start.

    Add it with ``spark.streams.addListener``. ``each``: called with a query's name or id and its rates after each batch.
    """

    def __init__(self, name: str = "throughput", each: Callable[[str, dict], None] | None = None):
        self.name, self.each = name, each
        self.totals: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        self.totals[str(event.runId)] = {"messages": 0, "bytes": 0, "seconds": 0.0}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(self.name)
        if seen is None:
            return
        seconds = p.durationMs.get("triggerExecution", 0) / 1000
        total = self.totals.setdefault(str(p.runId), {"messages": 0, "bytes": 0, "seconds": 0.0})
        for k, v in (("messages", seen["messages"]), ("bytes", seen["bytes"]), ("seconds", seconds)):
            total[k] += v
        if self.each is not None:
            self.each(p.name or str(p.id), {"messages_per_second": seen["messages"] / max(seconds, 1e-3), "mb_per_second": seen["bytes"] / 1e6 / max(seconds, 1e-3), **total})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.totals.pop(str(event.runId), None)
