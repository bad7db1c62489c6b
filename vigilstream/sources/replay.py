"""Replay files as a data source: records in many tasks from one file, by an index of byte ranges.

A replay file is a row of records, each after its length and time, so where a record begins is known only from those
before. ``index`` reads the heads alone, one task a file, and notes where ranges of about ``RANGE`` bytes begin, the number
of their first record, and their least and greatest time. ``replay`` then reads each range in a task of its own, as a
stream of Arrow batches; ranges outside the times that are asked for are not read. A compressed file can't be entered in
the middle: it is one range, and is unpacked as it is read.

Files are opened where they lie (local paths and what pyarrow has a file system for: file, hdfs, s3, gs). ``events.lv_scan``
reads what Spark alone can reach, a file at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, of a read, and of a batch; records of a batch.
RANGE, BLOCK, BATCH, RECORDS = 64 << 20, 1 << 20, 4 << 20, 4096
#: Length and milliseconds before each record.
HEAD = struct.Struct("<iq")
SCHEMA = "file string, at long, millis long, value string"
INDEX = "file string, start long, stop long, first long, records long, least long, most long"
NAMES = ["file", "start", "stop", "first", "records", "least", "most"]


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def files(path: str) -> list[str]:
    """The replay files (``.jlv``, ``.jlv.gz``) at or below a path."""
    system, base = _opened(path)
    if system.get_file_info(base).type == pafs.FileType.File:
        return [path]
    found = system.get_file_info(pafs.FileSelector(base, recursive=True))
    prefix = path[: len(path) - len(base)] if path.endswith(base) else "file://"
    return sorted(prefix + f.path for f in found if f.type == pafs.FileType.File and f.path.endswith((".jlv", ".jlv.gz")))


def _reader(uri: str, start: int) -> tuple[Callable[[int], bytes], Callable[[], None]]:
    """A function that reads on from a place, and one that closes the file."""
    system, path = _opened(uri)
    if path.endswith(".gz"):
        f = system.open_input_stream(path, compression="gzip")
    else:
        f = system.open_input_file(path)
        f.seek(start)
    return f.read, f.close


def framed(time: int, body: bytes) -> bytes:
    return HEAD.pack(len(body), time) + body


def records(read: Callable[[int], bytes], most: int | None = None) -> Iterator[tuple[int, int, bytes]]:
    """Size with its head, time and body of records; what is cut short, or has a negative length, ends them. ``most``: bytes that belong to the range."""
    held, at, done = b"", 0, 0
    while most is None or done < most:
        while len(held) - at < HEAD.size:  # a read may give less than what is asked for
            more = read(BLOCK)
            if not more:
                return
            held, at = held[at:] + more, 0
        size, time = HEAD.unpack_from(held, at)
        if size < 0:
            return
        lacking = at + HEAD.size + size - len(held)
        if lacking > 0:
            parts = [held[at:]]
            while lacking > 0:
                more = read(max(BLOCK, lacking))
                if not more:
                    return
                parts.append(more)
                lacking -= len(more)
            held, at = b"".join(parts), 0
        yield HEAD.size + size, time, held[at + HEAD.size : at + HEAD.size + size]
        at += HEAD.size + size
        done += HEAD.size + size


def ranges(uri: str, size: int) -> Iterator[tuple]:
    """The rows of a file's index."""
    read, close = _reader(uri, 0)
    try:
        start = place = first = n = 0
        least = most = None
        for length, time, _ in records(read):
            least, most = (time, time) if least is None else (min(least, time), max(most, time))
            place, n = place + length, n + 1
            if place - start >= size and not uri.endswith(".gz"):
                yield uri, start, place, first, n, least, most
                start, first, n, least, most = place, first + n, 0, None, None
        if n:
            yield uri, start, place, first, n, least, most
    finally:
        close()


def index(spark: SparkSession, path: str, to: str, size: int = RANGE) -> DataFrame:
    """Writes the index of all replay files at or below a path to a new folder, one task a file; returns it."""
    rows = spark.createDataFrame([(f,) for f in files(path)], "file string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                found = list(zip(*ranges(name, size), strict=True)) or [[] for _ in NAMES]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if k else pa.string()) for k, c in enumerate(found)], NAMES)

    n = max(1, min(rows.count(), 10_000))
    rows.repartition(n).mapInArrow(work, INDEX).write.parquet(to)
    return spark.read.schema(INDEX).parquet(to)


@dataclass
class Range(InputPartition):
    """Records of a file, from a place on; ``stop``: the place after the last, if known."""

    file: str
    start: int = 0
    stop: int | None = None
    first: int = 0


class ReplayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.index = options["path"], options.get("index")
        self.least, self.most = (int(options[k]) if k in options else None for k in ("least", "most"))

    def partitions(self) -> list[Range]:
        if self.index is None:
            return [Range(f) for f in files(self.path)]
        system, base = _opened(self.index)
        rows = pads.dataset(base, filesystem=system, format="parquet").to_table().to_pylist()
        rows = [r for r in rows if (self.least is None or r["most"] >= self.least) and (self.most is None or r["least"] <= self.most)]
        return [Range(r["file"], r["start"], r["stop"], r["first"]) for r in sorted(rows, key=lambda r: (r["file"], r["start"]))]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        read, close = _reader(partition.file, partition.start)
        try:
            at, times, bodies, size = partition.first, [], [], 0
            most = None if partition.stop is None else partition.stop - partition.start
            for length, time, body in records(read, most):
                times.append(time), bodies.append(body.decode("utf-8", "replace"))
                size += length
                if size >= BATCH or len(times) >= RECORDS:
                    yield self._batch(partition.file, at, times, bodies)
                    at, times, bodies, size = at + len(times), [], [], 0
            yield self._batch(partition.file, at, times, bodies)
        finally:
            close()

    def _batch(self, file: str, at: int, times: list[int], bodies: list[str]) -> pa.RecordBatch:
        columns = [pa.array([file] * len(times), pa.string()), pa.array(range(at, at + len(times)), pa.int64()), pa.array(times, pa.int64()), pa.array(bodies, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["file", "at", "millis", "value"])


class ReplaySource(DataSource):
    """``format("replay")``; options: ``path``; ``index``, a folder that ``index`` wrote; ``least`` and ``most``: times outside which ranges needn't be read."""

    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ReplayReader:
        return ReplayReader(self.options)


def replay(spark: SparkSession, path: str, index: str | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    """file, at (the record's number in its file), millis and value of the records of replay files; without an index a task reads a file.

    ``least`` and ``most``: records outside these times are left out, and ranges that have no other aren't read. (Conditions
    aren't pushed into the source by themselves: a plan that has them would share its partitions with one that hasn't.)
    """
    spark.dataSource.register(ReplaySource)
    source = spark.read.format("replay")
    for name, value in (("index", index), ("least", least), ("most", most)):
        source = source if value is None else source.option(name, str(value))
    rows = source.load(path)
    rows = rows if least is None else rows.where(F.col("millis") >= least)
    return rows if most is None else rows.where(F.col("millis") <= most)


def write(rows: DataFrame, path: str) -> int:
    """Writes millis and value as replay files, one for each partition that has rows, in the rows' order; returns the number of records."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, base = _opened(path)
        name = f"{base}/part-{context.partitionId():05d}.jlv"
        part, n, out = f"{name}.{context.taskAttemptId()}", 0, None
        for batch in batches:
            if out is None and len(batch):
                system.create_dir(base, recursive=True)
                out = system.open_output_stream(part)
            for time, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = (value or "").encode()
                out.write(framed(time or 0, body))
                n += 1
        if out is not None:
            out.close()
            system.move(part, name)  # whole, or not there; an attempt more writes the same
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return sum(r.n for r in rows.select("millis", "value").mapInArrow(work, "n long").collect())
