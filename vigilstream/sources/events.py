"""Events from JSON, from replay files, and from streams; syslog lines; configuration files."""

from __future__ import annotations

import gzip
import json
import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilstream.functions.times import flow_millis, millis, sys_millis
from vigilstream.schema import WIRE

#: Bytes after which an unfinished line is given out.
CARRY = 4096
#: Bytes of a framed record at most.
RECORD = 1 << 20


def json_events(raw: DataFrame, value: str = "value", time: Column | None = None) -> DataFrame:
    """Events of JSON records, with property names; ``bad`` is true for what is none. The record's own time isn't used.

    ``time``: the event's time; by default that of its arrival.
    """
    x = F.from_json(F.col(value), WIRE, {"mode": "PERMISSIVE"})
    rows = raw.withColumn("__x", x).withColumn("bad", F.col("__x").isNull() | F.to_json("__x").isin("{}"))
    c = lambda name: F.col(f"__x.{name}")
    number = lambda name: F.coalesce(c(name), F.lit(0))
    fields = {
        "event_time": F.current_timestamp() if time is None else time,
        "sensor_name": c("sensor"), "port_id": number("port_id"), "source": F.lower(c("source")), "self": F.coalesce(F.lower(c("self")).isin("1", "true"), F.lit(False)),
        "seq_num": number("seq_num"), "agent_ip": F.coalesce(c("agentip"), c("agent_ip")), "bytes": number("bytes"), "packets": number("packets"),
        "dst_ip": c("dip"), "src_ip": c("sip"), "direction": F.lower(c("direction")), "dst_mac": c("dmac"), "src_mac": c("smac"), "dns_name": c("dns_name"),
        "dst_port": number("dport"), "src_port": number("sport"), "dst_asn": number("dst_as"), "src_asn": number("src_as"), "eth_type": number("eth_type"),
        "ip_protocol": number("ip_protocol"), "ip_ttl": F.coalesce(c("ip_ttl"), c("ttl"), F.lit(0)), "tcp_flags": number("tcp_flags"), "gateway_ip": c("gatewayip"),
        "ioc_id": number("ioc_id"), "ioc_file_id": number("file_id"), "ioc_type": F.lower(c("type")), "ioc_threat_type": c("threat_type"), "ioc_value": c("value"),
        "ioc_ip": c("ip"), "ioc_dns": c("dns"), "length": number("length"), "l4_length": number("l4_length"), "message": c("message"), "tag": number("tag"),
        "flow_millis": flow_millis(number("flow_sec"), number("flow_usec")), "flow_start": millis(number("flow_start_sec"), number("flow_start_msec")),
        "flow_stop": millis(number("flow_stop_sec"), number("flow_stop_msec")), "sys_time": sys_millis(number("sys_time_sec"), number("sys_time_nsec")),
        "sys_uptime": millis(number("sys_uptime_sec"), number("sys_uptime_msec")),
    }
    return rows.select("bad", *[v.alias(k) for k, v in fields.items()])


def lv_records(data: bytes) -> Iterator[tuple[int, str]]:
    """Milliseconds and text of a replay file's records (length and milliseconds in little-endian order); what is cut short ends it."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at + 12 <= len(data):
        size, time = struct.unpack_from("<iq", data, at)
        if size < 0 or at + 12 + size > len(data):
            return
        yield time, data[at + 12 : at + 12 + size].decode("utf-8", "replace")
        at += 12 + size


def lv_scan(spark: SparkSession, path: str) -> DataFrame:
    """file, at, millis and value of the records of all replay files (``.jlv``, ``.jlv.gz``) below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jlv,jlv.gz}").load(path)
    return lv_decode(files.select(F.col("path").alias("file"), F.col("content").alias("raw")))


def lv_decode(files: DataFrame) -> DataFrame:
    """The records of files given as rows of ``file`` and ``raw``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(lv_records(raw.as_py() or b""))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array([t for t, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.string())], ["file", "at", "millis", "value"])

    return files.select("file", "raw").mapInArrow(work, "file string, at long, millis long, value string")


def lv_frame(time: Column, text: Column) -> Column:
    """A replay record as bytes, for writing."""
    little = lambda n, size: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(n), 2 * size, "0"), 2 * k + 1, 2) for k in reversed(range(size))]))
    body = text.cast("binary")
    return F.concat(little(F.length(body).cast("long"), 4), little(time, 8), body)


def stream(spark: SparkSession, kind: str, path: str = "", **options: str) -> DataFrame:
    """A stream of ``value`` records: a folder of JSON lines (``files``), a socket (``socket``), or any named format (``kafka``)."""
    if kind == "files":
        return spark.readStream.format("text").options(**options).load(path)
    if kind in ("socket", "kafka", "rate"):
        return spark.readStream.format(kind).options(**options).load()
    raise ValueError(f"unknown input type {kind}")


def source(spark: SparkSession, kind: str, path: str = "", **options: str) -> DataFrame:
    """Events of an input: ``lv_file`` (replay, with recorded times), ``queue`` (Kafka), ``socket``, or ``files``."""
    if kind == "lv_file":
        return json_events(lv_scan(spark, path), time=F.timestamp_millis("millis"))
    if kind == "queue":
        kind = "kafka"
    raw = stream(spark, kind, path, **options)
    return json_events(raw.select(F.col("value").cast("string").alias("value")))


def syslog_udp(datagrams: DataFrame, payload: str = "payload") -> DataFrame:
    """Each datagram that the sensor itself gets is one message."""
    return datagrams.where("self").withColumn("message", F.col(payload).cast("string"))


def line_frames(carry: bytes, data: bytes) -> tuple[list[bytes], bytes]:
    """Lines that a socket's bytes end, and what is left; what grows beyond ``CARRY`` bytes is given out unfinished."""
    parts = (carry + data).split(b"\n")
    out, rest = [p for p in parts[:-1] if p], parts[-1]
    while len(rest) >= CARRY:
        out.append(rest[:CARRY])
        rest = rest[CARRY:]
    return out, rest


def length_frames(carry: bytes, data: bytes) -> tuple[list[bytes], bytes]:
    """Records of a stream socket that bytes end (each after its length in four bytes, the smallest first), and what is left.

    A length that is negative or above ``RECORD`` can't be one; the connection's bytes mean nothing from there on and are dropped.
    """
    data, out, at = carry + data, [], 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "little", signed=True)
        if not 0 <= size <= RECORD:
            return out, b""
        if at + 4 + size > len(data):
            break
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out, data[at:]


def framed_records(segments: DataFrame, socket: str = "socket", order: str = "seq_num", payload: str = "payload") -> DataFrame:
    """socket, at and message of the records in each socket's segments, by ``length_frames``."""
    return _framed(segments, length_frames, socket, order, payload)


def syslog_tcp(segments: DataFrame, socket: str = "socket", order: str = "seq_num", payload: str = "payload") -> DataFrame:
    """socket, at and message of the lines of each socket's segments, in order; a last line without end is left out."""
    return _framed(segments, line_frames, socket, order, payload)


def _framed(segments: DataFrame, frames: Callable[[bytes, bytes], tuple[list[bytes], bytes]], socket: str, order: str, payload: str) -> DataFrame:

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, carry, at = None, b"", 0
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name != who:
                    who, carry, at = name, b"", 0
                lines, carry = frames(carry, data or b"")
                for x in lines:
                    rows.append((name, at, x.decode("utf-8", "replace")))
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["socket", "at", "message"])

    rows = segments.select(F.col(socket).cast("string").alias("socket"), F.col(order).alias("at"), F.col(payload).cast("binary").alias("payload"))
    return rows.repartition("socket").sortWithinPartitions("socket", "at").mapInArrow(work, "socket string, at long, message string")


_COMMENT = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', re.S)
_COMMA = re.compile(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', re.S)


def read_config(text: str) -> dict:
    """A configuration: JSON with comments and commas before closing brackets."""
    keep = lambda m: m[1] or ""
    return json.loads(_COMMA.sub(keep, _COMMENT.sub(keep, text)))
