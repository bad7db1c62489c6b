"""NetFlow versions 1, 5, 7, 9 and 10."""

from __future__ import annotations

import ipaddress
import struct
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vigilstream.operators.asof import as_of
from vigilstream.schema import FLOW, FLOW_SET
from vigilstream.sources.frames import decoded
from vigilstream.storage import kept

#: Header and record bytes, and most records, of the fixed versions.
FIXED = {1: (16, 52, 24), 5: (24, 48, 30), 7: (24, 52, 30)}
#: Field numbers of templates, and the column that each fills.
FIELDS = {
    1: "bytes", 2: "packets", 4: "protocol", 5: "tos", 6: "tcp_flags", 7: "src_port", 8: "src_ip", 9: "src_mask", 10: "if_in",
    11: "dst_port", 12: "dst_ip", 13: "dst_mask", 14: "if_out", 15: "gateway_ip", 16: "src_as", 17: "dst_as", 21: "flow_finish",
    22: "flow_start", 27: "src_ip", 28: "dst_ip", 29: "src_mask", 30: "dst_mask", 38: "engine_type", 39: "engine_id", 62: "gateway_ip",
}
#: Templates, sources and templates a source that an exporter may have; the one longest unused goes.
SOURCES, TEMPLATES = 64, 8
#: Bytes of a template at most.
TEMPLATE_BYTES = 1024


def _ip(raw: bytes) -> str:
    return str(ipaddress.ip_address(raw))


def fixed(data: bytes) -> list[dict]:
    """Flows of version 1, 5 or 7; none if the number of flows or the length isn't what the version says."""
    if len(data) < 16:
        return []
    version, count = struct.unpack_from(">HH", data)
    if version not in FIXED:
        return []
    head, size, most = FIXED[version]
    if not 1 <= count <= most or len(data) != head + count * size:
        return []
    uptime, secs, nsecs = struct.unpack_from(">III", data, 4)
    base = {"version": version, "sys_uptime_ms": uptime, "unix_secs": secs, "unix_nsecs": nsecs}
    if version != 1:
        base["flow_sequence"] = struct.unpack_from(">I", data, 16)[0]
    if version == 5:
        base["engine_type"], base["engine_id"] = data[20], data[21]
    out = []
    for k in range(count):
        r = data[head + k * size : head + (k + 1) * size]
        flow = dict(zip(("if_in", "if_out", "packets", "bytes", "flow_start", "flow_finish", "src_port", "dst_port"), struct.unpack_from(">HHIIIIHH", r, 12), strict=True))
        flow |= {"src_ip": _ip(r[:4]), "dst_ip": _ip(r[4:8]), "gateway_ip": _ip(r[8:12])}
        if version == 1:
            flow |= {"protocol": r[38], "tos": r[39], "tcp_flags": r[40]}
        else:
            flow |= {"tcp_flags": r[37], "protocol": r[38], "tos": r[39]}
            flow["src_as"], flow["dst_as"] = struct.unpack_from(">HH", r, 40)
            flow["src_mask"], flow["dst_mask"] = r[44], r[45]
        out.append(base | flow)
    return out


def fixed_flows(df: DataFrame, keys: tuple[str, ...], raw: str = "payload") -> DataFrame:
    return decoded(df, keys, raw, FLOW, lambda x: fixed(bytes(x)))


class Templates:
    """An exporter's templates by source and number, the longest unused leaving first."""

    def __init__(self, known: dict | None = None):
        self.known: OrderedDict[int, OrderedDict[int, list[tuple[int, int]]]] = OrderedDict()
        for source, templates in (known or {}).items():
            self.known[source] = OrderedDict(templates)

    def put(self, source: int, number: int, fields: list[tuple[int, int]]) -> None:
        of = self.known.setdefault(source, OrderedDict())
        self.known.move_to_end(source)
        of[number] = fields
        of.move_to_end(number)
        if len(of) > TEMPLATES:
            of.popitem(last=False)
        if len(self.known) > SOURCES:
            self.known.popitem(last=False)

    def get(self, source: int, number: int) -> list[tuple[int, int]] | None:
        found = self.known.get(source, {}).get(number)
        if found is not None:
            self.known.move_to_end(source)
            self.known[source].move_to_end(number)
        return found


def _opened(data: bytes) -> tuple[bytes, int, dict] | None:
    """The packet's bytes, where its first set is, and what its header says; nothing where it is no version 9 or 10."""
    if len(data) < 16 or (version := int.from_bytes(data[:2], "big")) not in (9, 10):
        return None
    if version == 9:
        if len(data) < 20:
            return None
        _, _, uptime, secs, sequence, source = struct.unpack_from(">HHIIII", data)
        at, base = 20, {"sys_uptime_ms": uptime}
    else:
        _, length, secs, sequence, source = struct.unpack_from(">HHIII", data)
        data, at, base = data[:length], 16, {}
    return data, at, base | {"version": version, "unix_secs": secs, "flow_sequence": sequence, "source_id": source}


def templated(data: bytes, templates: Templates, stats: dict[str, int]) -> list[dict]:
    """Flows of a version 9 or 10 packet; templates in it are taken in first come, data without template are counted."""
    if len(data) < 16 or int.from_bytes(data[:2], "big") not in (9, 10):
        return []
    stats["packets"] = stats.get("packets", 0) + 1
    opened = _opened(data)
    if opened is None:
        return []
    data, at, base = opened
    version, source, out = base["version"], base["source_id"], []
    while at + 4 <= len(data):
        kind, size = struct.unpack_from(">HH", data, at)
        if size < 4 or at + size > len(data):
            stats["invalid"] = stats.get("invalid", 0) + 1
            break
        body = data[at + 4 : at + size]
        if kind == (0 if version == 9 else 2):
            _take_templates(body, source, templates, stats, version)
        elif kind >= 256:
            fields = templates.get(source, kind)
            if fields is None:
                stats["no_template"] = stats.get("no_template", 0) + 1
            else:
                length = sum(n for _, n in fields)
                for k in range(len(body) // length if length else 0):
                    out.append(base | _record(body[k * length : (k + 1) * length], fields))
        at += size
    stats["flows"] = stats.get("flows", 0) + len(out)
    return out


def _take_templates(body: bytes, source: int, templates: Templates, stats: dict[str, int], version: int) -> None:
    at = 0
    while at + 4 <= len(body):
        number, count = struct.unpack_from(">HH", body, at)
        at += 4
        fields, good = [], number >= 256 and count > 0
        for _ in range(count):
            if at + 4 > len(body):
                good = False
                break
            kind, size = struct.unpack_from(">HH", body, at)
            at += 4
            if version == 10 and kind & 0x8000:  # the enterprise's own number follows
                kind, at = -1, at + 4
            width = {"src_ip": (4, 16), "dst_ip": (4, 16), "gateway_ip": (4, 16)}.get(FIELDS.get(kind))
            good &= size in width if width else kind not in FIELDS or size <= 8
            fields.append((kind, size))
        if good and sum(n for _, n in fields) <= TEMPLATE_BYTES:
            templates.put(source, number, fields)
        else:
            stats["invalid"] = stats.get("invalid", 0) + 1


#: The greatest number of a column.
_MOST = {f.name: (1 << 31) - 1 if isinstance(f.dataType, T.IntegerType) else (1 << 63) - 1 for f in FLOW.fields}


def _record(raw: bytes, fields: list[tuple[int, int]]) -> dict:
    """A flow's columns; a number that its column can't hold is null."""
    out, at = {}, 0
    for kind, size in fields:
        value, name = raw[at : at + size], FIELDS.get(kind)
        if name:
            if name.endswith("_ip"):
                out[name] = _ip(value)
            else:
                number = int.from_bytes(value, "big")
                out[name] = number if number <= _MOST[name] else None
        at += size
    return out


#: Numbers of a queue that lie together in a slice of the as-of join.
SLICE = 4096


def _written(fields: list[tuple[int, int]]) -> str:
    return ",".join(f"{k}:{n}" for k, n in fields)


def _read(fields: str) -> list[tuple[int, int]]:
    return [tuple(map(int, f.split(":"))) for f in fields.split(",")]


class _Sets(Templates):
    """Takes a packet's templates down in the order in which they come."""

    def __init__(self) -> None:
        super().__init__()
        self.taken: list[tuple[int, int, list[tuple[int, int]]]] = []

    def put(self, source: int, number: int, fields: list[tuple[int, int]]) -> None:
        self.taken.append((source, number, fields))


def packet_sets(data: bytes) -> Iterator[dict]:
    """The sets of a version 9 or 10 packet; what is no valid template is left out."""
    opened = _opened(data)
    if opened is None:
        return
    data, at, base = opened
    pos = 0
    while at + 4 <= len(data):
        kind, size = struct.unpack_from(">HH", data, at)
        if size < 4 or at + size > len(data):
            return
        head = {"source": base["source_id"], **{k: base.get(k) for k in ("version", "sys_uptime_ms", "unix_secs", "flow_sequence")}}
        if kind == (0 if base["version"] == 9 else 2):
            found = _Sets()
            _take_templates(data[at + 4 : at + size], base["source_id"], found, {}, base["version"])
            for _, number, fields in found.taken:
                yield {**head, "pos": pos, "number": number, "kind": 0, "fields": _written(fields)}
                pos += 1
        elif kind >= 256:
            yield {**head, "pos": pos, "number": kind, "kind": 1, "body": data[at + 4 : at + size]}
            pos += 1
        at += size


def templated_flows(df: DataFrame, exporter: str = "exporter", order: str = "seq_num", raw: str = "payload") -> DataFrame:
    """Flows of all exporters' packets, by the templates that came before them.

    Sets of data are joined with the last template of their exporter, source and number before them, in slices of the
    order, so that one exporter's packets are many tasks'. An exporter with more sources or templates than it may have
    loses the one longest unused, which depends on all before: its packets are walked through by one task.
    """
    fields = T.StructType([T.StructField("seq_num", T.LongType()), *FLOW.fields])
    rows = df.select(F.col(exporter).cast("string").alias("exporter"), F.col(order).cast("long").alias("seq_num"), F.col(raw).cast("binary").alias("payload")).where("payload IS NOT NULL")
    sets = kept(_sets(rows), "sets")
    many = sets.where("kind = 0").groupBy("exporter", "source").agg(F.count_distinct("number").alias("n")).groupBy("exporter").agg(F.max("n").alias("n"), F.count("*").alias("sources"))
    many = many.where((F.col("n") > TEMPLATES) | (F.col("sources") > SOURCES)).select(F.col("exporter").alias("of"))
    own = F.col("exporter").eqNullSafe(F.col("of"))
    few = sets.join(many, own, "left_anti")
    met = as_of(few.where("kind = 1").drop("fields"), few.where("kind = 0"), ("exporter", "source", "number"), ("seq_num", "pos"), F.expr(f"floor(seq_num / {SLICE})").cast("long"), F.col("fields"), "fields")
    return _flows(met.where("fields IS NOT NULL"), fields).unionByName(_in_order(rows.join(many, own, "left_semi"), fields))


def _sets(rows: DataFrame) -> DataFrame:
    shape = to_arrow_schema(FLOW_SET)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{**x, "exporter": r["exporter"], "seq_num": r["seq_num"]} for r in batch.to_pylist() for x in packet_sets(r["payload"])]
            yield pa.RecordBatch.from_pylist(found, schema=shape)

    return rows.mapInArrow(work, FLOW_SET)


def _flows(sets: DataFrame, fields: T.StructType) -> DataFrame:
    """The flows of sets of data with their template's fields."""
    shape = to_arrow_schema(fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                template, body = _read(r["fields"]), r["body"]
                length = sum(n for _, n in template)
                base = {k: r[k] for k in ("exporter", "seq_num", "version", "sys_uptime_ms", "unix_secs", "flow_sequence")} | {"source_id": r["source"]}
                out += [base | _record(body[k : k + length], template) for k in range(0, len(body) - length + 1, length) if length]
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    return sets.mapInArrow(work, fields)


def _in_order(rows: DataFrame, fields: T.StructType) -> DataFrame:
    """Flows of exporters each of whose packets are one task's, in order."""
    shape = to_arrow_schema(fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, templates = None, Templates()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["exporter"] != who:
                    who, templates = r["exporter"], Templates()
                out += [{**f, "exporter": who, "seq_num": r["seq_num"]} for f in templated(r["payload"], templates, {})]
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    return rows.repartition("exporter").sortWithinPartitions("exporter", "seq_num").mapInArrow(work, fields)


def exporter_stats(df: DataFrame, exporter: str = "exporter", order: str = "seq_num", raw: str = "payload") -> DataFrame:
    """Per exporter: packets, flows, invalid and no_template."""
    names = ("packets", "flows", "invalid", "no_template")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, dict[str, int]] = {}
        kept: dict[str, Templates] = {}
        for batch in batches:
            for name, data in zip(batch["exporter"], batch["payload"], strict=True):
                if data is not None:
                    templated(bytes(data), kept.setdefault(name, Templates()), found.setdefault(name, {}))
        yield pd.DataFrame([[k, *(v.get(n, 0) for n in names)] for k, v in found.items()], columns=["exporter", *names])

    rows = df.select(F.col(exporter).alias("exporter"), F.col(order).alias("seq_num"), F.col(raw).alias("payload"))
    dealt = rows.repartition("exporter").sortWithinPartitions("exporter", "seq_num")
    return dealt.mapInPandas(work, "exporter string, packets long, flows long, invalid long, no_template long")


def same_family(flows: DataFrame) -> DataFrame:
    """Flows whose ends are of one address family."""
    return flows.where(F.col("src_ip").contains(":") == F.col("dst_ip").contains(":"))
