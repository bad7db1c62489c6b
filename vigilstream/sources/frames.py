"""Ethernet frames, DNS messages, and what a datagram's port says it holds."""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vigilstream.functions import net
from vigilstream.schema import FRAME, MAX_ANSWERS

#: Destination ports of what is decoded.
UDP_PORTS = {53: "dns", 514: "syslog", 6343: "sflow", 2055: "netflow", 9995: "netflow", 9996: "netflow"}
TCP_PORTS = {514: "syslog", 601: "syslog", 53: "dns_logged", 2055: "netflow_logged"}
#: DNS record types that are kept.
RECORDS = {1: "A", 2: "NS", 5: "CNAME", 12: "PTR", 15: "MX", 28: "AAAA"}


def decoded(df: DataFrame, keys: tuple[str, ...], raw: str, schema: T.StructType, decode: Callable[[bytes], list[dict]]) -> DataFrame:
    """A row with the keys and the decoded fields for each record that ``decode`` finds in ``raw``; null and bad input gives none."""
    fields = T.StructType([*df.select(*keys).schema.fields, *schema.fields])
    shape = to_arrow_schema(fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                found = decode(row[raw]) if row[raw] is not None else []
                rows += [{**{k: row[k] for k in keys}, **x} for x in found]
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return df.select(*keys, raw).mapInArrow(work, fields)


def port_dispatch(protocol: Column, port: Column, both: Column | None = None) -> Column:
    """What a datagram holds by its destination port; ``both``: a source port that counts for DNS too."""
    out = F.when((protocol == 17) & port.isin(*UDP_PORTS), F.create_map(*[F.lit(x) for kv in UDP_PORTS.items() for x in kv])[port])
    out = out.when((protocol == 6) & port.isin(*TCP_PORTS), F.create_map(*[F.lit(x) for kv in TCP_PORTS.items() for x in kv])[port])
    return out if both is None else out.when((protocol == 17) & (both == 53), F.lit("dns"))


#: What only counts when it is sent to the sensor itself; name queries count wherever they go.
OWN_ONLY = ("syslog", "sflow", "netflow", "netflow_logged")


def is_self(address: Column, own: tuple[str, ...]) -> Column:
    """Whether an address is one of the sensor's own, of either family and however it is written."""
    wanted = [ipaddress.ip_address(a) for a in own]
    four, six = [str(a) for a in wanted if a.version == 4], [a.packed.hex() for a in wanted if a.version == 6]
    out = address.isin(*four) if four else F.lit(False)
    out = out | (address.contains(":") & net.ip_hex(address).isin(*six)) if six else out
    return F.coalesce(out, F.lit(False))


def guarded(datagrams: DataFrame, kind: str = "kind", own: str = "self") -> DataFrame:
    """Datagrams that are taken: what counts only for the sensor itself goes where ``self`` isn't true."""
    return datagrams.where(F.coalesce(F.col(own), F.lit(False)) | ~F.coalesce(F.col(kind).isin(*OWN_ONLY), F.lit(False)))


def mac(raw: bytes) -> str:
    return ":".join(f"{x:02x}" for x in raw)


def layers(data: bytes) -> dict | None:
    """Link, network and transport fields of a frame; None if it is cut short."""
    if len(data) < 14:
        return None
    out = {"dmac": mac(data[:6]), "smac": mac(data[6:12]), "eth_type": int.from_bytes(data[12:14], "big")}
    rest = data[14:]
    if out["eth_type"] in (0x8100, 0x88A8) and len(rest) >= 4:  # VLAN tag
        out["eth_type"], rest = int.from_bytes(rest[2:4], "big"), rest[4:]
    if out["eth_type"] in (0x0800, 0x86DD):
        out |= network(rest, out["eth_type"])
    return out


def network(data: bytes, eth_type: int) -> dict:
    if eth_type == 0x0800:
        if len(data) < 20 or data[0] >> 4 != 4 or (head := (data[0] & 15) * 4) < 20 or len(data) < head:
            return {}
        out = {"family": 4, "tos": data[1], "ttl": data[8], "ip_protocol": data[9], "sip": str(ipaddress.IPv4Address(data[12:16])), "dip": str(ipaddress.IPv4Address(data[16:20]))}
        total = min(len(data), max(head, int.from_bytes(data[2:4], "big")))
        rest = data[head:total]
    else:
        if len(data) < 40 or data[0] >> 4 != 6:
            return {}
        out = {"family": 6, "tos": (int.from_bytes(data[:2], "big") >> 4) & 255, "ttl": data[7], "ip_protocol": data[6], "sip": str(ipaddress.IPv6Address(data[8:24])), "dip": str(ipaddress.IPv6Address(data[24:40]))}
        rest = data[40 : 40 + int.from_bytes(data[4:6], "big")]
    out["l4_length"] = len(rest)
    return out | transport(rest, out["ip_protocol"])


def transport(data: bytes, protocol: int) -> dict:
    if protocol == 6 and len(data) >= 20:
        sport, dport = struct.unpack_from(">HH", data)
        return {"sport": sport, "dport": dport, "tcp_flags": data[13] & 0x3F, "payload": data[(data[12] >> 4) * 4 :]}
    if protocol == 17 and len(data) >= 8:
        sport, dport = struct.unpack_from(">HH", data)
        return {"sport": sport, "dport": dport, "payload": data[8:]}
    if protocol in (1, 58) and len(data) >= 2:
        return {"icmp_type": data[0], "icmp_code": data[1]}
    return {}


def frames(df: DataFrame, keys: tuple[str, ...], raw: str = "frame") -> DataFrame:
    return decoded(df, keys, raw, FRAME, lambda x: [found] if (found := layers(bytes(x))) else [])


def ipv4_check(version: Column, header: Column, total: Column, seen: Column) -> Column:
    """0, or why an IPv4 header is bad: too short (-1), another version (-3), its length (-4), the packet's length (-5)."""
    return F.when(seen < 20, -1).when(version != 4, -3).when((header < 20) | (header > seen), -4).when(total < header, -5).otherwise(0)


def _name(data: bytes, at: int) -> tuple[str, int]:
    """A name and where it ends; pointers are followed at most 64 times."""
    parts, end, jumps = [], None, 0
    while True:
        n = data[at]
        if n >= 0xC0:
            end = at + 2 if end is None else end
            at, jumps = int.from_bytes(data[at : at + 2], "big") & 0x3FFF, jumps + 1
            if jumps > 64:
                raise ValueError("names point at each other")
        elif n == 0:
            return ".".join(parts) + ".", at + 1 if end is None else end
        else:
            if at + 1 + n > len(data):
                raise IndexError
            parts.append(data[at + 1 : at + 1 + n].decode("ascii", "replace"))
            at += 1 + n


DNS = T.StructType([T.StructField("dns_name", T.StringType()), T.StructField("dns_answers", T.ArrayType(T.StructType([T.StructField(k, T.StringType()) for k in ("type", "name", "ip")])))])


def dns_message(data: bytes) -> list[dict]:
    """The first question's name and up to eight answers; kinds that aren't kept are EMPTY; none if the message is bad."""
    try:
        questions, answers = struct.unpack_from(">HH", data, 4)
        at, name = 12, None
        for k in range(questions):
            asked, at = _name(data, at)
            name, at = asked if k == 0 else name, at + 4
        found = []
        for _ in range(min(answers, MAX_ANSWERS)):
            _, at = _name(data, at)
            kind, _, _, size = struct.unpack_from(">HHIH", data, at)
            at += 10
            body = data[at : at + size]
            entry = {"type": RECORDS.get(kind, "EMPTY"), "name": None, "ip": None}
            if kind in (1, 28) and len(body) == (4 if kind == 1 else 16):
                entry["ip"] = str(ipaddress.ip_address(body))
            elif kind in (2, 5, 12, 15):
                entry["name"] = _name(data, at + 2 * (kind == 15))[0]
            found.append(entry)
            at += size
        return [{"dns_name": name, "dns_answers": found}]
    except (IndexError, struct.error, ValueError):
        return []


def dns(df: DataFrame, keys: tuple[str, ...], raw: str = "payload") -> DataFrame:
    return decoded(df, keys, raw, DNS, lambda x: dns_message(bytes(x)))


def answers(messages: DataFrame) -> DataFrame:
    """A row an answer, with its place."""
    return messages.select("*", F.posexplode(F.slice("dns_answers", 1, MAX_ANSWERS)).alias("answer_at", "answer")).drop("dns_answers").select("*", "answer.*").drop("answer")
