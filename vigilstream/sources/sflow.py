"""sFlow version 5 datagrams: samples, and the elements that fill an event; others are skipped by their length."""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Callable

from pyspark.sql import DataFrame

from vigilstream.schema import SFLOW
from vigilstream.sources.frames import decoded, layers, mac, network

#: Names of the generic interface counters, in their order, with their bytes.
GENERIC = (
    ("if_index", 4), ("if_type", 4), ("if_speed", 8), ("if_direction", 4), ("if_status", 4), ("in_octets", 8), ("in_ucast", 4),
    ("in_mcast", 4), ("in_bcast", 4), ("in_discards", 4), ("in_errors", 4), ("in_unknown", 4), ("out_octets", 8), ("out_ucast", 4),
    ("out_mcast", 4), ("out_bcast", 4), ("out_discards", 4), ("out_errors", 4), ("promiscuous", 4),
)


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def u32(self) -> int:
        return int.from_bytes(self.take(4), "big")

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def text(self) -> str:
        n = self.u32()
        out = self.take(n).decode("utf-8", "replace")
        self.take(-n % 4)
        return out

    def ip(self) -> str | None:
        kind = self.u32()
        return str(ipaddress.ip_address(self.take({1: 4, 2: 16}[kind]))) if kind in (1, 2) else None


def _header(r: Reader) -> dict:
    protocol, length, stripped = r.u32(), r.u32(), r.u32()
    raw = r.take(r.u32())
    out = {"packet_length": length, "stripped_length": stripped, "header_length": len(raw)}
    found = (layers(raw) or {}) if protocol == 1 else network(raw, 0x0800) if protocol == 11 else network(raw, 0x86DD) if protocol == 12 else {}
    return out | {k: v for k, v in found.items() if k in ("smac", "dmac", "eth_type", "sip", "dip", "ip_protocol", "ttl", "sport", "dport", "tcp_flags")}


def _ethernet(r: Reader) -> dict:
    length, src = r.u32(), mac(r.take(8)[:6])
    return {"packet_length": length, "smac": src, "dmac": mac(r.take(8)[:6]), "eth_type": r.u32()}


def _addresses(width: int) -> Callable[[Reader], dict]:
    def read(r: Reader) -> dict:
        length, protocol = r.u32(), r.u32()
        sip, dip = (str(ipaddress.ip_address(r.take(width))) for _ in range(2))
        return {"packet_length": length, "ip_protocol": protocol, "sip": sip, "dip": dip, "sport": r.u32(), "dport": r.u32(), "tcp_flags": r.u32()}

    return read


def _socket(width: int) -> Callable[[Reader], dict]:
    def read(r: Reader) -> dict:
        protocol = r.u32()
        sip, dip = (str(ipaddress.ip_address(r.take(width))) for _ in range(2))
        return {"ip_protocol": protocol, "sip": sip, "dip": dip, "sport": r.u32(), "dport": r.u32()}

    return read


def _switch(r: Reader) -> dict:
    rx, _, tx = r.u32(), r.u32(), r.u32()
    return {"rx_vlan": rx, "tx_vlan": tx}


def _user(r: Reader) -> dict:
    r.u32()
    src = r.text()
    r.u32()
    return {"src_user": src, "dst_user": r.text()}


def _url(r: Reader) -> dict:
    r.u32()
    return {"url": r.text(), "host": r.text()}


def _payload(r: Reader) -> dict:
    """A frame's payload without its radio header: logical link, then the network layer."""
    r.u32()
    raw = r.take(r.u32())
    if len(raw) < 8:
        return {}
    kind = int.from_bytes(raw[6:8], "big")
    return {k: v for k, v in network(raw[8:], kind).items() if k != "payload" and k not in ("family", "tos", "l4_length", "icmp_type", "icmp_code")}


#: Numbers of the flow elements that fill an event.
ELEMENTS: dict[int, Callable[[Reader], dict]] = {
    1: _header, 2: _ethernet, 3: _addresses(4), 4: _addresses(16), 1001: _switch, 1002: lambda r: {"next_hop": r.ip()}, 1004: _user,
    1005: _url, 1007: lambda r: {"natsip": r.ip(), "natdip": r.ip()}, 1013: _payload, 1020: lambda r: {"natsport": r.u32(), "natdport": r.u32()},
    1021: _ethernet, 1022: _ethernet, 1023: _addresses(4), 1024: _addresses(4), 1025: _addresses(16), 1026: _addresses(16),
    2100: _socket(4), 2101: _socket(16), 2102: _socket(4), 2103: _socket(16),
}
_AGGREGATION = 1016


def _flow(r: Reader, expanded: bool) -> dict:
    out: dict = {"sample_type": "flow", "sample_format": 3 if expanded else 1, "sample_seq_num": r.u32(), "skipped": []}
    if expanded:
        out["ds_type"], out["ds_index"] = r.u32(), r.u32()
    else:
        source = r.u32()
        out["ds_type"], out["ds_index"] = source >> 24, source & 0xFFFFFF
    out["sample_rate"], out["sample_pool"], out["drop_count"] = r.u32(), r.u32(), r.u32()
    if expanded:
        r.u32()
        out["input_port"] = r.u32()
        r.u32()
        out["output_port"] = r.u32()
    else:
        out["input_port"], out["output_port"] = r.u32(), r.u32()
    for _ in range(r.u32()):
        _element(r, out)
    return out


def _element(r: Reader, out: dict) -> None:
    """Elements share the sample's fields, so of two that fill one the last counts."""
    tag, body = r.u32(), Reader(r.take(r.u32()))
    if tag == _AGGREGATION:
        for _ in range(body.u32()):
            inner = _flow(body, False)
            out["skipped"] += inner.pop("skipped")
            out |= {k: v for k, v in inner.items() if k not in ("sample_type", "sample_format", "sample_seq_num", "ds_type", "ds_index", "sample_rate", "sample_pool", "drop_count")}
    elif tag in ELEMENTS:
        out |= ELEMENTS[tag](body)
    else:
        out["skipped"].append(f"{tag >> 12}:{tag & 0xFFF}")


def _counters(r: Reader, expanded: bool) -> dict:
    out: dict = {"sample_type": "counters", "sample_format": 4 if expanded else 2, "sample_seq_num": r.u32(), "skipped": [], "counters": []}
    if expanded:
        out["ds_type"], out["ds_index"] = r.u32(), r.u32()
    else:
        source = r.u32()
        out["ds_type"], out["ds_index"] = source >> 24, source & 0xFFFFFF
    for _ in range(r.u32()):
        tag, body = r.u32(), Reader(r.take(r.u32()))
        if tag == 1:
            out["counters"] += [(name, min(int.from_bytes(body.take(n), "big"), 2**63 - 1)) for name, n in GENERIC]
        else:
            out["skipped"].append(f"{tag >> 12}:{tag & 0xFFF}")
    return out


def samples(data: bytes) -> list[dict]:
    """The samples of a datagram, as far as it can be read."""
    r, out = Reader(data), []
    try:
        if r.u32() != 5:
            return []
        base = {"agent_ip": r.ip(), "agent_sub_id": r.u32(), "packet_seq_num": r.u32(), "sys_up_time": r.u32() / 1000.0}
        for _ in range(r.u32()):
            tag, body = r.u32(), Reader(r.take(r.u32()))
            if tag in (1, 3):
                out.append(base | _flow(body, tag == 3))
            elif tag in (2, 4):
                out.append(base | _counters(body, tag == 4))
    except (ValueError, struct.error, KeyError):
        pass
    return out


def sflow(df: DataFrame, keys: tuple[str, ...], raw: str = "payload") -> DataFrame:
    return decoded(df, keys, raw, SFLOW, lambda x: samples(bytes(x)))
