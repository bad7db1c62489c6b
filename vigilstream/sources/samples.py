"""Packets made for tests and queries: one flow, sample, frame or answer each, from a row with addresses and a port."""

from __future__ import annotations

import ipaddress
import struct


def _ip(text: str) -> bytes:
    return ipaddress.ip_address(text).packed


def netflow5(row: dict) -> bytes:
    head = struct.pack(">HHIIIIBBH", 5, 1, 1000, 1_700_000_000, 0, row["seq_num"] & 0xFFFFFFFF, 0, 1, 0)
    return head + _ip(row["src_ip"]) + _ip(row["dst_ip"]) + bytes(4) + struct.pack(">HHIIIIHHBBBBHHBBH", 1, 2, 3, row["bytes"] & 0xFFFFFFFF, 10, 20, 1024, row["dst_port"], 0, 2, 6, 0, 64512, 64513, 8, 24, 0)


def templated(row: dict, version: int) -> bytes:
    """A packet of one flow; every 25th has the template before it."""
    fields = ((8, 4), (12, 4), (1, 4), (11, 2))
    template = b""
    if row["seq_num"] % 25 == 0:
        body = struct.pack(">HH", 256, len(fields)) + b"".join(struct.pack(">HH", *f) for f in fields)
        template = struct.pack(">HH", 0 if version == 9 else 2, 4 + len(body)) + body
    data = _ip(row["src_ip"]) + _ip(row["dst_ip"]) + struct.pack(">IH", row["bytes"] & 0xFFFFFFFF, row["dst_port"])
    body = template + struct.pack(">HH", 256, 4 + len(data)) + data
    if version == 9:
        return struct.pack(">HHIIII", 9, 1, 1000, 1_700_000_000, row["seq_num"] & 0xFFFFFFFF, 1) + body
    return struct.pack(">HHIII", 10, 16 + len(body), 1_700_000_000, row["seq_num"] & 0xFFFFFFFF, 1) + body


def frame(row: dict) -> bytes:
    payload = b"hello"
    udp = struct.pack(">HHHH", 1024, row["dst_port"], 8 + len(payload), 0) + payload
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(udp), 0, 0, 64, 17, 0) + _ip(row["src_ip"]) + _ip(row["dst_ip"])
    return bytes.fromhex("020000000001020000000002") + struct.pack(">H", 0x0800) + ip + udp


def _element(tag: int, body: bytes) -> bytes:
    return struct.pack(">II", tag, len(body)) + body


def _text(x: str) -> bytes:
    raw = x.encode()
    return struct.pack(">I", len(raw)) + raw + bytes(-len(raw) % 4)


def sflow5(row: dict) -> bytes:
    raw = frame(row)
    header = struct.pack(">IIII", 1, len(raw) + 4, 4, len(raw)) + raw
    url = struct.pack(">I", 1) + _text(f"http://{row['dst_ip']}/") + _text("host.example.com")
    elements = _element(1, header) + _element(1005, url) + _element(2200, b"skip")
    sample = struct.pack(">IIIIIIII", row["seq_num"] & 0xFFFFFFFF, 1, 512, 1024, 0, 3, 4, 3) + elements
    return struct.pack(">II", 5, 1) + _ip("192.0.2.1") + struct.pack(">IIII", 0, row["seq_num"] & 0xFFFFFFFF, 5000, 1) + _element(1, sample)


def dns_reply(row: dict) -> bytes:
    name = b"\x03www\x07example\x03com\x00"
    question = name + struct.pack(">HH", 1, 1)
    answer = b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + _ip(row["dst_ip"])
    return struct.pack(">HHHHHH", 1, 0x8180, 1, 1, 0, 0) + question + answer
