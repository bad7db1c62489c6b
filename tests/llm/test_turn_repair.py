"""Conversation repair against a search over all edits, with odd rows and long conversations."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from vigilstream.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, copies long, matrix string"
TEXTS = [None, "", " \n\t", "Well.", "Well", "Why? ", "No!\n", "é…", "a.b", "\x1c", ". x", "Well."]
ROLES = ["user", "assistant", "system", "tool", "", None, "User", "union"]


def after_damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """rows: (role, text, fault). The least (cost, audit, said), by Dijkstra's search over place and role initials' state."""
    moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, said = heapq.heappop(heap)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit, said
        for c, name in (("u", "user"), ("a", "assistant")):
            if c in moves[state]:
                heapq.heappush(heap, (cost + 2, audit + "I", at, c, (*said, f"{name}:")))
        if at == len(rows):
            continue
        role, text, fault = rows[at]
        heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, said))
        if fault in ("", "truncated"):
            more = fault == "truncated"
            if role[:1] in moves[state]:
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[:1], (*said, f"{role}:{text}")))
            for c, name in (("u", "user"), ("a", "assistant")):
                if c in moves[state]:
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, c, (*said, f"{name}:{text}")))
    raise AssertionError


def brute(rows):
    left, out = after_damage(rows), []
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in left if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            solid = re.sub(r"[\x20\x09-\x0D]+", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {t for t, *_ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, said = cheapest([(r, t, f) for (_, r, t), f in zip(own, faults, strict=True)])
        digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return out


def conversations(seed, n):
    rnd = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        usual = rnd.random() < 0.5
        for turn in range(rnd.randrange(1, 9)):
            role = ROLES[turn % 2] if usual and rnd.random() < 0.8 else rnd.choice(ROLES)
            at = None if rnd.random() < 0.05 else turn + (rnd.random() < 0.1) * 3
            rows += [(conv, at, role, rnd.choice(TEXTS) if rnd.random() < 0.5 else f"Text {rnd.random()}.", None, "x")] * rnd.choice([1, 1, 1, 1, 2, 3])
    rows += [(7, t, ("user", "assistant")[t % 2], f"{t % 11}{'.' * (t % 3)}", None, None) for t in range(300)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [3, 512])
def test_against_search(spark, monkeypatch, block):
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    rows = conversations(block, 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = turn_repair.repair(turn_repair.damaged(df)).collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, brute(rows)))


def test_repeats_by_join_are_the_same(spark, monkeypatch):
    rows = conversations(1, 20)
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(turn_repair, "HELD", 0)
    found = turn_repair.repair(turn_repair.damaged(df)).collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, brute(rows)))


def test_turns_hash_to_the_summary(spark):
    df = spark.createDataFrame(conversations(2, 30), SCHEMA)
    rows = turn_repair.damaged(df)
    said = {}
    for r in turn_repair.repaired_turns(rows).orderBy("conv_id", "position").collect():
        said.setdefault(r.conv_id, []).append(r)
    for r in turn_repair.repair(rows).collect():
        own = said.get(r.conv_id, [])
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in own).encode()).hexdigest() == r.repaired_sha256
        assert [x.position for x in own] == list(range(1, len(own) + 1))
        assert "".join(x.edit for x in own) == r.audit.replace("D", "")


def test_copies_are_counted_and_empty_tables_are_empty(spark):
    many = spark.range(20_000).selectExpr("1L AS conv_id", "1L AS turn", "'user' AS role", "'Hi.' AS text", "1L AS copies")
    r = turn_repair.repair(many).first()
    assert (r.duplicate, r.illegal, r.cost, r.audit) == (19_999, 19_999, 3 * 19_999 + 2, "K" + "D" * 19_999 + "I")
    assert turn_repair.repair(many.where("conv_id = 2")).collect() == []
