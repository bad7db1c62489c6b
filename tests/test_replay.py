"""Replay files in ranges against the records that were written."""

import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from vigilstream.sources import events, replay


def record(time, body):
    return struct.pack("<iq", len(body), time) + body


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """A plain file, a compressed one in a folder below, an empty one, one cut short, one with a wrong length, and something else."""
    rnd = random.Random(6)
    path = tmp_path_factory.mktemp("replay")
    want = []

    def rows(name, n):
        out = [(1000 + k * 10 - rnd.randrange(30), ("x" * rnd.choice([0, 3, 50, 4000]) + f"é{k}").encode()) for k in range(n)]
        want.extend((name, k, t, b.decode()) for k, (t, b) in enumerate(out))
        return b"".join(record(*r) for r in out)

    (path / "below").mkdir()
    (path / "a.jlv").write_bytes(rows("a.jlv", 500))
    (path / "below" / "b.jlv.gz").write_bytes(gzip.compress(rows("b.jlv.gz", 200)))
    (path / "empty.jlv").write_bytes(b"")
    (path / "short.jlv").write_bytes(rows("short.jlv", 20) + record(5, b"y" * 100)[:-1])
    (path / "wrong.jlv").write_bytes(rows("wrong.jlv", 3) + struct.pack("<iq", -1, 7) + record(8, b"z"))
    (path / "other.txt").write_bytes(record(1, b"no"))
    return path, sorted(want)


def told(df):
    return sorted((r.file.rsplit("/", 1)[-1], r.at, r.millis, r.value) for r in df.collect())


@pytest.mark.parametrize("size", [1, 5000, 1 << 30])
def test_ranges_give_all_records(spark, folder, tmp_path, size):
    path, want = folder
    found = replay.index(spark, str(path), str(tmp_path / "index"), size)
    df = replay.replay(spark, str(path), str(tmp_path / "index"))
    assert told(df) == want
    assert df.rdd.getNumPartitions() == found.count()
    assert found.where("file LIKE '%a.jlv'").count() == {1: 500, 1 << 30: 1}.get(size, found.where("file LIKE '%a.jlv'").count())
    assert found.where("file LIKE '%.gz'").count() == 1 and found.agg(F.sum("records")).first()[0] == len(want)


def test_without_an_index_and_by_uri(spark, folder):
    path, want = folder
    assert told(replay.replay(spark, f"file://{path}")) == want
    assert told(replay.replay(spark, str(path / "a.jlv"))) == [w for w in want if w[0] == "a.jlv"]
    assert sorted((t, v) for _, _, t, v in want) == sorted((r.millis, r.value) for r in events.lv_scan(spark, str(path)).collect())


def test_times_leave_ranges_out(spark, folder, tmp_path):
    path, want = folder
    replay.index(spark, str(path), str(tmp_path / "index"), 2000)
    df = replay.replay(spark, str(path), str(tmp_path / "index"))
    part = replay.replay(spark, str(path), str(tmp_path / "index"), 4000, 4999)
    assert told(part) == [w for w in want if 4000 <= w[2] < 5000] and told(part)
    assert told(df.where("millis < 2000")) == [w for w in want if w[2] < 2000] and told(df) == want
    assert part.rdd.getNumPartitions() < df.rdd.getNumPartitions() / 3


def test_small_reads_and_batches(folder, monkeypatch):
    """Records longer than what is read at once, and heads that lie across two reads."""
    path, want = folder
    mine = [w[1:] for w in want if w[0] == "a.jlv"]
    for block in (1, 7, 13, 4096):
        monkeypatch.setattr(replay, "BLOCK", block)
        monkeypatch.setattr(replay, "RECORDS", 11)
        batches = list(replay.ReplayReader({"path": str(path)}).read(replay.Range(str(path / "a.jlv"))))
        assert [tuple(r.values())[1:] for b in batches for r in b.to_pylist()] == mine and max(len(b) for b in batches) == 11


def test_written_files_are_read_again(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id * 5 AS millis", "CASE WHEN id % 7 > 0 THEN concat('v', id) END AS value")
    assert replay.write(rows.repartitionByRange(4, "millis").sortWithinPartitions("millis"), str(tmp_path / "out")) == 1000
    got = told(replay.replay(spark, str(tmp_path / "out")))
    assert len({f for f, *_ in got}) == 4 and [(t, v) for _, _, t, v in got] == [(k * 5, f"v{k}" if k % 7 else "") for k in range(1000)]
