"""All statements over one scan: as a table against each statement by itself, and as a stream against the table."""

import random

import pytest
from pyspark.sql import functions as F

from vigilstream.functions import keys
from vigilstream.operators import counting, windows
from vigilstream.plans import fixture
from vigilstream.plans.statements import Registry, Statement, standard
from vigilstream.streaming import runner
from vigilstream.streaming.batchlog import BatchLog

SIZE = "5 minutes"
FIELDS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events over an hour from an odd second on, with two gaps, repeated numbers and times, in three files of rising times."""
    path = tmp_path_factory.mktemp("statements")
    kinds = ("view", "click", "signup", "purchase", "error")
    rows = [(k, 1_704_067_213 + k * 9 + (k > 120) * 1500 + (k > 250) * 900 - k % 2 * 4, k * 13 % 40, kinds[k % 5], k / 3, f'{{"k": {k % 29}}}') for k in range(400)]
    rows += rows[50:60]
    table = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string")
    table = table.select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type", "value", "props")
    for lo, hi in ((0, 130), (130, 260), (260, 400)):
        table.where(f"event_id >= {lo} AND event_id < {hi}").coalesce(1).write.mode("append").parquet(str(path / "events.parquet"))
    return path


@pytest.fixture(scope="module")
def events(spark, folder):
    return keys.with_connection(fixture.log_messages(spark, str(folder))).persist()


def stream(spark, folder):
    return keys.with_connection(fixture.as_log_messages(spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).parquet(str(folder / "events.parquet"))))


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.fixture(scope="module")
def together(events):
    return counting.all_tops(events, SIZE, 3, start=windows.first_event(events, SIZE)).persist()


@pytest.mark.parametrize("name", [r.name for r in windows.RANKINGS])
def test_a_ranking_is_that_by_itself(events, together, name):
    r = next(r for r in windows.RANKINGS if r.name == name)
    alone = windows.top(events, r, SIZE, 3, start=windows.first_event(events, SIZE))
    protocol = F.col("ip_protocol").cast("int") if len(r.keys) == 2 else F.lit(None).cast("int")
    alone = alone.select("window_start", F.col("rank").cast("int"), F.col(r.keys[-1]).cast("string"), protocol, "scount")
    assert rows_of(together.where(F.col("statement") == name).select("window_start", "rank", "key", "protocol", "scount")) == rows_of(alone)


def test_the_rate_is_that_by_itself(events, together):
    alone = windows.rate(events, SIZE, start=windows.first_event(events, SIZE)).select("window_start", "scount", "rate")
    assert rows_of(together.where("statement = 'rate'").select("window_start", "scount", "rate")) == rows_of(alone)
    assert alone.where("scount = 0").count() > 3


def test_one_scan(events, folder, spark):
    table = keys.with_connection(fixture.log_messages(spark, str(folder)))
    plan = counting.all_tops(table, SIZE)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("FileScan") == 1


def test_source_ports_by_a_walk(spark):
    """Ties in time and number, null numbers, several protocols, seconds and windows."""
    rnd = random.Random(4)
    rows = [(rnd.choice([None, 1, 2, 3]), 1_700_000_000_000_000 + rnd.randrange(200) * 500_000, rnd.choice([1, 6, 17]), rnd.choice([7, 7, 7, 9]), False) for _ in range(600)]
    df = spark.createDataFrame(rows, "seq_num long, us long, ip_protocol int, src_port int, self boolean").withColumn("event_time", F.expr("timestamp_micros(us)"))
    ranking = windows.RANKINGS[-1]
    want = {}
    for _, us, p, port, _ in rows:
        w = us // 60_000_000 * 60
        place = lambda r: (r[1], r[0] is not None, r[0] or 0)
        mine = [r for r in rows if r[1] // 60_000_000 * 60 == w and r[3] == port]
        last = max(place(r) for r in mine if r[2] == p)
        want[w, p, port] = sum(place(r) <= last for r in mine)
    got = {(r.window_start, r.ip_protocol, r.src_port): r.scount for r in windows.counts(df, ranking).collect()}
    assert got == want


def test_events_without_a_time_and_none_at_all(spark, events):
    odd = events.limit(5).withColumn("event_time", F.lit(None).cast(events.schema["event_time"].dataType))
    assert counting.all_tops(odd, SIZE).collect() == []
    assert rows_of(counting.all_tops(events.union(odd), SIZE)) == rows_of(counting.all_tops(events, SIZE))


def test_all_as_one_stream(spark, folder, events, tmp_path):
    start = windows.first_event(events, SIZE)
    got = []
    query = runner.start_all(stream(spark, folder), lambda rows, n: got.extend(map(str, (tuple(r) for r in rows.collect()))), str(tmp_path / "state"), size=SIZE, n=3, available_now=True, start=start)
    query.awaitTermination(300)
    assert query.exception() is None
    want = counting.all_tops(events, SIZE, 3, start=start)
    last = want.agg(F.max("window_start")).first()[0]  # is open still
    assert sorted(got) == rows_of(want.where(F.col("window_start") < last)) and len(query.recentProgress[0].sources) == 1


def test_ports_and_rate_as_streams(spark, folder, events, tmp_path):
    start = windows.first_event(events, SIZE)
    last = windows.rate(events, SIZE, start=start).agg(F.max("window_start")).first()[0]
    for name, df, want in (
        ("ports", runner.stream_ports(stream(spark, folder), SIZE, "1 minute", start=start), windows.counts(events, windows.RANKINGS[-1], SIZE, start=start).select("window_start", "ip_protocol", "src_port", "scount")),
        ("rates", runner.stream_rate(stream(spark, folder), SIZE, start=start), windows.rate(events, SIZE, start=start)),
    ):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
        assert rows_of(spark.table(name)) == rows_of(want.where(F.col("window_start") < last)), name


def test_running_counts_end_at_the_counts(spark, folder, events, tmp_path):
    ranking = next(r for r in windows.RANKINGS if r.name == "dst_ip")
    seen = {}
    counts = []

    def each(batch, number):
        for r in batch.collect():
            assert r.scount >= seen.get((r.window_start, r.dst_ip), 0)
            seen[r.window_start, r.dst_ip] = r.scount
            counts.append(number)

    query = runner.running_counts(stream(spark, folder), ranking, SIZE, "1 hour").writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert seen == {(r.window_start, r.dst_ip): r.scount for r in windows.counts(events, ranking, SIZE).collect()} and len(set(counts)) == 3


def test_registry(spark, events):
    r = standard(SIZE, 3)
    names = [s.name for s in r.order()]
    assert len(names) == 38 and all(names.index(s.reads) < names.index(s.name) for s in r.order() if s.reads)
    assert rows_of(r.build("dst_ip_top", events)) == rows_of(windows.top(events, next(x for x in windows.RANKINGS if x.name == "dst_ip"), SIZE, 3))
    with pytest.raises(ValueError):
        r.remove("dst_ip_sum")
    r.remove("dst_ip_top")
    counted, single = r.deploy(events, SIZE, 3)
    assert {x.statement for x in counted.select("statement").distinct().collect()} == {x.name for x in windows.RANKINGS if x.name != "dst_ip"} | {"rate"}
    assert list(single) == ["correlation"] and single["correlation"].count() > 0
    loop = Registry()
    loop.add(Statement("a", lambda df: df, reads="b"))
    with pytest.raises(ValueError):
        list(loop.order())
    loop.add(Statement("b", lambda df: df, reads="a"))
    with pytest.raises(ValueError):
        list(loop.order())


def test_batch_log(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "log"))
    assert log.before(0) == {} and not log.has(0)
    log.commit(0, last=5)
    log.commit(1, last=9)
    log.commit(1, last=8)
    assert BatchLog(spark, str(tmp_path / "log")).before(1) == {"last": 5} and log.before(2) == {"last": 8} and log.has(1) and log.numbers() == [0, 1]
