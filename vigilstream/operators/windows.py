"""Counts in fixed windows, rankings and rates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = "60 seconds"


@dataclass(frozen=True)
class Ranking:
    """What is counted: key columns, the condition on events, and whether the sensor's own events are left out."""

    name: str
    keys: tuple[str, ...]
    where: str
    not_self: bool
    shown: str | None = None


def _set(column: str) -> str:
    return f"{column} IS NOT NULL AND {column} <> ''"


def _nonzero(column: str) -> str:
    return f"coalesce({column}, 0) <> 0"


#: The rankings by one key; ``shown`` is how the key is written in a report.
RANKINGS = (
    Ranking("sensor_name", ("sensor_name",), _set("sensor_name"), False),
    Ranking("ioc_id", ("ioc_id",), _nonzero("ioc_id"), False),
    Ranking("ioc_type", ("ioc_type",), "ioc_type IS NOT NULL", False),
    Ranking("ioc_threat_type", ("ioc_threat_type",), _set("ioc_threat_type"), False),
    Ranking("ioc_value", ("ioc_value",), _set("ioc_value"), False),
    Ranking("ioc_ip", ("ioc_ip",), _set("ioc_ip"), False),
    Ranking("ioc_dns", ("ioc_dns",), _set("ioc_dns"), False),
    Ranking("hash_key", ("hash_key",), _set("hash_key"), True),
    Ranking("eth_type", ("eth_type",), _nonzero("eth_type"), True, "format_string('0x%04x', eth_type & 65535)"),
    Ranking("dst_mac", ("dst_mac",), _set("dst_mac"), True),
    Ranking("src_mac", ("src_mac",), _set("src_mac"), True),
    Ranking("dst_ip", ("dst_ip",), _set("dst_ip"), True),
    Ranking("src_ip", ("src_ip",), _set("src_ip"), True),
    Ranking("ip_protocol", ("ip_protocol",), _nonzero("ip_protocol"), True),
    Ranking("dst_asn", ("dst_asn",), _nonzero("dst_asn"), True),
    Ranking("src_asn", ("src_asn",), _nonzero("src_asn"), True),
    Ranking("dst_port", ("ip_protocol", "dst_port"), _nonzero("dst_port"), True),
    Ranking("src_port", ("ip_protocol", "src_port"), _nonzero("src_port"), True),
)


def first_event(events: DataFrame, size: str = WINDOW, time: str = "event_time") -> str:
    """The offset at which windows start that begin with the first event: a window's ``start``. Reads all events' times."""
    return offset(first_micros(events, time), size)


def first_micros(events: DataFrame, time: str = "event_time") -> int | None:
    """The least time in microseconds."""
    return events.agg(F.min(F.unix_micros(F.col(time).cast("timestamp")))).first()[0]


def offset(micros: int | None, size: str = WINDOW) -> str:
    """Where windows start that begin at a time, as a window's ``start``."""
    return f"{(micros or 0) % int(size_seconds(size) * 1_000_000)} microseconds"


def size_seconds(size: str) -> float:
    """Seconds of a window's size, as ``60 seconds`` or ``1 day``."""
    n, unit = size.split()
    return float(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def window_start(time: str, size: str, start: str = "0 seconds") -> Column:
    """The start of a tumbling window in seconds since 1970."""
    return F.unix_seconds(F.window(F.col(time).cast("timestamp"), size, startTime=start)["start"])


def chosen(events: DataFrame, ranking: Ranking) -> DataFrame:
    return events.where(ranking.where).where(~F.coalesce(F.col("self"), F.lit(False))) if ranking.not_self else events.where(ranking.where)


def counts(events: DataFrame, ranking: Ranking, size: str = WINDOW, time: str = "event_time", start: str = "0 seconds") -> DataFrame:
    """Events by window and key: window_start, the keys, scount. One shuffle, after map-side counts.

    ``start``: where windows start, as ``first_event`` tells it for windows that begin with the first event.

    The source-port ranking counts a port over all protocols, as of the last event that each protocol has of it.
    """
    events = chosen(events, ranking)
    start = window_start(time, size, start).alias("window_start")
    if ranking.name == "src_port":
        return _port_counts(events, start, time)
    out = events.select(start, *ranking.keys).groupBy("window_start", *ranking.keys).agg(F.count("*").alias("scount"))
    return out.withColumn(ranking.keys[0], F.expr(ranking.shown)) if ranking.shown else out


def _port_counts(events: DataFrame, start: Column, time: str) -> DataFrame:
    stamp = F.col(time).cast("timestamp")
    at = F.struct(F.unix_micros(stamp).alias("t"), "seq_num").alias("at")
    rows = events.select(start, "ip_protocol", "src_port", F.unix_seconds(stamp).alias("second"), at)
    rows = rows.groupBy("window_start", "ip_protocol", "src_port", "second", "at").agg(F.count("*").alias("n"))
    return as_of_last(rows, ["window_start", "src_port"], "ip_protocol").select("window_start", "ip_protocol", "src_port", "scount")


def as_of_last(rows: DataFrame, own: list[str], part: str) -> DataFrame:
    """``own``, ``part`` and scount: all of what ``own`` has, as of the last row of each ``part``.

    Rows have n events at ``at`` within ``second``; events at the same place count as of the last of them. Rows are put in
    order within seconds, and the seconds' sums run up, so that one key with a third of all rows is dealt by seconds. Rows
    without a second are counted as they are.
    """
    within = Window.partitionBy(*own, "second").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("so_far", F.sum("n").over(within)).groupBy(*own, part, "second").agg(F.max("so_far").alias("so_far"), F.sum("n").alias("n"))
    before = Window.partitionBy(*own).orderBy("second").rangeBetween(Window.unboundedPreceding, -1)
    earlier = F.when(F.col("second").isNull(), 0).otherwise(F.coalesce(F.sum("n").over(before), F.lit(0)))
    return rows.withColumn("scount", F.col("so_far") + earlier).groupBy(*own, part).agg(F.max("scount").alias("scount"))


def ranked(table: DataFrame, keys: tuple[str, ...], n: int = 10) -> DataFrame:
    """The n largest counts of each window; ties go to the smaller key."""
    by = Window.partitionBy("window_start").orderBy(F.desc("scount"), *keys)
    return table.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def top(events: DataFrame, ranking: Ranking, size: str = WINDOW, n: int = 10, time: str = "event_time", start: str = "0 seconds") -> DataFrame:
    return ranked(counts(events, ranking, size, time, start), ranking.keys, n)


def rate(events: DataFrame, size: str = WINDOW, time: str = "event_time", empty: bool = True, start: str = "0 seconds") -> DataFrame:
    """Events and events a second of each window, empty windows between the first and the last included."""
    t = F.col(time) if isinstance(events.schema[time].dataType, T.TimestampType) else F.col(time).cast("timestamp")
    out = events.groupBy(F.window(t, size, startTime=start).alias("w")).agg(F.count("*").alias("scount"))
    out = out.select(F.unix_seconds("w.start").alias("window_start"), (F.unix_millis("w.end") - F.unix_millis("w.start")).alias("window_ms"), "scount")
    if empty:
        span = out.agg(F.min("window_start").alias("a"), F.max("window_start").alias("b"), F.max("window_ms").alias("window_ms")).where("a is not null")
        every = span.select(F.explode(F.expr("sequence(a, b, window_ms div 1000)")).alias("window_start"), "window_ms")
        out = every.join(out.select("window_start", "scount"), "window_start", "left").withColumn("scount", F.coalesce("scount", F.lit(0).cast("long")))
    return out.withColumn("rate", F.col("scount") / (F.col("window_ms") / F.lit(1000.0)))


def tumbling(events: DataFrame, size: str = WINDOW, time: str = "event_time", start: str = "0 seconds") -> DataFrame:
    """Each event with the bounds of its window."""
    w = F.window(F.col(time).cast("timestamp"), size, startTime=start)
    return events.withColumn("w", w).withColumn("window_start", F.unix_seconds("w.start")).withColumn("window_end", F.unix_seconds("w.end")).drop("w")


def seq_gaps(events: DataFrame, queue: str = "sensor_name") -> DataFrame:
    """Where a sensor's sequence numbers jump: the number before, the number after, and how many are missing."""
    by = Window.partitionBy(queue).orderBy("seq_num")
    rows = events.select(queue, "seq_num", F.lag("seq_num").over(by).alias("previous"))
    return rows.where("seq_num - previous > 1").withColumn("missing", F.expr("seq_num - previous - 1"))


def queue_numbers(events: DataFrame, queue: str = "sensor_name", time: str = "event_time", order: str = "seq_num", out: str = "queue_num") -> DataFrame:
    """Events with a number within their queue, from 1, by time (nulls first) and ``order``.

    Numbers are given within minutes, and a queue's minutes follow each other, so that a queue with a third of all events is
    no task of its own. Events that are equal in both are numbered one after the other.
    """
    row = F.struct(*[F.col(c) for c in events.columns]).alias("row")
    rows = events.select(F.col(queue).alias("queue"), F.floor(F.col(time).cast("timestamp").cast("double") / 60).alias("minute"), F.col(time).alias("t"), F.col(order).alias("n"), row)
    at = F.row_number().over(Window.partitionBy("queue", "minute").orderBy("t", "n")).cast("long")
    so_far = Window.partitionBy("queue").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("queue", "minute").agg(F.count("*").alias("size")).select(F.col("queue").alias("of"), F.col("minute").alias("in"), F.coalesce(F.sum("size").over(so_far), F.lit(0)).alias("before"))
    met = rows.withColumn("at", at).join(before, F.col("queue").eqNullSafe(F.col("of")) & F.col("minute").eqNullSafe(F.col("in")))
    return met.select("row.*", (F.col("at") + F.col("before")).alias(out))
