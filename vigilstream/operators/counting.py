"""All rankings, and the rate, counted together: one scan, one aggregation by window, statement and key.

An event is laid out as one row for each statement that counts it, beside the window it lies in. Rows are counted by window,
statement and key, in part before the shuffle; the counts of all statements are then ranked at once. The same layout and
the same ranking serve a table and a stream.

The source-port ranking counts a port over all protocols, as of the last event that each protocol has of it. Its rows keep
the event's time and number, so that events can be put in order; they are ordered by port and second, and the seconds' sums
run up within the port, so a port with a third of all events is no task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vigilstream.operators.windows import RANKINGS, WINDOW, Ranking, as_of_last, size_seconds

#: The statement of the rate, beside those of the rankings.
RATE = "rate"
#: What rows are counted by. ``text`` or ``number`` is the key; ``at`` and ``second`` are of source ports alone.
KEYS = ("window", "statement", "text", "number", "protocol", "second", "at")


def _row(events: DataFrame, ranking: Ranking, time: str) -> Column:
    """What an event is to a ranking, null where it isn't counted."""
    key = ranking.keys[-1]
    is_text = isinstance(events.schema[key].dataType, StringType)
    none = F.lit(None)
    ordered = ranking.name == "src_port"
    stamp = F.col(time).cast("timestamp")
    row = F.struct(
        F.lit(ranking.name).alias("statement"),
        (F.col(key) if is_text else F.expr(ranking.shown) if ranking.shown else none).cast("string").alias("text"),
        (none if is_text else F.col(key)).cast("long").alias("number"),
        (F.col(ranking.keys[0]) if len(ranking.keys) == 2 else none).cast("int").alias("protocol"),
        (F.unix_seconds(stamp) if ordered else none).cast("long").alias("second"),
        (F.struct(F.unix_micros(stamp).alias("t"), F.col("seq_num").cast("long").alias("seq_num")) if ordered else none).cast("struct<t: bigint, seq_num: bigint>").alias("at"),
    )
    counted = F.expr(ranking.where)
    return F.when(counted & ~F.coalesce(F.col("self"), F.lit(False)) if ranking.not_self else counted, row)


def laid_out(events: DataFrame, rankings: tuple[Ranking, ...] = RANKINGS, rate: bool = True, size: str = WINDOW, time: str = "event_time", start: str = "0 seconds") -> DataFrame:
    """The columns of ``KEYS``: one row for each event and statement that counts it. Events without a time are in no window."""
    rows = [_row(events, r, time) for r in rankings]
    if rate:
        none = F.lit(None)
        names = (("text", "string"), ("number", "long"), ("protocol", "int"), ("second", "long"), ("at", "struct<t: bigint, seq_num: bigint>"))
        rows.append(F.struct(F.lit(RATE).alias("statement"), *[none.cast(kind).alias(name) for name, kind in names]))
    stamp = F.col(time) if events.schema[time].dataType.typeName() == "timestamp" else F.col(time).cast("timestamp")
    out = events.select(F.window(stamp, size, startTime=start).alias("window"), F.explode(F.array(*rows)).alias("row"))
    return out.where("row IS NOT NULL").select("window", "row.*")


def counted(rows: DataFrame) -> DataFrame:
    """Rows by ``KEYS``, and n."""
    return rows.groupBy(*KEYS).agg(F.count("*").alias("n"))


def finished(counts: DataFrame) -> DataFrame:
    """window_start, statement, text, number, protocol, scount: counts of keys; those of source ports are run up."""
    # The protocol is part of the key but for source ports, which run up over all protocols.
    rows = counts.withColumn("of_key", F.when(F.col("second").isNull(), F.col("protocol")))
    rows = as_of_last(rows, ["window", "statement", "text", "number", "of_key"], "protocol")
    return rows.select(F.unix_seconds("window.start").alias("window_start"), "statement", "text", "number", "protocol", "scount")


def ranked(counts: DataFrame, n: int = 10) -> DataFrame:
    """statement, window_start, rank, key, protocol, scount: the n largest counts of each ranking and window, ties to the smaller key; rates have neither rank nor key."""
    by = Window.partitionBy("statement", "window_start").orderBy(F.desc("scount"), "protocol", "text", "number")
    rows = counts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)
    rank = F.when(F.col("statement") != RATE, F.col("rank"))
    return rows.select("statement", "window_start", rank.alias("rank"), F.coalesce("text", F.col("number").cast("string")).alias("key"), "protocol", "scount")


def with_rates(rows: DataFrame, size: str = WINDOW, empty: bool = True) -> DataFrame:
    """``ranked``, with the rate of each window in events a second; windows without an event between two with some are added."""
    seconds = int(size_seconds(size))
    if empty:
        is_rate = F.col("statement") == RATE
        following = F.lead("window_start").over(Window.partitionBy("statement", F.when(~is_rate, F.struct("window_start", "rank"))).orderBy("window_start"))
        span = F.when(is_rate & F.col("next").isNotNull(), F.sequence("window_start", F.col("next") - 1, F.lit(seconds).cast("long"))).otherwise(F.array("window_start"))
        rows = rows.withColumn("next", following).withColumn("each", F.explode(span))
        rows = rows.withColumn("scount", F.when(F.col("each") == F.col("window_start"), F.col("scount")).otherwise(0)).withColumn("window_start", F.col("each")).drop("each", "next")
    return rows.withColumn("rate", F.when(F.col("statement") == RATE, F.col("scount") / F.lit(float(seconds))))


def all_tops(events: DataFrame, size: str = WINDOW, n: int = 10, time: str = "event_time", start: str = "0 seconds", rankings: tuple[Ranking, ...] = RANKINGS) -> DataFrame:
    """All rankings and the rate of a table of events: statement, window_start, rank, key, protocol, scount, rate."""
    return with_rates(ranked(finished(counted(laid_out(events, rankings, True, size, time, start))), n), size)
