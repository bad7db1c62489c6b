"""Statements over streams, and stateful processors.

Rankings can't be made on a stream itself, so windows are counted in the stream and ranked batch by batch, when the
watermark has closed them. Everything that keeps state does so by key, in the state store, with an expiry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from vigilstream.operators import counting, windows
from vigilstream.sources.events import length_frames, line_frames
from vigilstream.sources.flows import Templates, templated
from vigilstream.streaming.batchlog import BatchLog

#: Milliseconds after which an unused socket's or exporter's state goes.
EXPIRY = 600_000


def stream_rows(events: DataFrame, rankings: tuple[windows.Ranking, ...], rate: bool = True, size: str = windows.WINDOW, delay: str = "0 seconds", time: str = "event_time", start: str = "0 seconds") -> DataFrame:
    """``counting.counted`` of a stream: the counts of a window, given out when the watermark passes its end.

    State is a count for each window, statement and key that is open; of source ports, for each event too, as they are
    put in order when the window is over.
    """
    events = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", delay)
    return counting.counted(counting.laid_out(events, rankings, rate, size, "__t", start))


def stream_counts(events: DataFrame, ranking: windows.Ranking, size: str = windows.WINDOW, delay: str = "0 seconds", time: str = "event_time", start: str = "0 seconds") -> DataFrame:
    """``windows.counts`` of a stream, given out when the watermark passes a window's end. Source ports are counted with ``stream_ports``."""
    if ranking.name == "src_port":
        return stream_ports(events, size, delay, time, start)
    events = windows.chosen(events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", delay), ranking)
    window = F.window("__t", size, startTime=start).alias("w")
    begin = F.unix_seconds("w.start").alias("window_start")
    out = events.groupBy(window, *ranking.keys).agg(F.count("*").alias("scount")).select(begin, *ranking.keys, "scount")
    return out.withColumn(ranking.keys[0], F.expr(ranking.shown)) if ranking.shown else out


def running_counts(events: DataFrame, ranking: windows.Ranking, size: str = windows.WINDOW, delay: str = "0 seconds", time: str = "event_time", start: str = "0 seconds") -> DataFrame:
    """The counts so far of open windows, as each trigger leaves them: for a query in update mode."""
    events = windows.chosen(events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", delay), ranking)
    out = events.groupBy(F.window("__t", size, startTime=start).alias("w"), *ranking.keys).agg(F.count("*").alias("scount"))
    out = out.select(F.unix_seconds("w.start").alias("window_start"), *ranking.keys, "scount")
    return out.withColumn(ranking.keys[0], F.expr(ranking.shown)) if ranking.shown else out


class PortCounts(StatefulProcessor):
    """A port's count over all protocols, as of each protocol's last event, in one window.

    State is the count so far and, for each protocol, the count as of its last event. Events wait until the watermark has
    passed them, so they are counted in order; no more wait than came since.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "n long")
        self.as_of = handle.getMapState("as_of", "protocol long", "n long")
        self.waiting = handle.getListState("waiting", "t long, seq_num long, protocol long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for batch in rows:
            # Events of one protocol at one place are one entry.
            new = batch.groupby(["t", "seq_num", "protocol"], as_index=False, dropna=False).size()
            new = [(int(t), None if pd.isna(s) else int(s), int(p), int(n)) for t, s, p, n in new.itertuples(index=False)]
            if new:
                self.waiting.appendList(new)
                last = max(last or new[0][0], max(t for t, *_ in new))
        if last is not None:
            self.handle.registerTimer(last // 1000 + 1)
            self.handle.registerTimer(int(key[2]))
        yield self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))

    def _advance(self, key, watermark: int) -> pd.DataFrame:
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1] is not None, r[1] or 0)) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] < watermark * 1000]
        if ready:
            total, at = self.total.get()[0] if self.total.exists() else 0, 0
            while at < len(ready):
                # Events at the same place count as of the last of them.
                to = at
                while to < len(ready) and ready[to][:2] == ready[at][:2]:
                    total += ready[to][3]
                    to += 1
                for r in ready[at:to]:
                    self.as_of.updateValue((r[2],), (total,))
                at = to
            self.total.update((total,))
            left = rows[len(ready) :]
            if left:
                self.waiting.put([tuple(r) for r in left])
            else:
                self.waiting.clear()
        out = []
        if watermark >= int(key[2]) and self.total.exists():
            out = [[key[0], p, key[1], n] for (p,), (n,) in self.as_of.iterator()]
            self.total.clear(), self.as_of.clear()
        return pd.DataFrame(out, columns=["window_start", "ip_protocol", "src_port", "scount"])

    def close(self) -> None:
        pass


def stream_ports(events: DataFrame, size: str = windows.WINDOW, delay: str = "0 seconds", time: str = "event_time", start: str = "0 seconds") -> DataFrame:
    """The source-port counts of a stream, with a bounded state for each port; given out when the watermark passes a window's end."""
    ranking = next(r for r in windows.RANKINGS if r.name == "src_port")
    schema = events.schema
    events = windows.chosen(events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", delay), ranking)
    rows = events.select("__t", F.window("__t", size, startTime=start).alias("w"), F.col("src_port").cast("long").alias("port"), F.unix_micros("__t").alias("t"), "seq_num", F.col("ip_protocol").cast("long").alias("protocol"))
    rows = rows.select("__t", F.unix_seconds("w.start").alias("window_start"), "port", F.unix_millis("w.end").alias("ends"), "t", "seq_num", "protocol")
    found = "window_start long, ip_protocol long, src_port long, scount long"
    out = rows.groupBy("window_start", "port", "ends").transformWithStateInPandas(PortCounts(), found, "append", "eventTime")
    return out.select("window_start", F.col("ip_protocol").cast(schema["ip_protocol"].dataType), F.col("src_port").cast(schema["src_port"].dataType), "scount")


def start_top(events: DataFrame, ranking: windows.Ranking, sink: Callable[[DataFrame, int], None], checkpoint: str, size: str = windows.WINDOW, delay: str = "0 seconds", n: int = 10, available_now: bool = False, start: str = "0 seconds") -> StreamingQuery:
    """Starts a ranking; ``sink`` gets the ranked rows of each batch's closed windows."""

    def each(batch: DataFrame, number: int) -> None:
        sink(windows.ranked(batch, ranking.keys, n), number)

    writer = stream_counts(events, ranking, size, delay, start=start).writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_all(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, rankings: tuple[windows.Ranking, ...] = windows.RANKINGS, size: str = windows.WINDOW, delay: str = "0 seconds", n: int = 10, available_now: bool = False, start: str = "0 seconds") -> StreamingQuery:
    """Starts all rankings and the rate as one query, which reads its source once; ``sink`` gets the rows of ``counting.all_tops``.

    Each batch's closed windows are ranked together. The last window of the rate is kept in the checkpoint's folder, so that
    windows without an event are told by the batch that closes the next one.
    """
    log = BatchLog(events.sparkSession, f"{checkpoint}/rates")

    def each(batch: DataFrame, number: int) -> None:
        counts = counting.finished(batch).persist()
        try:
            last = log.before(number).get("window_start")
            rate = F.col("statement") == counting.RATE
            newest = counts.where(rate).agg(F.max("window_start")).first()[0]
            rows = counting.ranked(counts, n)
            if last is not None and newest is not None:
                # The window before stands for itself while gaps are filled, and goes then: it was told by its own batch.
                known = counts.sparkSession.createDataFrame([(counting.RATE, last, None, None, None, 0)], rows.schema)
                rows = counting.with_rates(rows.union(known), size).where(~rate | (F.col("window_start") > last))
            else:
                rows = counting.with_rates(rows, size)
            sink(rows, number)
            log.commit(number, window_start=newest if newest is not None else last)
        finally:
            counts.unpersist()

    writer = stream_rows(events, rankings, True, size, delay, start=start).writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class Gaps(StatefulProcessor):
    """Adds the windows without an event between two that have some; state is the last window."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "window_start long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, out = self.last.get()[0] if self.last.exists() else None, []
        for start, n in sorted((int(s), int(n)) for b in rows for s, n in b[["window_start", "scount"]].itertuples(index=False)):
            if last is not None:
                out += [(w, 0) for w in range(last + int(key[0]), start, int(key[0]))]
            out.append((start, n))
            last = start
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["window_start", "scount"])

    def close(self) -> None:
        pass


def stream_rate(events: DataFrame, size: str = windows.WINDOW, delay: str = "0 seconds", time: str = "event_time", start: str = "0 seconds", empty: bool = True) -> DataFrame:
    """``windows.rate`` of a stream; windows without an event are told when the next one with some is closed."""
    events = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", delay)
    if not empty:
        return windows.rate(events, size, "__t", False, start)
    seconds = int(windows.size_seconds(size))
    counts = events.groupBy(F.window("__t", size, startTime=start).alias("w")).agg(F.count("*").alias("scount"))
    # One row a window goes on, so that one task can see all of them.
    rows = counts.select(F.lit(seconds).cast("long").alias("seconds"), F.unix_seconds("w.start").alias("window_start"), "scount")
    out = rows.groupBy("seconds").transformWithStateInPandas(Gaps(), "window_start long, scount long", "append", "none")
    window_ms = F.lit(seconds * 1000).cast("long")
    return out.select("window_start", window_ms.alias("window_ms"), "scount", (F.col("scount") / F.lit(float(seconds))).alias("rate"))


FOUND = StructType([StructField("key", StringType()), StructField("window_start", LongType()), StructField("first_event", StringType()), StructField("last_event", StringType()), StructField("repeat_count", LongType())])


class Correlation(StatefulProcessor):
    """One open window a key: the first event opens it, the next one beyond its end opens another.

    Events wait until the watermark has passed them, so that they are taken in order however they come; what comes later
    than the watermark is dropped by Spark. An open window is given out when the watermark has passed its end.
    """

    def __init__(self, seconds: int = 60):
        self.millis = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start long, first string, last string, n long")
        self.waiting = handle.getListState("waiting", "t long, seq_num long, event string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for batch in rows:
            new = [(int(t), int(s), e) for t, s, e in batch[["t", "seq_num", "event"]].itertuples(index=False)]
            if new:
                self.waiting.appendList(new)
                last = max(last or 0, max(t for t, *_ in new))
        if last is not None:
            self.handle.registerTimer(last + 1)
        yield self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))

    def _advance(self, key, watermark: int) -> pd.DataFrame:
        """Takes what has waited for the watermark, in order."""
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        now, out = list(self.open.get()) if self.open.exists() else None, []
        ready = [r for r in rows if r[0] < watermark]
        for t, _, event in ready:
            if now is not None and t < now[0] + self.millis:
                now[2], now[3] = event, now[3] + 1
                continue
            if now is not None:
                out.append([key[0], *now])
            now = [t, event, event, 1]
        if now is not None and now[0] + self.millis <= watermark:
            out.append([key[0], *now])
            now = None
        if ready:
            left = rows[len(ready) :]
            if left:
                self.waiting.put([tuple(r) for r in left])
            else:
                self.waiting.clear()
        if now is not None:
            self.open.update(tuple(now))
            self.handle.registerTimer(now[0] + self.millis)
        else:
            self.open.clear()
        return pd.DataFrame(out, columns=FOUND.names)

    def close(self) -> None:
        pass


def stream_correlation(events: DataFrame, seconds: int = 60, key: str = "ip_hash_key", delay: str = "0 seconds", time: str = "event_time") -> DataFrame:
    """``correlation.correlation`` of a stream; the first and last event are JSON."""
    rows = events.where(~F.coalesce(F.col("self"), F.lit(False))).where(F.col(key).isNotNull())
    event = F.to_json(F.struct(*[F.col(c) for c in events.columns])).alias("event")
    rows = rows.select(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("__t"), F.unix_millis(F.col(time).cast("timestamp")).alias("t"), "seq_num", event)
    return rows.withWatermark("__t", delay).groupBy("key").transformWithStateInPandas(Correlation(seconds), FOUND, "append", "eventTime")


class TcpLines(StatefulProcessor):
    """Lines, or framed records, of a socket's segments in the order of their numbers, however triggers bring them.

    Segments that come before their time wait for the ones between: by ``number``, each follows the one numbered one less; by
    ``bytes``, each begins where the one before ends, and what was had already is cut off. A gap is waited for ``wait``
    milliseconds after the last segment behind it has come; then the next segment that is there goes on, as in a batch that
    never had the missing one, and the missing one is too late. Where ``first`` is not given, a socket begins with the least
    number of its first trigger. What a line lacks is kept, at most ten minutes.
    """

    def __init__(self, frames: Callable[[bytes, bytes], tuple[list[bytes], bytes]] = line_frames, by: str = "number", first: int | None = None, wait: int = 5_000):
        if by not in ("number", "bytes"):
            raise ValueError(f"segments are in order by number or bytes, not {by}")
        self.frames, self.by, self.first, self.wait = frames, by, first, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carry = handle.getValueState("carry", StructType([StructField("data", BinaryType())]), ttlDurationMs=EXPIRY)
        self.next = handle.getValueState("next", "number long", ttlDurationMs=EXPIRY)
        self.waiting = handle.getMapState("waiting", "number long", StructType([StructField("data", BinaryType())]), ttlDurationMs=EXPIRY)
        self.due = handle.getValueState("due", "millis long", ttlDurationMs=EXPIRY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = {}
        for batch in rows:
            for number, data in batch[["seq_num", "payload"]].itertuples(index=False):
                number, data = int(number), bytes(data)
                if len(data) >= len(new.get(number, b"")):
                    new[number] = data
        if self.next.exists():
            expected = self.next.get()[0]
        else:
            expected = min(new, default=0) if self.first is None else self.first
        for (number,), (data,) in self.waiting.iterator():
            if number not in new or len(data) > len(new[number]):
                new[number] = bytes(data)
        yield self._taken(key, new, expected, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = {number: bytes(data) for (number,), (data,) in self.waiting.iterator()}
        if held and self.due.exists() and self.due.get()[0] <= now:
            yield self._taken(key, held, min(held), now)
        else:
            yield pd.DataFrame([], columns=["socket", "message"])

    def _taken(self, key, held: dict[int, bytes], expected: int, now: int) -> pd.DataFrame:
        """Takes the segments that follow each other, and keeps those beyond the gap."""
        carry = bytes(self.carry.get()[0]) if self.carry.exists() else b""
        out = []
        for number in sorted(held):
            data = held[number]
            if number > expected:
                break
            if self.by == "number":
                if number < expected:  # was there, or is too late
                    continue
                expected = number + 1
            else:
                data = data[expected - number :]
                expected += len(data)
            lines, carry = self.frames(carry, data)
            out += [[key[0], x.decode("utf-8", "replace")] for x in lines]
        left = {n: d for n, d in held.items() if n >= expected}
        for (number,), _ in list(self.waiting.iterator()):
            if number not in left:
                self.waiting.removeKey((number,))
        for number, data in left.items():
            self.waiting.updateValue((number,), (data,))
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        if left:
            self.due.update((now + self.wait,))
            self.handle.registerTimer(now + self.wait)
        else:
            self.due.clear()
        self.next.update((expected,))
        self.carry.update((carry,))
        return pd.DataFrame(out, columns=["socket", "message"])

    def close(self) -> None:
        pass


def stream_tcp_lines(segments: DataFrame, by: str = "number", first: int | None = None, wait: int = 5_000) -> DataFrame:
    """socket and message of the lines in segments (socket, seq_num, payload)."""
    return segments.groupBy("socket").transformWithStateInPandas(TcpLines(line_frames, by, first, wait), "socket string, message string", "append", "processingTime")


def stream_records(segments: DataFrame, by: str = "number", first: int | None = None, wait: int = 5_000) -> DataFrame:
    """socket and message of the records, each after its length, in segments (socket, seq_num, payload)."""
    return segments.groupBy("socket").transformWithStateInPandas(TcpLines(length_frames, by, first, wait), "socket string, message string", "append", "processingTime")


class Exporter(StatefulProcessor):
    """Flows of an exporter's packets; its templates are state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("templates", "source long, number long", "fields string", ttlDurationMs=EXPIRY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for (source, number), (fields,) in self.known.iterator():
            known.setdefault(source, {})[number] = [tuple(map(int, f.split(":"))) for f in fields.split(",")]
        templates = Templates(known)
        out = []
        for at, data in pd.concat(list(rows)).sort_values("seq_num")[["seq_num", "payload"]].itertuples(index=False):
            for f in templated(bytes(data), templates, {}):
                out.append([key[0], int(at), f["version"], f.get("src_ip"), f.get("dst_ip"), f.get("bytes"), f.get("packets")])
        for source, of in templates.known.items():
            for number, fields in of.items():
                self.known.updateValue((source, number), (",".join(f"{k}:{n}" for k, n in fields),))
        yield pd.DataFrame(out, columns=["exporter", "seq_num", "version", "src_ip", "dst_ip", "bytes", "packets"])

    def close(self) -> None:
        pass


def stream_flows(packets: DataFrame) -> DataFrame:
    """Flows of a stream of packets (exporter, seq_num, payload)."""
    schema = "exporter string, seq_num long, version int, src_ip string, dst_ip string, bytes long, packets long"
    return packets.groupBy("exporter").transformWithStateInPandas(Exporter(), schema, "append", "processingTime")
