"""Logs as streams."""

from __future__ import annotations

import datetime
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.logs import level_rank

#: Setting and value: the state store that keeps lists and timers.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def level_counts(lines: DataFrame, late: str = "1 hour", window: str = "1 hour", least: str = "DEBUG") -> DataFrame:
    """Counts by level and window of event time, for lines of at least a level; lines later than ``late`` do not count."""
    own = lines.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", late).where(level_rank(F.col("level")) >= level_rank(F.lit(least)))
    return own.groupBy(F.window("time", window).alias("w"), "level").agg(F.count("*").alias("n")).select("level", F.col("w.start").alias("hour"), "n")


class _Spans(StatefulProcessor):
    """Events of a span wait until the watermark has passed them, and are then followed in their order."""

    def __init__(self, forget_us: int | None) -> None:
        self.forget_us = forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, nth long, tag string")
        self.open = handle.getValueState("open", "opened long, messages long")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int) -> None:
        """One timer is enough: the earliest."""
        if not self.timer.exists() or at < self.timer.get()[0]:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        events = [(r["us"], r["event_id"], r["tag"]) for r in rows]
        self.waiting.appendList(events)
        self._wake(min(e[0] for e in events) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        events = sorted(tuple(e) for e in self.waiting.get()) if self.waiting.exists() else []
        opened, count = self.open.get() if self.open.exists() else (None, 0)
        done = bisect_right(events, until, key=lambda e: e[0])
        for ts, _, tag in events[:done]:
            if opened is not None and self._old(opened, ts):
                opened = None
            if tag == "open":
                opened, count = ts, 0
            elif tag == "close" and opened is not None:
                yield Row(span=key[0], opened=opened, closed=ts, messages=count)
                opened = None
            elif opened is not None:
                count += 1
        if opened is not None and self._old(opened, until):
            opened = None
        if events[done:]:
            self.waiting.put(events[done:])
            self._wake(events[done][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if opened is None:
            self.open.clear()
        else:
            self.open.update((opened, count))
            if self.forget_us is not None:
                self._wake((opened + self.forget_us) // 1000 + 1)

    def _old(self, opened: int, now: int) -> bool:
        return self.forget_us is not None and now - opened > self.forget_us


def span_durations(lines: DataFrame, late: str = "1 hour", forget: datetime.timedelta | None = None) -> DataFrame:
    """span, opened, closed, messages of spans when they close, by event time: the same rows for any batches and any order of arrival.

    An event waits until the watermark, which is ``late`` behind the latest event, has passed it; events that
    come later than that are left out, as are those without a time or span. A second opening starts a span
    anew; of equal times the smaller event_id comes first. State is what waits, and one open span for each
    key; spans that are open for longer than ``forget`` are dropped. A stream that ends keeps its last events
    waiting until a later one comes. The session needs the state store of transformWithState (STATE_STORE).
    """
    own = lines.select("span", "event_id", "tag", F.col("ts").cast("timestamp").alias("ts")).where("span is not null and ts is not null").withWatermark("ts", late)
    own = own.withColumn("us", F.unix_micros("ts"))
    forget_us = None if forget is None else forget // datetime.timedelta(microseconds=1)
    out = own.groupBy("span").transformWithState(_Spans(forget_us), "span long, opened long, closed long, messages long", "Append", "EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("opened", "closed")})


def file_changes(before: str, out: str):
    """A function for foreachBatch: states of files (archive, rel_path, state) that differ from the table at ``before`` are appended to ``out``, and become the table."""
    from ..operators.states import changes

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{before}/{epoch}") if epoch else spark.createDataFrame([], "archive string, rel_path string, state int")
        now = batch.groupBy("archive", "rel_path").agg(F.max("state").alias("state"))
        rest = old.join(now, ["archive", "rel_path"], "left_anti")
        changes(old.join(now, ["archive", "rel_path"], "left_semi"), now).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        rest.unionByName(now).write.mode("overwrite").parquet(f"{before}/{epoch + 1}")

    return apply
