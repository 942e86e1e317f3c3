"""Sessions over a stream: runs of one label by event time, ended by a gap or by another label."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class Sessions(StatefulProcessor):
    """State of a key, one value: the first row of each frame that the watermark hasn't passed, the open session, and the next timer.

    A frame is due at its end, a session at the end of the last frame that could go on with it; the timer is for what is due
    first. At a timer all frames that the watermark has passed are met in order, so neither the order of rows nor that of
    timers matters. Every access to state is a call out of Python, so a key has a few a batch, not a few a frame.
    """

    def __init__(self, frame_s: int, gap: int):
        self.frame_ms, self.gap = frame_s * 1000, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        frames = "at array<long>, us array<long>, tie array<long>, label array<string>"
        self.state = handle.getValueState("state", f"{frames}, now string, start long, last long, n long, due long")

    def _read(self):
        """(waiting frames, open session, next timer)"""
        if (s := self.state.get()) is None:
            return {}, None, None
        waiting = {at: row for at, *row in zip(s[0], s[1], s[2], s[3], strict=True)}
        return waiting, None if s[7] is None else tuple(s[4:8]), s[8]

    def _write(self, waiting: dict, now: tuple | None, due: int | None) -> None:
        """Keeps the state, with a timer for what is due first if none is set for it."""
        ends = [*waiting, *([now[2] + self.gap] if now else [])]
        if not ends:
            self.state.clear()
            return
        first = (min(ends) + 1) * self.frame_ms
        if due is None or first < due:
            self.handle.registerTimer(first)
            due = first
        rows = sorted((at, *row) for at, row in waiting.items())
        self.state.update((*([r[i] for r in rows] for i in range(4)), *(now or (None,) * 4), due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting, now, due = self._read()
        for part in rows:
            for at, us, tie, label in zip(*(part[c].tolist() for c in ("at", "us", "tie", "label")), strict=True):
                held = waiting.get(at)
                if held is None or (us, tie) < (held[0], held[1]):
                    waiting[at] = [us, tie, None if pd.isna(label) else label]
        self._write(waiting, now, due)
        yield _rows([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen, done = timerValues.getCurrentWatermarkInMs() // self.frame_ms, []
        waiting, now, due = self._read()
        for at in sorted(x for x in waiting if x < seen):
            label = waiting.pop(at)[2]
            if label is None:
                continue
            if now and now[0] == label and at - now[2] <= self.gap:
                now = label, now[1], at, now[3] + 1
                continue
            if now:
                done.append((key[0], now[0], now[1], now[3]))
            now = label, at, at, 1
        if now and now[2] + self.gap < seen:
            done.append((key[0], now[0], now[1], now[3]))
            now = None
        self._write(waiting, now, due if due is not None and due > timerValues.getCurrentWatermarkInMs() else None)
        yield _rows(done)

    def close(self) -> None:
        pass


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "label", "start", "length"])


def gap_sessions(stream: DataFrame, key: str, ts: str, tie: str, label: str, frame_s: int, gap: int, late: str) -> DataFrame:
    """(key, label, start, length): the rows of `windows.gap_sessions` over frames that are labelled by their first row.

    A frame is a number of `frame_s` seconds since 1970, from then on; its first row is the least by time and `tie`, a whole number. Without a label
    it is no frame. A session comes once the watermark has passed the frame that ends it, or its gap. Rows behind the
    watermark are left out and counted by Spark as `numRowsDroppedByWatermark`. Needs the RocksDB state store.
    """
    kind = dict(stream.dtypes)[key]
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = stream.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), us.alias("us"), F.floor(us / F.lit(frame_s * 1_000_000)).cast("long").alias("at"), F.col(tie).cast("long").alias("tie"), F.col(label).cast("string").alias("label"))
    known = rows.where("ts is not null and tie is not null").withWatermark("ts", late).groupBy("key")
    return known.transformWithStateInPandas(Sessions(frame_s, gap), f"key {kind}, label string, start long, length long", "append", "eventTime")
