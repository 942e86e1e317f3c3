"""Re-identification over a stream: live tracks in a map state, frames closed and tracks ended by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from chronoweave.operators.reid import Gallery, Reid


class Tracks(StatefulProcessor):
    """State of a key: frames that wait for the watermark, live tracks, and how many tracks there were.

    A frame's timer is its time, when no row of it can come any more; a track's is a second past its gap. So frames are met in order
    whatever order their rows came in, and the state holds the frames inside the watermark's delay and the live tracks.
    """

    def __init__(self, settings: Reid):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "dets array<long>, sizes array<int>, flat array<double>")
        self.live = handle.getMapState("live", "track long", "seen long, total array<double>")
        self.made = handle.getValueState("made", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for at, frame in part.groupby("at"):
                at = int(at)
                dets, sizes, flat = self.waiting.getValue((at,)) if self.waiting.containsKey((at,)) else ([], [], [])
                vectors = [[] if v is None else [float(x) for x in v] for v in frame["v"]]
                new = [int(d) for d in frame["det"]], [-1 if v is None else len(v) for v in frame["v"]], [x for v in vectors for x in v]
                self.waiting.updateValue((at,), (list(dets) + new[0], list(sizes) + new[1], list(flat) + new[2]))
                self.handle.registerTimer(at * 1000)
        yield _none()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() // 1000
        live = {int(k[0]): (int(v[0]), np.asarray(v[1], float)) for k, v in self.live.iterator()}
        gallery = Gallery(self.settings, dict(live), int(self.made.get()[0]) if self.made.exists() else 0)
        gallery.expire(at)
        if self.waiting.containsKey((at,)):
            dets, sizes, flat = self.waiting.getValue((at,))
            self.waiting.removeKey((at,))
            ends = np.cumsum([max(n, 0) for n in sizes])
            frame = sorted(((d, None if n < 0 else flat[e - n : e]) for d, n, e in zip(dets, sizes, ends, strict=True)), key=lambda r: r[0])
            tracks = gallery.frame(at, [v for _, v in frame])
            for t in {t for t in tracks if t is not None}:
                seen, total = gallery.live[t]
                self.live.updateValue((t,), (seen, total.tolist()))
                self.handle.registerTimer((seen + self.settings.gap + 1) * 1000)
            self.made.update((gallery.made,))
            yield pd.DataFrame({"key": [key[0]] * len(frame), "at": at, "det": [d for d, _ in frame], "track": pd.array(tracks, "Int64")})
        else:
            yield _none()
        for t in live.keys() - gallery.live.keys():
            self.live.removeKey((t,))

    def close(self) -> None:
        pass


def _none() -> pd.DataFrame:
    return pd.DataFrame({"key": pd.Series(dtype=object), "at": pd.Series(dtype="int64"), "det": pd.Series(dtype="int64"), "track": pd.Series(dtype="Int64")})


def reidentified(stream: DataFrame, key: str, ts: str, det: str, vector: str, settings: Reid = Reid(), late: str = "10 seconds") -> DataFrame:
    """(key, at, det, track) of a stream, each frame once the watermark has passed it: the rows of `reidentify` over the rows in time.

    Needs the RocksDB state store. Time counts in whole seconds after 1970; ids are whole numbers. Rows behind the watermark are left out.
    """
    kind = dict(stream.dtypes)[key]
    at = F.unix_seconds(F.col(ts))
    rows = stream.select(F.col(key).alias("key"), F.timestamp_seconds(at).alias("ts"), at.alias("at"), F.col(det).cast("long").alias("det"), F.col(vector).cast("array<double>").alias("v"))
    tracked = rows.withWatermark("ts", late).groupBy("key")
    return tracked.transformWithStateInPandas(Tracks(settings), f"key {kind}, at long, det long, track long", "append", "eventTime")
