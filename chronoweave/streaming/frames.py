"""Frames and the two-threshold gate over a stream: event-time windows with a watermark, then state per channel."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def framed(events: DataFrame, channel: str, ts: str, value: str, frame: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(channel, start, n, db) of tumbling windows, each emitted once the watermark has passed it."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, frame), F.col(channel).alias("channel"))
    out = w.agg(F.count("*").alias("n"), F.sum(F.col(value) * F.col(value)).alias("energy"))
    return out.select("channel", F.col("window.start").alias("start"), "n", (10 * F.log10(F.col("energy") + 1e-12)).alias("db"))


def gated(events: DataFrame, channel: str, ts: str, value: str, open_db: float, close_db: float, min_on: int, min_off: int, frame_s: int = 3600, late: str = "10 minutes") -> DataFrame:
    """(channel, start, db, state) of each frame of a stream, once a later event of its channel has closed it.

    One stateful operator frames and gates. Its state is a channel's open frame and the machine's counters. A stream can't
    reopen the past, so the gate opens when its dwell is over. Events behind the open frame are late and left out, silent
    frames between two events are counted.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, energy, on, up, dn = state.get if state.exists else (-1, 0.0, 0, 0, 0)
        rows = []
        for p in parts:
            k = (p["ts"].astype("datetime64[us]").astype("int64") // (frame_s * 1_000_000)).to_numpy()
            for f, e in zip(*_sums(k, p["value"].to_numpy(float)), strict=True):
                if at >= 0 and f < at:
                    continue
                while 0 <= at < f:
                    db = 10 * math.log10(energy + 1e-12)
                    up, dn = (up + 1 if db > open_db else 0), (dn + 1 if db < close_db else 0)
                    on = 1 if up >= min_on else 0 if dn >= min_off else on
                    rows.append((key[0], pd.Timestamp(at * frame_s, unit="s"), db, on))
                    at, energy = at + 1, 0.0
                at, energy = int(f), energy + float(e)
        state.update((at, energy, on, up, dn))
        yield pd.DataFrame(rows, columns=["channel", "start", "db", "state"])

    rows = events.withWatermark(ts, late).select(F.col(channel).alias("channel"), F.col(ts).alias("ts"), F.col(value).alias("value"))
    return rows.groupBy("channel").applyInPandasWithState(run, "channel string, start timestamp, db double, state int", "at long, energy double, on_ int, up int, dn int", "append", GroupStateTimeout.NoTimeout)


def _sums(k: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    frames, which = np.unique(k, return_inverse=True)
    return frames, np.bincount(which, v * v)
