"""Re-identification over time: detections with vectors joined to live tracks, over a table or a stream by the same steps.

A detection has a key (a camera), a place in time (seconds), an id and a vector. Those of one key and place are a frame: each goes
to the live track that it is most like, one to a track, or starts a track. A track ends when it isn't seen for `gap` seconds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reid:
    same: float = 0.5  # least cosine of a detection and the sum of its track
    gap: int = 60  # seconds that a track lives unseen


class Gallery:
    """Live tracks of one key: track -> (last seen, sum of unit vectors), and the number of tracks so far."""

    def __init__(self, settings: Reid, live: dict[int, tuple[int, np.ndarray]] | None = None, made: int = 0):
        self.s, self.live, self.made = settings, live or {}, made

    def expire(self, at: int) -> list[int]:
        gone = [t for t, (seen, _) in self.live.items() if at - seen > self.s.gap]
        for t in gone:
            del self.live[t]
        return gone

    def frame(self, at: int, vectors: list) -> list[int | None]:
        """Tracks of a frame's detections, in order of likeness, then of track, then of place. Without a direction there is no track."""
        self.expire(at)
        units = [_unit(v) for v in vectors]
        out: list[int | None] = [None] * len(units)
        rows = [d for d, u in enumerate(units) if u is not None]
        tracks = sorted(self.live)
        if rows and tracks:
            sums = np.stack([_unit(self.live[t][1]) if self.live[t][1].any() else self.live[t][1] for t in tracks])
            like = np.stack([units[d] for d in rows]) @ sums.T
            d, t = np.nonzero(like > self.s.same)
            taken: set[int] = set()
            for i in np.lexsort((d, t, -like[d, t])):
                if out[rows[d[i]]] is None and t[i] not in taken:
                    taken.add(t[i])
                    out[rows[d[i]]] = tracks[t[i]]
        for d in rows:
            if out[d] is None:
                out[d], self.made = self.made, self.made + 1
            before = self.live[out[d]][1] if out[d] in self.live else 0.0
            self.live[out[d]] = (at, before + units[d])
        return out


def _unit(v) -> np.ndarray | None:
    if v is None:
        return None
    v = np.asarray(v, float)
    norm = float(np.sqrt((v * v).sum()))
    return v / norm if norm > 0 and np.isfinite(norm) else None


def reidentify(df: DataFrame, key: str, at: str, det: str, vector: str, settings: Reid = Reid()) -> DataFrame:
    """(key, at, det, track) of a table: one shuffle by key, rows in order of time, and only live tracks and one frame in memory.

    Time is sequential inside a key, so a key that holds most rows makes a long task, in bounded memory. Tracks are numbered from 0
    within a key. A NULL vector, or one of no length, has no track. Rows without a place in time are left without one too.
    """
    kinds = dict(df.dtypes)
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{at}`").cast("long").alias("at"), F.col(f"`{det}`").alias("det"), F.col(f"`{vector}`").cast("array<double>").alias("v"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gallery, now, waiting = None, None, []

        def close() -> list:
            tracks = gallery.frame(now[1], [v for _, v in waiting])
            return [(*now, det, t) for (det, _), t in zip(waiting, tracks, strict=True)]

        for p in parts:
            out = []
            for k, a, d, v in p.itertuples(index=False, name=None):
                k = None if pd.isna(k) else k
                if now != (k, a):
                    if now is not None:
                        out += close()
                    if now is None or now[0] != k:
                        gallery = Gallery(settings)
                    now, waiting = (k, a), []
                waiting.append((d, v))
            yield _frame(out)
        if waiting:
            yield _frame(close())

    out = rows.where("at is not null").repartition("key").sortWithinPartitions("key", "at", "det")
    out = out.mapInPandas(run, f"key {kinds[key]}, at long, det {kinds[det]}, track long")
    none = rows.where("at is null").select("key", "at", "det", F.lit(None).cast("long").alias("track"))
    return out.unionByName(none).withColumnsRenamed({"key": key, "at": at, "det": det})


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["key", "at", "det", "track"], dtype=object)
    return out.astype({"track": "Int64"})
