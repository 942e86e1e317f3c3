"""Tracks of detected boxes. Greedy and stateful in time, so one clip is one pandas group; clips spread over the cluster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from chronoweave.config import Tracking


def presence(tracks: DataFrame, keys: list[str], track: str, least: int = 12, most: int = 4) -> DataFrame:
    """The tracks seen most, `least` frames at least, numbered anew by rank; ties by the old number."""
    n = tracks.groupBy(*keys, track).agg(F.count("*").alias("frames")).where(F.col("frames") >= least)
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("frames"), track))
    return n.withColumn("rank", r - 1).where(F.col("rank") < most)


def _overlap(a, b) -> float:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return 0.0 if w <= 0 or h <= 0 else w * h / (a[2] * a[3] + b[2] * b[3] - w * h + 1e-12)


class Tracker:
    """Joins each frame's boxes to tracks: first by overlap, unless the embeddings object; then by embedding alone."""

    def __init__(self, s: Tracking = Tracking()):
        self.s, self.last, self.box, self.total = s, {}, {}, {}

    def similarity(self, track: int, emb) -> float | None:
        total = self.total.get(track)
        if emb is None or total is None or not (norm := float(np.linalg.norm(total))):
            return None
        return float(total @ np.asarray(emb, float)) / norm

    def frame(self, at: int, boxes: list, embs: list) -> list[int]:
        s, out = self.s, [-1] * len(boxes)
        pairs = []
        for t, seen in self.last.items():
            if at - seen <= s.gap:
                for d, b in enumerate(boxes):
                    like = self.similarity(t, embs[d])
                    if (o := _overlap(self.box[t], b)) > s.iou and (like is None or like >= s.veto):
                        pairs.append((o, t, d))
        taken: set[int] = set()
        for _, t, d in sorted(pairs, reverse=True):
            if t not in taken and out[d] < 0:
                taken.add(t)
                out[d] = t
        for d, emb in enumerate(embs):
            if out[d] < 0 and emb is not None:
                like = [(x, -t) for t in self.last if t not in taken and (x := self.similarity(t, emb)) is not None and x > s.same]
                if like:
                    out[d] = -max(like)[1]
                    taken.add(out[d])
        for d, b in enumerate(boxes):
            if out[d] < 0:
                out[d] = len(self.last)
            t = out[d]
            self.last[t], self.box[t] = at, b
            if embs[d] is not None:
                self.total[t] = self.total.get(t, 0) + np.asarray(embs[d], float)
        return out


def track(detections: DataFrame, clip: str, settings: Tracking = Tracking()) -> DataFrame:
    """(clip, frame, det, track) from rows of clip, frame, det, x, y, w, h and emb (nullable)."""
    kind = dict(detections.dtypes)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        tracker, out = Tracker(settings), []
        for at, f in df.sort_values(["frame", "det"]).groupby("frame"):
            ids = tracker.frame(int(at), list(f[["x", "y", "w", "h"]].itertuples(index=False, name=None)), list(f["emb"]))
            out += [(f[clip].iloc[0], int(at), int(d), t) for d, t in zip(f["det"], ids, strict=True)]
        return pd.DataFrame(out, columns=[clip, "frame", "det", "track"])

    return detections.groupBy(clip).applyInPandas(run, f"{clip} {kind[clip]}, frame int, det int, track int")
