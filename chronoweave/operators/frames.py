"""Series as (keys, index, value) rows: framing, levels, chunking and overlap-add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.numeric import level_db, power_db


def by(keys: list[str], index: str):
    return Window.partitionBy(*keys).orderBy(index)


def onward(keys: list[str], *index: str, start: int = 0):
    """The rows from `start` after a row to the last, met from the far end, so `last` gives the nearest.

    Spark works a frame that ends at the last row out anew for each row, which is quadratic in a series; this one grows by a row.
    """
    return Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in index]).rowsBetween(Window.unboundedPreceding, -start)


def mono(samples: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Mean of channels per sample."""
    return samples.groupBy(*keys, index).agg(F.avg(value).alias(value))


def complete(df: DataFrame, keys: list[str], index: str, first: int, last: int, fill: dict[str, float]) -> DataFrame:
    """A row for every index of every key; missing ones get the fill."""
    grid = df.select(*keys).distinct().withColumn(index, F.explode(F.sequence(F.lit(first), F.lit(last))))
    return grid.join(df, [*keys, index], "left").fillna(fill)


def frame_energy(samples: DataFrame, keys: list[str], index: str, value: str, frame: int) -> DataFrame:
    """Mean square of each frame in dB. The last frame is padded with zeros, so all divide by the whole frame."""
    cut = samples.groupBy(*keys, F.floor(F.col(index) / frame).alias("frame"))
    return cut.agg((F.sum(F.col(value) * F.col(value)) / frame).alias("power")).withColumn("db", power_db(F.col("power")))


def rms_frames(samples: DataFrame, keys: list[str], index: str, value: str, frame: int, truncate: bool = True) -> DataFrame:
    """Root mean square per frame; a partial last frame is dropped, or padded."""
    df = frame_energy(samples, keys, index, value, frame)
    if truncate:
        whole = samples.groupBy(*keys).agg(F.floor((F.max(index) + 1) / frame).alias("_whole"))
        df = df.join(whole, keys).where(F.col("frame") < F.col("_whole")).drop("_whole")
    return df.select(*keys, "frame", F.sqrt("power").alias("rms"))


def envelope_db(samples: DataFrame, keys: list[str], index: str, value: str, frame: int, smooth: int) -> DataFrame:
    """Level of each frame in dB, smoothed by a boxcar."""
    from chronoweave.operators.windows import boxcar

    df = rms_frames(samples, keys, index, value, frame, truncate=False).withColumn("db", level_db(F.col("rms")))
    return boxcar(df, keys, "frame", "db", smooth, "envelope")


def signal_db(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    return samples.groupBy(*keys).agg(level_db(F.sqrt(F.avg(F.col(value) * F.col(value))), 1e-12).alias("db"))


def zscore(df: DataFrame, keys: list[str], value: str, out: str = "z") -> DataFrame:
    """(x - mean) / population deviation; all zero where that is 1e-9 or less."""
    w = Window.partitionBy(*keys)
    dev = F.stddev_pop(value).over(w)
    return df.withColumn(out, F.when(dev > 1e-9, (F.col(value) - F.avg(value).over(w)) / dev).otherwise(0.0))


def absolute_step(df: DataFrame, keys: list[str], index: str, value: str, out: str = "step") -> DataFrame:
    """|x - previous x|, 0 for the first."""
    return df.withColumn(out, F.abs(F.col(value) - F.lag(value, 1).over(by(keys, index)))).fillna({out: 0.0})


def relative_level(df: DataFrame, keys: list[str], db: str, q: float = 0.95, out: str = "rel", long: bool = False) -> DataFrame:
    """Level less the exact q-quantile of its series. The quantile is aggregated first, then joined: no series is gathered.

    `long` is for series of more distinct levels than a task can hold: the same quantile, by counting.
    """
    if long:
        from chronoweave.operators.order import _spread, quantile

        return _spread(df, quantile(df, keys, db, q, "_ref", "_rows"), keys, "_rows").withColumn(out, F.col(db) - F.col("_ref")).drop("_ref")
    ref = df.groupBy(*keys).agg(F.percentile(db, F.lit(q)).alias("_ref"))
    return df.join(ref, keys).withColumn(out, F.col(db) - F.col("_ref")).drop("_ref")


def loud(df: DataFrame, keys: list[str], db: str, below: float = 12.0, q: float = 0.9) -> DataFrame:
    """Rows no more than `below` dB under the q-quantile of their series."""
    return relative_level(df, keys, db, q, "_rel").where(F.col("_rel") >= -below).drop("_rel")


def chunk_bounds(n: Column, chunk: int, overlap: int) -> Column:
    """Array of (start, stop) that cover 0 .. n-1; the overlap is held to half a chunk."""
    step = chunk - min(overlap, chunk // 2)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int"), F.lit(step))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + chunk, n.cast("int")).alias("stop")))
    # a chunk that lies wholly in the one before it is dropped
    return F.filter(cut, lambda c, i: (i == 0) | (c["stop"] - c["start"] > chunk - step))


def window_starts(n: Column, window: int, hop: int) -> Column:
    """Starts of overlapping windows, the last one flush with the end; a short series has one at 0."""
    last = F.greatest(n - window, F.lit(0)).cast("int")
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(hop)), F.array(last)))


def overlap_add(parts: DataFrame, keys: list[str], index: str, value: str, weight: str) -> DataFrame:
    """Sum of weighted parts over the sum of weights, which is held to 1e-8 at least."""
    out = parts.groupBy(*keys, index).agg(F.sum(F.col(value) * F.col(weight)).alias("_v"), F.sum(weight).alias("_w"))
    return out.select(*keys, index, (F.col("_v") / F.greatest(F.col("_w"), F.lit(1e-8))).alias(value))


def fade(at: Column, length: Column, ramp: int, first: Column, last: Column) -> Column:
    """Raised-cosine weight inside a chunk; the series' own ends don't fade."""
    up = F.when(first | (at >= ramp), 1.0).otherwise(0.5 - 0.5 * F.cos(F.lit(3.141592653589793) * (at + 1) / (ramp + 1)))
    left = length - 1 - at
    down = F.when(last | (left >= ramp), 1.0).otherwise(0.5 - 0.5 * F.cos(F.lit(3.141592653589793) * (left + 1) / (ramp + 1)))
    return F.least(up, down)


def shared_gain(*sets: tuple[DataFrame, str]) -> DataFrame:
    """One gain for several sets: 0.999 / peak where the peak exceeds it, else 1."""
    peaks = [df.agg(F.max(F.abs(F.col(c).cast("double"))).alias("p")) for df, c in sets]
    every = peaks[0]
    for p in peaks[1:]:
        every = every.unionAll(p)
    peak = F.coalesce(F.max("p"), F.lit(0.0))
    return every.agg(peak.alias("peak")).withColumn("gain", F.when(F.col("peak") > 0.999, 0.999 / F.col("peak")).otherwise(1.0))


def interleave(stems: DataFrame, keys: list[str], index: str, channel: str, value: str, channels: list[str]) -> DataFrame:
    """One column per channel, named in advance so that no pass is spent on finding them."""
    return stems.groupBy(*keys, index).pivot(channel, channels).agg(F.first(value))


def fit_length(df: DataFrame, keys: list[str], index: str, value: str, n: int) -> DataFrame:
    """Cropped or padded with zeros to n rows per key."""
    return complete(df.where(F.col(index) < n), keys, index, 0, n - 1, {value: 0.0})


def repeat_frames(frames: DataFrame, index: str, frame: int, n: Column | None = None) -> DataFrame:
    """Each frame's row once for every sample in it."""
    last = F.col(index) * frame + (frame - 1)
    df = frames.withColumn("sample", F.explode(F.sequence(F.col(index) * frame, last)))
    return df.where(F.col("sample") < n) if n is not None else df
