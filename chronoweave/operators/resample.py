"""Resampling where "absent" is a state of its own: held for a while, then invalid, never zero by accident."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.blocks import near
from chronoweave.operators.frames import onward


def last_and_next(df: DataFrame, keys: list[str], index: str, value: str, block: Column | None = None) -> DataFrame:
    """Adds prev_at, prev, next_at, next: the nearest values present at or before, and after, each row."""
    at, v = F.when(F.col(value).isNotNull(), F.col(index)), F.col(value)
    return near(df, keys, index, last={"prev_at": at, "prev": v}, after={"next_at": at, "next": v}, block=block)


def resample_hold(track: DataFrame, keys: list[str], index: str, value: str, fps: float, grid: list, n_out: int, rate: float, hold_s: float = 0.2, block: Column | None = None) -> DataFrame:
    """A track with gaps on a new grid: (keys, out, value, valid).

    A value is held for int(hold_s * fps) frames; beyond, and before the first, the track is invalid and 0. Between frames
    values are interpolated; validity is that of the nearest frame (half to even). Past the last frame and one more it is
    invalid. A track of nulls alone is invalid throughout. `rate` is the grid's rows per second.
    """
    held_for = int(hold_s * fps)
    seen = F.struct(F.col(index).alias("i"), F.col(value).alias("v"))
    held = near(track, keys, index, last={"_seen": F.when(F.col(value).isNotNull(), seen)}, block=block)
    ok = F.coalesce(F.col(index) - F.col("_seen.i") <= held_for, F.lit(False))
    frames = held.select(*keys, F.col(index).alias("_i"), F.when(ok, F.col("_seen.v")).otherwise(0.0).alias("_v"), ok.alias("_ok"))
    ends = frames.groupBy(*keys).agg(F.max("_i").alias("_last"))
    out = ends.withColumn("out", F.explode(F.sequence(F.lit(0), F.lit(n_out - 1))))
    t = F.col("out") / F.lit(float(rate)) * F.lit(float(fps))
    out = out.withColumns({"_t": t, "_lo": F.least(F.floor(t), F.col("_last")), "_hi": F.least(F.floor(t) + 1, F.col("_last")), "_near": F.least(F.bround(t).cast("long"), F.col("_last"))})
    side = lambda name, v: frames.select(*keys, F.col("_i").alias(name), F.col("_v").alias(v), F.col("_ok").alias(f"{v}_ok"))
    out = out.join(side("_lo", "_a"), [*keys, "_lo"], "left").join(side("_hi", "_b"), [*keys, "_hi"], "left").join(side("_near", "_n"), [*keys, "_near"], "left")
    inside = F.col("_t") <= F.col("_last")
    blend = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_t") - F.floor("_t"))
    valid = F.coalesce(F.col("_n_ok"), F.lit(False)) & (F.col("_t") <= F.col("_last") + 1)
    return out.select(*keys, "out", F.when(inside, F.coalesce(blend, F.lit(0.0))).otherwise(0.0).alias(value), valid.alias("valid"))


def interpolate(df: DataFrame, keys: list[str], index: str, value: str, out: str, block: Column | None = None) -> DataFrame:
    """Gaps filled along a line, flat beyond the ends; 0 for a series without values."""
    both = last_and_next(df, keys, index, value, block)
    line = F.col("prev") + (F.col("next") - F.col("prev")) * (F.col(index) - F.col("prev_at")) / (F.col("next_at") - F.col("prev_at"))
    return both.withColumn(out, F.coalesce(F.col(value), line, F.col("prev"), F.col("next"), F.lit(0.0))).drop("prev", "prev_at", "next", "next_at")


def match_length(df: DataFrame, keys: list[str], index: str, value: str, n: int) -> DataFrame:
    """The series stretched to n rows by a line between neighbours; zeros for an empty one."""
    size = df.groupBy(*keys).agg(F.max(index).alias("_last"))
    grid = size.withColumn("out", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    t = F.col("out") * F.col("_last") / F.lit(float(max(n - 1, 1)))
    grid = grid.withColumns({"_t": t, "_lo": F.floor(t), "_hi": F.least(F.floor(t) + 1, F.col("_last"))})
    side = lambda at, v: df.select(*keys, F.col(index).alias(at), F.col(value).alias(v))
    grid = grid.join(side("_lo", "_a"), [*keys, "_lo"], "left").join(side("_hi", "_b"), [*keys, "_hi"], "left")
    return grid.select(*keys, "out", F.coalesce(F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_t") - F.col("_lo")), F.lit(0.0)).alias(value))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, out: str) -> DataFrame:
    """As-of join to the nearest row of `right` on either side, the earlier of a tie: one union and one sort per key."""
    none = F.lit(None)
    rows = left.withColumns({"_side": F.lit(1), "_at": none.cast("long"), "_v": none.cast(right.schema[value].dataType)})
    add = right.select(*keys, at, F.lit(0).alias("_side"), F.col(at).alias("_at"), F.col(value).alias("_v"))
    for c in left.columns:
        if c not in add.columns:
            add = add.withColumn(c, none.cast(left.schema[c].dataType))
    rows = rows.unionByName(add)
    back = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    on = onward(keys, at, "_side", start=1)
    pick = F.when(F.col("_side") == 0, F.struct("_at", "_v"))
    rows = rows.withColumns({"_p": F.last(pick, ignorenulls=True).over(back), "_n": F.last(pick, ignorenulls=True).over(on)}).where("_side = 1")
    a, b = F.col(at) - F.col("_p._at"), F.col("_n._at") - F.col(at)
    chosen = F.when(b.isNull() | (a <= b), F.col("_p")).otherwise(F.coalesce(F.col("_n"), F.col("_p")))
    return rows.select(*left.columns, chosen["_at"].alias(f"{out}_at"), chosen["_v"].alias(out))


def covered(samples: DataFrame, centres: DataFrame, keys: list[str], at: str, centre: str, half: float, out: str) -> DataFrame:
    """True where a sample lies within `half` of a centre."""
    near = nearest(samples, centres.select(*keys, F.col(centre).cast(samples.schema[at].dataType).alias(at), F.col(centre).alias("_c")), keys, at, "_c", "_near")
    return near.withColumn(out, F.coalesce(F.abs(F.col(at) - F.col("_near")) <= half, F.lit(False))).drop("_near", "_near_at")


def valid_at(t: Column, fps: float, last: Column) -> Column:
    """Index of the frame nearest to a time, half to even, inside the series."""
    return F.greatest(F.lit(0), F.least(F.bround(t * fps).cast("long"), last))
