"""Gates: two thresholds with dwell times, cross-channel vetoes, visual activity and identity, all as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.numeric import clip
from chronoweave.operators.blocks import near
from chronoweave.operators.frames import absolute_step, by, onward
from chronoweave.operators.windows import boxcar, dilate, look_ahead, ramps


def _carry(df: DataFrame, keys: list[str], sums: dict[str, Column], steps: list[dict[str, Column]]) -> DataFrame:
    """Rows with what crosses the blocks `_blk` of their series: one summary row a block, then windows over those rows alone."""
    whole = df.groupBy(*keys, "_blk").agg(*[c.alias(n) for n, c in sums.items()])
    for step in steps:
        whole = whole.withColumns(step)
    whole = whole.drop(*sums)
    on = [df[k].eqNullSafe(whole[k]) for k in [*keys, "_blk"]]
    return df.join(whole, on).drop(*[whole[k] for k in [*keys, "_blk"]])


def hysteresis(df: DataFrame, keys: list[str], index: str, value: str, open_at: Column, close_at: Column, min_on: int, min_off: int, out: str = "state", block: Column | None = None) -> DataFrame:
    """0/1 state of a two-threshold machine with dwell times.

    It opens once min_on rows in a row are over `open_at`, from the first of them; it shuts on the min_off-th row in a row
    under `close_at`. open_at must not lie under close_at in any row. A NULL value crosses neither.

    `block` is for series too long for one task: a number that grows with the index. Each block is sorted by itself; the last
    and first rows off, the rows before and the last event cross blocks in one summary row each. The states are the same.
    """
    parts = keys if block is None else [*keys, "_blk"]
    if block is not None:
        df = df.withColumn("_blk", block)
    w = by(parts, index)
    so_far, on_from = w.rowsBetween(Window.unboundedPreceding, 0), onward(parts, index)
    v = F.col(value)
    df = df.withColumns({"_up": F.coalesce(v > open_at, F.lit(False)), "_dn": F.coalesce(v < close_at, F.lit(False)), "_i": F.row_number().over(w).cast("long")})
    off = {f: F.when(~F.col(f), F.col("_i")) for f in ("_up", "_dn")}
    local = {"_lu": F.max(off["_up"]).over(so_far), "_ld": F.max(off["_dn"]).over(so_far), "_nu": F.min(off["_up"]).over(on_from)}
    if block is None:
        df = df.withColumns(local | {"_end": F.count("*").over(Window.partitionBy(*keys)) + 1})
    else:
        order = Window.partitionBy(*keys).orderBy("_blk")
        before, after = order.rowsBetween(Window.unboundedPreceding, -1), onward(keys, "_blk", start=1)
        sums = {"_n": F.count("*"), "_lastu": F.max(off["_up"]), "_lastd": F.max(off["_dn"]), "_firstu": F.min(off["_up"])}
        start = {"_from": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy(*keys))}
        reach = {
            "_cu": F.max(F.col("_from") + F.col("_lastu")).over(before),
            "_cd": F.max(F.col("_from") + F.col("_lastd")).over(before),
            "_end": F.coalesce(F.min(F.col("_from") + F.col("_firstu")).over(after), F.col("_all") + 1),
        }
        df = _carry(df, keys, sums, [start, reach]).withColumns(local)
        df = df.withColumns({"_lu": F.coalesce(F.col("_from") + F.col("_lu"), "_cu"), "_ld": F.coalesce(F.col("_from") + F.col("_ld"), "_cd"), "_nu": F.col("_from") + F.col("_nu"), "_i": F.col("_from") + F.col("_i")})
        df = df.drop("_from", "_all", "_cu", "_cd")
    run = lambda flag, last: F.when(F.col(flag), F.col("_i") - F.coalesce(last, F.lit(0)))
    df = df.withColumns({"_u": run("_up", "_lu"), "_d": run("_dn", "_ld"), "_end": F.coalesce("_nu", "_end")})
    df = df.withColumn("_ev", F.when(F.col("_u") == min_on, 1).when(F.col("_d") == min_off, 0))
    if block is None:
        held = F.last("_ev", ignorenulls=True).over(so_far)
    else:
        last = {"_last": F.max(F.when(F.col("_ev").isNotNull(), F.struct("_i", "_ev")))}
        df = _carry(df, keys, last, [{"_held": F.last("_last", ignorenulls=True).over(before)["_ev"]}])
        held = F.coalesce(F.last("_ev", ignorenulls=True).over(so_far), "_held")
    early = F.col("_up") & (F.col("_u") + F.col("_end") - F.col("_i") - 1 >= min_on)
    state = (F.coalesce(held, F.lit(0)) == 1) | early
    return df.withColumn(out, state.cast("int")).drop("_up", "_dn", "_i", "_lu", "_ld", "_nu", "_u", "_d", "_end", "_ev", "_blk", "_held")


def veto_shift(mine: Column, mine_ok: Column, rival: Column, rival_ok: Column, db: float = 4.0, symmetric: bool = False) -> Column:
    """dB by which both thresholds rise where a rival is the more active; 0 where either side is absent."""
    return F.when(mine_ok & rival_ok, db * clip(rival - mine, -1.0 if symmetric else 0.0, 1.0)).otherwise(0.0)


def rival_max(df: DataFrame, frame: list[str], channel: str, value: str, out: str) -> DataFrame:
    """Greatest value of the other channels of a frame, NULL without any. A channel has one row a frame.

    In order of value the first row's rival is the next row, and all others' is the first: one shuffle by frame, and frames that
    Spark reads row by row. Of equal values the channel last in order is the first.
    """
    w = Window.partitionBy(*frame).orderBy(F.desc(value), F.desc(channel))
    return df.withColumn(out, F.when(F.row_number().over(w) == 1, F.lead(value).over(w)).otherwise(F.first(value).over(w)))


def visual_activity(df: DataFrame, keys: list[str], index: str, value: str, valid: str, smooth: int, spread: int, least: float = 1e-4, q: float = 0.9, out: str = "activity") -> DataFrame:
    """Activity in [0, 1] from a track: steps, smoothed, over their q-quantile, spread. Absent or frozen tracks give 0.

    The order matters: steps are zeroed where the track is invalid before they are smoothed.
    """
    df = absolute_step(df, keys, index, value, "_step")
    df = df.withColumn("_step", F.when(F.col(valid), F.col("_step")).otherwise(0.0))
    df = boxcar(df, keys, index, "_step", smooth, "_smooth")
    ref = df.groupBy(*keys).agg(F.percentile(F.when(F.col(valid), F.col("_smooth")), F.lit(q)).alias("_ref"))
    df = df.join(ref, keys)
    df = df.withColumn("_act", F.when(F.col("_ref") >= least, clip(F.col("_smooth") / F.col("_ref"), 0.0, 1.0)).otherwise(0.0))
    return dilate(df, keys, index, "_act", spread, out).drop("_step", "_smooth", "_ref", "_act")


def gate(df: DataFrame, keys: list[str], index: str, rel: str, open_db: float, close_db: float, min_on: int, min_off: int, ahead: int, ramp: int, shift: Column | None = None) -> DataFrame:
    """Adds `state` (with look-ahead) and `gain` (with ramps) to rows of relative level."""
    shift = F.lit(0.0) if shift is None else shift
    df = hysteresis(df, keys, index, rel, F.lit(open_db) + shift, F.lit(close_db) + shift, min_on, min_off, "_state")
    df = look_ahead(df, keys, index, "_state", ahead, "state").drop("_state")
    return ramps(df, keys, index, "state", ramp, "gain")


def identity_gate(scores: DataFrame, keys: list[str], index: str, score: str, on: float, off: float, dwell_s: float, hop_s: float) -> DataFrame:
    """State of window scores. The dwell counts rows, so windows left out as quiet don't count."""
    rows = max(1, round(dwell_s / hop_s))
    return hysteresis(scores, keys, index, score, F.lit(on), F.lit(off), rows, rows)


def lift(states: DataFrame, samples: DataFrame, keys: list[str], at: str, state: str, half: float, block: Column | None = None) -> DataFrame:
    """Window states on a grid of samples: over 0.5 between the windows on either side, and within `half` of one. Without windows all are 0."""
    df = samples.join(states.select(*keys, at, F.struct(F.col(at).alias("t"), F.col(state).alias("s")).alias("_w")), [*keys, at], "left")
    df = near(df, keys, at, last={"_p": F.col("_w")}, first={"_n": F.col("_w")}, block=block)
    before, after = F.col(at) - F.col("_p.t"), F.col("_n.t") - F.col(at)
    between = F.col("_p.s") + (F.col("_n.s") - F.col("_p.s")) * before / F.nullif(before + after, F.lit(0))
    level = F.coalesce(between, F.col("_p.s"), F.col("_n.s"))
    open_ = F.coalesce((level > 0.5) & (F.least(before, after) <= half), F.lit(False))
    return df.withColumn(state, open_.cast("int")).drop("_w", "_p", "_n")
