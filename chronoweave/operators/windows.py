"""Sliding and run-length operators over (keys, index, value) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.blocks import halo, near, stretches
from chronoweave.operators.order import _same, ranks
from chronoweave.operators.frames import by


def _around(keys, index, k: int):
    before = k - 1 - (k - 1) // 2
    return by(keys, index).rowsBetween(-before, (k - 1) // 2)


def _in_blocks(fn, df: DataFrame, keys: list[str], index: str, block: int, before: int, after: int) -> DataFrame:
    """A function of bounded frames over blocks of `block` indexes with halos; the index has no gaps."""
    cut = halo(df, index, block, before, after)
    return fn(cut, [*keys, "_blk"]).where("_own").drop("_blk", "_own")


def boxcar(df: DataFrame, keys: list[str], index: str, value: str, k: int, out: str, block: int | None = None) -> DataFrame:
    """Mean over k rows centred on each, zeros beyond the ends: always over k. NULL for a series shorter than k.

    With `block`, which bounds the rows that a task sorts, the index has no gaps.
    """
    if block:
        mean = lambda x, parts: x.withColumn(out, F.sum(value).over(_around(parts, index, k)) / k)
        rows = _same(_in_blocks(mean, df, keys, index, block, k, k), df.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
        return rows.withColumn(out, F.when(F.col("_n") >= k, F.col(out))).drop("_n")
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn(out, F.when(n >= k, F.sum(value).over(_around(keys, index, k)) / k))


def present_boxcar(df: DataFrame, keys: list[str], index: str, value: str, k: int, out: str, block: int | None = None) -> DataFrame:
    """Mean of the values present among k rows; NULL unless over half of them are."""
    if block:
        return _in_blocks(lambda x, parts: present_boxcar(x, parts, index, value, k, out), df, keys, index, block, k, k)
    w = _around(keys, index, k)
    n = F.count(value).over(w)
    return df.withColumn(out, F.when(n / k > 0.5, F.sum(value).over(w) / n))


def dilate(df: DataFrame, keys: list[str], index: str, value: str, width: int, out: str, block: int | None = None) -> DataFrame:
    """Greatest value around; an even width reaches one further back than forward."""
    if block:
        return _in_blocks(lambda x, parts: dilate(x, parts, index, value, width, out), df, keys, index, block, width, width)
    after = width // 2 - 1 if width % 2 == 0 else width // 2
    return df.withColumn(out, F.max(value).over(by(keys, index).rowsBetween(-(width // 2), after)))


def look_ahead(df: DataFrame, keys: list[str], index: str, state: str, rows: int, out: str, block: int | None = None) -> DataFrame:
    """True if this row or one of the next few is."""
    if block:
        return _in_blocks(lambda x, parts: look_ahead(x, parts, index, state, rows, out), df, keys, index, block, 0, rows)
    return df.withColumn(out, F.max(state).over(by(keys, index).rowsBetween(0, rows)))


def running_median(df: DataFrame, keys: list[str], index: str, value: str, width: int, out: str) -> DataFrame:
    """Median over an odd width with the end values repeated. A frame holds `width` values at most."""
    width |= 1
    half = width // 2
    w = by(keys, index)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = w.rowsBetween(-half, half)
    r = F.row_number().over(w)
    n = F.count("*").over(Window.partitionBy(*keys))
    lead = F.array_repeat(F.first(value).over(whole), F.greatest(half + 1 - r, F.lit(0)).cast("int"))
    tail = F.array_repeat(F.last(value).over(whole), F.greatest(r + half - n, F.lit(0)).cast("int"))
    return df.withColumn(out, F.get(F.sort_array(F.concat(lead, F.collect_list(value).over(near), tail)), F.lit(half)))


def box_mean_2d(df: DataFrame, keys: list[str], row: str, col: str, value: str, rows: int, cols: int, out: str) -> DataFrame:
    """Mean over a box, edges reflected (d c b a | a b c d | d c b a), one direction after the other."""

    def along(x: DataFrame, keep: list[str], index: str, k: int) -> DataFrame:
        if k <= 1:
            return x
        half = k // 2
        ends = x.groupBy(*keep).agg(F.min(index).alias("_lo"), F.max(index).alias("_hi"))
        x = x.join(ends, keep)
        i, lo, hi = F.col(index), F.col("_lo"), F.col("_hi")
        mirror = F.array(i, F.when(i - lo < half, 2 * lo - 1 - i), F.when(hi - i < half, 2 * hi + 1 - i))
        wide = x.select(*keep, F.explode(F.filter(mirror, lambda m: m.isNotNull())).alias(index), value, "_lo", "_hi")
        w = by(keep, index).rowsBetween(-half, k - 1 - half)
        wide = wide.withColumn(value, F.sum(value).over(w) / k)
        return wide.where((F.col(index) >= F.col("_lo")) & (F.col(index) <= F.col("_hi"))).drop("_lo", "_hi")

    one = along(df.select(*keys, row, col, value), [*keys, col], row, rows)
    return along(one, [*keys, row], col, cols).withColumnRenamed(value, out)


def hold(df: DataFrame, keys: list[str], index: str, values: list[str], block: Column | None = None) -> DataFrame:
    """The last value present; before the first, that one."""
    at = {v: F.col(v) for v in values}
    df = near(df, keys, index, last={f"_l{i}": c for i, c in enumerate(at.values())}, first={f"_f{i}": c for i, c in enumerate(at.values())}, block=block)
    return df.withColumns({v: F.coalesce(f"_l{i}", f"_f{i}") for i, v in enumerate(at)}).drop(*[f"_{s}{i}" for i in range(len(at)) for s in "lf"])


def runs(df: DataFrame, keys: list[str], index: str, flag: str, block: Column | None = None) -> DataFrame:
    """(keys, start, stop): stretches of consecutive rows where the flag holds; stop is one past the last."""
    if block is not None:
        cut = df.select(*keys, index, flag, block.alias("_block"))
        return stretches(cut, keys, index, flag, F.col("_block")).where(F.col(flag) & (F.col(index) == F.col("start"))).select(*keys, "start", "stop")
    at = F.col(index) - F.row_number().over(by(keys, index))
    return df.where(flag).withColumn("_run", at).groupBy(*keys, "_run").agg(F.min(index).alias("start"), (F.max(index) + 1).alias("stop")).drop("_run")


def long_run_mask(df: DataFrame, keys: list[str], index: str, flag: str, over: int, out: str, block: Column | None = None) -> DataFrame:
    """True in stretches of more than `over` rows."""
    if block is not None:
        return stretches(df, keys, index, flag, block).withColumn(out, F.col(flag) & (F.col("stop") - F.col("start") > over)).drop("start", "stop")
    marked = df.withColumn("_run", F.col(index) - F.row_number().over(Window.partitionBy(*keys, flag).orderBy(index)))
    n = F.count("*").over(Window.partitionBy(*keys, flag, "_run"))
    return marked.withColumn(out, F.col(flag) & (n > over)).drop("_run")


def pause_zones(df: DataFrame, keys: list[str], index: str, db: str, quiet: float, least: int, margin: int, block: Column | None = None) -> DataFrame:
    """Stretches at or under a level, `least` rows long at least, trimmed by a margin at both ends."""
    zones = runs(df.withColumn("_quiet", F.col(db) <= quiet), keys, index, "_quiet", block).where(F.col("stop") - F.col("start") >= least)
    return zones.select(*keys, (F.col("start") + margin).alias("start"), (F.col("stop") - margin).alias("stop")).where("stop > start")


def ramps(df: DataFrame, keys: list[str], index: str, state: str, ramp: int, out: str, block: Column | None = None) -> DataFrame:
    """Raised-cosine gain around a 0/1 state: rises in the `ramp` rows before it turns on, falls after it turns off."""
    i, s = F.col(index), F.col(state).cast("int")
    df = near(df, keys, index, before={"_was": F.struct(s.alias("s"))}, block=block)
    before = F.coalesce(F.col("_was.s"), s)
    on, off = F.when((s == 1) & (before == 0), i), F.when((s == 0) & (before == 1), i)
    df = near(df, keys, index, last={"_off": off}, after={"_on": on}, block=block)
    rise, fall = F.col("_on") - i, i - F.col("_off")
    curve = lambda left: F.when(left < ramp, 0.5 + 0.5 * F.cos(F.lit(3.141592653589793) * left / ramp)).otherwise(0.0)
    gain = F.when(s == 1, 1.0).otherwise(F.greatest(F.coalesce(curve(rise), F.lit(0.0)), F.coalesce(curve(fall + 1), F.lit(0.0))))
    return df.withColumn(out, gain).drop("_was", "_on", "_off")


def rank_norm(df: DataFrame, keys: list[str], value: str, ties: str, out: str, parts: int = 1) -> DataFrame:
    """Rank among the values present over their number less one; ties by another column.

    With `parts` a key's values are dealt into as many ranges, so that no task sorts a whole key.
    """
    if parts > 1:
        n = F.col("_n")
        df = _same(ranks(df, keys, value, ties, parts, "_rank"), df.groupBy(*keys).agg(F.count(value).alias("_n")), keys)
        return df.withColumn(out, F.when(F.col(value).isNotNull() & (n > 1), F.col("_rank") / (n - 1))).drop("_rank", "_n")
    w = Window.partitionBy(*keys, F.col(value).isNull()).orderBy(value, ties)
    n = F.count(value).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.when(F.col(value).isNotNull() & (n > 1), (F.row_number().over(w) - 1) / (n - 1)))


def circular_shift(df: DataFrame, index: str, n: int, lag: Column) -> DataFrame:
    return df.withColumn(index, F.pmod(F.col(index) + lag, F.lit(n)))


def gap_sessions(df: DataFrame, keys: list[str], index: str, label: str, gap: int) -> DataFrame:
    """(keys, label, start, length): runs of one label whose rows lie at most `gap` apart; another label ends a run."""
    w = by(keys, index)
    fresh = (F.lag(label).over(w) != F.col(label)) | (F.col(index) - F.lag(index).over(w) > gap) | F.lag(index).over(w).isNull()
    df = df.where(F.col(label).isNotNull()).withColumn("_new", fresh.cast("int"))
    df = df.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, label, "_run").agg(F.min(index).alias("start"), F.count("*").alias("length")).drop("_run")


def tumbling_trace(df: DataFrame, keys: list[str], index: str, value: str, power: str, n: int, least: int = 5) -> DataFrame:
    """Per window of n rows the median of the values present (NULL under `least`), their share and the level.

    The last window counts if at least half of it is there.
    """
    cut = df.groupBy(*keys, F.floor(F.col(index) / n).alias("window"))
    out = cut.agg(
        F.when(F.count(value) >= least, F.percentile(value, F.lit(0.5))).alias("median"),
        (F.count(value) / F.count("*")).alias("valid"),
        (10 * F.log10(F.avg(power) + 1e-12)).alias("db"),
        F.count("*").alias("rows"),
    )
    return out.where(F.col("rows") * 2 >= n).drop("rows")
