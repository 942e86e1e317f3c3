"""Series too long for one task: sorted block by block, with one summary row a block for what crosses them, or with halos.

A block is a number that grows with the index. An index has one row; it may have gaps unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.frames import by, onward

Columns = dict[str, Column]


def near(df: DataFrame, keys: list[str], index: str, last: Columns = {}, before: Columns = {}, first: Columns = {}, after: Columns = {}, block: Column | None = None) -> DataFrame:  # noqa: B006
    """Adds by name the nearest value present of each column: `last` at or before a row, `before` it, `first` at or after it, `after` it.

    With a block, each block gets a row at either end that holds what the blocks before and after give it, so the rows are
    shuffled once and joined with nothing. Those end rows come from one summary row a block, which alone meet in a window by key.
    """
    back, on = last | before, first | after
    if block is None:
        return df.withColumns(_local(keys, [index], last, before, first, after))
    own = {n: f"_v{i}" for i, n in enumerate([*back, *on])}
    x = df.withColumn("_blk", block).withColumns({own[n]: c for n, c in (back | on).items()})
    at = {n: F.when(F.col(v).isNotNull(), F.col(index)) for n, v in own.items()}
    ends = x.groupBy(*keys, "_blk").agg(*[F.max_by(own[n], at[n]).alias(own[n]) for n in back], *[F.min_by(own[n], at[n]).alias(own[n]) for n in on])
    past, future = by(keys, "_blk").rowsBetween(Window.unboundedPreceding, -1), onward(keys, "_blk", start=1)
    carried = {own[n]: F.last(own[n], ignorenulls=True).over(past if n in back else future) for n in own}
    ends = ends.select(*keys, "_blk", *[c.alias(v) for v, c in carried.items()])
    kinds = dict(zip(ends.columns, (f.dataType for f in ends.schema), strict=True))
    edge = lambda side, held: F.struct(F.lit(side).alias("_edge"), *[(F.col(v) if n in held else F.lit(None).cast(kinds[v])).alias(v) for n, v in own.items()])
    ends = ends.select(*keys, "_blk", F.inline(F.array(edge(0, back), edge(2, on))))
    rows = x.withColumn("_edge", F.lit(1)).unionByName(ends, allowMissingColumns=True)
    pick = lambda names: {n: F.col(own[n]) for n in names}
    rows = rows.withColumns(_local([*keys, "_blk"], ["_edge", index], pick(last), pick(before), pick(first), pick(after)))
    return rows.where("_edge = 1").drop("_edge", "_blk", *own.values())


def _local(keys: list[str], order: list[str], last: Columns, before: Columns, first: Columns, after: Columns) -> Columns:
    w = Window.partitionBy(*keys).orderBy(*order)
    frames = [(last, w.rowsBetween(Window.unboundedPreceding, 0)), (before, w.rowsBetween(Window.unboundedPreceding, -1)), (first, onward(keys, *order)), (after, onward(keys, *order, start=1))]
    return {n: F.last(c, ignorenulls=True).over(f) for columns, f in frames for n, c in columns.items()}


def stretches(df: DataFrame, keys: list[str], index: str, flag: str, block: Column | None = None) -> DataFrame:
    """Adds `start` and `stop`, the first index and one past the last of the stretch around a row: one flag, no index left out."""
    here = F.struct(F.col(index).alias("i"), F.col(flag).alias("f"))
    df = near(df, keys, index, before={"_p": here}, after={"_n": here}, block=block)
    parted = lambda s, step: s.isNull() | ~s["f"].eqNullSafe(F.col(flag)) | (s["i"] - F.col(index) != step)
    begins, ends = F.when(parted(F.col("_p"), -1), F.col(index)), F.when(parted(F.col("_n"), 1), F.col(index) + 1)
    return near(df, keys, index, last={"start": begins}, first={"stop": ends}, block=block).drop("_p", "_n")


def halo(df: DataFrame, index: str, size: int, before: int, after: int) -> DataFrame:
    """Adds `_blk`, blocks of `size` indexes, and `_own`: each block has copies of the rows up to `before` indexes earlier and `after` later.

    Frames of so many rows are whole inside a block if the index has no gaps; keep the rows where `_own` holds.
    """
    i, at = F.col(index).cast("long"), lambda c: F.floor(c / F.lit(size))
    df = df.withColumn("_blk", F.explode(F.sequence(at(i - after), at(i + before))))
    return df.withColumn("_own", F.col("_blk") == at(i))
