"""Order statistics of groups that no task could sort or hold: quantiles by counting, ranks by ranges.

Both start from Spark's quantile sketch, whose error is bounded, and end in exact counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of the sketch: a quantile's rank is off by n / ACCURACY at most.
ACCURACY = 10_000
#: Half the bracket that is counted exactly, as a share of n: ten times the error.
HALF = 10 / ACCURACY
#: Groups up to this size are their own bracket.
SMALL = 10_000
#: Keys that travel to their rows, at most.
MOST = 4096


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joined by keys, of which there may be none (then right has one row); a NULL key is a group."""
    if not keys:
        return left.join(F.broadcast(right), how="cross" if how == "inner" else how)
    own = [f"_key{i}" for i in range(len(keys))]
    right = right.withColumnsRenamed(dict(zip(keys, own, strict=True)))
    on = [F.col(f"`{k}`").eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)]
    return left.join(right, on, how).drop(*own)


def _spread(left: DataFrame, right: DataFrame, keys: list[str], n: str) -> DataFrame:
    """_same(left, right, keys) where n of right is a key's rows: the 4,096 largest keys travel to their rows, which aren't shuffled.

    A join by key alone sorts all rows of a key in one task. Of the other keys each has at most 1/4096 of all rows.
    """
    if not keys:
        return _same(left, right, keys).drop(n)
    own = [f"_key{i}" for i in range(len(keys))]
    right = right.withColumnsRenamed(dict(zip(keys, own, strict=True)))
    on = [F.col(f"`{k}`").eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)]
    large = F.broadcast(right.orderBy(F.desc(n), *own).limit(MOST))
    hot = left.join(large, on).drop(*own, n)
    if right.limit(MOST + 1).count() <= MOST:
        return hot
    rest = left.join(large.select(*own), on, "left_anti")
    return hot.unionByName(rest.join(right, on).drop(*own, n))


def quantile(df: DataFrame, keys: list[str], value: str, q: float, out: str = "quantile", rows: str | None = None) -> DataFrame:
    """(keys, out): the exact q-quantile of each key's values, between neighbours by their distance, as `percentile` gives it.

    `percentile` holds all distinct values of a key in one task. Here a sketch brackets the rank, rows below the bracket are
    counted where they are, and only the bracket's distinct values, 0.0024 of the key at most beside ties, are put in order.
    NULL and NaN values count for nothing; a key without others has NULL. With `rows` a column of that name has the count of values.
    """
    x = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{value}`").cast("double").alias("_x"))
    x = x.withColumn("_x", F.when(~F.isnan("_x"), F.col("_x")))
    ends = F.percentile_approx("_x", F.array(F.lit(max(0.0, q - HALF)), F.lit(min(1.0, q + HALF))), F.lit(ACCURACY))
    ref = x.groupBy(*keys).agg(F.count("_x").alias("_n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"), ends.alias("_e"))
    whole = F.col("_n") <= SMALL
    low = F.when(whole | F.lit(q <= HALF), F.col("_min")).otherwise(F.col("_e")[0])
    high = F.when(whole | F.lit(q >= 1 - HALF), F.col("_max")).otherwise(F.col("_e")[1])
    ref = ref.select(*keys, "_n", low.alias("_low"), high.alias("_high"))
    met = _spread(x, ref.withColumn("_rows", F.col("_n")), keys, "_rows").where(F.col("_x") <= F.col("_high"))
    # Below the bracket all rows of a key are one group, whose place in the order is first.
    inside = F.when(F.col("_x") >= F.col("_low"), F.col("_x"))
    counts = met.groupBy(*keys, "_n", inside.alias("_v")).agg(F.count("*").alias("_c"))
    so_far = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_upto", F.sum("_c").over(so_far))
    at = (F.col("_n") - 1) * F.lit(float(q))
    first = F.min(F.when(F.col("_upto") > F.floor(at), F.col("_v")))
    second = F.min(F.when(F.col("_upto") > F.ceil(at), F.col("_v")))
    found = counts.groupBy(*keys, "_n").agg(first.alias("_a"), second.alias("_b"))
    share = at - F.floor(at)
    exact = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((1 - share) * F.col("_a") + share * F.col("_b"))
    found = found.select(*keys, exact.alias(out))
    own = [F.col("_n").alias(rows)] if rows else []
    return _same(ref.select(*keys, *own), found.select(*keys, out), keys, "left")


def ranges(df: DataFrame, keys: list[str], value: str, parts: int, out: str = "_part") -> DataFrame:
    """Adds the number of a row's range, 0 to parts - 1: ranges of a key follow each other in value and hold about as many rows.

    Bounds are quantiles of a sketch, one row a key. Equal values share a range. NULL is in range 0.
    """
    steps = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    bounds = df.groupBy(*keys).agg(F.percentile_approx(F.col(f"`{value}`"), steps, F.lit(max(ACCURACY, 20 * parts))).alias("_bounds"))
    met = _same(df, bounds, keys)
    over = F.size(F.filter("_bounds", lambda b: b < F.col(f"`{value}`")))
    return met.withColumn(out, F.when(F.col(f"`{value}`").isNotNull() & F.col("_bounds").isNotNull(), over).otherwise(0)).drop("_bounds")


def before(df: DataFrame, keys: list[str], part: str, count: Column, out: str) -> DataFrame:
    """(keys, part, out): the sum of `count` over the parts of a key before each part; one row a part meets in a window."""
    sums = df.groupBy(*keys, part).agg(count.alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias(out))


def ranks(df: DataFrame, keys: list[str], value: str, ties: str, parts: int, out: str = "rank") -> DataFrame:
    """Adds the rank from 0 of each value of a key, ties by another column; NULL values have none.

    A window over the key would sort it in one task. Here each range of values is sorted by itself and starts from the
    number of rows in the ranges before.
    """
    known = ranges(df.where(F.col(f"`{value}`").isNotNull()), keys, value, parts)
    starts = before(known, keys, "_part", F.count("*"), "_before")
    met = _same(known, starts, [*keys, "_part"])
    here = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(value, ties)) - 1
    ranked = met.withColumn(out, (F.col("_before") + here).cast("long")).drop("_part", "_before")
    return ranked.unionByName(df.where(F.col(f"`{value}`").isNull()).withColumn(out, F.lit(None).cast("long")))
