"""Draws with replacement by weight, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.operators.order import _same, before, ranges


def seeded(draw: Column, seed: int) -> Column:
    """A number in [0, 1) from a whole number under 2^31, by arithmetic that any engine has."""
    x = (draw * 1103515245 + F.lit(12345 + seed)) % 2147483648
    y = (x * (x % 65536 + 1) + F.lit(seed)) % 2147483647
    return y / F.lit(2147483647.0)


def points(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(draw, u) for n draws."""
    return spark.range(n).select(F.col("id").alias("draw"), seeded(F.col("id"), seed).alias("u"))


def prefix_sums(df: DataFrame, key: str, weight: str, parts: int) -> DataFrame:
    """(key, start, stop): the sum of whole-numbered weights before each row and with it, in order of a key that no two rows share.

    Each range of keys is summed by itself and starts from the sums of those before, so no task sorts all rows.
    """
    rows = ranges(df.where(F.col(weight) > 0).select(key, F.col(weight).cast("long").alias("_w")), [], key, parts)
    rows = _same(rows, before(rows, [], "_part", F.sum("_w"), "_start"), ["_part"])
    here = F.sum("_w").over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(key, (F.col("_start") + here - F.col("_w")).alias("start"), (F.col("_start") + here).alias("stop"))


def weighted_draws(df: DataFrame, key: str, weight: str, drawn: DataFrame, parts: int = 32) -> DataFrame:
    """(draw, key): the row that each point (draw, u in [0, 1)) falls on, if every row takes a share of the line as its weight.

    Rows of no weight (NULL, 0 or less) are never drawn; without any other there are no draws. The line is cut into as many cells
    as there are rows: a row stands in the cells that it reaches into, two a row on average, and a point meets its cell's rows
    alone. A row of most of the weight has most of the cells, and its points are as evenly spread.
    """
    sums = prefix_sums(df, key, weight, parts)
    whole = sums.agg(F.max("stop").alias("_total"), F.count("*").alias("_rows")).where("_total is not null")
    cell = lambda at: F.floor(at * F.col("_rows") / F.col("_total")).cast("long")
    rows = sums.join(F.broadcast(whole), how="cross")
    rows = rows.select(key, "start", "stop", F.explode(F.sequence(cell(F.col("start")), cell(F.col("stop") - 1))).alias("_cell"))
    at = drawn.join(F.broadcast(whole), how="cross").withColumn("_at", F.floor(F.col("u") * F.col("_total")).cast("long"))
    at = at.select("draw", "_at", cell(F.col("_at")).alias("_cell"))
    return at.join(rows, "_cell").where((F.col("_at") >= F.col("start")) & (F.col("_at") < F.col("stop"))).select("draw", key)
