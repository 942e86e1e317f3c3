"""Operators in blocks give the rows that they give on whole series."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import blocks, gates, resample, windows

K = ["k"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    out = []
    for k, n, gaps in (("a", 300, True), ("b", 1, False), ("c", 97, False), (None, 120, True), ("none", 40, False)):
        i = rng.randrange(5)
        for _ in range(n):
            flag = None if rng.random() < 0.03 else rng.random() < 0.7
            v = rng.random() if k != "none" and rng.random() < 0.2 else None
            out.append((k, i, v, flag, int(rng.random() < (0.02 if k == "c" else 0.4)), rng.random()))
            i += 1 + (rng.randrange(1, 30) if gaps and rng.random() < 0.1 else 0)
    return spark.createDataFrame(out, "k string, i long, v double, flag boolean, state int, x double").repartition(3).cache()


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    key = lambda r: tuple((v is None, v) for v in r)
    got, want = (sorted(map(tuple, x.select(*cols).collect()), key=key) for x in (a, b))
    assert got == want and want


@pytest.mark.parametrize("size", [1, 7, 64, 100_000])
@pytest.mark.parametrize(
    "fn",
    [
        lambda d, b: windows.hold(d, K, "i", ["v", "flag"], b),
        lambda d, b: windows.long_run_mask(d, K, "i", "flag", 2, "long", b),
        lambda d, b: windows.runs(d, K, "i", "flag", b),
        lambda d, b: windows.pause_zones(d, K, "i", "x", 0.7, 2, 0, b),
        lambda d, b: windows.ramps(d, K, "i", "state", 4, "gain", b),
        lambda d, b: resample.last_and_next(d, K, "i", "v", b),
        lambda d, b: resample.interpolate(d, K, "i", "v", "line", b),
        lambda d, b: gates.lift(d.where("state = 1").select("k", "i", F.col("x").alias("s")), d.select("k", "i"), K, "i", "s", 3.0, b),
    ],
    ids=["hold", "long_run_mask", "runs", "pause_zones", "ramps", "last_and_next", "interpolate", "lift"],
)
def test_blocks_equal_whole_series(rows, fn, size):
    same(fn(rows, F.floor(F.col("i") / size)), fn(rows, None))


@pytest.mark.parametrize("size", [1, 7, 500])
def test_halos_equal_whole_series(rows, size):
    dense = rows.where("k in ('b', 'c', 'none')")
    for k in (1, 4, 9):
        same(windows.present_boxcar(dense, K, "i", "v", k, "o", size), windows.present_boxcar(dense, K, "i", "v", k, "o"))
        same(windows.dilate(dense, K, "i", "x", k, "o", size), windows.dilate(dense, K, "i", "x", k, "o"))
        same(windows.look_ahead(dense, K, "i", "state", k, "o", size), windows.look_ahead(dense, K, "i", "state", k, "o"))
        r = lambda d: d.withColumn("o", F.round("o", 9))
        same(r(windows.boxcar(dense, K, "i", "x", k, "o", size)), r(windows.boxcar(dense, K, "i", "x", k, "o")))


@pytest.mark.parametrize("size", [3, 50])
def test_resample_in_blocks(rows, size):
    dense = rows.where("k in ('b', 'c', 'none')").withColumn("i", F.row_number().over(windows.by(K, "i")) - 1)
    go = lambda b: resample.resample_hold(dense, K, "i", "v", 2.0, [], 130, 3.0, 1.5, block=b)
    same(go(F.floor(F.col("i") / size)), go(None))


def test_empty_series(spark, rows):
    none = rows.limit(0)
    assert windows.runs(none, K, "i", "flag", F.col("i")).count() == 0
    assert windows.hold(none, K, "i", ["v"], F.col("i")).columns == rows.columns


def test_no_task_gets_a_whole_series(spark):
    df = spark.range(200_000).select(F.lit("a").alias("k"), F.col("id").alias("i"), F.when(F.col("id") % 50_000 == 0, F.col("id")).alias("v"))
    out = blocks.near(df, K, "i", last={"p": F.col("v")}, block=F.floor(F.col("i") / 4096))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("t")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 120_000 and sum(sizes) == 200_000
    assert out.where("p != i - i % 50000").count() == 0
