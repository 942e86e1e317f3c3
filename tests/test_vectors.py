"""Cosine k-means and the choice of k against plain loops, and what they cost."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.functions.numeric import unit
from chronoweave.operators import vectors


def plain(x, k, rounds=80):
    """Labels and centres by loops over all rows, in order of key."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = [x[0]]
    while len(c) < k:
        c.append(x[np.argmin((x @ np.array(c).T).max(axis=1))])
    for _ in range(rounds):
        label = (x @ np.array(c).T).argmax(axis=1)
        means = [x[label == i].mean(axis=0) if (label == i).any() else np.zeros(x.shape[1]) for i in range(k)]
        new = [np.round(m / np.linalg.norm(m), 12) if m.any() else c[i] for i, m in enumerate(means)]
        if all((a == b).all() for a, b in zip(new, c, strict=True)):
            break
        c = new
    return label, c


def plain_k(x, mixed, base, extra=3, share=0.04, least=3):
    best = base
    for k in range(base, min(base + extra, len(x)) + 1):
        n, m = (np.bincount(v, minlength=k) for v in (plain(x, k)[0], plain(x, k)[0][mixed]))
        if n.min() < max(share * n.sum(), 1) or m.min() < max(share * m.sum(), least):
            break
        best = k
    return best


def cloud(seed, n=240, dims=6, groups=5, lone=0):
    """Vectors about some directions, the first `lone` of them with no row in the mixture."""
    rng = np.random.default_rng(seed)
    at = rng.integers(0, groups, n)
    return rng.normal(size=(groups, dims))[at] + 0.5 * rng.normal(size=(n, dims)), (rng.random(n) < 0.5) & (at >= lone)


def table(spark, x, mixed=None):
    mixed = np.zeros(len(x), bool) if mixed is None else mixed
    return spark.createDataFrame([(i, v.tolist(), bool(m)) for i, (v, m) in enumerate(zip(x, mixed, strict=True))], "key long, v array<double>, m boolean").repartition(3)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_kmeans_equals_plain(spark, k):
    x, _ = cloud(k)
    got, centres = vectors.kmeans(table(spark, x), "key", "v", k)
    label, c = plain(x, k)
    assert [r.cluster for r in got.orderBy("key").collect()] == label.tolist() and np.allclose(centres, c, atol=1e-9)


@pytest.mark.parametrize("seed, lone", [(1, 0), (2, 0), (3, 1), (4, 2), (5, 3)])
def test_choose_k_equals_plain(spark, seed, lone):
    x, mixed = cloud(seed, lone=lone)
    assert vectors.choose_k(table(spark, x, mixed), "key", "v", 2, F.col("m")) == plain_k(x, mixed, 2)


def test_choose_k_takes_no_more_than_there_is(spark):
    x = np.eye(3).repeat(4, axis=0)
    assert vectors.choose_k(table(spark, x, np.ones(12, bool)), "key", "v", 2, F.col("m")) == 3  # a fourth centre would be a copy with no rows
    assert vectors.choose_k(table(spark, x, np.zeros(12, bool)), "key", "v", 2, F.col("m")) == 2
    assert vectors.choose_k(table(spark, np.zeros((4, 2)), np.ones(4, bool)), "key", "v", 2, F.col("m")) == 2  # no direction at all


def test_zero_short_and_nan_vectors_keep_their_place(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0]), (3, None), (4, [0.1, 1.0]), (5, [float("nan"), 1.0])]
    got = vectors.kmeans(spark.createDataFrame(rows, "key long, v array<double>"), "key", "v", 2)[0]
    assert {r.key: r.cluster for r in got.collect()} == {0: 0, 1: 1, 4: 1, 5: 0}


def test_runs_share_their_passes(spark):
    x, mixed = cloud(1)
    df = table(spark, x, mixed).cache()
    df.count()
    sc = spark.sparkContext
    jobs = {}
    for name, run in [("one", lambda: vectors.kmeans(df, "key", "v", 5)), ("all", lambda: vectors.choose_k(df, "key", "v", 2, F.col("m")))]:
        sc.setJobGroup(name, name)
        run()
        jobs[name] = len(sc.statusTracker().getJobIdsForGroup(name))
    sc.setLocalProperty("spark.jobGroup.id", None)
    most = max(len_of_run(x, k) for k in range(2, 6))
    assert jobs["all"] <= jobs["one"] + 2 * (most - len_of_run(x, 5)) + 4  # the longest run and a count, not four runs


def len_of_run(x, k):
    """Rounds until the centres rest."""
    return next(r for r in range(1, 81) if all((a == b).all() for a, b in zip(plain(x, k, r)[1], plain(x, k, r + 1)[1], strict=True))) + 1


def test_nothing_stays_cached(spark):
    held = spark.sparkContext._jsc.getPersistentRDDs
    x, mixed = cloud(6, n=60)
    before = held().size()
    vectors.kmeans(table(spark, x), "key", "v", 2)[0].count()
    vectors.choose_k(table(spark, x, mixed), "key", "v", 2, F.col("m"))
    assert held().size() == before


def test_unit_measures_a_vector_once(spark):
    df = spark.range(4).select(F.array(F.col("id") * 3, F.col("id") * 4).alias("v")).select(unit(F.col("v")).alias("u"))
    assert [r.u for r in df.collect()] == [None, [0.6, 0.8], [0.6, 0.8], [0.6, 0.8]]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
