"""Embedding vectors: nearest and relative similarity, cosine k-means, shares and claims of clusters."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.numeric import cosine, dot, unit


def mean_vector(df: DataFrame, keys: list[str], vector: str, weight: Column | None = None, out: str = "mean") -> DataFrame:
    """Weighted mean by dimension, pre-aggregated map-side; no group is gathered."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    dims = df.select(*keys, w.alias("_w"), F.posexplode(vector).alias("_d", "_x"))
    dims = dims.groupBy(*keys, "_d").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_x"))
    return dims.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_d", "_x"))), lambda s: s["_x"]).alias(out))


def even_sample(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """At most n rows per key at evenly spaced places, both ends included."""
    w = Window.partitionBy(*keys)
    df = df.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    spot = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * (F.col("_n") - 1) / F.lit(max(n - 1, 1))))
    return df.where((F.col("_n") <= n) | F.array_contains(spot, F.col("_i").cast("long"))).drop("_i", "_n")


def nearest_reference(df: DataFrame, refs: DataFrame, ids: list[str], vector: str, ref: str, ref_vector: str) -> DataFrame:
    """The reference of the greatest cosine, of ties the least, and that cosine.

    The references are few (faces, centroids), so they travel to the vectors, which are not shuffled.
    """
    held = refs.agg(F.collect_list(F.struct(F.col(ref).alias("r"), F.col(ref_vector).alias("v"))).alias("_refs"))
    df = df.crossJoin(F.broadcast(held))
    each = F.transform("_refs", lambda x: F.struct(dot(F.col(vector), x["v"]).alias("score"), (-x["r"]).alias("neg")))
    best = F.array_max(each)
    return df.withColumn("_b", best).select(*ids, (-F.col("_b.neg")).alias(ref), F.col("_b.score").alias("score"))


def relative_score(df: DataFrame, refs: DataFrame, ids: list[str], own: str, vector: str, ref: str, ref_vector: str) -> DataFrame:
    """cos(own reference) less the greatest cosine of any other reference; 1.0 where there is no other."""
    held = refs.agg(F.collect_list(F.struct(F.col(ref).alias("r"), F.col(ref_vector).alias("v"))).alias("_refs"))
    df = df.crossJoin(F.broadcast(held))
    scores = F.transform("_refs", lambda x: F.struct(x["r"].alias("r"), dot(F.col(vector), x["v"]).alias("s")))
    df = df.withColumn("_s", scores)
    mine = F.array_max(F.transform(F.filter("_s", lambda x: x["r"] == F.col(own)), lambda x: x["s"]))
    rival = F.array_max(F.transform(F.filter("_s", lambda x: x["r"] != F.col(own)), lambda x: x["s"]))
    return df.select(*ids, own, F.when(rival.isNull(), 1.0).otherwise(mine - rival).alias("score"))


def accepts(df: DataFrame, vector: str, refs: DataFrame, ref_vector: str, least: float = 0.5) -> DataFrame:
    """Adds `best`, the greatest cosine to any stored vector (-1 without a vector, NULL without stored ones), and `match`."""
    held = refs.agg(F.collect_list(ref_vector).alias("_refs"))
    df = df.crossJoin(F.broadcast(held))
    best = F.when(F.size("_refs") > 0, F.when(F.col(vector).isNull(), -1.0).otherwise(F.array_max(F.transform("_refs", lambda r: cosine(F.col(vector), r)))))
    return df.withColumn("best", best).withColumn("match", F.coalesce(F.col("best") >= least, F.lit(False))).drop("_refs")


def cluster_shares(df: DataFrame, owner: str, cluster: str) -> DataFrame:
    """Share of each cluster in each owner's rows, 0 where it has none."""
    counts = df.groupBy(owner, cluster).agg(F.count("*").alias("_n"))
    grid = df.select(owner).distinct().crossJoin(F.broadcast(df.select(cluster).distinct()))
    full = grid.join(counts, [owner, cluster], "left").fillna({"_n": 0})
    return full.select(owner, cluster, (F.col("_n") / F.sum("_n").over(Window.partitionBy(owner))).alias("share"))


def kmeans(df: DataFrame, key: str, vector: str, k: int, rounds: int = 80) -> tuple[DataFrame, list[list[float]]]:
    """Cosine k-means: (key, cluster) and the centres.

    The first centre is the vector of the least key, the others the farthest from those chosen (of ties the least key).
    An empty cluster keeps its centre. Stops when no label changes. Only centres reach the driver.
    """
    rows = _units(df, key, vector)
    held = rows.cache()
    try:
        starts = _spread(held, key, k)
        before, centres, _ = _move(held, {k: starts}, rounds).get(k, ([], starts, []))
    finally:
        held.unpersist()
    label = F.lit(0)
    if before:
        each = F.array(*[F.struct(dot(F.col("_v"), _lit(c)).alias("s"), F.lit(-i).alias("n")) for i, c in enumerate(before)])
        label = -F.array_max(each)["n"]
    return rows.withColumn("cluster", label).select(key, "cluster"), centres


def _lit(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def _units(df: DataFrame, key: str, vector: str, mixture: Column | None = None) -> DataFrame:
    """(key, _v, _m): unit vectors, and 1 for a row of the mixture."""
    mixed = F.lit(0) if mixture is None else F.coalesce(mixture.cast("int"), F.lit(0))
    return df.select(key, unit(F.col(vector)).alias("_v"), mixed.alias("_m")).where("_v is not null")


def _spread(rows: DataFrame, key: str, k: int) -> list[list[float]]:
    """First centres: the vector of the least key, then the farthest from those chosen. A smaller k has the first of them."""
    centres = [r[0] for r in rows.orderBy(key).limit(1).select("_v").collect()]
    while centres and len(centres) < k:
        far = rows.withColumn("_c", F.greatest(*[dot(F.col("_v"), _lit(c)) for c in centres]) if len(centres) > 1 else dot(F.col("_v"), _lit(centres[0])))
        centres.append(far.orderBy("_c", key).limit(1).select("_v").first()[0])
    return centres


def _move(rows: DataFrame, starts: dict[int, list[list[float]]], rounds: int, last: Callable[[list[tuple[int, int]]], bool] = lambda counts: False) -> dict[int, tuple]:
    """Moves the centres of several runs, by their k: the centres that gave the labels, the moved ones and per cluster (n, mixed).

    A pass over the rows serves all runs that still move. When `last` holds for the counts of a run that has come to rest,
    those of a greater k are given up.
    """
    moving, found = {k: c for k, c in starts.items() if c}, {}
    for left in range(rounds, 0, -1):
        if not moving:
            break
        sums = _sums(rows, moving)
        for k, before in sorted(moving.items()):
            centres, counts = list(before), []
            for i in range(len(before)):
                n, mixed, mean = sums.get((k, i), (0, 0, []))
                counts.append((n, mixed))
                norm = sum(x * x for x in mean) ** 0.5
                if norm > 0:
                    centres[i] = [round(x / norm, 12) for x in mean]
            moving[k] = centres
            if centres == before or left == 1:  # equal labels give equal centres: one pass a round settles both
                found[k] = before, centres, counts
                del moving[k]
                if last(counts):
                    moving = {j: c for j, c in moving.items() if j < k}
                    break
    return found


#: Vectors that are compared at once in a task.
CHUNK = 2048


def _sums(rows: DataFrame, runs: dict[int, list[list[float]]]) -> dict[tuple[int, int], tuple[int, int, list[float]]]:
    """By run and nearest centre: rows, rows of the mixture and the mean vector. A task sends one sum a cluster, no row is shuffled.

    Products are added dimension by dimension, as dot() does, so that labels are equal to its labels to the last bit.
    """
    centres = [(k, i, np.array(c)) for k, cs in runs.items() for i, c in enumerate(cs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = {}

        def add(v: np.ndarray, m: np.ndarray) -> None:
            scores = np.full((len(centres), len(v)), -np.inf)
            same = [at for at, (_, _, c) in enumerate(centres) if len(c) == v.shape[1]]
            if same:
                c, total = np.array([centres[at][2] for at in same]), np.zeros((len(same), len(v)))
                for d, x in enumerate(np.ascontiguousarray(v.T)):
                    total += c[:, d, None] * x
                scores[same] = total
            for k in runs:
                mine = [at for at, c in enumerate(centres) if c[0] == k]
                label = scores[mine].argmax(axis=0)
                for i in np.unique(label).tolist():
                    held = label == i
                    n, mixed, s = out.get((k, i, v.shape[1]), (0, 0, 0.0))
                    out[k, i, v.shape[1]] = n + int(held.sum()), mixed + int(m[held].sum()), s + v[held].sum(axis=0)

        for batch in batches:
            size = np.diff(batch.column(0).offsets.to_numpy())
            flat, m = batch.column(0).flatten().to_numpy(), batch.column(1).to_numpy()
            for one in np.unique(size).tolist():
                v, some = flat[np.repeat(size == one, size)].reshape(-1, one), m[size == one]
                for low in range(0, len(v), CHUNK):
                    add(v[low : low + CHUNK], some[low : low + CHUNK])
        if out:
            cols = zip(*[(k, i, n, mixed, s.tolist()) for (k, i, _), (n, mixed, s) in out.items()], strict=True)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], ["k", "i", "n", "mixed", "s"])

    parts = rows.select("_v", "_m").mapInArrow(run, "k int, i int, n long, mixed long, s array<double>")
    parts = parts.select("k", "i", "n", "mixed", F.posexplode("s").alias("d", "x"))
    # sorted, so that a sum doesn't hang on which task ends first, and centres come to rest
    total = F.aggregate(F.sort_array(F.collect_list("x")), F.lit(0.0), lambda s, x: s + x)
    found = parts.groupBy("k", "i", "d").agg(F.sum("n").alias("n"), F.sum("mixed").alias("mixed"), total.alias("x")).collect()
    means: dict[tuple[int, int], list] = {}
    for r in sorted(found, key=lambda r: r["d"]):
        at = means.setdefault((r["k"], r["i"]), (r["n"], r["mixed"], []))
        at[2].append(r["x"] / r["n"])
    return means


def choose_k(df: DataFrame, key: str, vector: str, base: int, mixture: Column | None = None, extra: int = 3, share: float = 0.04, least: int = 3) -> int:
    """Grows k from `base` while every cluster keeps a share of all rows and of the mixture's rows; base without a mixture.

    The runs of all k start from the first of the same centres and share their passes over the rows.
    """
    n = df.count()
    if mixture is None or not n:
        return base
    ks = range(base, min(base + extra, n) + 1)

    def poor(counts: list[tuple[int, int]]) -> bool:
        rows, mixed = zip(*counts, strict=True)
        return min(rows) < max(share * sum(rows), 1) or min(mixed) < max(share * sum(mixed), least)

    held = _units(df, key, vector, mixture).cache()
    try:
        starts = _spread(held, key, max(ks, default=0))
        found = _move(held, {k: starts[: max(k, 1)] for k in ks}, 80, poor)
    finally:
        held.unpersist()
    return max(itertools.takewhile(lambda k: k in found and not poor(found[k][2]), ks), default=base)


def purity(shares: DataFrame, held: DataFrame, owner: str, cluster: str) -> DataFrame:
    """Share of the claimed cluster in its owner's rows."""
    return held.join(shares, [owner, cluster]).select(owner, cluster, F.col("share").alias("purity"))
