"""Tracks over a table and over a stream against a plain replay."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chronoweave.operators.reid import Reid, reidentify
from chronoweave.streaming.reid import reidentified

S = Reid(0.8, 5)


def replay(rows, s):
    """Every row in order, by loops alone."""
    out, keys = {}, {}
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1])):
        keys.setdefault(r[0], {}).setdefault(r[1], []).append(r)
    for k, frames in keys.items():
        live, made = {}, 0
        for at in sorted(frames):
            live = {t: v for t, v in live.items() if at - v[0] <= s.gap}
            dets = sorted(frames[at], key=lambda r: r[2])
            unit = {r[2]: [x / math.hypot(*r[3]) for x in r[3]] for r in dets if r[3] and math.hypot(*r[3]) > 0}
            pairs = []
            for d, u in unit.items():
                for t, (_, total) in live.items():
                    like = sum(a * b for a, b in zip(u, total, strict=True)) / math.hypot(*total)
                    if like > s.same:
                        pairs.append((-like, t, d))
            got, used = {}, set()
            for _, t, d in sorted(pairs):
                if d not in got and t not in used:
                    got[d] = t
                    used.add(t)
            for d in unit:
                if d not in got:
                    got[d], made = made, made + 1
                total = live[got[d]][1] if got[d] in live else [0.0] * len(unit[d])
                live[got[d]] = (at, [a + b for a, b in zip(total, unit[d], strict=True)])
            out |= {(k, at, r[2]): got.get(r[2]) for r in dets}
    return out


def detections(n=240, keys=("a", "b", "c")):
    rng = random.Random(3)
    who = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    out = []
    for det in range(n):
        v = None if rng.random() < 0.03 else [0.0] * 6 if rng.random() < 0.03 else [x + rng.gauss(0, 0.25) for x in rng.choice(who)]
        out.append((rng.choice(keys), 1 + det // 4 + (40 if det > n // 2 else 0), det, v))
    return out


SCHEMA = "k string, at long, det long, v array<double>"


def rows_of(df):
    return {(r["k"], r["at"], r["det"]): r["track"] for r in df.collect()}


def test_table_equals_replay(spark):
    rows = detections(keys=("a", "b", None)) + [("a", None, 999, [1.0] * 6)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = reidentify(spark.createDataFrame(rows, SCHEMA).withColumn("track_", F.lit(1)), "k", "at", "det", "v", S)
        got = rows_of(df)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == replay(rows, S) | {("a", None, 999): None}
    assert len(set(got.values())) < 40 and rows_of(reidentify(spark.createDataFrame([], SCHEMA), "k", "at", "det", "v")) == {}


def test_a_track_ends_after_its_gap(spark):
    rows = [("a", at, at, [1.0, 0.0]) for at in (0, 5, 10, 16)]
    assert rows_of(reidentify(spark.createDataFrame(rows, SCHEMA), "k", "at", "det", "v", S)) == {("a", 0, 0): 0, ("a", 5, 5): 0, ("a", 10, 10): 0, ("a", 16, 16): 1}


def test_stream_equals_replay_over_a_restart(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, src, out = detections(), str(tmp_path / "in"), str(tmp_path / "out")
    rng = random.Random(1)
    parts = [rows[:100], rows[100:180], rows[180:]]
    try:
        state = []
        for n, part in enumerate([*parts, [(k, 100_000, 10_000 + i, [1.0] * 6) for i, k in enumerate("abc")]]):
            rng.shuffle(part)
            spark.createDataFrame(part, SCHEMA).withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(SCHEMA + ", ts timestamp").parquet(src)
            q = reidentified(stream, "k", "ts", "det", "v", S, "2 seconds").withColumnRenamed("key", "k")
            q = q.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            q.awaitTermination()  # each part is a run of its own that starts from the checkpoint
            state.append([p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators][-1])
        got = rows_of(spark.read.parquet(out))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert got == replay(rows, S)
    assert state[-1] <= state[0] + 6  # the tracks of the past have ended


def test_query_equals_replay(spark):
    from chronoweave.plans import catalog, entities

    data = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select(F.pmod(F.xxhash64("vec_id"), F.lit(8)), F.floor(F.col("vec_id") / 16), "vec_id", F.col("embedding").cast("array<double>")).collect()
    got = {(r["camera"], r["at"], r["vec_id"]): r["track"] for r in catalog.queries()["reidentified"](spark, data).collect()}
    want = replay([tuple(r) for r in rows], Reid(entities.ALIKE, 40))
    assert got == want and len({(k[0], t) for k, t in want.items()}) < len(want)
