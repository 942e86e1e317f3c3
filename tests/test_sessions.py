"""Sessions over a stream against those over a table: files out of order, late rows, a restart between files."""

import random

from pyspark.sql import functions as F

from chronoweave.operators import windows as wi
from chronoweave.plans.streams import ROCKS, STORE
from chronoweave.streaming.sessions import gap_sessions

SCHEMA = "user string, sec long, id long, kind string"


def test_stream_equals_table_over_files_out_of_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(3000), i, rng.choice(["x", "x", "x", "y", None])) for i in range(400)] + [(None, 7, 900, "x"), (None, 8, 901, "y"), ("a", None, 902, "x")]
    rng.shuffle(rows)
    parts = [[r for r in rows if r[1] is None or lo <= r[1] < lo + 1000] for lo in (0, 1000, 2000)]
    swap = [r for r in parts[1] if r[1] is not None and r[1] < 1040]  # these come a file too late, but inside the watermark's delay
    parts[1], parts[2] = [r for r in parts[1] if r not in swap and r[1] is not None], [r for r in parts[2] if r[1] is not None]
    parts[0] = parts[0] + [("z", 1100, 903, "x")]
    parts[1] += swap
    late = [("a", 5, 904, "y"), ("b", 6, 905, "y"), ("c", 100, 906, "x")]
    flush = [("z", 90_000, 999, "end")]
    src, out, old = str(tmp_path / "in"), str(tmp_path / "out"), spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    dropped = []
    try:
        for part in (*parts, late, flush):
            spark.createDataFrame(part, SCHEMA).withColumn("ts", F.timestamp_seconds("sec")).coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(SCHEMA + ", ts timestamp").parquet(src)
            q = gap_sessions(stream, "user", "ts", "id", "kind", 10, 5, "200 seconds").writeStream.format("parquet")
            q = q.option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            q.awaitTermination()
            dropped.append(sum(o.numRowsDroppedByWatermark for p in q.recentProgress for o in p.stateOperators))
        left = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators][-1]
    finally:
        spark.conf.set(STORE, old)
    got = sorted(map(tuple, spark.read.parquet(out).collect()), key=str)
    df = spark.createDataFrame([r for p in parts for r in p if r[1] is not None], SCHEMA)
    first = df.groupBy("user", F.floor(F.col("sec") / 10).alias("at")).agg(F.min(F.struct("sec", "id", "kind")).alias("e"))
    want = wi.gap_sessions(first.select("user", "at", F.col("e.kind").alias("label")), ["user"], "at", "label", 5)
    assert got == sorted(map(tuple, want.collect()), key=str) and len(got) > 60
    assert dropped == [0, 0, 0, 3, 0] and left < 8


def test_few_state_calls_a_key():
    """Each access to state is a call out of Python; a key of 200 frames had some hundreds of them a batch."""
    import pandas as pd

    from chronoweave.streaming.sessions import Sessions

    calls, timers = [], []

    class Store:
        value = None

        def __getattr__(self, name):
            return lambda *a: calls.append(name) or False

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            calls.append("clear")
            self.value = None

    class Handle:
        def getValueState(self, *_):
            return Store()

        def getMapState(self, *_):
            return Store()

        def registerTimer(self, at):
            calls.append("timer")
            timers.append(at)

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    s = Sessions(10, 5)
    s.init(Handle())
    df = pd.DataFrame({"at": range(200), "us": range(200), "tie": range(200), "label": ["x"] * 100 + ["y"] * 100})
    list(s.handleInputRows(("k",), iter([df.sample(frac=1, random_state=1)]), At(0)))
    assert len(calls) <= 4 and timers == [10_000]
    out = pd.concat(s.handleExpiredTimer(("k",), At(5_000_000), None))
    assert out.values.tolist() == [["k", "x", 0, 100], ["k", "y", 100, 100]] and len(calls) <= 8
