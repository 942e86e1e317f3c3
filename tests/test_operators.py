"""Operators against plain loops and known answers."""

import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoweave.operators import entity, fragments, frames, gates, matching, metrics, order, report, resample, sampling, spectral, vectors, windows


def machine(v, hi, lo, on, off):
    """The two-threshold machine as a loop."""
    out, state, up, dn = [], 0, 0, 0
    for i, x in enumerate(v):
        up = up + 1 if x is not None and x > hi else 0
        dn = dn + 1 if x is not None and x < lo else 0
        if not state and up >= on:
            state = 1
            for k in range(i - on + 1, i):
                out[k] = 1
        elif state and dn >= off:
            state = 0
        out.append(state)
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.one_of(st.none(), st.floats(-5, 5)), min_size=1, max_size=40), min_size=1, max_size=6), st.integers(1, 4), st.integers(1, 4))
def test_hysteresis(spark, series, on, off):
    rows = [(k, i, v) for k, s in enumerate(series) for i, v in enumerate(s)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    got = gates.hysteresis(df, ["k"], "i", "v", F.lit(1.0), F.lit(-1.0), on, off).orderBy("k", "i").toPandas()
    for k, s in enumerate(series):
        assert got[got.k == k].state.tolist() == machine(s, 1.0, -1.0, on, off)


@pytest.mark.parametrize("on,off,size", [(1, 1, 1), (2, 3, 4), (5, 4, 3), (3, 2, 1000)])
def test_hysteresis_by_blocks(spark, on, off, size):
    rng = np.random.default_rng(on)
    long = [[None if rng.random() < 0.05 else float(x) for x in np.repeat(rng.normal(0, 2, 40), rng.integers(1, 7, 40))], [3.0] * 30, [-3.0] * 9, [0.0], [None] * 5]
    rows = [(k or None, i, v) for k, s in enumerate(long) for i, v in enumerate(s)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    got = gates.hysteresis(df, ["k"], "i", "v", F.lit(1.0), F.lit(-1.0), on, off, block=F.floor(F.col("i") / size)).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"k", "i", "v", "state"}
    for k, s in enumerate(long):
        assert [r.state for r in sorted((r for r in got if r.k == (k or None)), key=lambda r: r.i)] == machine(s, 1.0, -1.0, on, off)


def series(spark, values):
    return spark.createDataFrame([(0, i, None if v is None else float(v)) for i, v in enumerate(values)], "k int, i int, v double")


@pytest.mark.parametrize("k", [1, 4, 5])
def test_boxcar_is_same_convolution(spark, k):
    x = np.random.default_rng(1).normal(size=30)
    got = windows.boxcar(series(spark, x), ["k"], "i", "v", k, "m").orderBy("i").toPandas().m
    assert np.allclose(got, np.convolve(x, np.ones(k) / k, mode="same"))


def test_boxcar_abstains_on_short_series(spark):
    assert windows.boxcar(series(spark, [1, 2]), ["k"], "i", "v", 5, "m").toPandas().m.isna().all()


def test_running_median_repeats_ends(spark):
    x = [5, 1, 9, 2, 2, 8, 0]
    got = windows.running_median(series(spark, x), ["k"], "i", "v", 3, "m").orderBy("i").toPandas().m
    p = np.pad(x, 1, mode="edge")
    assert got.tolist() == [float(np.median(p[i : i + 3])) for i in range(len(x))]


def test_resample_hold_edges(spark):
    got = resample.resample_hold(series(spark, [None, 1, None, None, None, 3]), ["k"], "i", "v", 10.0, [], 8, 10.0, 0.2).orderBy("out").toPandas()
    assert got.valid.tolist() == [False, True, True, True, False, True, True, False]
    assert got.v.tolist() == [0, 1, 1, 1, 0, 3, 0, 0]
    none = resample.resample_hold(series(spark, [None, None]), ["k"], "i", "v", 10.0, [], 3, 10.0).toPandas()
    assert not none.valid.any() and (none.v == 0).all()


def test_ramps_reach_zero_and_one(spark):
    got = windows.ramps(series(spark, [0] * 5 + [1] * 3 + [0] * 5), ["k"], "i", "v", 3, "g").orderBy("i").toPandas().g
    assert got[5:8].tolist() == [1, 1, 1] and got[0] == 0 and got[12] == 0 and 0 < got[4] < 1 and got[4] == got[8]


def test_overlap_add_returns_the_series(spark):
    df = spark.range(100).select(F.lit(0).alias("k"), F.col("id").alias("i"), (F.col("id") * 1.5).alias("v"))
    c = df.withColumn("c", F.explode(frames.chunk_bounds(F.lit(100), 30, 10))).where("i >= c.start and i < c.stop")
    w = frames.fade(F.col("i") - F.col("c.start"), F.col("c.stop") - F.col("c.start"), 10, F.col("c.start") == 0, F.col("c.stop") == 100)
    got = frames.overlap_add(c.withColumn("w", w), ["k"], "i", "v", "w").orderBy("i").toPandas()
    assert np.allclose(got.v, got.i * 1.5) and len(got) == 100


def test_assignment_ties_are_lexicographic_with_margin_zero(spark):
    df = spark.createDataFrame([(r, c, 1.0) for r in range(2) for c in range(2)], "r int, c int, s double")
    got = matching.assign(df, [], "r", "c", "s").first()
    assert got.plan == [0, 1] and got.margin == 0 and got.total == 2


def test_single_plan_has_its_total_as_margin(spark):
    df = spark.createDataFrame([(0, 0, 0.7)], "r int, c int, s double")
    assert matching.assign(df, [], "r", "c", "s").first().margin == 0.7


def test_greedy(spark):
    df = spark.createDataFrame([(0, 0, 0, 0.5), (0, 0, 1, 0.9), (0, 1, 1, 0.95), (0, 1, 0, 0.1)], "k int, r int, c int, s double")
    assert {(x.r, x.c) for x in matching.greedy(df, ["k"], "r", "c", "s").collect()} == {(1, 1), (0, 0)}


def test_si_sdr_of_a_scaled_copy_is_high(spark):
    x = np.random.default_rng(0).normal(size=200)
    df = spark.createDataFrame([(0, float(a), float(3 * a + 5)) for a in x], "k int, x double, y double")
    assert metrics.si_sdr(df, ["k"], "x", "y").first().si_sdr > 60


def test_auc_of_an_empty_side_is_null(spark):
    assert metrics.auc(spark.createDataFrame([(0, 1, 1.0)], "k int, p int, v double"), ["k"], "p", "v").first().auc is None


def test_silence_of_an_all_zero_channel(spark):
    r = metrics.silence_stats(series(spark, [0, 0]), ["k"], "v").first()
    assert r.zero_fraction == 1 and r.floor_db is None and r.peak == 0


def test_json_safe_nested(spark):
    df = spark.createDataFrame([(1, [1.0, float("nan")], float("-inf"))], "id int, a array<double>, x double")
    assert df.select(report.json_safe(df, ["id", "a", "x"]).alias("j")).first().j == '{"id":1,"a":[1.0,null],"x":null}'


def test_kmeans_finds_directions(spark):
    rows = [(i, [1.0, 0.01 * i] if i % 2 else [0.01 * i, 1.0]) for i in range(20)]
    got = {r.key: r.cluster for r in vectors.kmeans(spark.createDataFrame(rows, "key long, v array<double>"), "key", "v", 2)[0].collect()}
    assert len({got[i] for i in range(0, 20, 2)}) == 1 and len(set(got.values())) == 2


def test_choose_k_without_mixture(spark):
    assert vectors.choose_k(spark.createDataFrame([(1, [1.0, 0.0])], "key long, v array<double>"), "key", "v", 2) == 2


def test_tracker_keeps_identity_over_a_gap():
    t = entity.Tracker()
    box, emb = (0.1, 0.1, 0.2, 0.2), [1.0, 0.0]
    assert t.frame(0, [box], [emb]) == [0]
    assert t.frame(40, [(0.7, 0.7, 0.2, 0.2)], [emb]) == [0]  # too long ago for overlap, known by its embedding
    assert t.frame(41, [(0.7, 0.7, 0.2, 0.2)], [[-1.0, 0.0]]) == [1]  # overlap refused by the embedding


def test_fragments_merge_into_the_largest(spark):
    rows = [("a", 0, list(range(20)), [1.0, 0.0]), ("a", 1, list(range(30, 35)), [0.9, 0.1]), ("a", 2, list(range(10)), [0.0, 1.0])]
    df = spark.createDataFrame(rows, "clip string, track int, frames array<int>, emb array<double>")
    got = fragments.merge_fragments(df, df.selectExpr("clip", "track", "explode(frames) AS frame")).toPandas()
    assert dict(zip(got.track, got["into"], strict=True)) == {0: 0, 1: 0, 2: 2}


def test_stft_roundtrip_and_wiener():
    x = np.random.default_rng(0).normal(size=5000)
    assert np.allclose(spectral.istft(spectral.stft(x), len(x)), x)
    t = np.arange(8000) / 16000
    a, b = np.sin(2 * np.pi * 200 * t), np.sin(2 * np.pi * 3000 * t)
    out = spectral.wiener(np.stack([a + 0.1 * b, b + 0.1 * a]), order=0)
    assert np.corrcoef(out[0], a)[0, 1] > 0.99


@pytest.mark.parametrize("fn", [spectral.f0_autocorrelation, spectral.f0_yin])
def test_pitch(fn):
    t = np.arange(8000) / 16000
    f = fn(np.sin(2 * np.pi * 160 * t) + 0.4 * np.sin(2 * np.pi * 320 * t), 16000)
    assert abs(np.nanmedian(f) - 160) < 4


def test_planar_fit(spark):
    """Known moves come back; a mirror image can't be reached by a turn; points on one place are only shifted; a gap gives NULL."""
    from chronoweave.functions import numeric

    r = np.random.default_rng(0)
    a = r.normal(size=(6, 9, 2))
    turn = np.array([[np.cos(2.0), -np.sin(2.0)], [np.sin(2.0), np.cos(2.0)]])
    b = 2 * a @ turn.T + [3, 4]
    b[1] = a[1] * [1, -1]
    a[2] = 5.0
    b[3] += 0.1 * r.normal(size=(9, 2))
    point = lambda p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [(i, point(a[i]), point(b[i])) for i in range(6)]
    rows[4][1][0]["x"] = None
    df = spark.createDataFrame(rows, "i int, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    df = df.withColumn("fit", numeric.planar_fit(F.col("a"), F.col("b"))).withColumn("first", numeric.moved(F.col("fit"), F.col("a")[0]))
    got = {x.i: x for x in df.collect()}
    for i in (0, 5):
        assert np.allclose([got[i].fit.re, got[i].fit.im], [2 * np.cos(2.0), 2 * np.sin(2.0)]) and np.allclose([got[i].first.x, got[i].first.y], b[i, 0])
    assert (got[2].fit.re, got[2].fit.im) == (1.0, 0.0) and np.allclose([got[2].first.x, got[2].first.y], b[2].mean(0))
    assert got[4].fit.re is None
    for i in (1, 3):  # no scale and turn near by does better
        x, y = a[i] - a[i].mean(0), b[i] - b[i].mean(0)
        off = lambda re, im: ((x @ np.array([[re, im], [-im, re]]) - y) ** 2).sum()
        best = off(got[i].fit.re, got[i].fit.im)
        assert all(best <= off(got[i].fit.re + d, got[i].fit.im + e) for d in (-0.01, 0, 0.01) for e in (-0.01, 0, 0.01))


def test_leak_and_cepstrum():
    t = np.arange(8000) / 16000
    a, b = np.sin(2 * np.pi * 300 * t), np.sin(2 * np.pi * 2500 * t)
    out = spectral.cancel_leak(np.stack([a + 0.2 * b, b + 0.2 * a]))
    assert abs(np.corrcoef(out[0], b)[0, 1]) < abs(np.corrcoef(a + 0.2 * b, b)[0, 1])
    assert spectral.cepstral_smooth(np.full((257, 3), 0.5)).shape == (257, 3)
    with pytest.raises(ValueError):
        spectral.cepstral_smooth(np.ones((9, 1)), 1)


def test_stream_of_frames(spark, tmp_path):
    from chronoweave.streaming.frames import framed, gated

    at = pd.date_range("2024-01-01", periods=240, freq="6min")
    src = spark.createDataFrame(pd.DataFrame({"ts": at, "c": "a", "v": [0.1 if i < 100 else 10.0 for i in range(240)]}))
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    assert framed(stream, "c", "ts", "v").isStreaming
    q = gated(stream, "c", "ts", "v", 10.0, 0.0, 2, 2).writeStream.format("memory").queryName("gate").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("gate").orderBy("start").toPandas()
    assert len(got) >= 20 and got.state.iloc[0] == 0 and got.state.iloc[-1] == 1


def _noise(n, seed):
    return np.random.default_rng(seed).normal(size=n)


def test_wiener_is_a_smoothed_share_of_each_stem():
    x = np.stack([_noise(3000, 1), _noise(3000, 2) * 0.5, _noise(3000, 3)])
    specs = [spectral.stft(v) for v in x]
    total = sum(np.abs(s) ** 2 for s in specs) + 1e-12
    got = spectral.wiener(x)
    for i, s in enumerate(specs):
        gain = np.empty(s.shape)
        for t in range(s.shape[1]):
            log = np.log(np.maximum(np.abs(s[:, t]) ** 2 / total[:, t], 1e-10))
            c = np.fft.irfft(log)
            gain[:, t] = np.clip(np.exp(np.fft.rfft([v if k < 24 or k > len(c) - 24 else 0.0 for k, v in enumerate(c)]).real), 0, 1)
        assert np.allclose(got[i], spectral.istft(gain * s, 3000))
    assert np.allclose(spectral.wiener(x[:1]), x[:1])


def test_leak_of_three_stems_equals_a_plain_version():
    x = np.stack([_noise(1500, k) for k in range(3)])
    x[0] += 0.5 * x[1] - 0.3 * x[2]
    s = [spectral.stft(v) for v in x]
    rows, cols = s[0].shape

    def near(z, r, c):  # mirrored at the edges
        at = lambda k, n: -k - 1 if k < 0 else 2 * n - 1 - k if k >= n else k
        return np.mean([z[at(r + a, rows), at(c + b, cols)] for a in range(-2, 3) for b in range(-4, 5)])

    got = spectral.cancel_leak(x)
    for i in range(3):
        want = s[i].copy()
        for r in range(rows):
            for c in range(cols):
                if not (r % 37 == 0 and c % 5 == 0):
                    continue
                for j in {0, 1, 2} - {i}:
                    pi, pj = near(np.abs(s[i]) ** 2, r, c) + 1e-20, near(np.abs(s[j]) ** 2, r, c) + 1e-20
                    a = near(s[i] * s[j].conj(), r, c) / pj
                    want[r, c] -= a / max(abs(a), 1) * s[j][r, c] / (1 + pi / pj)
        p, copy = spectral.leakage(s, (5, 9))
        mine = s[i] - sum(copy(i, j) / (1 + p[i] / p[j]) for j in range(3) if j != i)
        at = np.ix_(range(0, rows, 37), range(0, cols, 5))
        assert np.allclose(mine[at], want[at]) and np.allclose(got[i], spectral.istft(mine, 1500))


def test_yin_falls_back_to_the_least_value():
    noise = spectral.f0_yin(_noise(4096, 5), 16000)
    assert len(noise) == 4 and np.isfinite(noise).all()
    t = np.arange(4096) / 16000
    assert np.allclose(spectral.f0_yin(np.sin(2 * np.pi * 150 * t) + 5.0, 16000), 150, atol=2)


def test_cepstral_profile_of_silence_and_level():
    assert len(spectral.cepstral_profile(np.zeros(16000), 16000)) == len(spectral.cepstral_profile(np.ones(100), 16000)) == len(spectral.cepstral_profile(_noise(16000, 1) * 1e-5, 16000)) == 0
    x = _noise(16000, 1)
    assert np.allclose(spectral.cepstral_profile(x, 16000), spectral.cepstral_profile(x * 0.25, 16000))
    n, hop = 512, 256
    frames = [x[k : k + n] * np.hanning(n) for k in range(0, len(x) - n + 1, hop)]
    level = np.array([np.sqrt(np.mean(f * f)) for f in frames])
    ceps = []
    for f in [f for f, v in zip(frames, level, strict=True) if v >= np.percentile(level, 50)]:
        m = np.abs(np.fft.rfft(f))
        ceps.append(np.fft.irfft(np.log(m / m.mean() + 1e-12))[1:21])
    want = np.mean(ceps, 0)
    assert np.allclose(spectral.cepstral_profile(x, 16000), want / np.linalg.norm(want))


def test_rival_max_of_many_channels(spark):
    from chronoweave.operators import gates

    r = np.random.default_rng(0)
    rows = [(f, c, float(v)) for f in range(20) for c, v in enumerate(r.integers(0, 9, f))]
    got = gates.rival_max(spark.createDataFrame(rows, "frame long, channel long, v double"), ["frame"], "channel", "v", "rival").collect()
    for x in got:
        assert x.rival == max((v for f, c, v in rows if f == x.frame and c != x.channel), default=None)


def every_plan(m):
    """(total, plan) of every plan with as many pairs as the smaller side has, best first; a column before none."""
    rows, cols = m.shape
    found = {tuple(p) for p in itertools.permutations([*range(cols), *[None] * max(0, rows - cols)], rows)}
    plans = [(sum(m[r, c] for r, c in enumerate(p) if c is not None), p) for p in found]
    return sorted((x for x in plans if not np.isnan(x[0])), key=lambda x: (-x[0], [cols if c is None else c for c in x[1]]))


@pytest.mark.parametrize("shape", [(1, 1), (1, 4), (4, 1), (3, 3), (2, 5), (5, 3), (4, 5), (6, 6)])
def test_assignment_equals_every_plan(shape):
    """Small whole numbers tie often; a few pairs are absent; negative scores don't make a plan shorter."""
    r = np.random.default_rng(sum(shape))
    for trial in range(30):
        m = r.integers(-2, 4, shape).astype(float) if trial % 3 else r.normal(size=shape)
        if trial % 5 == 4:
            m[r.random(shape) < 0.25] = np.nan
        want, got = every_plan(m), matching.solve(m)
        if not want:
            assert got is None
            continue
        plan, total, margin = got
        assert tuple(plan) == want[0][1] and np.isclose(total, want[0][0])
        assert np.isclose(margin, max(0.0, want[0][0] - want[1][0]) if len(want) > 1 else total)


def test_assignment_of_large_matrices(spark):
    """Complementary slackness proves the optimum of 40 x 64 and 64 x 40; the runner-up equals a solve with each pair forbidden."""
    r = np.random.default_rng(3)
    for shape in ((40, 64), (64, 40)):
        m = r.normal(size=shape)
        s = matching._Solver(m)
        slack = s.cost - s.u[:, None] - s.v
        assert slack.min() > -1e-9 and max(slack[i, s.of_row[i]] for i in range(64)) < 1e-9
        totals = []
        for i, c in s.pairs():
            x = m.copy()
            x[i, c] = np.nan
            totals.append(matching._Solver(x).total())
        assert np.isclose(s.runner_up(), max(totals))
    none = spark.createDataFrame([], "k int, r string, c string, s double")
    assert matching.assign(none, ["k"], "r", "c", "s").collect() == [] and matching.assign(none, [], "r", "c", "s").collect() == []


@pytest.mark.parametrize("turn", [False, True])
def test_ties_among_many_left_over(turn):
    """Row 0 can have either column, row 1 ties with all that are left over; that chain of rows made the square's search recurse too deep."""
    m = np.zeros((3000, 2))
    m[:, 0] = m[0, 1] = 1.0
    plan, total, margin = matching.solve(m.T if turn else m)
    assert (plan if turn else plan[:2]) == [1, 0] and (total, margin) == (2.0, 0.0) and sum(c is not None for c in plan) == 2


@pytest.mark.parametrize("turn", [False, True])
def test_assignment_of_long_tied_matrices(turn):
    """Thousands of rows left over beside tied ones: the first of ties by all plans of each column's best four rows."""
    r = np.random.default_rng(5)
    m = np.concatenate((np.zeros((3000, 3)), r.integers(1, 4, (60, 3)).astype(float)))
    m[::7, 0] = 3.0
    m[50, 1] = m[2999, 1] = m[3010, 1] = 9.0
    keep = sorted({int(i) for c in range(3) for i in np.lexsort((np.arange(len(m)), -m[:, c]))[:4]})
    plans = sorted(((m[p, range(3)].sum(), p) for p in itertools.permutations(keep, 3)), key=lambda x: (-x[0], x[1] if turn else [x[1].index(i) if i in x[1] else 3 for i in keep]))
    plan, total, margin = matching.solve(m.T if turn else m)
    assert (plan if turn else [plan.index(c) for c in range(3)]) == list(plans[0][1])
    assert total == plans[0][0] and margin == plans[0][0] - plans[1][0]


def test_backfill_goes_stem_by_stem(spark):
    held = spark.createDataFrame([(1, 0, 9, 0.4)], "clip int, track int, stem int, confidence double")
    scores = spark.createDataFrame([(1, t, s, v) for t, s, v in [(1, 0, 0.5), (2, 0, 0.4), (1, 1, 0.9), (2, 1, 0.8)]], "clip int, track int, stem int, score double")
    got = {(r.track, r.stem) for r in matching.backfill(held, scores, ["clip"], "track", "stem", "score").collect()}
    assert got == {(0, 9), (1, 0), (2, 1)}


def test_backfill_gives_free_tracks_no_confidence(spark):
    from chronoweave.operators import matching

    held = spark.createDataFrame([(1, "a", "x", 0.4)], "clip int, track string, stem string, confidence double")
    scores = spark.createDataFrame([(1, t, s, v) for t, s, v in [("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.7), ("b", "y", 0.1), ("c", "y", 0.3)]], "clip int, track string, stem string, score double")
    got = {(r.track, r.stem, r.confidence) for r in matching.backfill(held, scores, ["clip"], "track", "stem", "score").collect()}
    assert got == {("a", "x", 0.4), ("c", "y", 0.0)}


def test_refinement_inputs_equal_a_plain_version():
    r = np.random.default_rng(4)
    x = r.normal(size=(3, 1500))
    mix = x.sum(0)
    got = spectral.refinement_inputs(mix, x, 0.5)
    s = [spectral.stft(a) for a in x]

    def local(z, b, f):  # mean of 5 bins and 9 frames, mirrored at the edges
        pick = lambda i, n: -i - 1 if i < 0 else 2 * n - i - 1 if i >= n else i
        return np.mean([z[pick(b + i, z.shape[0]), pick(f + j, z.shape[1])] for i in range(-2, 3) for j in range(-4, 5)])

    for i in range(3):
        taken = np.zeros_like(s[i])
        for j in set(range(3)) - {i}:
            for b in range(s[i].shape[0]):
                for f in range(s[i].shape[1]):
                    a = local(s[j] * s[i].conj(), b, f) / (local(abs(s[i]) ** 2, b, f) + 1e-12)
                    a = a / max(abs(a), 1)
                    taken[b, f] += s[j][b, f] - 0.5 * a * s[i][b, f]
        assert np.allclose(got[i], mix - spectral.istft(taken, 1500), atol=1e-8)
    assert np.allclose(spectral.refinement_inputs(x[0], x[:1]), x[:1])


def test_lift_without_windows(spark):
    from chronoweave.operators import gates

    grid = spark.range(5).select(F.lit(1).alias("k"), F.col("id").alias("at"))
    none = spark.createDataFrame([], "k int, at long, state int")
    assert [r.state for r in gates.lift(none, grid, ["k"], "at", "state", 2.0).collect()] == [0] * 5
    some = spark.createDataFrame([(1, 0, 1), (1, 4, 0)], "k int, at long, state int")
    assert [r.state for r in gates.lift(some, grid, ["k"], "at", "state", 2.0).orderBy("at").collect()] == [1, 1, 0, 0, 0]


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_quantile_by_counting(spark, q):
    """Small and large keys, heavy ties, NULL keys, NULL and NaN values, keys without any."""
    r = np.random.default_rng(5)
    data = {"a": r.normal(size=30_000), "b": r.integers(0, 5, 25_000).astype(float), "c": r.normal(size=7), "d": np.array([2.5]), None: r.lognormal(size=12_000)}
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("a", None), ("c", float("nan")), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {x.k: x["quantile"] for x in order.quantile(df, ["k"], "v", q).collect()}
    assert got.keys() == {*data, "e"} and got["e"] is None
    for k, v in data.items():
        assert np.isclose(got[k], np.percentile(v, 100 * q), rtol=1e-12)


def test_quantile_of_one_large_key(spark):
    df = spark.range(5_000_000).select(((F.col("id") * 7919) % 4_999_999 / 3).alias("v"))
    want = df.agg(F.percentile("v", F.lit(0.95))).first()[0]
    assert np.isclose(order.quantile(df, [], "v", 0.95).first()[0], want, rtol=1e-12)
    assert order.quantile(df.where("v < 0"), [], "v", 0.95).first()[0] is None


def test_ranks_by_ranges(spark):
    r = np.random.default_rng(6)
    rows = [(i, ["x", "y", None][i % 3], None if i % 17 == 0 else float(r.integers(0, 300))) for i in range(6000)]
    df = spark.createDataFrame(rows, "i int, k string, v double").repartition(4)
    for keys in ([], ["k"]):
        got = {x.i: x["rank"] for x in order.ranks(df, keys, "v", "i", 16).collect()}
        want = {}
        for k in {x[1] for x in rows} if keys else {0}:
            group = sorted((x[2], x[0]) for x in rows if x[2] is not None and (not keys or x[1] == k))
            want |= {i: n for n, (_, i) in enumerate(group)}
        assert got == {x[0]: want.get(x[0]) for x in rows}
        norm = windows.rank_norm(df, keys, "v", "i", "r", 16).exceptAll(windows.rank_norm(df, keys, "v", "i", "r"))
        assert norm.count() == 0


def test_ranges_are_even(spark):
    df = spark.range(200_000).select((F.pow(F.col("id") % 65_536, F.lit(3.0))).alias("v"))
    sizes = [x["count"] for x in order.ranges(df, [], "v", 20).groupBy("_part").count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 2 * sum(sizes) / 20


def test_auc_by_ranges(spark):
    r = np.random.default_rng(8)
    df = spark.createDataFrame([(int(i % 2), int(r.random() < 0.4), float(r.integers(0, 40))) for i in range(3000)], "k int, p int, v double")
    for keys in ([], ["k"]):
        same = lambda parts: sorted(round(x.auc, 12) for x in metrics.auc(df, keys, "p", "v", parts).collect())
        assert same(7) == same(1)


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_running_orders_equal_a_loop(spark, block):
    """Series of several lengths and sizes, with steps that stand by themselves."""
    r = np.random.default_rng(9)
    rows = [(k, i, (r.permutation(2 + k) + 1).tolist(), bool(r.random() < 0.2)) for k in range(4) for i in range(5 * k, 5 * k + 40 // (k + 1))]
    df = spark.createDataFrame(rows, "k int, i long, step array<int>, fixed boolean").repartition(3)
    got = {(x.k, x.i): x.order for x in matching.running_orders(df, ["k"], "i", block).collect()}
    want = {}
    for k in range(4):
        order = list(range(1, 3 + k))
        for _, i, step, fixed in (x for x in rows if x[0] == k):
            order = step if fixed else [step[j - 1] for j in order]
            want[k, i] = order
    assert got == want


def test_cascade_takes_the_first_sure_basis(spark):
    wave = spark.createDataFrame([(0, [2, 1], 0.2), (1, [2, 1], 0.1), (2, [2, 1], 0.1), (3, [2, 1], 0.1)], "day int, plan array<int>, margin double")
    voice = spark.createDataFrame([(0, [1, 2], 0.9, 0.9), (1, [2, 1], 0.2, 0.5), (2, [2, 1], 0.2, 0.4)], "day int, plan array<int>, margin double, least double")
    got = {x.day: (x.step, x.fixed, x.basis) for x in matching.decide(wave, voice, ["day"]).collect()}
    assert got == {0: ([2, 1], False, "waveform"), 1: ([2, 1], True, "identity"), 2: ([1, 2], True, "hold"), 3: ([1, 2], True, "hold")}


@pytest.mark.parametrize("tracks, stems", [(3, 3), (2, 4), (4, 2)])
def test_match_stems_of_any_numbers(spark, tracks, stems):
    """Stems are noisy copies of tracks in reverse order; what has no partner is left over."""
    r = np.random.default_rng(11)
    n, both = 64, min(tracks, stems)
    x = r.normal(size=(tracks, n))
    y = r.normal(size=(stems, n))
    y[:both] = x[:both][::-1] + 0.05 * r.normal(size=(both, n))
    z = lambda m: (m - m.mean(1, keepdims=True)) / m.std(1, keepdims=True)
    lips = spark.createDataFrame([(t, i, float(v)) for t, row in enumerate(z(x)) for i, v in enumerate(row)], "t int, i int, a double")
    envs = spark.createDataFrame([(t, i, float(v)) for t, row in enumerate(z(y)) for i, v in enumerate(row)], "s int, i int, b double")
    got = {q.t: q for q in matching.match_stems(lips, envs, "i", "t", "s", "a", "b", n).collect()}
    assert {t: q.s for t, q in got.items()} == {t: both - 1 - t if t < both else None for t in range(tracks)}
    score = z(x) @ z(y).T / n
    _, total, margin = matching.solve(score)
    assert all(np.isclose(q.confidence, margin if q.s is not None else 0.0) and q.trusted for q in got.values())
    null = [matching.solve(np.stack([np.roll(row, lag) for row in z(x)]) @ z(y).T / n)[2] for lag in range(1, n)]
    assert np.isclose(got[0].p, (sum(m >= margin for m in null) + 1) / n)


@pytest.mark.parametrize("parts", [1, 5])
def test_weighted_draws(spark, parts):
    """Points fall on the rows that a running sum gives them; shares are within three deviations; a row may hold most of the weight."""
    weights = [(i, w) for i, w in enumerate([3, 0, 1, 5000, None, 7, 200, -4, 90, *[2] * 300])]
    df = spark.createDataFrame(weights, "k long, w int").repartition(3)
    n = 20_000
    got = dict(map(tuple, sampling.weighted_draws(df, "k", "w", sampling.points(spark, n, 5), parts).collect()))
    live = [(k, w) for k, w in weights if w and w > 0]
    stops, total = np.cumsum([w for _, w in live]), sum(w for _, w in live)
    u = [r.u for r in sampling.points(spark, n, 5).orderBy("draw").collect()]
    assert 0 <= min(u) and max(u) < 1
    assert got == {i: live[int(np.searchsorted(stops, int(x * total), side="right"))][0] for i, x in enumerate(u)}
    for k, w in live[:6]:
        p = w / total
        assert abs(sum(v == k for v in got.values()) - n * p) <= 3 * np.sqrt(n * p * (1 - p)) + 1
    assert sampling.weighted_draws(df.where("k = 1"), "k", "w", sampling.points(spark, 5, 1)).count() == 0


def test_written_spans_boxes_and_permutations(spark):
    """Texts as they are typed: several faces, boxes that are missing or too short, the last permutation and one alone."""
    t = spark.createDataFrame([(1, "0:1-2.5,4-6;1:3-9"), (2, "2:0-1")], "clip long, text string")
    spans = sorted((r.clip, r.face, r.start, r.stop) for r in report.spans(t, ["clip"], "text").collect())
    assert spans == [(1, 0, 1.0, 2.5), (1, 0, 4.0, 6.0), (1, 1, 3.0, 9.0), (2, 2, 0.0, 1.0)]
    j = spark.createDataFrame([(1, "[[0.1,0.2,0.3,0.4],null,[1,2]]"), (2, "[[0,0,1,1]]")], "clip long, j string")
    boxes = sorted((r.clip, r.frame, r.x, r.y, r.w, r.h) for r in report.boxes(j, ["clip"], "j").collect())
    assert boxes == [(1, 0, 0.1, 0.2, 0.3, 0.4), (1, 1, None, None, None, None), (1, 2, None, None, None, None), (2, 0, 0.0, 0.0, 1.0, 1.0)]
    p = spark.createDataFrame([([1, 2, 3, 4],), ([1, 2, 4, 3],), ([1, 4, 3, 2],), ([4, 3, 2, 1],), ([7],)], "p array<int>")
    got = {tuple(r.p): r.q for r in p.withColumn("q", matching.next_permutation(F.col("p"))).collect()}
    assert got == {(1, 2, 3, 4): [1, 2, 4, 3], (1, 2, 4, 3): [1, 3, 2, 4], (1, 4, 3, 2): [2, 1, 3, 4], (4, 3, 2, 1): [1, 2, 3, 4], (7,): [7]}


def test_purity(spark):
    from chronoweave.operators import metrics as me

    rows = [("a", 0, 0.9), ("a", 1, 0.2), ("b", 0, 0.5), ("b", 1, None), ("c", 0, 0.5), ("d", 0, 0.1), ("d", 1, 0.2), ("d", 2, 0.3)]
    got = {r.k: r.purity for r in me.purity(spark.createDataFrame(rows, "k string, stem int, low_share double"), ["k"]).collect()}
    assert abs(got.pop("a") - 0.7) < 1e-12 and got == {"b": None, "c": None, "d": None}


def test_large_keys_travel_to_their_rows(spark, monkeypatch):
    """A quantile joined by key alone had all rows of a key sorted by one task."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), (F.col("id") % 977).cast("double").alias("x"))
    rel = lambda: frames.relative_level(df, ["k"], "x", 0.9, "rel", long=True)
    assert rel()._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") >= 2
    want = sorted(map(str, rel().collect()))
    monkeypatch.setattr(order, "MOST", 1)
    assert sorted(map(str, rel().collect())) == want and len(want) == 3000


def test_resamples_by_tiles(spark, monkeypatch):
    """Draws are made where the values are, tile by tile: no row a draw."""
    monkeypatch.setattr(metrics, "TILE", 7)
    rows = [(k, k % 3 == 0, None if k == 5 else k * k % 101) for k in range(60)]
    draw = lambda rep, k, n: (rep * 31 + k * 17 + 5) % n
    got = metrics.bootstrap_difference(spark.createDataFrame(rows, "key long, g boolean, x long"), "g", "x", 40, draw).first()
    of = {g: [np.nan if x is None else x for _, f, x in rows if f == g] for g in (True, False)}
    d = [np.subtract(*[np.nanmean(np.array(of[g], float)[draw(rep, np.arange(len(of[g])), len(of[g]))]) for g in (True, False)]) for rep in range(40)]
    assert np.allclose([got.low, got.high], np.quantile(d, [0.025, 0.975]))


def test_best_rows_keep_the_plan(spark):
    """Of many rows and few columns, with ties and NULLs, the rows kept give the pairs, total and margin of all rows."""
    r = np.random.default_rng(4)
    rows = [(k, i, c, None if r.random() < 0.1 else float(r.integers(0, 12))) for k in range(6) for i in range(2 + 8 * k) for c in range(3)]
    df = spark.createDataFrame(rows, "k int, r int, c int, s double")
    plans = lambda d: {x.k: ([c for c in x.plan if c is not None], x.total, x.margin) for x in matching.assign(d, ["k"], "r", "c", "s").collect()}
    few = matching.best_rows(df, ["k"], "r", "c", "s")
    assert plans(few) == plans(df) and few.groupBy("k").agg(F.count_distinct("r").alias("n")).agg(F.max("n")).first()[0] <= 12
