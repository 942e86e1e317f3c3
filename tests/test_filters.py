"""The recurrence by blocks against the plain one, and the envelope of known signals."""

import numpy as np
import pandas as pd

from chronoweave.operators.filters import band_envelope, bandpass, cascade, recurrence, respond, zero_phase


def plain(gain, sections, x, start=0.0):
    """Section by section with the difference equation, after a constant input of `start`, whose output is 0."""
    y = np.asarray(x, float) * gain
    before = start * gain
    for a1, a2 in sections:
        out, x1, x2, y1, y2 = [], before, before, 0.0, 0.0
        for v in y:
            w = v - x2 - a1 * y1 - a2 * y2
            out.append(w)
            x1, x2, y1, y2 = v, x1, w, y1
        y, before = np.array(out), 0.0
    return y


def both_ways(gain, sections, x):
    edge = 3 * (2 * len(sections) + 1)
    e = np.concatenate([2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2 : -edge - 2 : -1]])
    y = plain(gain, sections, e, e[0])[::-1]
    return plain(gain, sections, y, y[0])[::-1][edge:-edge]


def test_bandpass_response():
    for order, low, high, rate in ((3, 1.5, 8, 25), (3, 1.5, 8, 24), (2, 0.5, 3, 30), (1, 2, 4, 16)):
        gain, sections = bandpass(order, low, high, rate)
        z = np.exp(-2j * np.pi * np.array([low, high, 1e-9]) / rate)
        h = np.abs(gain * np.prod([(1 - z**2) / (1 + a1 * z + a2 * z**2) for a1, a2 in sections], axis=0))
        assert np.allclose(h, [0.5**0.5, 0.5**0.5, 0], atol=1e-8) and len(sections) == order
        assert all(np.all(np.abs(np.roots([1, *s])) < 1) for s in sections)


def test_steps_equal_the_plain_recurrence():
    gain, sections = bandpass(3, 1.5, 8, 25)
    system, x = cascade(gain, sections), np.random.default_rng(1).normal(size=333) + 4
    y, state = respond(system, x, system.steady() * x[0])
    assert np.abs(y - plain(gain, sections, x, x[0])).max() < 1e-9
    again, end = respond(system, x[100:], respond(system, x[:100], system.steady() * x[0])[1])
    assert np.abs(again - y[100:]).max() < 1e-9 and np.abs(end - state).max() < 1e-9


def test_blocks_equal_the_plain_recurrence(spark):
    rng, (gain, sections) = np.random.default_rng(2), bandpass(3, 1.5, 8, 25)
    series = {"a": rng.normal(size=1000).cumsum() + 50, "b": rng.normal(size=22), "c": rng.normal(size=21), "d": np.full(90, 7.0)}
    df = spark.createDataFrame(pd.DataFrame([(k, i + 5, float(v)) for k, x in series.items() for i, v in enumerate(x)], columns=["k", "i", "x"])).repartition(7)
    one = recurrence(df, ["k"], "i", "x", cascade(gain, sections), "y", 128).toPandas().sort_values("i")
    two = zero_phase(df, ["k"], "i", "x", gain, sections, "y", 128).toPandas().sort_values("i")
    for k, x in series.items():
        assert np.abs(one[one.k == k].y.to_numpy() - plain(gain, sections, x, x[0])).max() < 1e-9
        got = two[two.k == k]
        if k == "c":
            assert got.empty
        else:
            assert got.i.tolist() == list(range(5, len(x) + 5)) and np.abs(got.y.to_numpy() - both_ways(gain, sections, x)).max() < 1e-9


def test_envelope(spark):
    t = np.arange(500) / 25
    tone = 3 * np.sin(2 * np.pi * 4 * t) + 100 + 5 * np.sin(2 * np.pi * 0.1 * t)
    rows = [("a", i, float(v) if i % 50 else None) for i, v in enumerate(tone)]
    rows += [("few", i, 1.0 if i < 7 else float("nan")) for i in range(60)] + [("short", i, float(i % 3)) for i in range(20)]
    got = band_envelope(spark.createDataFrame(rows, "k string, i long, x double"), ["k"], "i", "x", 25.0, block=100).toPandas().sort_values("i")
    a = got[got.k == "a"].envelope.to_numpy()
    assert len(a) == 500 and (a[::50] == 0).all()
    middle = a[100:400][np.arange(100, 400) % 50 != 0]
    assert np.abs(np.median(middle) - 3) < 0.1
    assert (got[got.k != "a"].envelope == 0).all() and len(got) == 580
