"""Linear recurrences over series of any length, as affine scans over blocks, and the band envelope on top of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.windows import hold

#: Samples of a block, and of a step inside it whose response is one matrix product.
BLOCK, STEP = 1 << 16, 64


@dataclass(frozen=True)
class System:
    """State s and output y for input x: s' = m s + n x, y = c s + d x."""

    m: np.ndarray
    n: np.ndarray
    c: np.ndarray
    d: float

    def steady(self) -> np.ndarray:
        """The state under a constant input of one."""
        return np.linalg.solve(np.eye(len(self.n)) - self.m, self.n)


def bandpass(order: int, low: float, high: float, rate: float) -> tuple[float, list[tuple[float, float]]]:
    """(gain, [(a1, a2)]) of a Butterworth band-pass: sections (1 - z^-2) / (1 + a1 z^-1 + a2 z^-2), by the bilinear transform."""
    w1, w2 = (2 * rate * np.tan(np.pi * f / rate) for f in (low, high))
    proto = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order)) * (w2 - w1) / 2
    root = np.sqrt(proto**2 - w1 * w2)
    z = [(2 * rate + s) / (2 * rate - s) for s in np.concatenate([proto + root, proto - root])]
    # The conjugate of each pole is a pole: complex ones make a section with theirs, real ones two by two.
    real = sorted(p.real for p in z if abs(p.imag) < 1e-12)
    pairs = [(p, p.conjugate()) for p in z if p.imag >= 1e-12] + list(zip(real[::2], real[1::2], strict=True))
    sections = sorted((float(-(p + q).real), float((p * q).real)) for p, q in pairs)
    mid = np.exp(-2j * np.arctan(np.sqrt(w1 * w2) / (2 * rate)))
    response = np.prod([(1 - mid**2) / (1 + a1 * mid + a2 * mid**2) for a1, a2 in sections])
    return float(1 / abs(response)), sections


def cascade(gain: float, sections: list[tuple[float, float]]) -> System:
    """The sections one after the other as one system, two numbers of state each."""
    size = 2 * len(sections)

    def step(s, x):
        s, x = s.copy(), gain * x
        for k, (a1, a2) in enumerate(sections):
            y = x + s[2 * k]
            s[2 * k], s[2 * k + 1] = s[2 * k + 1] - a1 * y, -x - a2 * y
            x = y
        return s, x

    units = [step(e, 0.0) for e in np.eye(size)]
    n, d = step(np.zeros(size), 1.0)
    return System(np.array([u for u, _ in units]).T, n, np.array([y for _, y in units]), d)


def respond(system: System, x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(output, state after): the recurrence over x from state s, STEP samples at a time."""
    powers = [np.eye(len(s))]
    for _ in range(STEP):
        powers.append(system.m @ powers[-1])
    impulse = np.array([system.d, *(system.c @ p @ system.n for p in powers[: STEP - 1])])
    lag = np.subtract.outer(np.arange(STEP), np.arange(STEP))
    own = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    free = np.array([system.c @ p for p in powers[:STEP]])
    reach = np.array([powers[STEP - 1 - k] @ system.n for k in range(STEP)]).T
    whole = len(x) // STEP * STEP
    rows = x[:whole].reshape(-1, STEP)
    given, y = rows @ reach.T, rows @ own.T
    for k in range(len(rows)):
        y[k] += free @ s
        s = powers[STEP] @ s + given[k]
    rest = np.empty(len(x) - whole)
    for k, v in enumerate(x[whole:]):
        rest[k] = system.c @ s + system.d * v
        s = system.m @ s + system.n * v
    return np.concatenate([y.reshape(-1), rest]), s


def recurrence(df: DataFrame, keys: list[str], index: str, value: str, system: System, out: str, block: int = BLOCK) -> DataFrame:
    """(keys, index, out): the system's output over each key in order of the index, as if its first value had always been its input.

    A block's effect on the state is affine, s -> m^n s + r, so blocks are summed up by themselves, one row a block is carried
    through by key, and blocks are run again from the state they start in. A task holds a block, or a key's summaries.
    Values are present; keys and indexes are too, and an index has one row.
    """
    rows = df.select(*keys, F.col(index).cast("long").alias("_i"), F.col(value).cast("double").alias("_x")).withColumn("_blk", F.floor(F.col("_i") / block))
    key = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    size = len(system.n)

    def summed(p: pd.DataFrame) -> pd.DataFrame:
        x = p.sort_values("_i")["_x"].to_numpy()
        one = p.iloc[:1][[*keys, "_blk"]].reset_index(drop=True)
        return one.assign(_n=len(x), _first=x[0], _s=[respond(system, x, np.zeros(size))[1]])

    def carried(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_blk")
        s, starts = system.steady() * p["_first"].iloc[0], []
        for n, r in zip(p["_n"], p["_s"], strict=True):
            starts.append(s)
            s = np.linalg.matrix_power(system.m, int(n)) @ s + np.asarray(r)
        return p[[*keys, "_blk"]].assign(_s=starts)

    def run(p: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_i")
        y, _ = respond(system, p["_x"].to_numpy(), np.asarray(start["_s"].iloc[0]))
        return p[[*keys, "_i"]].assign(_y=y)

    sums = rows.groupBy(*keys, "_blk").applyInPandas(summed, f"{key}, _blk long, _n long, _first double, _s array<double>")
    starts = sums.groupBy(*keys).applyInPandas(carried, f"{key}, _blk long, _s array<double>")
    done = rows.groupBy(*keys, "_blk").cogroup(starts.groupBy(*keys, "_blk")).applyInPandas(run, f"{key}, _i long, _y double")
    return done.select(*keys, F.col("_i").alias(index), F.col("_y").alias(out))


def zero_phase(df: DataFrame, keys: list[str], index: str, value: str, gain: float, sections: list[tuple[float, float]], out: str, block: int = BLOCK) -> DataFrame:
    """(keys, index, out): the filter forth and back, so nothing is delayed; each end is first led on by its mirror image turned over.

    The index has no gaps. A key of no more rows than an end is led on by (6 a section and 3) has no output.
    """
    edge, system = 3 * (2 * len(sections) + 1), cascade(gain, sections)
    i, x = F.col(index), F.col(value).cast("double")
    ends = df.groupBy(*keys).agg(F.min(index).alias("_a"), F.max(index).alias("_b"), F.min_by(x, i).alias("_xa"), F.max_by(x, i).alias("_xb"))
    met = df.select(*keys, i, x.alias("_x")).join(ends.where(F.col("_b") - F.col("_a") >= edge), keys)
    mirrored = lambda at, v: F.when((F.abs(i - at) <= edge) & (i != at), F.struct((2 * at - i).alias("_i"), (2 * v - F.col("_x")).alias("_v")))
    every = F.array(F.struct(i.alias("_i"), F.col("_x").alias("_v")), mirrored(F.col("_a"), F.col("_xa")), mirrored(F.col("_b"), F.col("_xb")))
    wide = met.select(*keys, F.inline(F.filter(every, lambda e: e.isNotNull())))
    forth = recurrence(wide, keys, "_i", "_v", system, "_v", block).withColumn("_i", -F.col("_i"))
    back = recurrence(forth, keys, "_i", "_v", system, out, block)
    back = back.select(*keys, (-F.col("_i")).alias(index), out).join(ends, keys)
    return back.where((i >= F.col("_a")) & (i <= F.col("_b"))).select(*keys, index, out)


def band_envelope(df: DataFrame, keys: list[str], index: str, value: str, rate: float, low: float = 1.5, high: float = 8.0, order: int = 3, least: int = 8, out: str = "envelope", block: int = BLOCK) -> DataFrame:
    """(keys, index, out): magnitude of the analytic signal of a band of each series, 0 where the series is absent.

    Absent values (NULL, NaN) hold the last one, before the first that one. A key of under `least` values, or too short for the
    filter, is 0 throughout. The filter goes by blocks; the transform to the analytic signal takes a whole series in one task.
    The index has no gaps and one row each.
    """
    x = F.col(value).cast("double")
    held = df.select(*keys, index, F.when(~F.isnan(x), x).alias("_x")).withColumn("_ok", F.col("_x").isNotNull())
    held = hold(held, keys, index, ["_x"], F.floor(F.col(index) / block))
    stats = held.groupBy(*keys).agg(F.avg("_x").alias("_mean"), F.count_if("_ok").alias("_n")).where(F.col("_n") >= least)
    centred = held.join(stats, keys).select(*keys, index, (F.col("_x") - F.col("_mean")).alias("_x"))
    band = zero_phase(centred, keys, index, "_x", *bandpass(order, low, high, rate), "_x", block)
    key = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys, index).schema)

    def magnitude(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(index)
        n = len(p)
        half = np.fft.fft(p["_x"].to_numpy())
        half[1 : (n + 1) // 2] *= 2
        half[n // 2 + 1 :] = 0
        return p[[*keys, index]].assign(_e=np.abs(np.fft.ifft(half)))

    found = band.groupBy(*keys).applyInPandas(magnitude, f"{key}, _e double")
    return held.join(found, [*keys, index], "left").select(*keys, index, F.when(F.col("_ok"), F.coalesce("_e", F.lit(0.0))).otherwise(0.0).alias(out))
