"""Waveform operators that need an FFT or linear algebra: NumPy inside one pandas group per signal."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def stft(x: np.ndarray, n: int = 512, hop: int = 128) -> np.ndarray:
    """Hann spectra (bins, frames) of the signal padded by n zeros at both ends."""
    w = np.hanning(n + 1)[:-1]
    x = np.pad(np.asarray(x, float), (n, n + (-len(x)) % hop))
    frames = np.lib.stride_tricks.sliding_window_view(x, n)[::hop]
    return np.fft.rfft(frames * w, axis=1).T


def istft(s: np.ndarray, length: int, n: int = 512, hop: int = 128) -> np.ndarray:
    w = np.hanning(n + 1)[:-1]
    frames = np.fft.irfft(s.T, n, axis=1) * w
    out, norm = np.zeros((len(frames) - 1) * hop + n), np.zeros((len(frames) - 1) * hop + n)
    for i, f in enumerate(frames):
        out[i * hop : i * hop + n] += f
        norm[i * hop : i * hop + n] += w * w
    return (out / np.maximum(norm, 1e-8))[n : n + length]


def wiener(stems: np.ndarray, power: float = 2.0, floor: float = 0.0, order: int = 24, n: int = 512, hop: int = 128) -> np.ndarray:
    """Each stem under the ratio mask of its power among all, smoothed over frequency; a single stem stays as it is."""
    if len(stems) < 2:
        return np.array(stems, float)
    spectra = [stft(x, n, hop) for x in stems]
    share = np.abs(np.stack(spectra)) ** power
    share = share / (share.sum(0) + 1e-12)
    if floor > 0:
        share = np.maximum(share, floor)
        share = share / (share.sum(0) + 1e-12)
    return np.stack([istft(cepstral_smooth(g, order) * x, np.shape(stems)[1], n, hop) for g, x in zip(share, spectra, strict=True)])


def cepstral_smooth(mask: np.ndarray, order: int = 24) -> np.ndarray:
    """A gain smoothed over frequency by keeping the first `order` cepstral terms; 0 leaves it."""
    if not order:
        return mask
    if order < 2:
        raise ValueError("an order under 2 would keep everything")
    full = np.log(np.maximum(np.concatenate([mask, mask[-2:0:-1]]), 1e-10))
    c = np.fft.fft(full, axis=0).real
    c[order : len(c) - order + 1] = 0
    return np.clip(np.exp(np.fft.ifft(c, axis=0).real[: len(mask)]), 0, 1)


def _box(x: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    for axis, k in enumerate(size):
        pad = [(0, 0)] * x.ndim
        pad[axis] = (k // 2, k - 1 - k // 2)
        y = np.cumsum(np.pad(x, pad, mode="symmetric"), axis=axis)
        y = np.concatenate([np.zeros_like(np.take(y, [0], axis)), y], axis)
        x = (np.take(y, range(k, y.shape[axis]), axis) - np.take(y, range(y.shape[axis] - k), axis)) / k
    return x


def leakage(s: list[np.ndarray], size: tuple[int, int], floor: float = 1e-20) -> tuple[list[np.ndarray], Callable[[int, int], np.ndarray]]:
    """Local powers, and for (i, j) the part of spectrum i that is a copy of spectrum j: a local regression, at most of gain one."""
    p = [_box(np.abs(x) ** 2, size) + floor for x in s]

    def copy(i: int, j: int) -> np.ndarray:
        cross = s[i] * s[j].conj()
        a = (_box(cross.real, size) + 1j * _box(cross.imag, size)) / p[j]
        return a / np.maximum(np.abs(a), 1) * s[j]

    return p, copy


def cancel_leak(stems: np.ndarray, size: tuple[int, int] = (5, 9), owner: float = 1.0, n: int = 512, hop: int = 128) -> np.ndarray:
    """Takes from each stem what every other explains locally, weighted by how much louder that one is; a single stem stays."""
    if len(stems) < 2:
        return np.array(stems, float)
    s = [stft(x, n, hop) for x in stems]
    p, copy = leakage(s, size)
    others = lambda i: sum(copy(i, j) / (1 + (p[i] / p[j]) ** owner) for j in range(len(s)) if j != i)
    return np.stack([istft(s[i] - others(i), np.shape(stems)[1], n, hop) for i in range(len(s))])


def refinement_inputs(mixture: np.ndarray, stems: np.ndarray, shared: float = 0.5, size: tuple[int, int] = (5, 9), n: int = 512, hop: int = 128) -> np.ndarray:
    """The mixture for each stem without the others; of what they share with it only `shared` is taken out."""
    s = [stft(x, n, hop) for x in stems]
    _, copy = leakage(s, size, 1e-12)
    others = lambda i: sum((s[j] - (1 - shared) * copy(j, i) for j in range(len(s)) if j != i), np.zeros_like(s[i]))
    return np.stack([mixture - istft(others(i), np.shape(stems)[1], n, hop) for i in range(len(s))])


def f0_autocorrelation(x: np.ndarray, rate: int, frame: int = 640, low: float = 70, high: float = 400, voiced: float = 0.35) -> np.ndarray:
    """Pitch of each frame from the peak of its autocorrelation; NaN where it is not periodic enough."""
    out = []
    for k in range(0, len(x) - frame + 1, frame):
        f = x[k : k + frame] - x[k : k + frame].mean()
        r = np.fft.irfft(np.abs(np.fft.rfft(f, 2 * frame)) ** 2)[:frame]
        lo, hi = int(rate / high), min(int(rate / low), frame - 1)
        lag = lo + int(np.argmax(r[lo : hi + 1]))
        out.append(rate / lag if r[0] > 0 and r[lag] / r[0] > voiced else np.nan)
    return np.array(out)


def f0_yin(x: np.ndarray, rate: int, frame: int = 1024, low: float = 70, high: float = 400, dip: float = 0.15) -> np.ndarray:
    """Pitch of each frame: the bottom of the first dip of the normalised difference function, else its least value, refined by a parabola."""
    lo, hi = max(2, int(rate / high)), min(frame - 1, int(rate / low))
    out = []
    for k in range(0, len(x) - frame + 1, frame):
        f = np.asarray(x[k : k + frame], float)
        f = f - f.mean()
        d = np.array([np.square(f[: frame - t] - f[t:]).sum() for t in range(hi + 1)])
        m = np.append(1.0, d[1:] * np.arange(1, hi + 1) / np.maximum(np.cumsum(d[1:]), 1e-12))
        inside = m[lo:hi]
        t = lo + int(np.argmax(inside < dip) if (inside < dip).any() else np.argmin(inside))
        while m[t] < dip and t + 1 < hi and m[t + 1] < m[t]:
            t += 1
        bend = m[t - 1] - 2 * m[t] + m[t + 1]
        out.append(rate / (t + (float(np.clip(0.5 * (m[t - 1] - m[t + 1]) / bend, -1, 1)) if abs(bend) > 1e-12 else 0.0)))
    return np.array(out)


def f0_harmonic_product(x: np.ndarray, rate: int, n: int = 4096, low: float = 70, high: float = 400, terms: int = 4) -> float:
    s = np.log(np.abs(np.fft.rfft(np.asarray(x)[:n] * np.hanning(min(n, len(x))), n)) + 1e-12)
    bins = np.arange(int(low * n / rate), int(high * n / rate) + 1)
    return float(bins[np.argmax(sum(s[bins * k] for k in range(1, terms + 1)))] * rate / n)


def formants(x: np.ndarray, rate: int, order: int = 12) -> np.ndarray:
    """Resonances below half the rate from the roots of a linear predictor (Levinson-Durbin)."""
    x = np.append(x[0], x[1:] - 0.97 * x[:-1]) * np.hamming(len(x))
    r = np.correlate(x, x, "full")[len(x) - 1 : len(x) + order]
    a, e = np.zeros(order + 1), r[0]
    a[0] = 1
    for i in range(1, order + 1):
        k = -(r[i] + a[1:i] @ r[i - 1 : 0 : -1]) / e
        a[1 : i + 1] = a[1 : i + 1] + k * np.append(a[1:i][::-1], 1)
        e *= 1 - k * k
    roots = np.roots(a)
    roots = roots[roots.imag > 0]
    hz, width = np.angle(roots) * rate / (2 * np.pi), -np.log(np.abs(roots)) * rate / np.pi
    return np.sort(hz[(hz > 90) & (width < 400)])


#: Root mean square under which a frame is silence, whatever the other frames are.
SILENCE = 1e-3


def cepstral_profile(x: np.ndarray, rate: int, coefs: int = 20) -> np.ndarray:
    """Unit mean of the louder frames' cepstra without the level term; empty where under two frames can be measured."""
    n, hop = max(8, int(0.032 * rate)), max(1, int(0.016 * rate))
    if len(x) < n:
        return np.zeros(0)
    f = np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), n)[::hop] * np.hanning(n)
    level = np.sqrt(np.square(f).mean(1))
    loud = level > SILENCE
    if loud.sum() >= 4:
        loud &= level >= np.median(level[loud])
    if loud.sum() < 2:
        return np.zeros(0)
    spectrum = np.abs(np.fft.rfft(f[loud], axis=1))
    # Each frame over its own mean before the log, so that the profile doesn't follow the level.
    spectrum /= spectrum.mean(1, keepdims=True) + 1e-20
    mean = np.fft.irfft(np.log(spectrum + 1e-12), axis=1)[:, 1 : coefs + 1].mean(0)
    norm = np.linalg.norm(mean)
    return mean / norm if norm > 1e-12 else np.zeros(0)


def band_profile(x: np.ndarray, rate: int, bands: int = 24, n: int = 512, hop: int = 128) -> np.ndarray:
    """Unit, mean-free spectrum in log-spaced bands, louder frames weighing more."""
    p = np.abs(stft(x, n, hop)) ** 2
    edges = np.unique(np.geomspace(1, p.shape[0], bands + 1).astype(int))
    b = np.stack([p[i:j].mean(0) for i, j in zip(edges[:-1], np.maximum(edges[1:], edges[:-1] + 1), strict=True)])
    v = np.log((b * p.sum(0)).sum(1) / (p.sum() + 1e-12) + 1e-12)
    v -= v.mean()
    return v / (np.linalg.norm(v) + 1e-12)


def per_signal(df: DataFrame, keys: list[str], index: str, value: str, fn: Callable[[np.ndarray], np.ndarray], out: str = "value") -> DataFrame:
    """(keys, i, out): fn over each signal's samples in order."""
    kinds = dict(df.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        y = np.atleast_1d(fn(g.sort_values(index)[value].to_numpy(float)))
        return pd.DataFrame({**{k: g[k].iloc[0] for k in keys}, "i": np.arange(len(y)), out: y})

    return df.select(*keys, index, value).groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", i long, {out} double")


def per_clip(df: DataFrame, clip: str, channel: str, index: str, value: str, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(clip, channel, index, value): fn over the matrix (channels, samples) of each clip."""
    kinds = dict(df.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        m = g.pivot(index=channel, columns=index, values=value).sort_index().sort_index(axis=1)
        y = pd.DataFrame(fn(m.to_numpy(float)), index=m.index, columns=m.columns).stack().rename(value).reset_index()
        y[clip] = g[clip].iloc[0]
        return y[[clip, channel, index, value]]

    return df.select(clip, channel, index, value).groupBy(clip).applyInPandas(run, f"{clip} {kinds[clip]}, {channel} {kinds[channel]}, {index} {kinds[index]}, {value} double")
