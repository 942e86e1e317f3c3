"""Scalar expressions under the engine's null contract: NaN and infinities mean absent and become NULL on the way in."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(x: Column) -> Column:
    """NULL for NaN and infinities. Spark orders NaN above every number, so a comparison must never see one."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(math.inf)), x)


def power_db(power: Column, floor: float = 1e-12) -> Column:
    return 10 * F.log10(power + F.lit(floor))


def level_db(rms: Column, floor: float = 1e-10) -> Column:
    return 20 * F.log10(rms + F.lit(floor))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(a, b)


def clip(x: Column, low: float, high: float) -> Column:
    """x held to a range; NULL stays NULL, which least() and greatest() alone would not keep."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v over its length; NULL for a zero vector. The length is held in an array, else each element would work it out anew."""
    over = lambda norm: F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))
    return F.transform(F.array(F.sqrt(dot(v, v))), over)[0]


def cosine(a: Column, b: Column) -> Column:
    """Inner product of unit vectors, NULL if either is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), dot(a, b))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two (x, y, w, h) structs; 0 if they are apart."""
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    both = wide * high
    return F.when((wide <= 0) | (high <= 0), 0.0).otherwise(both / (a["w"] * a["h"] + b["w"] * b["h"] - both + 1e-12))


def polygon_area(ring: Column) -> Column:
    """Shoelace area of an array of (x, y) structs, closed by its first corner."""
    n = F.size(ring)
    cross = F.transform(ring, lambda p, i: p["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2


def planar_fit(a: Column, b: Column) -> Column:
    """The scaling, turn and shift that bring points a closest to b in the mean square: (re, im, ax, ay, bx, by).

    a and b are arrays of (x, y) structs of one length. As complex numbers about their centres the best factor is
    sum(b * conj(a)) / sum(|a|^2). Points a that all lie on one place are only shifted. NULL if a coordinate is missing.
    """
    mean = lambda p, c: F.aggregate(p, F.lit(0.0), lambda s, x: s + x[c]) / F.size(p)
    ends = F.struct(mean(a, "x").alias("ax"), mean(a, "y").alias("ay"), mean(b, "x").alias("bx"), mean(b, "y").alias("by"))
    zero = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"), F.lit(0.0).alias("n"))

    def add(m: Column, s: Column, p: Column) -> Column:
        x, y, u, v = p["a"]["x"] - m["ax"], p["a"]["y"] - m["ay"], p["b"]["x"] - m["bx"], p["b"]["y"] - m["by"]
        return F.struct((s["re"] + u * x + v * y).alias("re"), (s["im"] + v * x - u * y).alias("im"), (s["n"] + x * x + y * y).alias("n"))

    def fit(m: Column) -> Column:
        s = F.aggregate(F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b"))), zero, lambda s, p: add(m, s, p))
        some = s["n"] > 1e-12 * F.size(a)
        re, im = F.when(some, s["re"] / s["n"]).when(~some, 1.0), F.when(some, s["im"] / s["n"]).when(~some, 0.0)
        return F.struct(re.alias("re"), im.alias("im"), *[m[c].alias(c) for c in ("ax", "ay", "bx", "by")])

    return F.transform(F.array(ends), fit)[0]


def moved(fit: Column, p: Column) -> Column:
    """A point taken along with a fit."""
    x, y = p["x"] - fit["ax"], p["y"] - fit["ay"]
    return F.struct((fit["re"] * x - fit["im"] * y + fit["bx"]).alias("x"), (fit["im"] * x + fit["re"] * y + fit["by"]).alias("y"))


def ownership(mine: Column, other: Column, sharpness: float = 2.0) -> Column:
    return 1 / (1 + F.pow(mine / other, F.lit(sharpness)))


def deadband(excess: Column, gain: float, limit: float, band: float) -> Column:
    """Correction against a drift: none inside the band, else proportional and held to the limit."""
    return F.when(F.abs(excess) <= band, 0.0).otherwise(clip(-gain * (excess - F.signum(excess) * band), -limit, limit))
