"""Queries that prepare, cut and describe channels: windows, anchors, gains, landmarks, cadence. Each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from chronoweave.functions import numeric as nu
from chronoweave.operators import filters as fi
from chronoweave.operators import frames as fr
from chronoweave.operators import matching as mt
from chronoweave.operators import resample as rs
from chronoweave.plans import series as se
from chronoweave.plans.entities import E, _vectors
from chronoweave.plans.series import H, I, K, r6
from chronoweave.sources.tables import hourly, table


def durations(s, d):
    """Last index of a channel's series over its rate; 0.0 for one without events."""
    ev = table(s, d, "events").withColumn("i", F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")))
    known = ev.groupBy(F.col("event_type").alias("channel")).agg((F.max("i") / 25.0).alias("seconds"))
    asked = known.select("channel").unionByName(s.createDataFrame([("absent",)], "channel string"))
    return asked.join(known, "channel", "left").select("channel", r6(F.coalesce("seconds", F.lit(0.0))).alias("seconds"))


DURATIONS = "SELECT event_type AS channel, round(count(*) / 25.0, 6) + 0.0 AS seconds FROM events GROUP BY 1 UNION ALL SELECT 'absent', 0.0"


def mono_resampled(s, d):
    """The mean of the channels at each hour, read at two fifths of the rate between the hours on either side."""
    m = fr.mono(hourly(s, d), [], "hour", "energy")
    first = lambda h: F.ceil(h * 2 / 5)
    out = m.select("hour", "energy", F.explode(F.when(first(F.col("hour") + 1) > first(F.col("hour")), F.sequence(first(F.col("hour")), first(F.col("hour") + 1) - 1))).alias("out"))
    after = m.select((F.col("hour") - 1).alias("hour"), F.col("energy").alias("after"))
    between = F.col("energy") + (F.coalesce("after", "energy") - F.col("energy")) * (F.col("out") * 2.5 - F.col("hour"))
    return out.join(after, "hour", "left").select("out", r6(between).alias("x"))


MONO = f"""
WITH {H}, m AS (SELECT hour, avg(energy) AS x FROM h GROUP BY 1), g AS (SELECT unnest(range(288)) AS out)
SELECT out, round(a.x + (coalesce(b.x, a.x) - a.x) * (out * 2.5 - a.hour), 6) + 0.0 AS x FROM g JOIN m a ON a.hour = floor(out * 2.5) LEFT JOIN m b ON b.hour = a.hour + 1"""


def lip_apertures(s, d):
    """P9, P10 on landmark rows: the first 16 numbers of a vector are 8 points of the inner ring in its crop, the next 4 the eyes, two more the size of the crop."""
    v = F.col("v")
    at = lambda i: F.get(v, F.lit(i))
    crop = F.floor(F.abs(at(20)) * 400)
    x, y = (lambda k: at(2 * (k % 8)) * crop), (lambda k: at(2 * (k % 8) + 1) * crop)
    area = F.abs(sum(x(k) * y(k + 1) - x(k + 1) * y(k) for k in range(8))) / 2
    eyes = F.sqrt((at(16) - at(18)) ** 2 + (at(17) - at(19)) ** 2) * crop
    span = F.greatest(*[y(k) for k in range(8)]) - F.least(*[y(k) for k in range(8)])
    ok = (crop >= 24) & (eyes >= 1e-6)
    gap = F.abs(y(6) - y(2))
    return _vectors(s, d).select("vec_id", r6(F.when(ok, area / (eyes * eyes))).alias("aperture"), r6(F.when(ok & (span > 1e-6), area / (eyes * span))).alias("by_span"), r6(F.when(ok, gap / eyes)).alias("gap"), r6(F.when(ok & (span > 1e-6), gap / span)).alias("gap_v"))


_X, _Y = (lambda k: f"v[{2 * (k % 8) + 1}] * crop"), (lambda k: f"v[{2 * (k % 8) + 2}] * crop")
APERTURES = f"""
WITH {E}, c AS (SELECT *, floor(abs(v[21]) * 400) AS crop FROM e),
a AS (SELECT vec_id, crop, abs({' + '.join(f'{_X(k)} * {_Y(k + 1)} - {_X(k + 1)} * {_Y(k)}' for k in range(8))}) / 2 AS area, sqrt((v[17] - v[19]) ** 2 + (v[18] - v[20]) ** 2) * crop AS eyes,
  greatest({', '.join(_Y(k) for k in range(8))}) - least({', '.join(_Y(k) for k in range(8))}) AS span, abs({_Y(6)} - {_Y(2)}) AS gap FROM c),
o AS (SELECT *, crop >= 24 AND eyes >= 1e-6 AS ok FROM a)
SELECT vec_id, CASE WHEN ok THEN round(area / (eyes * eyes), 6) + 0.0 END AS aperture, CASE WHEN ok AND span > 1e-6 THEN round(area / (eyes * span), 6) + 0.0 END AS by_span,
  CASE WHEN ok THEN round(gap / eyes, 6) + 0.0 END AS gap, CASE WHEN ok AND span > 1e-6 THEN round(gap / span, 6) + 0.0 END AS gap_v FROM o"""


#: Landmarks of a row: seven that the mouth doesn't move, then the upper and the lower lip.
_RIGID = 7


def lip_gap_fitted(s, d):
    """The opening after a row's rigid landmarks are brought to the median ones of its track (label)."""
    v = _vectors(s, d)
    point = lambda k: F.struct(F.get("v", F.lit(2 * k)).alias("x"), F.get("v", F.lit(2 * k + 1)).alias("y"))
    rows = v.select("vec_id", "label", F.array(*[point(k) for k in range(_RIGID)]).alias("p"), point(_RIGID).alias("up"), point(_RIGID + 1).alias("low"))
    each = rows.select("label", F.posexplode("p").alias("k", "p")).groupBy("label", "k").agg(F.percentile("p.x", F.lit(0.5)).alias("x"), F.percentile("p.y", F.lit(0.5)).alias("y"))
    usual = each.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x", "y"))), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("q"))
    fitted = rows.join(usual, "label").withColumn("fit", nu.planar_fit(F.col("p"), F.col("q")))
    gap = F.abs(nu.moved(F.col("fit"), F.col("low"))["y"] - nu.moved(F.col("fit"), F.col("up"))["y"])
    scale = F.sqrt(F.col("fit.re") ** 2 + F.col("fit.im") ** 2)
    return fitted.select("vec_id", r6(scale).alias("scale"), r6(F.atan2("fit.im", "fit.re")).alias("turn"), r6(gap).alias("gap"))


LIP_GAP = f"""
WITH {E}, x AS (SELECT vec_id, label, v, k, v[2 * k + 1] AS x, v[2 * k + 2] AS y FROM e, (SELECT unnest(range({_RIGID})) AS k)),
q AS (SELECT label, k, quantile_cont(x, 0.5) AS u, quantile_cont(y, 0.5) AS w FROM x GROUP BY 1, 2),
c AS (SELECT vec_id, x.label, k, v, x - avg(x) OVER m AS x, y - avg(y) OVER m AS y, u - avg(u) OVER m AS u, w - avg(w) OVER m AS w FROM x JOIN q USING (label, k) WINDOW m AS (PARTITION BY vec_id)),
f AS (SELECT vec_id, any_value(v) AS v, sum(u * x + w * y) / sum(x * x + y * y) AS re, sum(w * x - u * y) / sum(x * x + y * y) AS im FROM c GROUP BY 1)
SELECT vec_id, round(sqrt(re * re + im * im), 6) + 0.0 AS scale, round(atan2(im, re), 6) + 0.0 AS turn,
  round(abs(im * (v[{2 * _RIGID + 3}] - v[{2 * _RIGID + 1}]) + re * (v[{2 * _RIGID + 4}] - v[{2 * _RIGID + 2}])), 6) + 0.0 AS gap FROM f"""


def gain_to_target(s, d):
    """Gain that brings a channel to a target level, and its mean under another 6 dB down."""
    h = hourly(s, d).groupBy("channel").agg(F.sqrt(F.avg(F.col("energy"))).alias("rms"), F.avg("n").alias("mean"))
    gain = F.when(F.col("rms") > 1e-9, F.lit(10.0) / F.col("rms")).otherwise(1.0)
    return h.select("channel", r6(gain, 9).alias("gain"), r6(F.col("mean") * gain * F.pow(F.lit(10.0), F.lit(-6 / 20)), 9).alias("mixed"))


GAIN_TARGET = f"WITH {H}, a AS (SELECT channel, sqrt(avg(energy)) AS rms, avg(n) AS mean FROM h GROUP BY 1), g AS (SELECT *, CASE WHEN rms > 1e-9 THEN 10.0 / rms ELSE 1.0 END AS gain FROM a) SELECT channel, round(gain, 9) + 0.0 AS gain, round(mean * gain * pow(10.0, -0.3), 9) + 0.0 AS mixed FROM g"


def frame_map(s, d):
    """P20: samples to frames, floored, and back, ceiled."""
    n = table(s, d, "events").groupBy(F.col("event_type").alias("channel")).agg(F.count("*").alias("n"))
    frames = F.floor(F.col("n") / 16.0 * 2.5).cast("long")
    return n.select("channel", "n", frames.alias("frames"), F.ceil(frames / 2.5 * 16.0).cast("long").alias("samples"))


FRAME_MAP = "WITH c AS (SELECT event_type AS channel, count(*) AS n FROM events GROUP BY 1), f AS (SELECT *, floor(n / 16.0 * 2.5)::BIGINT AS frames FROM c) SELECT *, ceil(frames / 2.5 * 16.0)::BIGINT AS samples FROM f"


def drift_correction(s, d):
    """Offsets of orders in frames, less half a frame, past a deadband, as a bounded rate; and the share to warn of."""
    frame, dead, gain, most = 0.04, 0.1, 0.05, 0.02
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("clip"), ((F.col("o_totalprice").cast("double") % 1.0) - 0.5).alias("x"))
    drift = F.floor(F.col("x") / frame) * frame + frame / 2
    excess = F.signum("drift") * F.greatest(F.abs("drift") - dead, F.lit(0.0))
    df = o.withColumn("drift", drift).withColumn("rate", F.greatest(F.lit(-most), F.least(F.lit(most), -gain * excess)))
    return df.groupBy((F.col("clip") % 100).alias("group")).agg(r6(F.avg("rate")).alias("rate"), r6(F.avg((F.abs("drift") > 2 * dead).cast("int"))).alias("warn"))


DRIFT_CORRECTION = """
WITH o AS (SELECT o_orderkey AS clip, (o_totalprice::DOUBLE % 1.0) - 0.5 AS x FROM orders), f AS (SELECT clip, floor(x / 0.04) * 0.04 + 0.02 AS drift FROM o),
r AS (SELECT clip, drift, greatest(-0.02, least(0.02, -0.05 * sign(drift) * greatest(abs(drift) - 0.1, 0.0))) AS rate FROM f)
SELECT clip % 100 AS "group", round(avg(rate), 6) + 0.0 AS rate, round(avg((abs(drift) > 0.2)::INT), 6) + 0.0 AS warn FROM r GROUP BY 1"""


def split_labels(s, d):
    """Hours without events, below and above a split, the geometric mean of the least and greatest channel means."""
    h = hourly(s, d)
    split = h.where("n > 0").groupBy("channel").agg(F.avg("energy").alias("m")).agg(F.sqrt(F.min("m") * F.max("m")).alias("split"))
    label = F.when(F.col("n") == 0, "none").when(F.col("energy") < F.col("split"), "below").otherwise("above")
    return h.join(F.broadcast(split.limit(1))).groupBy("channel", label.alias("label")).agg(F.count("*").alias("hours"))


SPLIT_LABELS = f"WITH {H}, m AS (SELECT sqrt(min(m) * max(m)) AS split FROM (SELECT avg(energy) AS m FROM h WHERE n > 0 GROUP BY channel)) SELECT channel, CASE WHEN n = 0 THEN 'none' WHEN energy < split THEN 'below' ELSE 'above' END AS label, count(*) AS hours FROM h, m GROUP BY 1, 2"


def window_coverage(s, d):
    """Hours within half a window of the nearest verified centre."""
    h = hourly(s, d)
    centres = h.where((F.col("n") > 2) & (F.col("hour") % 3 == 0)).select("channel", F.col("hour").alias("centre"))
    return rs.covered(h.select("channel", "hour"), centres, K, I, "centre", 2.5, "covered").select("channel", F.col("hour").cast("long").alias("hour"), "covered")


COVERAGE = f"WITH {H} SELECT a.channel, a.hour, EXISTS (SELECT 1 FROM h c WHERE c.channel = a.channel AND c.n > 2 AND c.hour % 3 = 0 AND c.hour BETWEEN a.hour - 2 AND a.hour + 2) AS covered FROM h a"


def interferers(s, d):
    """For each customer the next other of the same nation, else the first of another."""
    c = table(s, d, "customer").select("c_custkey", "c_nationkey")
    own = Window.partitionBy("c_nationkey")
    c = c.withColumns({"next": F.lead("c_custkey").over(own.orderBy("c_custkey")), "first": F.min("c_custkey").over(own)})
    least = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("k")).orderBy("k").limit(2)
    two = F.broadcast(least.agg(F.sort_array(F.collect_list(F.struct("k", "c_nationkey"))).alias("two")).limit(1))
    same = F.coalesce("next", F.when(F.col("first") != F.col("c_custkey"), F.col("first")))
    other = F.when(F.get("two", F.lit(0))["c_nationkey"] != F.col("c_nationkey"), F.get("two", F.lit(0))["k"]).otherwise(F.get("two", F.lit(1))["k"])
    return c.join(two).select("c_custkey", F.coalesce(same, other).alias("interferer"), same.isNotNull().alias("same_nation"))


INTERFERERS = """
WITH c AS (SELECT c_custkey, c_nationkey, lead(c_custkey) OVER w AS nx, min(c_custkey) OVER (PARTITION BY c_nationkey) AS fi FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
s AS (SELECT *, coalesce(nx, CASE WHEN fi <> c_custkey THEN fi END) AS same FROM c)
SELECT c_custkey, coalesce(same, (SELECT min(o.c_custkey) FROM customer o WHERE o.c_nationkey <> s.c_nationkey)) AS interferer, same IS NOT NULL AS same_nation FROM s"""

BODY, FADE, CONTEXT = 40, 4, 6


def window_starts(s, d):
    """Starts of windows of a body that overlap by a fade; the last is the first that reaches the end."""
    n = table(s, d, "events").groupBy(F.col("event_type").alias("channel")).agg(F.count("*").alias("n"))
    step = BODY - FADE
    more = F.ceil(F.greatest(F.col("n") - BODY, F.lit(0)) / step).cast("int")
    return n.select("channel", F.posexplode(F.sequence(F.lit(0), more)).alias("w", "k")).select("channel", F.col("w").cast("long").alias("w"), (F.col("k") * step).cast("long").alias("start"))


STARTS = "WITH c AS (SELECT event_type AS channel, count(*) AS n FROM events GROUP BY 1) SELECT channel, w, w * 36 AS start FROM (SELECT channel, unnest(range(1 + ceil(greatest(n - 40, 0) / 36.0)::BIGINT)) AS w FROM c)"


def window_bodies(s, d):
    """Windows with context on both sides, of which only the body is kept."""
    h = hourly(s, d).select("channel", F.col("hour").cast("long").alias("hour"), "n")
    wide, step = BODY + 2 * CONTEXT, BODY - FADE
    first = F.greatest(F.lit(0), F.ceil((F.col("hour") + CONTEXT - wide + 1) / step)).cast("int")
    last = F.floor((F.col("hour") + CONTEXT) / step).cast("int")
    df = h.withColumn("w", F.explode(F.when(first <= last, F.sequence(first, last))))
    offset = F.col("hour") + CONTEXT - F.col("w") * step
    return df.where((offset >= CONTEXT) & (offset < CONTEXT + BODY)).groupBy("channel", F.col("w").cast("long").alias("w")).agg(F.sum("n").alias("n"), F.min("hour").alias("first"), F.max("hour").alias("last"))


BODIES = f"WITH {H} SELECT channel, w, sum(n)::BIGINT AS n, min(hour) AS first, max(hour) AS last FROM h, (SELECT unnest(range(40)) AS w) WHERE hour >= w * 36 AND hour < w * 36 + 40 GROUP BY 1, 2"


def dropouts_filled(s, d):
    """Absent hours hold the last value; what is before any value is zero."""
    h = hourly(s, d).withColumn("v", F.when(F.col("n") > 2, F.col("energy")))
    held = F.last("v", ignorenulls=True).over(Window.partitionBy("channel").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0))
    return h.select("channel", F.col("hour").cast("long").alias("hour"), r6(F.coalesce(held, F.lit(0.0)), 5).alias("v"))


DROPOUTS = f"WITH {H} SELECT channel, hour, round(coalesce(last_value(CASE WHEN n > 2 THEN energy END IGNORE NULLS) OVER (PARTITION BY channel ORDER BY hour), 0.0), 5) + 0.0 AS v FROM h"


BAND = fi.bandpass(3, 1.5, 8.0, 24.0)


def lip_envelope(s, d):
    """The envelope of what repeats 1.5 to 8 times a day, at 24 samples a day; hours without events are absent."""
    h = hourly(s, d).withColumn("v", F.when(F.col("n") > 0, F.col("n").cast("double")))
    return fi.band_envelope(h, K, "hour", "v", 24.0).select("channel", F.col("hour").cast("long").alias("hour"), r6("envelope").alias("envelope"))


def _pass_sql(name: str, src: str) -> str:
    """Recursive CTE name(channel, i, y, states) of the band's sections over src(channel, i, x), whose first i is -21."""
    gain, sections = BAND
    steady = ", ".join(f"x * {v!r}" for v in fi.cascade(*BAND).steady().tolist())
    y = "".join(f", y{k} + f.p{2 * k} AS y{k + 1}" for k in range(len(sections)))
    after = "".join(f", f.p{2 * k + 1} - {a1!r} * y{k + 1}, -y{k} - {a2!r} * y{k + 1}" for k, (a1, a2) in enumerate(sections))
    return f"""{name}(channel, i, y, {', '.join(f'p{k}' for k in range(2 * len(sections)))}) AS (SELECT channel, -22::BIGINT, 0.0::DOUBLE, {steady} FROM {src} WHERE i = -21 UNION ALL
  SELECT channel, i, y{len(sections)}{after.replace('f.', '')} FROM (SELECT e.channel, e.i, {gain!r} * e.x AS y0{y}, f.* EXCLUDE (channel, i, y) FROM {name} f JOIN {src} e ON e.channel = f.channel AND e.i = f.i + 1))"""


ENVELOPE = f"""
WITH RECURSIVE {H}, v AS (SELECT channel, hour, n > 0 AS ok, coalesce(last_value(nullif(n, 0) IGNORE NULLS) OVER w, first_value(nullif(n, 0) IGNORE NULLS) OVER (PARTITION BY channel ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))::DOUBLE AS v
  FROM h WINDOW w AS (PARTITION BY channel ORDER BY hour)),
c AS (SELECT v.channel, hour AS i, v - m AS x FROM v JOIN (SELECT channel, avg(v) AS m FROM v GROUP BY 1 HAVING sum(ok::INT) >= 8) USING (channel)),
e1 AS (SELECT * FROM c UNION ALL SELECT c.channel, -c.i, 2 * z.x - c.x FROM c JOIN c z ON z.channel = c.channel AND z.i = 0 WHERE c.i BETWEEN 1 AND 21
  UNION ALL SELECT c.channel, 1438 - c.i, 2 * z.x - c.x FROM c JOIN c z ON z.channel = c.channel AND z.i = 719 WHERE c.i BETWEEN 698 AND 718),
{_pass_sql('forth', 'e1')}, e2 AS (SELECT channel, 719 - i AS i, y AS x FROM forth WHERE i >= -21),
{_pass_sql('back', 'e2')}, b AS (SELECT channel, 719 - i AS i, y AS x FROM back WHERE i BETWEEN 0 AND 719),
q AS (SELECT a.channel, a.i, sum(o.x * cot(pi() * (a.i - o.i) / 720)) / 360 AS q FROM b a JOIN b o ON o.channel = a.channel AND abs(a.i - o.i) % 2 = 1 GROUP BY 1, 2)
SELECT v.channel, v.hour, round(CASE WHEN ok THEN coalesce(sqrt(b.x * b.x + q * q), 0.0) ELSE 0.0 END, 6) + 0.0 AS envelope
FROM v LEFT JOIN b ON b.channel = v.channel AND b.i = v.hour LEFT JOIN q ON q.channel = v.channel AND q.i = v.hour"""


def lip_resampled(s, d):
    """The resampled track without its validity."""
    return se.resample_hold(s, d).drop("valid")


def channel_sets(s, d):
    """Strict channels, then natural ones, as one set, with the offset at which each mode starts."""
    names = hourly(s, d).groupBy("channel").agg(F.sum("n").alias("n"))
    strict = names.where("n % 2 = 0").select(F.lit("a_strict").alias("mode"), "channel")
    both = strict.unionByName(names.select(F.lit("b_natural").alias("mode"), "channel"))
    place = (F.row_number().over(Window.orderBy("mode", "channel")) - 1).cast("long")
    return both.withColumn("place", place).withColumn("base", F.min("place").over(Window.partitionBy("mode")))


SETS = f"""
WITH {H}, n AS (SELECT channel, sum(n) AS n FROM h GROUP BY 1), b AS (SELECT 'a_strict' AS mode, channel FROM n WHERE n % 2 = 0 UNION ALL SELECT 'b_natural', channel FROM n),
a AS (SELECT *, row_number() OVER (ORDER BY mode, channel) - 1 AS place FROM b) SELECT *, min(place) OVER (PARTITION BY mode) AS base FROM a"""


def _feature_rows(s: SparkSession, d: str) -> DataFrame:
    return fr.zscore(fr.zscore(hourly(s, d), K, "n", "za"), K, "energy", "zb")


def match_backfill(s, d):
    """M1's last step: pairs that beat every rival of their row and column by 0.3 are kept, the other stems go to the best free track with confidence 0."""
    z = _feature_rows(s, d)
    a, b = z.select(F.col("channel").alias("track"), "hour", "za"), z.select(F.col("channel").alias("stem"), "hour", "zb")
    m = a.join(b, "hour").groupBy("track", "stem").agg(F.round(F.sum(F.col("za") * F.col("zb")) / 720, 9).alias("score")).withColumn("clip", F.lit(1))
    rivals = lambda by: F.max("score").over(Window.partitionBy(by).orderBy(F.desc("score"), "track", "stem").rowsBetween(1, Window.unboundedFollowing))
    ranked = m.withColumns({"r": F.coalesce(rivals("track"), F.lit(-9.0)), "c": F.coalesce(rivals("stem"), F.lit(-9.0)), "kr": F.row_number().over(Window.partitionBy("track").orderBy(F.desc("score"), "track", "stem")), "kc": F.row_number().over(Window.partitionBy("stem").orderBy(F.desc("score"), "track", "stem"))})
    margin = F.col("score") - F.greatest("r", "c")
    sure = ranked.where((F.col("kr") == 1) & (F.col("kc") == 1)).where(margin >= 0.3).select("clip", "track", "stem", margin.alias("confidence"))
    return mt.backfill(sure, m, ["clip"], "track", "stem", "score").select("track", "stem", r6("confidence", 4).alias("confidence"))


def cadence(s, d):
    """Detection every 5th hour, and at each hour while none is held; what it finds is held to the next."""
    h = hourly(s, d).withColumn("found", F.when(F.col("n") > 1, F.col("energy"))).withColumn("block", F.floor(F.col("hour") / 5))
    w = Window.partitionBy("channel", "block").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return h.select("channel", F.col("hour").cast("long").alias("hour"), r6(F.first("found", ignorenulls=True).over(w), 5).alias("held"))


CADENCE = f"WITH {H} SELECT channel, hour, round(first_value(CASE WHEN n > 1 THEN energy END IGNORE NULLS) OVER (PARTITION BY channel, hour // 5 ORDER BY hour ROWS UNBOUNDED PRECEDING), 5) + 0.0 AS held FROM h"


def anchor_score(s, d):
    """Vectors of a label as chunks in order: the weighted mean of those before (observe), whether there is one (ready), and the cosine of the next with it (score)."""
    v = _vectors(s, d).withColumn("w", (F.col("vec_id") % 7 + 1).cast("double"))
    x = v.select("vec_id", "label", "w", F.posexplode("v").alias("dim", "x"))
    before = Window.partitionBy("label", "dim").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("m", F.sum(F.col("x") * F.col("w")).over(before) / F.sum("w").over(before))
    g = x.groupBy("label", "vec_id").agg(F.sum(F.col("x") * F.col("m")).alias("xm"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("m") * F.col("m")).alias("mm"))
    return g.select("label", "vec_id", F.col("mm").isNotNull().alias("ready"), r6(F.col("xm") / (F.sqrt("xx") * F.sqrt("mm") + 1e-12)).alias("score"))


ANCHOR = f"""
WITH {E}, x AS (SELECT vec_id, label, (vec_id % 7 + 1)::DOUBLE AS w, unnest(range(len(v))) AS dim, unnest(v) AS x FROM e),
m AS (SELECT *, sum(x * w) OVER b / sum(w) OVER b AS m FROM x WINDOW b AS (PARTITION BY label, dim ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT label, vec_id, sum(x * m) AS xm, sum(x * x) AS xx, sum(m * m) AS mm FROM m GROUP BY 1, 2)
SELECT label, vec_id, mm IS NOT NULL AS ready, round(xm / (sqrt(xx) * sqrt(mm) + 1e-12), 6) + 0.0 AS score FROM g"""


def chunk_anchor(s, d):
    """Scores of tracks and stems within each chunk of 72 hours."""
    h = hourly(s, d).withColumn("chunk", F.floor(F.col("hour") / 72).cast("long"))
    z = fr.zscore(fr.zscore(h, ["channel", "chunk"], "n", "za"), ["channel", "chunk"], "energy", "zb")
    a, b = z.select("chunk", "hour", F.col("channel").alias("track"), "za"), z.select("chunk", "hour", F.col("channel").alias("stem"), "zb")
    return a.join(b, ["chunk", "hour"]).groupBy("chunk", "track", "stem").agg(r6(F.avg(F.col("za") * F.col("zb"))).alias("score"))


CHUNK_ANCHOR = f"""
WITH {H}, c AS (SELECT *, hour // 72 AS chunk FROM h),
z AS (SELECT *, CASE WHEN stddev_pop(n) OVER w > 1e-9 THEN (n - avg(n) OVER w) / stddev_pop(n) OVER w ELSE 0 END AS za, CASE WHEN stddev_pop(energy) OVER w > 1e-9 THEN (energy - avg(energy) OVER w) / stddev_pop(energy) OVER w ELSE 0 END AS zb FROM c WINDOW w AS (PARTITION BY channel, chunk))
SELECT a.chunk, a.channel AS track, b.channel AS stem, round(avg(a.za * b.zb), 6) + 0.0 AS score FROM z a JOIN z b USING (chunk, hour) GROUP BY 1, 2, 3"""


QUERIES = {
    "mono_resampled": (mono_resampled, MONO),
    "durations": (durations, DURATIONS),
    "lip_apertures": (lip_apertures, APERTURES),
    "lip_gap_fitted": (lip_gap_fitted, LIP_GAP),
    "gain_to_target": (gain_to_target, GAIN_TARGET),
    "frame_map": (frame_map, FRAME_MAP),
    "drift_correction": (drift_correction, DRIFT_CORRECTION),
    "split_labels": (split_labels, SPLIT_LABELS),
    "window_coverage": (window_coverage, COVERAGE),
    "interferers": (interferers, INTERFERERS),
    "window_starts": (window_starts, STARTS),
    "window_bodies": (window_bodies, BODIES),
    "dropouts_filled": (dropouts_filled, DROPOUTS),
    "lip_envelope": (lip_envelope, ENVELOPE),
    "lip_resampled": (lip_resampled, f"SELECT channel, out, v FROM ({se.RESAMPLE_HOLD})"),
    "channel_sets": (channel_sets, SETS),
    "match_backfill": (match_backfill, None),
    "cadence": (cadence, CADENCE),
    "anchor_score": (anchor_score, ANCHOR),
    "chunk_anchor": (chunk_anchor, CHUNK_ANCHOR),
}
