"""Queries over event series, each with SQL that gives the same rows.

The common series: events per type and hour over 720 hours from 2024-01-01, hours without events as zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import frames as fr
from chronoweave.operators import gates as gt
from chronoweave.operators import matching as mt
from chronoweave.operators import metrics as me
from chronoweave.operators import report as rp
from chronoweave.operators import resample as rs
from chronoweave.operators import windows as wi
from chronoweave.sources.tables import HOURS, hourly, table

K, I = ["channel"], "hour"

H = """
ev AS (SELECT event_type AS channel, date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts))::BIGINT AS hour, value, user_id, ts, event_id FROM events),
per AS (SELECT channel, hour, count(*) AS n, sum(value * value) AS energy FROM ev WHERE hour BETWEEN 0 AND 719 GROUP BY 1, 2),
h AS (SELECT c.channel, t.hour, coalesce(n, 0)::BIGINT AS n, coalesce(energy, 0.0) AS energy, 10 * log10(coalesce(energy, 0.0) + 1e-12) AS db
      FROM (SELECT DISTINCT channel FROM ev) c CROSS JOIN (SELECT unnest(range(720)) AS hour) t LEFT JOIN per p ON p.channel = c.channel AND p.hour = t.hour),
r AS (SELECT *, db - quantile_cont(db, 0.95) OVER (PARTITION BY channel) AS rel FROM h)"""


def r6(c, digits: int = 6):
    """Rounded for comparison between engines, whose sums differ in the last bits; never a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def _rel(s: SparkSession, d: str) -> DataFrame:
    return fr.relative_level(hourly(s, d), K, "db")


def gate_sql(src: str, o: str = "-6", c: str = "-9", on: int = 2, off: int = 2, v: str = "rel") -> str:
    """CTEs that end in g(channel, hour, state, ..) for the two-threshold gate."""
    return f"""
ga AS (SELECT *, coalesce({v} > {o}, false) AS up, coalesce({v} < {c}, false) AS dn FROM {src}),
gb AS (SELECT *, hour - row_number() OVER (PARTITION BY channel, up ORDER BY hour) AS gu, hour - row_number() OVER (PARTITION BY channel, dn ORDER BY hour) AS gd FROM ga),
gc AS (SELECT *, row_number() OVER (PARTITION BY channel, up, gu ORDER BY hour) AS urn, count(*) OVER (PARTITION BY channel, up, gu) AS ul,
       row_number() OVER (PARTITION BY channel, dn, gd ORDER BY hour) AS drn FROM gb),
gd AS (SELECT *, CASE WHEN up AND urn = {on} THEN 1 WHEN dn AND drn = {off} THEN 0 END AS e FROM gc),
g AS (SELECT *, (coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY channel ORDER BY hour), 0) = 1 OR (up AND ul >= {on}))::BIGINT AS state FROM gd)"""


def frame_energy(s, d):
    return hourly(s, d).select("channel", F.col("hour").cast("long").alias("hour"), "n", r6(F.col("db"), 4).alias("db"))


def sample_frames(s, d):
    """P1-P4 over event order: the values of each type as samples, frames of 40."""
    ev = table(s, d, "events").withColumn("i", F.row_number().over(fr.Window.partitionBy("event_type").orderBy("ts", "event_id")) - 1)
    e = fr.frame_energy(ev, ["event_type"], "i", "value", 40).select("event_type", "frame", "db")
    t = fr.rms_frames(ev, ["event_type"], "i", "value", 40).select("event_type", "frame", "rms")
    whole = fr.signal_db(ev, ["event_type"], "value").withColumnRenamed("db", "signal_db")
    out = e.join(t, ["event_type", "frame"], "left").join(whole, "event_type")
    return out.select("event_type", "frame", r6("db", 4).alias("db"), r6("rms", 4).alias("rms"), r6("signal_db", 4).alias("signal_db"))


SAMPLE_FRAMES = """
WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events),
n AS (SELECT event_type, count(*) AS n, 20 * log10(sqrt(avg(value * value)) + 1e-12) AS signal_db FROM x GROUP BY 1)
SELECT event_type, i // 40 AS frame, round(10 * log10(sum(value * value) / 40 + 1e-12), 4) + 0.0 AS db,
       CASE WHEN i // 40 < any_value(n) // 40 THEN round(sqrt(sum(value * value) / 40), 4) + 0.0 END AS rms, round(any_value(signal_db), 4) + 0.0 AS signal_db
FROM x JOIN n USING (event_type) GROUP BY event_type, i // 40"""


def rel_level_p95(s, d):
    return _rel(s, d).select("channel", F.col("hour").cast("long").alias("hour"), r6("rel", 4).alias("rel"))


def _gated(s, d):
    return gt.hysteresis(_rel(s, d), K, I, "rel", F.lit(-6.0), F.lit(-9.0), 2, 2)


def hysteresis_gate(s, d):
    return _gated(s, d).select("channel", F.col("hour").cast("long").alias("hour"), F.col("state").cast("long").alias("state"))


#: Rows of a long series that are sorted in one task.
BLOCK = 8192


def gate_long(s, d):
    """All events as one series in blocks: no task holds the series, however long it is."""
    level = F.when(F.col("value") > 0, F.log10("value")).when(F.col("value") == 0, float("-inf"))  # Spark's own log10(0) is NULL, which shuts nothing
    e = table(s, d, "events").select(F.lit("all").alias("channel"), F.col("event_id").alias("hour"), level.alias("rel"))
    df = gt.hysteresis(e, K, I, "rel", F.lit(1.6), F.lit(1.2), 2, 3, block=F.floor(F.col("hour") / BLOCK))
    return df.select(F.col("hour").alias("event_id"), F.col("state").cast("long").alias("state"))


GATE_LONG = f"""
WITH r AS (SELECT 'all' AS channel, event_id AS hour, log10(value) AS rel FROM events), {gate_sql('r', '1.6', '1.2', 2, 3)}
SELECT hour AS event_id, state FROM g"""


def _all_events(s, d):
    """All events as one series and its blocks: `v` on every third event if over 30, `state` where the value is over 50."""
    e = table(s, d, "events").select(F.lit("all").alias("channel"), F.col("event_id").alias("hour"), "value")
    return e.withColumns({"v": F.when((F.col("value") > 30) & (F.col("hour") % 3 == 0), F.col("value")), "state": (F.col("value") > 50).cast("int")}), F.floor(F.col("hour") / BLOCK)


def holds_long(s, d):
    """Last value, interpolation and ramps over one series in blocks."""
    df, block = _all_events(s, d)
    df = rs.interpolate(df, K, I, "v", "line", block)
    df = wi.ramps(df, K, I, "state", 5, "gain", block)
    df = wi.hold(df, K, I, ["v"], block)
    return df.select(F.col("hour").alias("event_id"), "v", r6("line").alias("line"), r6("gain").alias("gain"))


HOLDS_LONG = """
WITH e AS (SELECT event_id AS i, CASE WHEN value > 30 AND event_id % 3 = 0 THEN value END AS v, (value > 50)::INT AS s FROM events),
a AS (SELECT *, coalesce(lag(s) OVER w, s) AS was, last_value(v IGNORE NULLS) OVER w AS p, max(CASE WHEN v IS NOT NULL THEN i END) OVER w AS pa,
      first_value(v IGNORE NULLS) OVER f AS n, min(CASE WHEN v IS NOT NULL THEN i END) OVER f AS na
      FROM e WINDOW w AS (ORDER BY i), f AS (ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
b AS (SELECT *, min(CASE WHEN s = 1 AND was = 0 THEN i END) OVER (ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - i AS rise,
      i - max(CASE WHEN s = 0 AND was = 1 THEN i END) OVER (ORDER BY i) + 1 AS fall FROM a)
SELECT i AS event_id, coalesce(p, n) AS v, round(coalesce(v, p + (n - p) * (i - pa) / (na - pa), p, n, 0.0), 6) + 0.0 AS line,
  round(CASE WHEN s = 1 THEN 1.0 ELSE greatest(CASE WHEN rise < 5 THEN 0.5 + 0.5 * cos(pi() * rise / 5) ELSE 0.0 END, CASE WHEN fall < 5 THEN 0.5 + 0.5 * cos(pi() * fall / 5) ELSE 0.0 END) END, 6) + 0.0 AS gain
FROM b"""


def islands_long(s, d):
    """Runs of over three events of at least 20 in one series, in blocks."""
    df, block = _all_events(s, d)
    df = wi.long_run_mask(df.withColumn("high", F.col("value") >= 20), K, I, "high", 3, "long", block)
    return wi.runs(df, K, I, "long", block).select("start", "stop")


ISLANDS_LONG = """
WITH z AS (SELECT event_id AS i, event_id - row_number() OVER (ORDER BY event_id) AS k FROM events WHERE value >= 20)
SELECT min(i) AS start, max(i) + 1 AS stop FROM z GROUP BY k HAVING count(*) > 3"""


def smooth_long(s, d):
    """Boxcar, boxcar of what is present, dilation and look-ahead over one series in blocks with halos."""
    df, _ = _all_events(s, d)
    df = wi.boxcar(df, K, I, "value", 9, "mean", BLOCK)
    df = wi.present_boxcar(df, K, I, "v", 3, "present", BLOCK)
    df = wi.dilate(df, K, I, "value", 6, "wide", BLOCK)
    df = wi.look_ahead(df, K, I, "state", 4, "soon", BLOCK)
    return df.select(F.col("hour").alias("event_id"), r6("mean").alias("mean"), r6("present").alias("present"), "wide", F.col("soon").cast("long").alias("soon"))


SMOOTH_LONG = """
WITH e AS (SELECT event_id AS i, value, CASE WHEN value > 30 AND event_id % 3 = 0 THEN value END AS v, (value > 50)::INT AS s FROM events)
SELECT i AS event_id, round(sum(value) OVER (ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9, 6) + 0.0 AS mean,
  round(CASE WHEN count(v) OVER p > 1.5 THEN avg(v) OVER p END, 6) + 0.0 AS present,
  max(value) OVER (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS wide, max(s) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)::BIGINT AS soon
FROM e WINDOW p AS (ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"""


def gate_full(s, d):
    df = gt.gate(_rel(s, d), K, I, "rel", -6.0, -9.0, 2, 2, 1, 3)
    return df.select("channel", F.col("hour").cast("long").alias("hour"), F.col("state").cast("long").alias("state"), r6("gain").alias("gain"), r6(F.col("gain") * F.col("energy"), 7).alias("out_energy"))


GATE_FULL = f"""
WITH {H}, {gate_sql('r')},
a AS (SELECT channel, hour, energy, max(state) OVER (PARTITION BY channel ORDER BY hour ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS s FROM g),
b AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY channel ORDER BY hour), s) AS p FROM a),
c AS (SELECT *, min(CASE WHEN s = 1 AND p = 0 THEN hour END) OVER (PARTITION BY channel ORDER BY hour ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
      max(CASE WHEN s = 0 AND p = 1 THEN hour END) OVER (PARTITION BY channel ORDER BY hour) AS prv FROM b),
k AS (SELECT *, CASE WHEN s = 1 THEN 1.0 ELSE greatest(coalesce(CASE WHEN nxt - hour < 3 THEN 0.5 + 0.5 * cos(pi() * (nxt - hour) / 3) END, 0.0),
      coalesce(CASE WHEN hour - prv + 1 < 3 THEN 0.5 + 0.5 * cos(pi() * (hour - prv + 1) / 3) END, 0.0)) END AS gain FROM c)
SELECT channel, hour, s AS state, round(gain, 6) + 0.0 AS gain, round(gain * energy, 7) + 0.0 AS out_energy FROM k"""


def gate_runs(s, d):
    df = _gated(s, d).withColumn("open", F.col("state") == 1)
    return wi.runs(df, K, I, "open").select("channel", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


GATE_RUNS = f"""
WITH {H}, {gate_sql('r')}, o AS (SELECT channel, hour, hour - row_number() OVER (PARTITION BY channel ORDER BY hour) AS k FROM g WHERE state = 1)
SELECT channel, min(hour) AS start, max(hour) + 1 AS stop FROM o GROUP BY channel, k"""


def gap_sessions(s, d):
    at = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(3600000000))
    ev = table(s, d, "events").select("user_id", at.alias("hour"), F.struct("ts", "event_id", "event_type").alias("e"))
    first = ev.groupBy("user_id", "hour").agg(F.min("e").alias("e")).select("user_id", "hour", F.col("e.event_type").alias("label"))
    return wi.gap_sessions(first, ["user_id"], "hour", "label", 5)


GAP_SESSIONS = f"""
WITH {H}, f AS (SELECT user_id, hour, arg_min(channel, (ts, event_id)) AS label FROM ev GROUP BY 1, 2),
a AS (SELECT *, lag(label) OVER w AS pl, lag(hour) OVER w AS ph FROM f WINDOW w AS (PARTITION BY user_id ORDER BY hour)),
b AS (SELECT *, sum((ph IS NULL OR pl <> label OR hour - ph > 5)::INT) OVER (PARTITION BY user_id ORDER BY hour) AS k FROM a)
SELECT user_id, label, min(hour) AS start, count(*) AS length FROM b GROUP BY user_id, label, k"""


def daily_trace(s, d):
    h = hourly(s, d).withColumn("v", F.when(F.col("n") > 0, F.col("n").cast("double")))
    t = wi.tumbling_trace(h, K, I, "v", "energy", 24)
    return t.select("channel", "window", r6("median").alias("median"), r6("valid").alias("valid"), r6("db", 4).alias("db"))


DAILY_TRACE = f"""
WITH {H} SELECT channel, hour // 24 AS "window", CASE WHEN count(nullif(n, 0)) >= 5 THEN round(quantile_cont(nullif(n, 0)::DOUBLE, 0.5), 6) + 0.0 END AS median,
  round(count(nullif(n, 0)) / count(*), 6) + 0.0 AS valid, round(10 * log10(avg(energy) + 1e-12), 4) + 0.0 AS db FROM h GROUP BY channel, hour // 24"""


def level_profile(s, d):
    out = me.level_profile(hourly(s, d), K, "db", "n", 3.0)
    return out.select("channel", "frames", r6("low_share").alias("low_share"))


LEVEL_PROFILE = f"""
WITH {H}, x AS (SELECT * FROM r WHERE rel >= -25)
SELECT channel, count(*) AS frames, CASE WHEN count(*) >= 10 THEN round(avg((n < 3)::INT), 6) + 0.0 END AS low_share FROM x GROUP BY channel"""


def level_purity(s, d):
    """A channel's even and odd hours as two signals."""
    h = hourly(s, d).withColumn("stem", F.col("hour") % 2)
    return me.purity(me.level_profile(h, ["channel", "stem"], "db", "n", 3.0), K).select("channel", r6("purity").alias("purity"))


LEVEL_PURITY = f"""
WITH {H}, q AS (SELECT *, quantile_cont(db, 0.95) OVER (PARTITION BY channel, hour % 2) AS ref FROM h),
p AS (SELECT channel, hour % 2 AS stem, CASE WHEN count(*) >= 10 THEN avg((n < 3)::INT) END AS p FROM q WHERE db >= ref - 25 GROUP BY 1, 2)
SELECT channel, CASE WHEN count(*) = 2 AND count(p) = 2 THEN round(max(p) - min(p), 6) + 0.0 END AS purity FROM p GROUP BY 1"""


def long_absence(s, d):
    h = hourly(s, d).withColumn("none", F.col("n") == 0)
    h = wi.long_run_mask(h, K, I, "none", 1, "long")
    return wi.runs(h, K, I, "long").select("channel", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


LONG_ABSENCE = f"""
WITH {H}, z AS (SELECT channel, hour, hour - row_number() OVER (PARTITION BY channel ORDER BY hour) AS k FROM h WHERE n = 0)
SELECT channel, min(hour) AS start, max(hour) + 1 AS stop FROM z GROUP BY channel, k HAVING count(*) > 1"""


def pause_zones(s, d):
    z = wi.pause_zones(_rel(s, d), K, I, "rel", -12.0, 3, 1)
    return z.select("channel", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


PAUSE_ZONES = f"""
WITH {H}, z AS (SELECT channel, hour, hour - row_number() OVER (PARTITION BY channel ORDER BY hour) AS k FROM r WHERE rel <= -12)
SELECT channel, min(hour) + 1 AS start, max(hour) AS stop FROM z GROUP BY channel, k HAVING count(*) >= 3 AND max(hour) > min(hour) + 1"""


def _w(before: int, after: int, agg: str) -> str:
    return f"{agg} OVER (PARTITION BY channel ORDER BY hour ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"


def boxcar_smooth(s, d):
    h = wi.boxcar(wi.boxcar(hourly(s, d), K, I, "n", 7, "k7"), K, I, "n", 22, "k22")
    return h.select("channel", F.col("hour").cast("long").alias("hour"), r6("k7").alias("k7"), r6("k22").alias("k22"))


BOXCAR = f"WITH {H} SELECT channel, hour, round({_w(3, 3, 'sum(n)')} / 7, 6) + 0.0 AS k7, round({_w(11, 10, 'sum(n)')} / 22, 6) + 0.0 AS k22 FROM h"


def nan_boxcar(s, d):
    h = hourly(s, d).withColumn("v", F.when(F.col("n") > 1, F.col("n")))
    return wi.present_boxcar(h, K, I, "v", 5, "m").select("channel", F.col("hour").cast("long").alias("hour"), r6("m").alias("m"))


NAN_BOXCAR = f"""
WITH {H}, x AS (SELECT channel, hour, CASE WHEN n > 1 THEN n END AS v FROM h)
SELECT channel, hour, CASE WHEN {_w(2, 2, 'count(v)')} / 5 > 0.5 THEN round({_w(2, 2, 'sum(v)')} / {_w(2, 2, 'count(v)')}, 6) + 0.0 END AS m FROM x"""


def dilate_activity(s, d):
    h = wi.dilate(wi.dilate(hourly(s, d), K, I, "n", 6, "even"), K, I, "n", 5, "odd").withColumn("hot", (F.col("n") > 3).cast("long"))
    return wi.look_ahead(h, K, I, "hot", 2, "soon").select("channel", F.col("hour").cast("long").alias("hour"), "even", "odd", "soon")


DILATE = f"""
WITH {H}, x AS (SELECT *, (n > 3)::BIGINT AS hot FROM h)
SELECT channel, hour, {_w(3, 2, 'max(n)')} AS even, {_w(2, 2, 'max(n)')} AS odd, {_w(0, 2, 'max(hot)')} AS soon FROM x"""


def running_median(s, d):
    return wi.running_median(hourly(s, d), K, I, "n", 13, "m").select("channel", F.col("hour").cast("long").alias("hour"), "m")


RUNNING_MEDIAN = f"""
WITH {H}, e AS (SELECT channel, unnest(range(-6, 726)) AS hour FROM (SELECT DISTINCT channel FROM h)),
x AS (SELECT e.channel, e.hour, h.n FROM e JOIN h ON h.channel = e.channel AND h.hour = greatest(0, least(719, e.hour))),
y AS (SELECT channel, hour, {_w(6, 6, 'quantile_disc(n, 0.5)')} AS m FROM x)
SELECT channel, hour, m FROM y WHERE hour BETWEEN 0 AND 719"""


def box_mean_2d(s, d):
    h = hourly(s, d).select(F.lit(1).alias("k"), (F.col("hour") % 24).alias("row"), F.floor(F.col("hour") / 24).cast("int").alias("col"), "n").groupBy("k", "row", "col").agg(F.sum("n").cast("double").alias("n"))
    return wi.box_mean_2d(h, ["k"], "row", "col", "n", 5, 3, "m").select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), r6("m").alias("m"))


BOX_MEAN = f"""
WITH {H}, x AS (SELECT hour % 24 AS "row", hour // 24 AS col, sum(n) AS n FROM h GROUP BY 1, 2),
a AS (SELECT y."row", y.col, sum(x.n) / 5 AS n FROM x y, (SELECT unnest(range(-2, 3)) AS k) t JOIN x ON x.col = y.col AND x."row" = CASE WHEN y."row" + k < 0 THEN -1 - y."row" - k WHEN y."row" + k > 23 THEN 47 - y."row" - k ELSE y."row" + k END GROUP BY 1, 2),
b AS (SELECT y."row", y.col, sum(x.n) / 3 AS m FROM a y, (SELECT unnest(range(-1, 2)) AS k) t JOIN a x ON x."row" = y."row" AND x.col = CASE WHEN y.col + k < 0 THEN -1 - y.col - k WHEN y.col + k > 29 THEN 59 - y.col - k ELSE y.col + k END GROUP BY 1, 2)
SELECT "row", col, round(m, 6) + 0.0 AS m FROM b"""


def hold_geometry(s, d):
    h = hourly(s, d).withColumn("v", F.when(F.col("n") > 2, F.col("n")))
    return wi.hold(h, K, I, ["v"]).select("channel", F.col("hour").cast("long").alias("hour"), "v")


HOLD = f"""
WITH {H}, x AS (SELECT channel, hour, CASE WHEN n > 2 THEN n END AS v FROM h)
SELECT channel, hour, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY channel ORDER BY hour),
  first_value(v IGNORE NULLS) OVER (PARTITION BY channel ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM x"""


def zscore_step(s, d):
    h = fr.zscore(fr.absolute_step(hourly(s, d), K, I, "n"), K, "n")
    return h.select("channel", F.col("hour").cast("long").alias("hour"), r6("step").alias("step"), r6("z").alias("z"))


ZSCORE_STEP = f"""
WITH {H} SELECT channel, hour, coalesce(abs(n - lag(n) OVER (PARTITION BY channel ORDER BY hour)), 0)::DOUBLE AS step,
  round(coalesce((n - avg(n) OVER (PARTITION BY channel)) / nullif(stddev_pop(n) OVER (PARTITION BY channel), 0), 0), 6) + 0.0 AS z FROM h"""


def resample_hold(s, d):
    h = hourly(s, d).withColumn("v", F.when(F.col("n") > 1, F.col("n").cast("double")))
    out = rs.resample_hold(h, K, I, "v", 1.0, [], 1090, 1.5, 3.0)
    return out.select("channel", F.col("out").cast("long").alias("out"), r6("v").alias("v"), "valid")


RESAMPLE_HOLD = f"""
WITH {H}, x AS (SELECT channel, hour, CASE WHEN n > 1 THEN n::DOUBLE END AS v FROM h),
y AS (SELECT channel, hour, last_value(v IGNORE NULLS) OVER w AS lv, last_value(CASE WHEN v IS NOT NULL THEN hour END IGNORE NULLS) OVER w AS la FROM x WINDOW w AS (PARTITION BY channel ORDER BY hour)),
z AS (SELECT channel, hour, coalesce(hour - la <= 3, false) AS ok, CASE WHEN coalesce(hour - la <= 3, false) THEN lv ELSE 0.0 END AS v FROM y),
o AS (SELECT channel, o, o / 1.5 AS t FROM (SELECT DISTINCT channel FROM h), (SELECT unnest(range(1090)) AS o)),
q AS (SELECT o.*, a.v AS va, b.v AS vb, c.ok FROM o
  LEFT JOIN z a ON a.channel = o.channel AND a.hour = least(floor(t), 719) LEFT JOIN z b ON b.channel = o.channel AND b.hour = least(floor(t) + 1, 719)
  LEFT JOIN z c ON c.channel = o.channel AND c.hour = least(round_even(t, 0), 719))
SELECT channel, o AS out, CASE WHEN t <= 719 THEN round(va + (vb - va) * (t - floor(t)), 6) + 0.0 ELSE 0.0 END AS v, coalesce(ok, false) AND t <= 720 AS valid FROM q"""


def interpolate_gaps(s, d):
    h = hourly(s, d).withColumn("v", F.when(F.col("n") > 2, F.col("n").cast("double")))
    return rs.interpolate(h, K, I, "v", "x").select("channel", F.col("hour").cast("long").alias("hour"), r6("x").alias("x"))


INTERPOLATE = f"""
WITH {H}, a AS (SELECT channel, hour, CASE WHEN n > 2 THEN n::DOUBLE END AS v FROM h),
b AS (SELECT *, CASE WHEN v IS NOT NULL THEN hour END AS w_at FROM a),
c AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS p, last_value(w_at IGNORE NULLS) OVER w AS pa, first_value(v IGNORE NULLS) OVER f AS q, first_value(w_at IGNORE NULLS) OVER f AS qa FROM b
  WINDOW w AS (PARTITION BY channel ORDER BY hour), f AS (PARTITION BY channel ORDER BY hour ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT channel, hour, round(coalesce(v, p + (q - p) * (hour - pa) / (qa - pa), p, q, 0), 6) + 0.0 AS x FROM c"""


def stretch_length(s, d):
    h = hourly(s, d).withColumn("v", F.col("n").cast("double"))
    return rs.match_length(h, K, I, "v", 1111).select("channel", F.col("out").cast("long").alias("out"), r6("v").alias("v"))


STRETCH = f"""
WITH {H}, o AS (SELECT channel, o, o * 719 / 1110.0 AS t FROM (SELECT DISTINCT channel FROM h), (SELECT unnest(range(1111)) AS o))
SELECT o.channel, o AS out, round(a.n + (b.n - a.n) * (t - floor(t)), 6) + 0.0 AS v FROM o JOIN h a ON a.channel = o.channel AND a.hour = floor(t) JOIN h b ON b.channel = o.channel AND b.hour = least(floor(t) + 1, 719)"""


def fit_length(s, d):
    short = hourly(s, d).where("n > 4").select("channel", F.col("hour").cast("long").alias("hour"), "energy")
    return fr.fit_length(short, K, "hour", "energy", 30).select("channel", F.col("hour").cast("long").alias("hour"), r6("energy", 5).alias("energy"))


FIT_LENGTH = f"""
WITH {H} SELECT channel, hour, CASE WHEN n > 4 THEN round(energy, 5) + 0.0 ELSE 0.0 END AS energy FROM h
WHERE hour < 30 AND channel IN (SELECT channel FROM h WHERE n > 4 AND hour < 30)"""


def _activity(s, d):
    h = hourly(s, d).withColumn("valid", F.col("n") > 0)
    return gt.visual_activity(h, K, I, "n", "valid", 5, 6)


ACT = f"""{H},
s1 AS (SELECT *, CASE WHEN n > 0 THEN coalesce(abs(n - lag(n) OVER (PARTITION BY channel ORDER BY hour)), 0) ELSE 0 END AS step FROM h),
s2 AS (SELECT *, {_w(2, 2, 'sum(step)')} / 5 AS sm FROM s1),
s3 AS (SELECT *, quantile_cont(CASE WHEN n > 0 THEN sm END, 0.9) OVER (PARTITION BY channel) AS ref FROM s2),
s4 AS (SELECT *, CASE WHEN ref >= 1e-4 THEN greatest(0.0, least(1.0, sm / ref)) ELSE 0.0 END AS a FROM s3),
act AS (SELECT *, {_w(3, 2, 'max(a)')} AS activity FROM s4)"""


def visual_activity(s, d):
    return _activity(s, d).select("channel", F.col("hour").cast("long").alias("hour"), r6("activity").alias("activity"))


def rival_veto_gate(s, d):
    df = fr.relative_level(_activity(s, d), K, "db")
    df = gt.rival_max(df, ["hour"], "channel", "activity", "rival")
    df = df.withColumn("shift", F.round(gt.veto_shift(F.col("activity"), F.col("valid"), F.col("rival"), F.lit(True)), 9))
    df = gt.hysteresis(df, K, I, "rel", F.lit(-6.0) + F.col("shift"), F.lit(-9.0) + F.col("shift"), 2, 2)
    return df.select("channel", F.col("hour").cast("long").alias("hour"), r6("shift").alias("shift"), F.col("state").cast("long").alias("state"))


VETO = f"""
WITH {ACT}, x AS (SELECT a.*, r.rel, (SELECT max(b.activity) FROM act b WHERE b.hour = a.hour AND b.channel <> a.channel) AS rival FROM act a JOIN r USING (channel, hour)),
y AS (SELECT *, CASE WHEN n > 0 THEN round(4.0 * greatest(0.0, least(1.0, rival - activity)), 9) ELSE 0.0 END AS shift FROM x),
{gate_sql('y', '-6 + shift', '-9 + shift')}
SELECT channel, hour, round(shift, 6) + 0.0 AS shift, state FROM g"""

def _pair(s, d, b: str = "energy"):
    h = hourly(s, d)
    z = fr.zscore(fr.zscore(h, K, "n", "za"), K, b, "zb")
    return z.select(F.col("channel").alias("track"), "hour", "za"), z.select(F.col("channel").alias("stem"), "hour", "zb")


ZS = f"""{H}, z AS (SELECT channel, hour, (n - avg(n) OVER w) / stddev_pop(n) OVER w AS za, (energy - avg(energy) OVER w) / stddev_pop(energy) OVER w AS zb,
  (db - avg(db) OVER w) / stddev_pop(db) OVER w AS zd FROM h WINDOW w AS (PARTITION BY channel))"""


def score_matrix(s, d):
    a, b = _pair(s, d)
    return mt.score_matrix(a, b, [], "hour", "track", "stem", "za", "zb", HOURS).select("track", "stem", r6("score").alias("score"))


SCORES = f"WITH {ZS} SELECT a.channel AS track, b.channel AS stem, round(sum(a.za * b.zb) / 720, 6) + 0.0 AS score FROM z a JOIN z b USING (hour) GROUP BY 1, 2"


def correlation_matrix(s, d):
    a, b = _pair(s, d, "db")
    return mt.correlation_matrix(a, b, [], "hour", "track", "stem", "za", "zb").select("track", "stem", r6("score").alias("score"))


CORRELATIONS = f"WITH {ZS} SELECT a.channel AS track, b.channel AS stem, round(abs(sum(a.za * b.zd)) / (sqrt(sum(a.za * a.za) * sum(b.zd * b.zd)) + 1e-12), 6) + 0.0 AS score FROM z a JOIN z b USING (hour) GROUP BY 1, 2"


def assign_margin(s, d):
    a, b = _pair(s, d)
    m = mt.assign(mt.score_matrix(a, b, [], "hour", "track", "stem", "za", "zb", HOURS), [], "track", "stem", "score")
    return m.select(F.array_join("plan", ",").alias("plan"), r6("total").alias("total"), r6("margin").alias("margin"))


#: The five channels of the events table, each in order with a stem of its own.
_FIVE = "abcde"
PLANS = f"""mr AS (SELECT *, dense_rank() OVER (ORDER BY track) AS r FROM m),
p AS (SELECT lag, {" || ',' || ".join(f"{x}.stem" for x in _FIVE)} AS plan, {' + '.join(f'{x}.score' for x in _FIVE)} AS total FROM (SELECT * FROM mr WHERE r = 1) a
  {' '.join(f'JOIN (SELECT * FROM mr WHERE r = {i + 1}) {x} USING (lag)' for i, x in enumerate(_FIVE) if i)}
  WHERE {' AND '.join(f'{x}.stem <> {y}.stem' for i, x in enumerate(_FIVE) for y in _FIVE[:i])}),
q AS (SELECT *, row_number() OVER (PARTITION BY lag ORDER BY total DESC, plan) AS k FROM p),
t AS (SELECT a.lag, a.plan, a.total, greatest(0.0, a.total - b.total) AS margin FROM q a JOIN q b USING (lag) WHERE a.k = 1 AND b.k = 2)"""
ASSIGN = f"""WITH {ZS}, m AS (SELECT 0 AS lag, a.channel AS track, b.channel AS stem, sum(a.za * b.zb) / 720 AS score FROM z a JOIN z b USING (hour) GROUP BY 1, 2, 3), {PLANS}
SELECT plan, round(total, 6) + 0.0 AS total, round(margin, 6) + 0.0 AS margin FROM t"""


def shift_significance(s, d, feature: str = "energy"):
    a, b = _pair(s, d, feature)
    m = mt.shift_scores(a, b, "hour", "track", "stem", "za", "zb", HOURS)
    best = mt.assign(m, ["lag"], "track", "stem", "score")
    out = mt.significance(best, HOURS)
    return out.select(F.array_join("plan", ",").alias("plan"), r6("total").alias("total"), r6("margin").alias("margin"), r6("p").alias("p"), r6("agreement").alias("agreement"), mt.trusted(F.col("p"), F.col("margin")).alias("trusted"))


SHIFTS = f"""WITH {ZS}, l AS (SELECT unnest(range(720)) AS lag),
m AS (SELECT lag, a.channel AS track, b.channel AS stem, sum(a.za * b.zb) / 720 AS score FROM l, z a JOIN z b ON b.hour = (a.hour + lag) % 720 GROUP BY 1, 2, 3), {PLANS},
o AS (SELECT * FROM t WHERE lag = 0)
SELECT o.plan, round(o.total, 6) + 0.0 AS total, round(o.margin, 6) + 0.0 AS margin, round((sum((t.margin >= o.margin)::INT) + 1) / 720.0, 6) + 0.0 AS p,
  round(avg((t.plan = o.plan)::INT), 6) + 0.0 AS agreement, (sum((t.margin >= o.margin)::INT) + 1) / 720.0 <= 0.05 AND o.margin >= 0.05 AS trusted
FROM t, o WHERE t.lag > 0 GROUP BY o.plan, o.total, o.margin"""


def match_stems(s, d):
    """M1 from end to end: counts of two hours, held over gaps, on the hourly grid, and their steps, against smoothed hourly levels."""
    h = hourly(s, d)
    env = fr.zscore(wi.boxcar(h, K, I, "db", 3, "env"), K, "env", "zb").select(F.col("channel").alias("stem"), "hour", "zb")
    seen = h.groupBy("channel", F.floor(F.col("hour") / 2).alias("frame")).agg(F.sum("n").cast("double").alias("v")).withColumn("v", F.when(F.col("v") > 0, F.col("v")))
    lip = rs.resample_hold(seen, K, "frame", "v", 0.5, [], HOURS, 1.0, 4.0).select("channel", F.col("out").alias("hour"), "v")
    lip = fr.zscore(fr.absolute_step(lip, K, I, "v"), K, "step", "za").select(F.col("channel").alias("track"), "hour", "za")
    out = mt.match_stems(lip, env, I, "track", "stem", "za", "zb", HOURS)
    return out.select("track", "stem", *[r6(c).alias(c) for c in ("confidence", "p", "agreement")], "trusted")


MATCH_STEMS = f"""
WITH {H}, b AS (SELECT channel, hour, (coalesce(lag(db) OVER w, 0) + db + coalesce(lead(db) OVER w, 0)) / 3 AS env FROM h WINDOW w AS (PARTITION BY channel ORDER BY hour)),
x AS (SELECT channel, hour // 2 AS f, nullif(sum(n), 0)::DOUBLE AS v FROM h GROUP BY 1, 2),
y AS (SELECT channel, f, last_value(v IGNORE NULLS) OVER w AS lv, last_value(CASE WHEN v IS NOT NULL THEN f END IGNORE NULLS) OVER w AS la FROM x WINDOW w AS (PARTITION BY channel ORDER BY f)),
u AS (SELECT channel, f, CASE WHEN coalesce(f - la <= 2, false) THEN lv ELSE 0.0 END AS v FROM y),
g AS (SELECT h.channel, h.hour, CASE WHEN h.hour / 2 <= 359 THEN a.v + (c.v - a.v) * (h.hour / 2 - h.hour // 2) ELSE 0.0 END AS v
      FROM h JOIN u a ON a.channel = h.channel AND a.f = h.hour // 2 JOIN u c ON c.channel = h.channel AND c.f = least(h.hour // 2 + 1, 359)),
e AS (SELECT channel, hour, coalesce(abs(v - lag(v) OVER (PARTITION BY channel ORDER BY hour)), 0.0) AS step FROM g),
z AS (SELECT channel, hour, CASE WHEN stddev_pop(step) OVER w > 1e-9 THEN (step - avg(step) OVER w) / stddev_pop(step) OVER w ELSE 0 END AS za,
      CASE WHEN stddev_pop(env) OVER w > 1e-9 THEN (env - avg(env) OVER w) / stddev_pop(env) OVER w ELSE 0 END AS zb FROM e JOIN b USING (channel, hour) WINDOW w AS (PARTITION BY channel)),
l AS (SELECT unnest(range(720)) AS lag),
m AS (SELECT lag, a.channel AS track, b.channel AS stem, sum(a.za * b.zb) / 720 AS score FROM l, z a JOIN z b ON b.hour = (a.hour + lag) % 720 GROUP BY 1, 2, 3), {PLANS},
o AS (SELECT * FROM t WHERE lag = 0),
s AS (SELECT o.plan, o.margin, (sum((t.margin >= o.margin)::INT) + 1) / 720.0 AS p, avg((t.plan = o.plan)::INT) AS agreement FROM t, o WHERE t.lag > 0 GROUP BY 1, 2)
SELECT r.track, string_split(plan, ',')[r.i] AS stem, round(margin, 6) + 0.0 AS confidence, round(p, 6) + 0.0 AS p, round(agreement, 6) + 0.0 AS agreement, p <= 0.05 AND margin >= 0.05 AS trusted
FROM s, (SELECT channel AS track, row_number() OVER (ORDER BY channel) AS i FROM (SELECT DISTINCT channel FROM h)) r"""


def channel_plan(s, d):
    """Vectors as tracks of twenty clips, whose claims on three stems double, miss, or lie out of range."""
    stem = F.when(F.col("vec_id") % 7 != 0, F.floor(F.get("embedding", F.lit(0)).cast("double") * 20))
    pairs = table(s, d, "embeddings").select((F.col("vec_id") % 20).alias("clip"), F.col("vec_id").alias("track"), stem.alias("stem"))
    stems = pairs.select("clip").distinct().withColumn("stem", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    held = mt.claims(pairs, ["clip"], "track", "stem", F.lit(3))
    return mt.channel_plan(pairs.select("clip", "track"), stems, held, ["clip"], "track", "stem").select("clip", F.col("channel").cast("long").alias("channel"), "track", "stem")


CHANNEL_PLAN = """
WITH p AS (SELECT vec_id % 20 AS clip, vec_id AS track, CASE WHEN vec_id % 7 <> 0 THEN floor(embedding[1]::DOUBLE * 20)::BIGINT END AS stem FROM embeddings),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip, stem ORDER BY track) AS k FROM p WHERE stem BETWEEN 0 AND 2) WHERE k = 1),
s AS (SELECT clip, stem FROM (SELECT DISTINCT clip FROM p), (VALUES (0), (1), (2)) b(stem))
SELECT s.clip, row_number() OVER (PARTITION BY s.clip ORDER BY c.track IS NULL, c.track, s.stem) - 1 AS channel, c.track, s.stem::BIGINT AS stem FROM s LEFT JOIN c USING (clip, stem)
UNION ALL SELECT p.clip, NULL, p.track, NULL FROM p ANTI JOIN c ON c.clip = p.clip AND c.track = p.track"""


def best_lag(s, d):
    h = fr.zscore(hourly(s, d), K, "n")
    names = h.select("channel").distinct()
    a = h.select(F.col("channel").alias("a"), "hour", F.round("z", 9).alias("za")).join(names.withColumnRenamed("channel", "b"), F.col("a") < F.col("b"))
    b = h.select(F.col("channel").alias("b"), "hour", F.round("z", 9).alias("zb")).join(names.withColumnRenamed("channel", "a"), F.col("a") < F.col("b"))
    return mt.best_lag(a, b, ["a", "b"], "hour", "za", "zb", 24).select("a", "b", F.col("lag").cast("long").alias("lag"), r6("score", 4).alias("score"))


BEST_LAG = f"""
WITH {H}, z AS (SELECT channel, hour, round((n - avg(n) OVER w) / stddev_pop(n) OVER w, 9) AS z FROM h WINDOW w AS (PARTITION BY channel)),
t AS (SELECT x.channel AS a, y.channel AS b, lag, sum(x.z * y.z) AS score FROM (SELECT unnest(range(-24, 25)) AS lag), z x JOIN z y ON x.channel < y.channel AND y.hour = x.hour + lag GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, lag) AS k FROM t)
SELECT a, b, lag, round(score, 4) + 0.0 AS score FROM k WHERE k = 1"""


def overlap_add(s, d):
    h = hourly(s, d).withColumn("c", F.explode(fr.chunk_bounds(F.lit(HOURS), 48, 8))).where("hour >= c.start and hour < c.stop")
    w = fr.fade(F.col("hour") - F.col("c.start"), F.col("c.stop") - F.col("c.start"), 8, F.col("c.start") == 0, F.col("c.stop") == HOURS)
    out = fr.overlap_add(h.withColumn("w", w), K, "hour", "energy", "w")
    return out.select("channel", F.col("hour").cast("long").alias("hour"), r6("energy", 5).alias("energy"))


OVERLAP_ADD = f"WITH {H} SELECT channel, hour, round(energy, 5) + 0.0 AS energy FROM h"


def silence_stats(s, d):
    g = gt.gate(_rel(s, d), K, I, "rel", -6.0, -9.0, 2, 2, 1, 3).withColumn("y", F.col("gain") * F.col("energy"))
    return me.silence_stats(g, K, "y").select("channel", r6("zero_fraction").alias("zero_fraction"), r6("floor_db", 4).alias("floor_db"), r6("peak", 7).alias("peak"))


SILENCE = f"""WITH o AS ({GATE_FULL.replace('round(gain * energy, 7) + 0.0', 'gain * energy')})
SELECT channel, round(avg((out_energy = 0)::INT), 6) + 0.0 AS zero_fraction, round(20 * log10(min(nullif(out_energy, 0)) + 1e-20), 4) + 0.0 AS floor_db, round(max(out_energy), 7) + 0.0 AS peak FROM o GROUP BY 1"""


def whisper_db(s, d):
    h = fr.interleave(hourly(s, d), [], "hour", "channel", "energy", ["click", "view", "signup"])
    h = h.withColumn("k", F.lit("click<view")).withColumn("y", F.col("click") * 0.5)
    return me.whisper_db(h, ["k"], "click", "view", "y", 6.0).select("k", r6("whisper_db", 4).alias("whisper_db"))


WHISPER = f"""
WITH {H}, x AS (SELECT a.energy AS own, b.energy AS other, a.energy * 0.5 AS y FROM h a JOIN h b USING (hour) WHERE a.channel = 'click' AND b.channel = 'view'),
q AS (SELECT quantile_cont(own, 0.95) * 10 ** (-0.6) AS o, quantile_cont(other, 0.95) * 10 ** (-0.6) AS r FROM x),
m AS (SELECT avg(CASE WHEN other > r AND own <= o THEN y END) AS leak, avg(CASE WHEN y > 0 THEN y END) AS kept FROM x, q)
SELECT 'click<view' AS k, CASE WHEN leak > 0 AND kept > 0 THEN round(10 * log10(leak / kept), 4) + 0.0 END AS whisper_db FROM m"""


def veto_cost(s, d):
    a = _gated(s, d).select("channel", "hour", F.col("state").alias("acoustic"))
    b = rival_veto_gate(s, d).select("channel", "hour", F.col("state").alias("fused"))
    other = hourly(s, d).where("channel = 'view'").select("hour", F.col("db").alias("other_db"))
    df = a.where("channel <> 'view'").join(b, ["channel", "hour"]).join(other, "hour")
    return me.veto_cost(df, K, "acoustic", "fused", "other_db", 3.0).select("channel", r6("cost").alias("cost"))


VETO_COST = f"""
WITH b AS ({VETO.strip()}), a AS (WITH {H}, {gate_sql('r')} SELECT channel, hour, state FROM g), v AS (WITH {H} SELECT hour, rel FROM r WHERE channel = 'view'),
x AS (SELECT a.channel, b.state FROM a JOIN b USING (channel, hour) JOIN v USING (hour) WHERE a.state = 1 AND v.rel <= -3 AND a.channel <> 'view')
SELECT c.channel, round(coalesce(avg((x.state = 0)::INT), 0), 6) + 0.0 AS cost FROM (SELECT DISTINCT event_type AS channel FROM events WHERE event_type <> 'view') c LEFT JOIN x ON x.channel = c.channel GROUP BY 1"""


def leakage_db(s, d):
    g = _gated(s, d)
    g = gt.rival_max(g, ["hour"], "channel", "energy", "rival")
    return me.leakage_db(g, K, "energy", "rival", "state").select("channel", r6("leakage_db", 4).alias("leakage_db"))


LEAKAGE = f"""
WITH {H}, {gate_sql('r')}, x AS (SELECT g.channel, state, energy, (SELECT max(b.energy) FROM h b WHERE b.hour = g.hour AND b.channel <> g.channel) AS rival FROM g)
SELECT channel, CASE WHEN count(CASE WHEN state = 0 THEN 1 END) > 0 AND avg(energy) > 0 THEN round(10 * log10((avg(CASE WHEN state = 0 THEN rival END) + 1e-20) / avg(energy)), 4) + 0.0 END AS leakage_db FROM x GROUP BY 1"""


def gate_score(s, d):
    g = _gated(s, d)
    return me.gate_score(g, K, "state", F.col("rel") > -3, F.col("rel") < -15).select("channel", r6("retain").alias("retain"), r6("silence").alias("silence"))


GATE_SCORE = f"WITH {H}, {gate_sql('r')} SELECT channel, round(avg(CASE WHEN rel > -3 THEN state END), 6) + 0.0 AS retain, round(avg(CASE WHEN rel < -15 THEN 1 - state END), 6) + 0.0 AS silence FROM g GROUP BY 1"


def dominance(s, d):
    return me.dominance_db(hourly(s, d), ["hour"], "channel", "energy").select("channel", F.col("hour").cast("long").alias("hour"), r6("sir", 4).alias("sir"))


DOMINANCE = f"WITH {H} SELECT a.channel, a.hour, round(10 * log10((a.energy + 1e-20) / (max(b.energy) + 1e-20)), 4) + 0.0 AS sir FROM h a JOIN h b ON b.hour = a.hour AND b.channel <> a.channel GROUP BY a.channel, a.hour, a.energy"


def ratio_mask(s, d):
    p = F.col("energy") * F.col("energy")
    m = p / (F.sum(p).over(fr.Window.partitionBy("hour")) + 1e-12)
    return hourly(s, d).select("channel", F.col("hour").cast("long").alias("hour"), r6(m).alias("mask"))


RATIO_MASK = f"WITH {H} SELECT channel, hour, round(energy * energy / (sum(energy * energy) OVER (PARTITION BY hour) + 1e-12), 6) + 0.0 AS mask FROM h"


def hist_modes(s, d):
    out = me.histogram_modes(table(s, d, "events"), ["event_type"], "value", 10.0)
    return out.select("event_type", "bin", "n", "mode")


HIST = """
WITH b AS (SELECT event_type, floor(value / 10)::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1, 2),
p AS (SELECT b.*, coalesce(l.n, 0) AS ln, coalesce(r.n, 0) AS rn, max(b.n) OVER (PARTITION BY b.event_type) AS peak FROM b
  LEFT JOIN b l ON l.event_type = b.event_type AND l.bin = b.bin - 1 LEFT JOIN b r ON r.event_type = b.event_type AND r.bin = b.bin + 1)
SELECT event_type, bin, n, n > ln AND n > rn AND n >= 0.15 * peak AS mode FROM p"""


def nearest_asof(s, d):
    us = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    ev = table(s, d, "events").select("user_id", "event_id", "event_type", us)
    left = ev.where("event_type = 'purchase'").select("user_id", "event_id", "at")
    right = ev.where("event_type = 'click'").select("user_id", "at", F.col("event_id").alias("click"))
    return rs.nearest(left, right, ["user_id"], "at", "click", "near").select("user_id", "event_id", "near", F.abs(F.col("near_at") - F.col("at")).alias("away"))


NEAREST = """
WITH p AS (SELECT user_id, event_id, epoch_us(ts) AS at FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, event_id, epoch_us(ts) AS at FROM events WHERE event_type = 'click'),
j AS (SELECT p.user_id, p.event_id, c.event_id AS near, abs(c.at - p.at) AS away, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(c.at - p.at) NULLS LAST, c.at) AS k FROM p LEFT JOIN c ON c.user_id = p.user_id)
SELECT user_id, event_id, near, away FROM j WHERE k = 1"""


def loudness_windows(s, d):
    return fr.loud(hourly(s, d), K, "db").select("channel", F.col("hour").cast("long").alias("hour"), r6("db", 4).alias("db"))


LOUD = f"WITH {H}, q AS (SELECT *, quantile_cont(db, 0.9) OVER (PARTITION BY channel) AS ref FROM h) SELECT channel, hour, round(db, 4) + 0.0 AS db FROM q WHERE db - ref >= -12"


def pivot_channels(s, d):
    p = fr.interleave(hourly(s, d), [], "hour", "channel", "n", ["click", "error", "purchase", "signup", "view"])
    return p.withColumn("hour", F.col("hour").cast("long"))


PIVOT = f"WITH {H} SELECT hour, " + ", ".join(f"max(CASE WHEN channel = '{c}' THEN n END) AS {c}" for c in ("click", "error", "purchase", "signup", "view")) + " FROM h GROUP BY hour"


def sliding_windows(s, d):
    n = table(s, d, "events").groupBy("user_id").agg(F.count("*").cast("int").alias("n"))
    return n.select("user_id", F.explode(fr.window_starts(F.col("n"), 20, 8).cast("array<bigint>")).alias("start"))


SLIDING = """
WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT DISTINCT user_id, start FROM (SELECT user_id, unnest(range(0, greatest(n - 20, 0) + 1, 8)) AS start FROM n UNION ALL SELECT user_id, greatest(n - 20, 0) FROM n)"""


def circular_shift(s, d):
    return wi.circular_shift(hourly(s, d), "hour", HOURS, F.lit(100)).select("channel", F.col("hour").cast("long").alias("hour"), "n")


CIRCULAR = f"WITH {H} SELECT channel, (hour + 100) % 720 AS hour, n FROM h"


def reliability_caveat(s, d):
    at = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(86400000000))
    f = table(s, d, "events").groupBy("user_id", at.alias("day")).agg(F.count("*").alias("n"), F.max("value").alias("px"))
    grid = fr.complete(f, ["user_id"], "day", 0, 29, {"n": 0}).withColumn("filled", F.col("n") == 0)
    q = rp.track_quality(grid, ["user_id"], "px", "filled", 0.8, 50.0)
    why = rp.caveat((F.col("sparse"), "seldom seen"), (F.col("undersized"), "too small"))
    return q.select("user_id", r6("coverage").alias("coverage"), r6("median_px").alias("median_px"), "usable", why.alias("caveat"))


RELIABILITY = """
WITH f AS (SELECT user_id, date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS day, max(value) AS px FROM events GROUP BY 1, 2),
q AS (SELECT user_id, count(*) / 30 AS c, quantile_cont(px, 0.5) AS m FROM f WHERE day BETWEEN 0 AND 29 GROUP BY 1)
SELECT user_id, round(c, 6) + 0.0 AS coverage, round(m, 6) + 0.0 AS median_px, c >= 0.8 AND m >= 50 AS usable, CASE WHEN c < 0.8 THEN 'seldom seen' WHEN m < 50 THEN 'too small' END AS caveat FROM q"""


def presence_top(s, d):
    from chronoweave.operators.entity import presence

    ev = table(s, d, "events").select("event_type", "user_id")
    return presence(ev, ["event_type"], "user_id", 2, 4).select("event_type", "user_id", "frames", F.col("rank").cast("long").alias("rank"))


PRESENCE = """
WITH n AS (SELECT event_type, user_id, count(*) AS frames FROM events GROUP BY 1, 2 HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY frames DESC, user_id) - 1 AS rank FROM n) SELECT * FROM r WHERE rank < 4"""


def three_way(s, d):
    h = fr.relative_level(hourly(s, d), K, "db").withColumn("label", rp.three_way(F.col("rel"), F.col("n") > 0, F.lit(-10.0)))
    return h.groupBy("channel", "label").agg(F.count("*").alias("hours"))


THREE_WAY = f"WITH {H} SELECT channel, CASE WHEN n = 0 THEN 'unvoiced' WHEN rel < -10 THEN 'low' ELSE 'high' END AS label, count(*) AS hours FROM r GROUP BY 1, 2"


def union_unclaimed(s, d):
    """Pooled windows of two owners, and the hours of one that the other doesn't claim."""
    h = hourly(s, d).where("n > 3").select("channel", F.col("hour").cast("long").alias("hour"))
    a, b = h.where("channel = 'click'"), h.where("channel = 'view'")
    pool = a.unionByName(b)
    free = a.join(b, a["hour"] == b["hour"], "left_anti").withColumn("channel", F.lit("click only"))
    return pool.unionByName(free)


UNION = f"""WITH {H}, p AS (SELECT channel, hour FROM h WHERE n > 3 AND channel IN ('click', 'view'))
SELECT channel, hour FROM p UNION ALL SELECT 'click only', hour FROM p a WHERE channel = 'click' AND NOT EXISTS (SELECT 1 FROM p b WHERE b.channel = 'view' AND b.hour = a.hour)"""


QUERIES = {
    "frame_energy": (frame_energy, f"WITH {H} SELECT channel, hour, n, round(db, 4) + 0.0 AS db FROM h"),
    "sample_frames": (sample_frames, SAMPLE_FRAMES),
    "rel_level_p95": (rel_level_p95, f"WITH {H} SELECT channel, hour, round(rel, 4) + 0.0 AS rel FROM r"),
    "gate_long": (gate_long, GATE_LONG),
    "holds_long": (holds_long, HOLDS_LONG),
    "islands_long": (islands_long, ISLANDS_LONG),
    "smooth_long": (smooth_long, SMOOTH_LONG),
    "hysteresis_gate": (hysteresis_gate, f"WITH {H}, {gate_sql('r')} SELECT channel, hour, state FROM g"),
    "gate_full": (gate_full, GATE_FULL),
    "gate_runs": (gate_runs, GATE_RUNS),
    "gap_sessions": (gap_sessions, GAP_SESSIONS),
    "daily_trace": (daily_trace, DAILY_TRACE),
    "level_profile": (level_profile, LEVEL_PROFILE),
    "level_purity": (level_purity, LEVEL_PURITY),
    "long_absence": (long_absence, LONG_ABSENCE),
    "pause_zones": (pause_zones, PAUSE_ZONES),
    "boxcar_smooth": (boxcar_smooth, BOXCAR),
    "nan_boxcar": (nan_boxcar, NAN_BOXCAR),
    "dilate_activity": (dilate_activity, DILATE),
    "running_median": (running_median, RUNNING_MEDIAN),
    "box_mean_2d": (box_mean_2d, BOX_MEAN),
    "hold_geometry": (hold_geometry, HOLD),
    "zscore_step": (zscore_step, ZSCORE_STEP),
    "resample_hold": (resample_hold, RESAMPLE_HOLD),
    "interpolate_gaps": (interpolate_gaps, INTERPOLATE),
    "stretch_length": (stretch_length, STRETCH),
    "fit_length": (fit_length, FIT_LENGTH),
    "visual_activity": (visual_activity, f"WITH {ACT} SELECT channel, hour, round(activity, 6) + 0.0 AS activity FROM act"),
    "rival_veto_gate": (rival_veto_gate, VETO),
    "score_matrix": (score_matrix, SCORES),
    "correlation_matrix": (correlation_matrix, CORRELATIONS),
    "assign_margin": (assign_margin, ASSIGN),
    "shift_significance": (shift_significance, SHIFTS),
    "shift_significance_db": (lambda s, d: shift_significance(s, d, "db"), SHIFTS.replace("a.za * b.zb", "a.za * b.zd")),
    "match_stems": (match_stems, MATCH_STEMS),
    "channel_plan": (channel_plan, CHANNEL_PLAN),
    "best_lag": (best_lag, BEST_LAG),
    "overlap_add": (overlap_add, OVERLAP_ADD),
    "silence_stats": (silence_stats, SILENCE),
    "whisper_db": (whisper_db, WHISPER),
    "veto_cost": (veto_cost, VETO_COST),
    "leakage_db": (leakage_db, LEAKAGE),
    "gate_score": (gate_score, GATE_SCORE),
    "dominance": (dominance, DOMINANCE),
    "ratio_mask": (ratio_mask, RATIO_MASK),
    "hist_modes": (hist_modes, HIST),
    "nearest_asof": (nearest_asof, NEAREST),
    "loudness_windows": (loudness_windows, LOUD),
    "pivot_channels": (pivot_channels, PIVOT),
    "sliding_windows": (sliding_windows, SLIDING),
    "circular_shift": (circular_shift, CIRCULAR),
    "reliability_caveat": (reliability_caveat, RELIABILITY),
    "presence_top": (presence_top, PRESENCE),
    "three_way": (three_way, THREE_WAY),
    "union_unclaimed": (union_unclaimed, UNION),
}
