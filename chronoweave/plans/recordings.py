"""Queries that go through files of sound. Each with SQL that gives the same rows."""

from __future__ import annotations

import atexit

from pyspark.sql import functions as F
from pyspark.sql import Window

from chronoweave.operators import frames as fr
from chronoweave.plans.series import r6
from chronoweave.sources.pcm import drop, read_pcm16, write_pcm16
from chronoweave.sources.tables import shared_folder, table

RATE, FRAMES = 16_000, 1 << 16


def _recorded(s, d):
    """All events as one recording: a channel a type, a sample an event. Written as files, and read back in parts."""
    ev = table(s, d, "events")
    # Types are few: they are numbered by name in one small table.
    types = ev.select("event_type").distinct().withColumn("channel", F.row_number().over(Window.orderBy("event_type")) - 1)
    path = shared_folder(s, "recording")
    atexit.register(drop, path)
    rows = ev.join(types, "event_type").select(F.lit("events").alias("file"), "channel", F.col("event_id").alias("sample"), "value")
    write_pcm16(rows, path, "file", "channel", "sample", "value", types.count(), RATE, segment=FRAMES)
    return read_pcm16(s, path, 1 << 20)


def pcm_recording(s, d):
    """Interleaved PCM16 under one gain."""
    return _recorded(s, d).select("file", F.col("channel").cast("long").alias("channel"), "sample", (F.col("value") * 32768).cast("long").alias("pcm"))


_R = f"""
t AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS channel FROM (SELECT DISTINCT event_type FROM events)),
g AS (SELECT CASE WHEN max(abs(value)) > 0.999 THEN 0.999 / max(abs(value)) ELSE 1.0 END AS gain FROM events),
n AS (SELECT unnest(range(min(event_id) // {FRAMES} * {FRAMES}, max(event_id) + 1)) AS sample FROM events),
f AS (SELECT channel, sample, round_even(coalesce(value * gain, 0.0) * 32767, 0) / 32768 AS value FROM n CROSS JOIN t CROSS JOIN g LEFT JOIN events e ON e.event_id = n.sample AND e.event_type = t.event_type)"""
PCM_RECORDING = f"WITH {_R} SELECT 'events' AS file, channel, sample, (value * 32768)::BIGINT AS pcm FROM f"


def pcm_mono(s, d):
    """The mean of a recording's channels at each sample."""
    return fr.mono(_recorded(s, d), ["file"], "sample", "value").select("file", "sample", r6(F.col("value") * 32768).alias("level"))


PCM_MONO = f"WITH {_R} SELECT 'events' AS file, sample, round(avg(value) * 32768, 6) + 0.0 AS level FROM f GROUP BY sample"

QUERIES = {"pcm_recording": (pcm_recording, PCM_RECORDING), "pcm_mono": (pcm_mono, PCM_MONO)}
