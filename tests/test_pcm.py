"""PCM16 files: bytes, round trips over segments and parts, and what is left after a failure."""

import math
import struct
import wave as stdwave
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chronoweave.sources.pcm import header, read_pcm16, write_pcm16

SCHEMA = "f string, c int, i long, x double"


def put(spark, rows, path, channels=2, **kw):
    write_pcm16(spark.createDataFrame(rows, SCHEMA), str(path), "f", "c", "i", "x", channels, 8000, **kw)


def pcm(x):
    return max(-32768, min(32767, round(x * 32767))) / 32768


def test_header_and_bytes(spark, tmp_path):
    want = b"RIFF" + struct.pack("<I", 36 + 12) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", 12)
    assert header(2, 8000, 3) == want and len(want) == 44
    put(spark, [("a", 0, 0, 0.5), ("a", 1, 2, -1.0), ("a", 0, 1, None), ("a", 1, 0, float("nan"))], tmp_path, gain=1.0)
    (file,) = tmp_path.glob("*")
    assert file.name == "a@000000000000000.wav"
    assert file.read_bytes() == want + struct.pack("<6h", 16384, 0, 0, 0, 0, -32767)
    with stdwave.open(str(file)) as w:
        assert (w.getnchannels(), w.getframerate(), w.getsampwidth(), w.getnframes()) == (2, 8000, 2, 3)


def test_round_trip_over_segments_and_parts(spark, tmp_path):
    rows = [(f, c, i, math.sin(i * (c + 1) / 7) * 3) for f, n in (("a/b %", 1000), ("z@1", 130)) for c in range(3) for i in range(n) if (i + c) % 11]
    put(spark, rows, tmp_path, 3, segment=64)
    got = {(r.file, r.channel, r.sample): r.value for r in read_pcm16(spark, str(tmp_path), 100).collect()}
    gain = 0.999 / max(abs(x) for *_, x in rows)
    want = {(f, c, i): 0.0 for f, n in (("a/b %", 1000), ("z@1", 130)) for c in range(3) for i in range(n)}
    want |= {(f, c, i): pcm(x * gain) for f, c, i, x in rows}
    assert got == want
    assert len(list(tmp_path.glob("*.wav"))) == 16 + 3 and read_pcm16(spark, str(tmp_path), 100).rdd.getNumPartitions() > 19


def test_foreign_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    samples = struct.pack("<4h", 1, -2, 3, -32768)
    odd = b"RIFF\0\0\0\0WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<IHHIIHH", 18, 0xFFFE, 2, 44100, 176400, 4, 16) + b"\0\0" + b"data" + struct.pack("<I", 0xFFFFFFFF) + samples
    (tmp_path / "sub" / "x@y.wav").write_bytes(odd)
    (tmp_path / "empty.wav").write_bytes(header(1, 8000, 0))
    got = read_pcm16(spark, "file://" + str(tmp_path)).orderBy("sample", "channel").collect()
    assert [(r.file, r.channel, r.sample, r.value * 32768, r.rate) for r in got] == [("sub/x@y", 0, 0, 1, 44100), ("sub/x@y", 1, 0, -2, 44100), ("sub/x@y", 0, 1, 3, 44100), ("sub/x@y", 1, 1, -32768, 44100)]
    (tmp_path / "bad.wav").write_bytes(odd.replace(b"\xfe\xff\x02\x00", b"\x03\x00\x02\x00"))
    with pytest.raises(Exception, match="not 16-bit PCM"):
        read_pcm16(spark, str(tmp_path)).count()


@pytest.mark.parametrize("bad", [("b", 5, 0, 0.1), ("b", 0, None, 0.1), (None, 0, 0, 0.1), ("b", 0, -1, 0.1), ("a", 0, 7, 0.1)])
def test_a_failed_run_leaves_no_file(spark, tmp_path, bad):
    put(spark, [("kept", 0, 0, 0.25)], tmp_path)
    with pytest.raises(Exception, match="channel|comes twice"):
        put(spark, [("a", 0, i, 0.1) for i in range(300)] + [bad], tmp_path, segment=16)
    assert [p.name for p in Path(tmp_path).rglob("*")] == ["kept@000000000000000.wav"]


def test_modes_and_empty(spark, tmp_path):
    put(spark, [("a", 0, 0, 0.25)], tmp_path / "x")
    with pytest.raises(Exception, match="a@0"):
        put(spark, [("a", 0, 0, 0.5)], tmp_path / "x")
    put(spark, [("b", 0, 0, 0.5)], tmp_path / "x", mode="overwrite")
    assert [(r.file, r.channel) for r in read_pcm16(spark, str(tmp_path / "x")).where(F.col("value") > 0).collect()] == [("b", 0)]
    put(spark, [], tmp_path / "none")
    assert read_pcm16(spark, str(tmp_path / "none")).count() == 0
