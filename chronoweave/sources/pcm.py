"""PCM16 recordings (RIFF/WAVE) as rows: a source that reads parts of files side by side, and a sink whose files appear once all tasks are done.

A recording may be cut into segments, one file each, named by the recording and the segment's first sample; the source puts
them together again. So a recording's length is bounded neither by a file of 4 GB nor by a task.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import quote, unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from chronoweave.operators.frames import shared_gain

#: Sizes in bytes of a part that one task reads, and in frames of a step inside it and of a segment that is written.
PART, STEP, SEGMENT = 64 << 20, 1 << 15, 1 << 20
SCHEMA = "file string, channel int, sample long, value double, rate int"
_WAVE = struct.Struct("<4sI4s4sIHHIIHH4sI")
_SEGMENT = re.compile(r"(.*)@(\d{15})\.wav")


@dataclass(frozen=True)
class Wave:
    channels: int
    rate: int
    start: int  # byte of the first sample
    frames: int


def header(channels: int, rate: int, frames: int) -> bytes:
    """The 44 bytes before the samples."""
    size = frames * channels * 2
    return _WAVE.pack(b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", size)


def wave(stream, size: int) -> Wave:
    """What a file says of itself. Chunks other than the format and the samples are passed over; a data size beyond the file ends with it."""
    riff = stream.read(12)
    if riff[:4] != b"RIFF" or riff[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form = 12, None
    while len(head := stream.read(8)) == 8:
        name, length = struct.unpack("<4sI", head)
        at += 8
        if name == b"data":
            if form is None:
                raise ValueError("samples before their format")
            channels, rate = form
            return Wave(channels, rate, at, min(length, size - at) // (2 * channels))
        if name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", stream.read(16))
            if code not in (1, 0xFFFE) or bits != 16 or not channels:
                raise ValueError(f"not 16-bit PCM: format {code}, {bits} bits, {channels} channels")
            form = channels, rate
        at += length + length % 2
        stream.seek(at)
    raise ValueError("no samples")


def _files(path: str) -> tuple[fs.FileSystem, str]:
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem(), str(Path(unquote(url.path) if url.scheme else path).absolute())
    return fs.FileSystem.from_uri(path)


@dataclass
class Part(InputPartition):
    path: str
    file: str
    first: int  # number of the file's first sample in its recording
    k: int
    of: int


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("part", PART))

    def partitions(self) -> list[Part]:
        """Parts by the size of the files; headers are read by the tasks."""
        files, root = _files(self.path)
        found = files.get_file_info(root)
        listed = files.get_file_info(fs.FileSelector(root, recursive=True)) if found.type == fs.FileType.Directory else [found]
        parts = []
        for info in sorted((i for i in listed if i.type == fs.FileType.File and i.path.lower().endswith(".wav")), key=lambda i: i.path):
            name = info.path[len(root) :].lstrip("/") or info.base_name
            if name.startswith("_temporary/"):
                continue
            cut = _SEGMENT.fullmatch(name)
            file, first = (unquote(cut[1]), int(cut[2])) if cut else (name[:-4], 0)
            of = max(1, -(-info.size // self.size))
            parts += [Part(info.path, file, first, k, of) for k in range(of)]
        return parts

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark gives a folder without files
            return
        files, _ = _files(self.path)
        with files.open_input_file(partition.path) as stream:
            w = wave(stream, stream.size())
            at, stop = (w.frames * k // partition.of for k in (partition.k, partition.k + 1))
            stream.seek(w.start + at * 2 * w.channels)
            while at < stop:
                n = min(STEP, stop - at)
                x = np.frombuffer(stream.read(n * 2 * w.channels), "<i2")
                sample = np.repeat(np.arange(at, at + n) + partition.first, w.channels)
                channel = np.tile(np.arange(w.channels, dtype="int32"), n)
                columns = [pa.repeat(partition.file, len(x)), pa.array(channel), pa.array(sample), pa.array(x / 32768.0), pa.repeat(pa.scalar(w.rate, pa.int32()), len(x))]
                yield pa.RecordBatch.from_arrays(columns, ["file", "channel", "sample", "value", "rate"])
                at += n


@dataclass
class _Written(WriterCommitMessage):
    names: list[tuple[str, str]]  # where a file is, and its name once it counts


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.channels, self.rate, self.segment = (int(options[n]) for n in ("channels", "rate", "segment"))
        self.job = f"_temporary/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        """Holds one segment at a time. Rows come by file and sample; absent ones are zero, and the last one present ends the segment."""
        files, root = _files(self.path)
        at = f"{root}/{self.job}/{uuid.uuid4().hex}"
        written, block = [], np.zeros((self.segment, self.channels), "<i2")
        known, now = np.zeros(block.shape, bool), None

        def flush():
            file, number = now
            n = int(np.flatnonzero(known.any(axis=1))[-1]) + 1
            name = f"{quote(file, safe='')}@{number * self.segment:015d}.wav"
            files.create_dir(at, recursive=True)
            with files.open_output_stream(f"{at}/{name}") as out:
                out.write(header(self.channels, self.rate, n))
                out.write(block[:n].tobytes())
            written.append((f"{at}/{name}", name))
            block[:n], known[:n] = 0, False

        for batch in iterator:
            if any(batch.column(c).null_count for c in ("file", "channel", "sample")):
                raise ValueError("a row without file, channel or sample")
            channel, sample = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("channel", "sample"))
            if len(channel) and (sample.min() < 0 or channel.min() < 0 or channel.max() >= self.channels):
                raise ValueError(f"a sample below 0, or a channel outside 0 to {self.channels - 1}")
            value = np.nan_to_num(pc.fill_null(batch.column("value"), 0.0).to_numpy(zero_copy_only=False), nan=0.0)
            value = np.clip(np.rint(value * 32767.0), -32768, 32767).astype("<i2")
            code = pc.dictionary_encode(batch.column("file"))
            ids, number = code.indices.to_numpy(), sample // self.segment
            edges = np.flatnonzero((np.diff(ids) != 0) | (np.diff(number) != 0)) + 1
            for i, j in zip([0, *edges], [*edges, len(ids)], strict=True):
                if i == j:
                    continue
                here = code.dictionary[int(ids[i])].as_py(), int(number[i])
                if here != now:
                    if now:
                        flush()
                    now = here
                place = sample[i:j] % self.segment, channel[i:j]
                cells = place[0] * self.channels + place[1]
                if known[place].any() or len(np.unique(cells)) < j - i:
                    raise ValueError(f"a sample of {here[0]} comes twice in a channel")
                block[place], known[place] = value[i:j], True
        if now:
            flush()
        return _Written(written)

    def commit(self, messages: list[_Written | None]) -> None:
        files, root = _files(self.path)
        moves = [m for message in messages if message for m in message.names]
        names = [name for _, name in moves]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a segment was written by two tasks: partition by file and segment")
        files.create_dir(root, recursive=True)
        old = [i.path for i in files.get_file_info(fs.FileSelector(root)) if i.path.endswith(".wav")]
        if self.overwrite:
            for path in old:
                files.delete_file(path)
        elif clash := {f"{root}/{n}" for n in names} & set(old):
            self.abort(messages)
            raise FileExistsError(min(clash))
        for path, name in moves:
            files.move(path, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        files, root = _files(self.path)
        if files.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.job}")
        rest = f"{root}/_temporary"
        if files.get_file_info(rest).type == fs.FileType.Directory and not files.get_file_info(fs.FileSelector(rest)):
            files.delete_dir(rest)


class Pcm16(DataSource):
    """Format `pcm16`. Options: path; to read, `part` (bytes a task); to write, `channels`, `rate` and `segment` (frames a file)."""

    @classmethod
    def name(cls) -> str:
        return "pcm16"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


def read_pcm16(spark: SparkSession, path: str, part: int = PART) -> DataFrame:
    """(file, channel, sample, value, rate) of the .wav files under a folder, or of one file; values are from -1 to 1."""
    spark.dataSource.register(Pcm16)
    return spark.read.format("pcm16").option("part", part).load(path)


def write_pcm16(df: DataFrame, path: str, file: str, channel: str, sample: str, value: str, channels: int, rate: int, gain: float | None = None, segment: int = SEGMENT, mode: str = "append") -> None:
    """Writes rows as interleaved files, channel i of a file being number i.

    One gain holds for all: without one, what brings the greatest magnitude to 0.999 if it is above. Zeros stay exact zeros.
    NULL and NaN values and absent rows are zero; a segment without rows has no file. A sample that comes twice in a channel,
    and a row without file, channel or sample, are errors, and no file of the run is left. A task holds one segment.
    """
    df.sparkSession.dataSource.register(Pcm16)
    gain = shared_gain((df.where(~F.isnan(F.col(value).cast("double"))), value)).first()["gain"] if gain is None else gain
    rows = df.select(F.col(file).cast("string").alias("file"), F.col(channel).cast("int").alias("channel"), F.col(sample).cast("long").alias("sample"), (F.col(value).cast("double") * gain).alias("value"))
    rows = rows.repartition("file", F.floor(F.col("sample") / segment)).sortWithinPartitions("file", "sample")
    rows.write.format("pcm16").options(channels=channels, rate=rate, segment=segment).mode(mode).save(path)


def drop(path: str) -> None:
    """Removes a folder of recordings, if it is there."""
    files, root = _files(path)
    if files.get_file_info(root).type == fs.FileType.Directory:
        files.delete_dir(root)
