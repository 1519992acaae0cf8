"""Capture files as rows of frames and back (S1, S14): tasks read stretches of files, and write one file at a time."""

from __future__ import annotations

import io
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.sources.scratch import kept

#: The first four bytes of files in either byte order, with microseconds.
MAGIC = {b"\xd4\xc3\xb2\xa1": "<", b"\xa1\xb2\xc3\xd4": ">"}
SCHEMA = "path string, record long, timestamp double, length int, bytes binary"
NAMES = ["path", "record", "timestamp", "length", "bytes"]
#: Bytes of frames that a task holds before it hands them on.
HELD = 8 << 20


class _Raw(io.RawIOBase):
    """An open file of Arrow's for Python's own buffering."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def _frames(stream, order: str | None = None, n: int = 0, most: int | None = None) -> Iterator[tuple[int, float, int, bytes]]:
    """Number, time, original length and bytes of each whole record; a cut-off record ends the file. If the byte order is given, the
    stream is at a record's head, n records came before, and `most` are wanted."""
    if order is None:
        start = stream.read(24)
        if start[:4] not in MAGIC or len(start) < 24:
            raise ValueError("not a capture file")
        order = MAGIC[start[:4]]
    head, last = struct.Struct(order + "IIII"), None if most is None else n + most
    while n != last and len(mark := stream.read(16)) == 16:
        seconds, micros, kept, whole = head.unpack(mark)
        data = stream.read(kept)
        if len(data) < kept:
            return
        n += 1
        yield n, seconds + micros / 1e6, whole, data


def _batches(path: str, stream, *of) -> Iterator[pd.DataFrame]:
    rows, size = [], 0
    for frame in _frames(stream, *of):
        rows.append((path, *frame))
        size += len(frame[3]) + 64
        if size > HELD:
            yield pd.DataFrame(rows, columns=NAMES)
            rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=NAMES)


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path)) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


#: Bytes of a file that are one task; bytes that are looked at for a record's head, and heads in a row that make one likely.
SPLIT, SEEN, LINKS = 64 << 20, 1 << 20, 6
SPANS = "path string, begin long, stop long, length long, start long, `end` long, frames long"


def _order(file) -> str:
    file.seek(0)
    start = file.read(24)
    if start[:4] not in MAGIC or len(start) < 24:
        raise ValueError("not a capture file")
    return MAGIC[start[:4]]


def _likely_start(file, order: str, begin: int, length: int) -> int:
    """The first place from begin on at which heads of records follow one another, or the file's end if there is none.

    It may be wrong, where a frame holds records itself; whoever asks compares it with where the records before it end.
    """
    while begin < length:
        file.seek(begin)
        data = np.frombuffer(file.read(SEEN + 15), np.uint8)
        n = len(data) - 15
        if n <= 0:
            return length
        field = lambda k: sum(data[k + (i if order == "<" else 3 - i) :][:n].astype(np.int64) << 8 * i for i in range(4))
        micros, kept, whole = field(4), field(8), field(12)
        good = (micros < 1_000_000) & (kept <= whole) & (whole <= 1 << 18)
        following = np.arange(n) + 16 + kept
        chain = good & (begin + following <= length)
        for _ in range(LINKS):  # a head whose follower is beyond what was read, or the file's end, is as good as followed
            inside = following < n
            chain &= ~inside | chain[np.where(inside, following, 0)] | (begin + following == length)
        if len(at := np.flatnonzero(chain)):
            return begin + int(at[0])
        begin += n
    return length


def _walked(file, order: str, start: int, stop: int, length: int) -> tuple[int, int]:
    """(where the first record from stop on begins, how many begin from start to there); a cut-off record is the file's end."""
    head, at, n, chunk, base = struct.Struct(order + "I"), start, 0, b"", 0
    while at < stop:
        if at + 16 > length:
            return length, n
        if not base <= at <= base + len(chunk) - 16:
            file.seek(at)
            base, chunk = at, file.read(1 << 20)
        (kept,) = head.unpack_from(chunk, at - base + 8)
        if at + 16 + kept > length:
            return length, n
        at, n = at + 16 + kept, n + 1
    return at, n


def _span(batches):
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            fs, inner = _system(r.path)
            with fs.open_input_file(inner) as file:
                order = _order(file)
                start = int(r.start) if r.start == r.start and r.start is not None else 24 if r.begin == 0 else _likely_start(file, order, r.begin, r.length)
                rows.append((r.path, r.begin, r.stop, r.length, start, *_walked(file, order, start, r.stop, r.length)))
        yield pd.DataFrame(rows, columns=["path", "begin", "stop", "length", "start", "end", "frames"])


def spans(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Where the records of each stretch of each file begin and end, and how many they are: a row for `split` bytes.

    Every stretch finds its first record on its own. Where that isn't the place at which the records before it end, it is read again
    from there, until all fit together: so no record is lost or met twice, whatever the frames hold.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    cut = files.select("path", "length", F.explode(F.sequence(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split))).alias("begin"))
    asked = cut.select("path", "begin", F.least(F.col("begin") + split, "length").alias("stop"), "length", F.lit(None).cast("double").alias("start"))
    tasks = max(1, 4 * spark.sparkContext.defaultParallelism)
    found = kept(asked.repartition(tasks, "path", "begin").mapInPandas(_span, SPANS))
    before = F.lag("end").over(Window.partitionBy("path").orderBy("begin"))
    while True:
        tried = found.withColumn("_due", F.coalesce(before, F.col("start")))
        wrong = tried.where("_due <> start")
        if wrong.isEmpty():
            return found
        again = wrong.select("path", "begin", "stop", "length", F.col("_due").cast("double").alias("start")).repartition(tasks, "path", "begin").mapInPandas(_span, SPANS)
        found = kept(tried.where("_due = start").drop("_due").unionByName(again))


def read(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The frames of all files of a path, of any size: tasks read stretches of `split` bytes, so a long file is many. A bad file fails."""

    def parse(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                fs, inner = _system(r.path)
                with fs.open_input_file(inner) as file:
                    order = _order(file)
                with fs.open_input_file(inner) as file:
                    file.seek(r.start)
                    yield from _batches(r.path, io.BufferedReader(_Raw(file), 1 << 20), order, int(r.before), int(r.frames))

    earlier = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    found = spans(spark, path, split).withColumn("before", F.coalesce(F.sum("frames").over(earlier), F.lit(0))).where("frames > 0")
    tasks = max(1, 4 * spark.sparkContext.defaultParallelism)
    return found.select("path", "start", "before", "frames").repartition(tasks, "path", "start").mapInPandas(parse, SCHEMA)


def read_landed(files: DataFrame) -> DataFrame:
    """The frames of files that come as rows of a path, as from a stream of new files: each is streamed, whatever its size."""

    def parse(batches):
        for batch in batches:
            for path in batch["path"]:
                fs, inner = _system(path)
                with fs.open_input_stream(inner, compression=None, buffer_size=1 << 20) as stream:
                    yield from _batches(path, stream)

    return files.select("path").mapInPandas(parse, SCHEMA)


def read_whole(files: DataFrame) -> DataFrame:
    """The frames of files that come as rows of path and content, as from a stream of new files or a store that only
    Spark opens; a file is then one value, of at most 2 GB."""

    def parse(batches):
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                yield from _batches(path, io.BytesIO(data))

    return files.select("path", "content").mapInPandas(parse, SCHEMA)


def write(packets: DataFrame, folder: str, by: str | None = None) -> DataFrame:
    """Packets (timestamp, bytes) as capture files below a folder that all executors reach, in the order of their
    time, one for each task and value of `by`; the result lists them: path, by, frames. A task that is run again writes
    files of new names; only those of the attempt that Spark accepts are in the list."""
    fs, base = _system(folder)
    fs.create_dir(base, recursive=True)

    def store(batches):
        fs, base = _system(folder)
        out, now, done, n, name = None, None, [], 0, ""
        for pdf in batches:
            for group, head, data in zip(pdf["group"], pdf["head"], pdf["bytes"]):
                if out is None or group != now:
                    if out is not None:
                        out.close()
                        done.append((f"{folder}/{name}", now, n))
                    name, now, n = f"{uuid.uuid4().hex}.pcap", group, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(file_head())
                out.write(bytes(head) + bytes(data))
                n += 1
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", now, n))
        yield pd.DataFrame(done, columns=["path", "group", "frames"])

    key = F.col(by).cast("string") if by else F.lit("")
    rows = packets.select(key.alias("group"), "timestamp", record_head().alias("head"), "bytes")
    rows = rows.repartition("group").sortWithinPartitions("group", "timestamp") if by else rows.sortWithinPartitions("timestamp")
    listed = rows.select("group", "head", "bytes").mapInPandas(store, "path string, group string, frames long").collect()  # a row for each file
    return packets.sparkSession.createDataFrame(listed, "path string, group string, frames long").withColumnRenamed("group", by or "group")


def record_head(timestamp: str = "timestamp", frame: str = "bytes"):
    """The head of a frame's record in a little-endian file, in built-in functions."""
    little = lambda n: F.unhex(F.regexp_replace(F.lpad(F.hex(n), 8, "0"), "(..)(..)(..)(..)", "$4$3$2$1"))
    micros = F.round(F.col(timestamp) * 1_000_000).cast("long")
    size = F.length(frame).cast("long")
    return F.concat(little(F.floor(micros / 1_000_000)), little(micros % 1_000_000), little(size), little(size))


def record(timestamp: str = "timestamp", frame: str = "bytes"):
    """A frame as a record of a little-endian file."""
    return F.concat(record_head(timestamp, frame), F.col(frame))


def file_head() -> bytes:
    """Version 2.4, Ethernet, frames of up to 65535 bytes."""
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
