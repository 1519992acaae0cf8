"""Text files that grow, as a stream of their complete lines (S12): a stream's offset is a number of bytes for each file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from netloom.sources.pcap import _system

#: Bytes of appended lines that one task reads, and bytes that are read at once.
PART, STEP = 32 << 20, 1 << 20


class Stretch(InputPartition):
    """Bytes from begin to end of a file; lines that begin there are its own."""

    def __init__(self, path: str, begin: int, end: int, last: int):
        self.path, self.begin, self.end, self.last = path, begin, end, last


def _after_last_newline(file, size: int, floor: int) -> int:
    """Where the last complete line ends, floor if there is none: read from the end backwards."""
    at = size
    while at > floor:
        begin = max(floor, at - STEP)
        file.seek(begin)
        found = file.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return floor


class TailReader(DataSourceStreamReader):
    """Batches are what is appended; a line without its end waits. A file that got shorter is read anew from its beginning."""

    def __init__(self, folder: str):
        self.folder, self.known = folder, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, inner = _system(self.folder)
        now = {}
        for info in fs.get_file_info(pafs.FileSelector(inner, recursive=False)):
            if info.type == pafs.FileType.File and not info.base_name.startswith((".", "_")):
                before = self.known.get(info.base_name, 0)
                with fs.open_input_file(info.path) as file:
                    now[info.base_name] = _after_last_newline(file, info.size, before if before <= info.size else 0)
        self.known = now
        return now

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for name, last in sorted(end.items()):
            begin = start.get(name, 0)
            begin = begin if begin <= last else 0  # cut off since
            out += [Stretch(f"{self.folder.rstrip('/')}/{name}", at, min(at + PART, last), last) for at in range(begin, last, PART)]
        return out

    def commit(self, end: dict) -> None:
        pass

    def read(self, partition: Stretch) -> Iterator[tuple]:
        fs, inner = _system(partition.path)
        name = partition.path.rsplit("/", 1)[-1]
        with fs.open_input_file(inner) as file:
            at = partition.begin
            if at:
                file.seek(at - 1)
                if file.read(1) != b"\n":  # the stretch before has this line
                    at = self._next_line(file, at, partition.last)
            file.seek(at)
            rest = b""
            while at < partition.end:
                data = file.read(min(STEP, partition.last - at - len(rest)))
                lines = (rest + data).split(b"\n")
                rest = lines.pop()
                for line in lines:
                    if at >= partition.end:
                        return
                    yield name, at, line.decode("utf-8", "replace")
                    at += len(line) + 1
                if not data:
                    return

    @staticmethod
    def _next_line(file, at: int, last: int) -> int:
        while at < last:
            file.seek(at)
            data = file.read(min(STEP, last - at))
            found = data.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(data)
        return last


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, offset long, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"])


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Complete lines as they are appended to the files of a folder: file, offset, value. The query's checkpoint keeps how far each is read."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").load(folder)


def owners(spark: SparkSession, folder: str) -> DataFrame:
    """Socket owners of files that grow, by file and place; empty lines and comments are passed over, any other line is an error."""
    from netloom.sources.feeds import _owners

    rows = lines(spark, folder).select(F.trim("value").alias("line"), "file", "offset")
    return _owners(rows.where("line != '' and not startswith(line, '#')"))


def losses(spark: SparkSession, folder: str) -> DataFrame:
    """What the collector says it lost, comment by comment."""
    number = lambda name: F.nullif(F.regexp_extract("value", rf"(?:^|\s){name}=(\d+)", 1), F.lit("")).cast("long").alias(name)
    return lines(spark, folder).where("startswith(trim(value), '#')").select("file", "offset", number("kernel_lost"), number("userspace_invalid"))
