"""WARC archives: a writer of deduplicated records and a reader that salvages what it can.

Archives are gzip members, one a record, or plain records. After a failed check the reader searches for the next
gzip member or version line that holds a valid record, goes on from there, and logs the bytes it passed over as a
quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import materialise, shared_dir, table

GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
#: A record's header, and the HTTP head in its block, are at most this long.
HEADER_MOST = 1 << 16
#: A gzip member's own header is at most about this long.
GZIP_HEADER_MOST = 1 << 12
#: Bytes that are read, and inflated, at a time.
PIECE = 1 << 18
#: Payloads beyond this many bytes are told by digest and length only, whatever was asked for.
PAYLOAD_MOST = 64 << 20


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [b"WARC/1.1"] + [f"{k}: {v}".encode("utf-8") for k, v in headers] + [b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, wbits=31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    """A record as it was checked. The payload is the block without the HTTP head if it has one; its bytes are there
    only where they were asked for and are no more than PAYLOAD_MOST."""

    offset: int
    length: int
    headers: dict[str, str]
    head: bytes
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


class _Block:
    """Takes a record's block piece by piece: digests and lengths, and the payload's bytes if they are to be kept."""

    def __init__(self, headers: dict[str, str], keep: bool):
        self.whole, self.rest, self.size, self.parts, self.keep = hashlib.sha1(), hashlib.sha1(), 0, [], keep
        self.head, self.in_head = b"", headers.get("content-type", "").startswith("application/http")

    def add(self, piece: bytes) -> None:
        self.whole.update(piece)
        if self.in_head:
            self.head += piece
            head, found, piece = self.head.partition(b"\r\n\r\n")
            if not found:
                if len(self.head) > HEADER_MOST:  # no HTTP head that long: the block has none, and no payload
                    self.head, self.in_head, self.rest = self.head[:HEADER_MOST], False, None
                return
            self.head, self.in_head = head, False
        if self.rest is not None:
            self.rest.update(piece)
            self.size += len(piece)
            if self.keep and self.size <= PAYLOAD_MOST:
                self.parts.append(piece)
            else:
                self.keep, self.parts = False, []

    def record(self, at: int, length: int, headers: dict[str, str]) -> Record | str:
        """The record, or which of its digests fails."""
        text = lambda x: base64.b32encode(x.digest()).decode("ascii")
        own = text(self.rest or hashlib.sha1())
        stated = headers.get("warc-block-digest", "").removeprefix("sha1:")
        if stated and stated != text(self.whole):
            return "block digest"
        stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
        if stated and headers.get("warc-type") != "revisit" and stated != own:
            return "payload digest"
        return Record(at, length, headers, self.head, self.size, own, b"".join(self.parts) if self.keep else None)


def header_of(data: bytes) -> tuple[dict[str, str], int] | str | None:
    """(fields, length) of the header that data begins with, what is wrong with it, or None if it goes on beyond data."""
    if not data.startswith((VERSION + b"0\r\n", VERSION + b"1\r\n")):
        return "no version line"
    at, fields, name = len(VERSION) + 3, {}, ""
    while (end := data.find(b"\r\n", at)) >= 0:
        line = data[at:end]
        at = end + 2
        if not line:
            return fields, at
        name_, colon, value = line.partition(b":")
        if line[:1] in b" \t" and name:
            fields[name] += " " + line.strip().decode("utf-8", "replace")
        elif colon:
            name = name_.strip().lower().decode("utf-8", "replace")
            fields[name] = value.strip().decode("utf-8", "replace")
        else:
            return "no header"
    return None


@dataclass
class Salvage:
    """Reads records from a binary stream that can seek; gaps gets (offset, length, reason) of what no record covers.

    Memory holds one piece of the stream, one header and, if payloads are asked for, one payload of bounded size: a
    block goes through its digests a piece at a time, and a plain record's end is looked at before its block is read,
    so a false length costs one seek. A record is accepted if its header parses, its block and end are whole, its
    gzip checksum holds if it is a member, and its digests, where it states them, too.
    """

    stream: object
    with_payload: bool = True
    gaps: list[tuple[int, int, str]] = field(default_factory=list)
    _data: bytes = b""
    _base: int = 0  # place of _data in the stream
    _next: dict[bytes, int] = field(default_factory=dict)  # the first place of each mark at or after the last search

    def _have(self, at: int, n: int) -> int:
        """Hold the piece with the n bytes from a place on; how many of them there are."""
        if not self._base <= at <= at + n <= self._base + len(self._data):
            self.stream.seek(at)
            self._base, self._data = at, self.stream.read(max(n, PIECE))
        return min(n, self._base + len(self._data) - at)

    def _get(self, at: int, n: int) -> bytes:
        self._have(at, n)
        return self._data[at - self._base : at - self._base + n]

    def _find(self, mark: bytes, at: int) -> int | None:
        """The first place of a mark from there on. No byte is searched twice for it."""
        known = self._next.get(mark, -1)
        while known is not None and known < at:
            have = self._have(at, len(mark))
            found = self._data.find(mark, at - self._base)
            if found >= 0:
                known = self._base + found
            elif have < len(mark):
                known = None
            else:
                at = self._base + len(self._data) - len(mark) + 1
        self._next[mark] = known
        return known

    def _header(self, more) -> tuple[dict[str, str], int] | str:
        for n in (1 << 10, 1 << 13, HEADER_MOST):
            data = more(n)
            if (found := header_of(data)) is not None:
                return found
            if len(data) < n:
                break
        return "header cut off"

    def _plain(self, at: int) -> Record | str:
        found = self._header(lambda n: self._get(at, n))
        if isinstance(found, str):
            return found
        headers, begin = found[0], at + found[1]
        if not (size := headers.get("content-length", "")).isdecimal() or len(size) > 18:
            return "no length"
        end = begin + int(size)
        tail = self._get(end, 4)
        if tail != b"\r\n\r\n":
            return "cut off" if len(tail) < 4 else "no end where the length says"
        block = _Block(headers, self.with_payload)
        for place in range(begin, end, PIECE):
            block.add(self._get(place, min(PIECE, end - place)))
        return block.record(at, end + 4 - at, headers)

    def _member(self, at: int) -> Record | str:
        inflate, place, out, begun = zlib.decompressobj(31), at, b"", False

        def more(n: int) -> bytes:
            """At least n inflated bytes, or all there are, from those not yet taken on."""
            nonlocal place, out, begun
            while len(out) < n and not inflate.eof:
                # most false starts show at once; a gzip header that never ends is one too
                if not begun and place - at > GZIP_HEADER_MOST:
                    raise zlib.error("no data after the header")
                piece = inflate.unconsumed_tail or self._get(place, PIECE if begun else 512 if place == at else GZIP_HEADER_MOST)
                if not piece:
                    raise zlib.error("cut off")
                place += 0 if inflate.unconsumed_tail else len(piece)
                out += inflate.decompress(piece, PIECE)
                begun = begun or bool(out)
            return out[:n]

        try:
            if not (len(VERSION) > len(start := more(len(VERSION))) or start == VERSION):
                return "no version line"
            found = self._header(more)
            if isinstance(found, str):
                return found
            headers, begin = found
            if not (size := headers.get("content-length", "")).isdecimal() or len(size) > 18:
                return "no length"
            out, left, block = out[begin:], int(size), _Block(headers, self.with_payload)
            while left:
                if not (piece := more(min(left, PIECE))):
                    return "cut off"
                block.add(piece)
                out, left = out[len(piece) :], left - len(piece)
            if more(5) != b"\r\n\r\n":
                return "no end where the length says"
        except zlib.error as e:
            return f"gzip: {str(e)[:60]}"
        return block.record(at, place - len(inflate.unused_data) - at, headers)

    def __iter__(self) -> Iterator[Record]:
        at, bad_from, reason = 0, None, ""
        while True:
            start = min((x for x in (self._find(GZIP, at), self._find(VERSION, at)) if x is not None), default=None)
            if (start is None or start > at) and bad_from is None and self._have(at, 1):
                bad_from, reason = at, "not a record"
            if start is None:
                if bad_from is not None:
                    self.stream.seek(0, 2)
                    self.gaps.append((bad_from, self.stream.tell() - bad_from, reason))
                return
            found = self._member(start) if self._get(start, len(GZIP)) == GZIP else self._plain(start)
            if isinstance(found, str):
                if bad_from is None:
                    bad_from, reason = start, found
                at = start + 1
                continue
            if bad_from is not None:
                self.gaps.append((bad_from, start - bad_from, reason))
                bad_from = None
            yield found
            at = start + found.length


def _open_for(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path that Spark knows, and the path in it; a URI (file:, hdfs:, s3:) or a local path."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path)) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


RECORDS = "path string, offset long, length long, type string, record_id string, refers_to string, uri string, payload_digest string, payload_bytes long, payload binary, gap_reason string"


def _read(with_payload: bool):
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def read(batches):
        for pdf in batches:
            for path in pdf["path"]:
                fs, name = _open_for(path)
                with fs.open_input_file(name) as stream:
                    reader, rows, size, logged = Salvage(stream, with_payload), [], 0, 0
                    for r in reader:
                        h, full = r.headers, r.payload_bytes
                        if h.get("warc-type") == "revisit":  # the kept HTTP head tells the length of what it stands for
                            m = re.search(rb"(?im)^content-length:\s*(\d+)", r.head)
                            full = int(m[1]) if m else full
                        rows.append((path, r.offset, r.length, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:") or r.payload_digest, full, r.payload, None))
                        size += len(r.payload or b"") + 512
                        if size > 1 << 24:
                            rows += [(path, o, n, "gap", *[None] * 6, why) for o, n, why in reader.gaps[logged:]]
                            logged = len(reader.gaps)
                            yield pd.DataFrame(rows, columns=names)
                            rows, size = [], 0
                    rows += [(path, o, n, "gap", *[None] * 6, why) for o, n, why in reader.gaps[logged:]]
                    if rows:
                        yield pd.DataFrame(rows, columns=names)

    return read


def read_archives(paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for every record that can be recovered from the archives in paths(path), and one of type "gap" for
    every run of bytes that can't, with its reason. An empty archive has no rows. One task reads one archive at a
    time, as a stream. Payloads beyond PAYLOAD_MOST are null; their digest and length are told."""
    n = max(1, paths.sparkSession.sparkContext.defaultParallelism)
    return paths.select("path").repartition(4 * n, "path").mapInPandas(_read(with_payload), RECORDS)


def list_archives(spark, glob: str) -> DataFrame:
    """path of every file that a path or pattern names, listed by Spark; the contents are not read."""
    return spark.read.format("binaryFile").load(glob).select("path")


def _write(folder: str, records: int):
    def write(batches):
        from pyspark import TaskContext

        fs, base = _open_for(folder)
        part, done, out = TaskContext.get().partitionId(), [], None

        def close():
            out.close()
            fs.move(f"{base}/{name}.part", f"{base}/{name}")  # a retried task writes the same name again, whole
            done.append((f"{folder}/{name}", count))

        number = count = 0
        name = ""
        for pdf in batches:
            for row in pdf.itertuples():
                if out is None:
                    name, count = f"part-{part:05d}-{number:05d}-{uuid.uuid4().hex[:8]}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}.part", compression=None)
                payload = row.payload or b""
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                revisit = isinstance(row.refers_to, str)
                block = head if revisit else head + payload
                headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{row.record_id}>"), ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"), ("WARC-Block-Digest", f"sha1:{digest32(block)}"), ("Content-Type", "application/http; msgtype=response")]
                if isinstance(row.uri, str):
                    headers.append(("WARC-Target-URI", re.sub(r"[\r\n]+", " ", row.uri)))
                if revisit:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{row.refers_to}>")]
                out.write(member(record_bytes(headers, block)))
                count += 1
                if count >= records:
                    close()
                    out, number = None, number + 1
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["path", "records"])

    return write


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", smallest: int = 0, records: int = 20_000) -> DataFrame:
    """Write a record for each row into .warc.gz archives below folder; the result is their list (path, records).

    Of rows with equal payloads (SHA-1 of the UTF-8 text; null counts as empty) of at least `smallest` bytes, that
    with the largest id is the response and the others revisit it; smaller ones are all responses. Only digests
    are grouped, not payloads, so a payload with any number of copies is one group of short rows, reduced before
    the shuffle. Rows with a null id are responses. A task that is run again writes files of new names; only those
    of the attempt that Spark accepts are in the list.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    first = rows.where(F.octet_length("payload") >= smallest).groupBy(F.col("digest").alias("of")).agg(F.max("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    marked = rows.join(first, (F.col("digest") == F.col("of")) & (F.octet_length("payload") >= smallest), "left")
    name = lambda c: F.concat(F.lit("urn:netloom:page:"), F.col(c).cast("string"))
    refers = F.when((F.col("id") != F.col("first")), name("first"))
    ready = marked.select(F.coalesce(name("id"), F.lit("urn:netloom:page:")).alias("record_id"), "uri", refers.alias("refers_to"), "payload")
    fs, base = _open_for(folder)
    fs.create_dir(base, recursive=True)
    return materialise(ready.mapInPandas(_write(folder, records), "path string, records long"))


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row of pages, read back from archives.

    Null ids and repeated rows are records of their own; of repeated rows with the largest id all are responses. Ids
    are whole numbers. Extra columns are not read; an empty table gives no rows. Records that can't be read back make
    the query fail, as they would be missing without a word.
    """
    pages = table(spark, sf_dir, "pages")
    archives = write_archives(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    records = materialise(read_archives(archives, with_payload=False))
    seen = records.agg(F.count_if(F.col("type") != "gap").alias("records"), F.count_if(F.col("type") == "gap").alias("gaps")).first()
    written = archives.agg(F.sum("records").alias("n")).first()["n"] or 0
    if (seen["records"], seen["gaps"]) != (written, 0):
        raise ValueError(f"{written} records were written, {seen['records']} read, with {seen['gaps']} gaps")
    number = lambda c: F.regexp_extract(c, "([0-9-]+)>$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c)).cast("long")
    return records.select(as_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), as_id("refers_to").alias("refers_to"))
