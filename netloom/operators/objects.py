"""Streams and objects: search, carving, pattern rules, previews, and what is exported of them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.automaton import Pattern, automaton_of
from netloom.sources.scratch import kept

#: Kinds of files with their beginning, end (or none) and the size they are cut at.
SIGNATURES = (
    (b"\x89PNG\r\n\x1a\n", "image/png", b"\x00\x00\x00\x00IEND\xaeB`\x82", 10_000_000), (b"\xff\xd8\xff", "image/jpeg", b"\xff\xd9", 10_000_000), (b"GIF87a", "image/gif", b"\x00;", 5_000_000), (b"GIF89a", "image/gif", b"\x00;", 5_000_000),
    (b"%PDF-", "application/pdf", b"%%EOF", 50_000_000), (b"PK\x03\x04", "application/zip", b"PK\x05\x06", 50_000_000), (b"\x1f\x8b\x08", "application/gzip", None, 50_000_000), (b"BZh", "application/bzip2", None, 50_000_000),
    (b"\xfd7zXZ\x00", "application/xz", None, 50_000_000), (b"MZ", "application/exe", None, 20_000_000), (b"\x7fELF", "application/elf", None, 20_000_000), (b"RIFF", "audio/wav", None, 20_000_000), (b"OggS", "audio/ogg", None, 20_000_000),
    (b"ID3", "audio/mp3", None, 20_000_000), (b"\x00\x00\x00\x20ftyp", "video/mp4", None, 100_000_000), (b"<!DOCTYPE html", "text/html", b"</html>", 5_000_000), (b"<html", "text/html", b"</html>", 5_000_000),
)


def is_http(data: Column, answer: Column | None = None) -> Column:
    """Whether a stream's bytes, or those of its other direction, begin like HTTP."""
    begins = lambda c, *words: F.coalesce(F.substring(c, 1, 5).isin(*(F.lit(w).cast("binary") for w in words if len(w) == 5)) | F.substring(c, 1, 4).isin(*(F.lit(w).cast("binary") for w in words if len(w) == 4)), F.lit(False))
    own = begins(data, b"GET ", b"POST ", b"HTTP/")
    return own if answer is None else own | F.coalesce(F.substring(answer, 1, 5) == F.lit(b"HTTP/").cast("binary"), F.lit(False))


def preview(data: Column, most: int = 256) -> Column:
    """The first bytes of a direction: line ends as one sign, other bytes that can't be printed as a dot."""
    text = F.decode(F.substring(data, 1, most), "ISO-8859-1")
    return F.regexp_replace(F.regexp_replace(text, "[\r\n]", "↵"), "[^\\x20-\\x7e↵]", "·")


def found_at(rows: DataFrame, needle: bytes, id_cols: list[str], data_col: str = "data") -> DataFrame:
    """Every place of some bytes, A-Z and a-z alike, in each row's data, overlapping ones too: id columns, offset."""
    pattern = re.compile(b"(?=" + re.escape(needle.lower()) + b")", re.S)

    @F.pandas_udf("array<int>")
    def places(data: pd.Series) -> pd.Series:
        return data.map(lambda b: [m.start() for m in pattern.finditer(bytes(b).lower())] if b is not None else [])

    some = rows.where(F.contains(F.lower(F.decode(F.col(data_col), "ISO-8859-1")), F.lit(needle.lower().decode("latin-1")))) if needle else rows.where("false")
    return some.select(*id_cols, F.explode(places(data_col)).alias("offset"))


OBJECT = "offset int, kind string, size int, sha256 string, data binary"


def carved(rows: DataFrame, id_col: str, data_col: str = "data", with_data: bool = True) -> DataFrame:
    """Files in payloads, from their beginning to their end mark or the size limit: id, offset, kind, size, sha256,
    data. The same file comes once: where its id, then its offset, is the smallest. Payloads without any beginning
    never reach Python; copies are told apart by their digest, so the data of none are compared."""

    def find(batches):
        for pdf in batches:
            out = []
            for id_, data in zip(pdf["id"], pdf["data"]):
                data = bytes(data)
                for mark, kind, end, most in SIGNATURES:
                    at, k = data.find(mark), -1
                    while at >= 0:
                        stop = min(at + most, len(data))
                        if end and k is not None and k < at:  # the next end is looked for once
                            k = data.find(end, at)
                            k = None if k < 0 else k
                        if end and k is not None:
                            stop = min(k + len(end), at + most)
                        if stop - at > len(mark):
                            piece = data[at:stop]
                            out.append((id_, at, kind, len(piece), hashlib.sha256(piece).hexdigest(), piece if with_data else None))
                        at = data.find(mark, at + len(mark))
            yield pd.DataFrame(out, columns=["id", *(c.split()[0] for c in OBJECT.split(", "))])

    some = F.lit(False)
    for mark, *_ in SIGNATURES:
        some = some | F.contains(F.col(data_col), F.lit(mark).cast("binary"))
    kind = dict(rows.dtypes)[id_col]
    found = rows.where(some).select(F.col(id_col).alias("id"), F.col(data_col).alias("data")).mapInPandas(find, f"id {kind}, {OBJECT}")
    once = found.groupBy("sha256").agg(F.min_by(F.struct("id", "offset", "kind", "size", "data"), F.struct("id", "offset", "kind")).alias("o"))
    out = once.select(F.col("o.id").alias(id_col), "o.offset", "o.kind", "o.size", "sha256", "o.data")
    return out if with_data else out.drop("data")


RULES = "rule string, pattern string, kind string, text string, nocase boolean, condition string"
MATCHES = "rule string, pattern string, offset int, bytes binary"


#: Rules that are collected to be compiled; bytes that come to Python and are scanned at once; hits that leave it at once.
MOST_RULES, SCANNED_BYTES, HITS = 100_000, 2 << 20, 20_000


def rules_of(table: DataFrame) -> list[dict]:
    """A table of rules (columns as RULES) as the rows that pattern_hits compiles; more than MOST_RULES are refused."""
    rows = table.select(*(c.split()[0] for c in RULES.split(", "))).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return sorted((r.asDict() for r in rows), key=lambda r: (r["rule"], r["pattern"]))


def _pattern(rule: dict) -> Pattern:
    return Pattern.hex(rule["text"]) if rule["kind"] == "hex" else Pattern.literal(rule["text"], bool(rule["nocase"]))


def _sliced(payloads: list[bytes]) -> Iterator[slice]:
    begin = held = 0
    for i, data in enumerate(payloads):
        if held and held + len(data) > SCANNED_BYTES:
            yield slice(begin, i)
            begin, held = i, 0
        held += len(data)
    yield slice(begin, len(payloads))


def pattern_hits(rows: DataFrame, rules: list[dict], id_col: str, data_col: str = "data", most: int = 1 << 20) -> DataFrame:
    """Hits of pattern rules in each row's first `most` bytes: id, rule, pattern, offset and 32 bytes at most.

    A rule is one or more dicts of rule, pattern (its name), kind (literal or hex, with ?? for any byte), text, nocase
    and condition: any, all, true, or the name of a pattern. Hits of a pattern don't overlap; a rule whose condition
    doesn't hold has none. One automaton finds the hits of all patterns in one pass, however many they are; the rules go
    with the code (`rules_of` reads a table), and a row's rules are judged where its bytes are. Rows are cut before they go to Python,
    and come and leave in small batches, so a worker's memory doesn't depend on how many or how long they are. The hits are a table of their own.
    """
    kind = dict(rows.dtypes)[id_col]
    made = [r for r in rules if r["text"]]
    patterns = tuple(_pattern(r) for r in made)
    number = {name: i for i, name in enumerate(dict.fromkeys(r["rule"] for r in made))}
    of = np.array([number[r["rule"]] for r in made], np.int64)
    first = {number[r["rule"]]: r["condition"] for r in reversed(made)}
    condition = [first[i] for i in range(len(number))]

    def scan(batches):
        automaton = automaton_of(patterns)
        for pdf in batches:
            payloads = [bytes(d) if d is not None else b"" for d in pdf["data"]]
            for part in _sliced(payloads):
                here, ids = payloads[part], pdf["id"].iloc[part].tolist()
                hits = automaton.hits(here)
                rule = of[hits[:, 1]]
                holds = np.ones(len(hits), bool)
                for r in np.unique(rule):
                    if condition[r] in ("any", "true"):
                        continue
                    mine = rule == r
                    wanted = np.flatnonzero(of == r) if condition[r] == "all" else np.array([i for i in np.flatnonzero(of == r) if made[i]["pattern"] == condition[r]], np.int64)
                    fires = np.ones(len(here), bool) if len(wanted) else np.zeros(len(here), bool)
                    for i in wanted:
                        fires &= np.isin(np.arange(len(here)), hits[mine & (hits[:, 1] == i), 0])
                    holds[mine] = fires[hits[mine, 0]]
                hits = hits[holds]
                for begin in range(0, len(hits), HITS):
                    found = [(ids[k], made[i]["rule"], made[i]["pattern"], at, here[k][at : at + min(32, len(patterns[i].text))]) for k, i, at in hits[begin : begin + HITS].tolist()]
                    yield pd.DataFrame(found, columns=["id", *(c.split()[0] for c in MATCHES.split(", "))])

    cut = rows.select(F.col(id_col).alias("id"), F.substring(F.col(data_col).cast("binary"), 1, most).alias("data"))
    return kept(cut.mapInPandas(scan, f"id {kind}, {MATCHES}").withColumnRenamed("id", id_col), SCANNED_BYTES)


def unscanned(rows: DataFrame, matches: DataFrame, id_col: str) -> DataFrame:
    """The rows that no scan has a result for yet."""
    return rows.join(matches.select(F.col(id_col).alias("_seen")).distinct(), F.col(id_col) == F.col("_seen"), "left_anti")


def rule_totals(matches: DataFrame, id_col: str) -> DataFrame:
    """Matches of each target and its rules in the order in which they are first met."""
    first = matches.groupBy(id_col, "rule").agg(F.count("*").alias("_n"), F.min("offset").alias("_at"))
    return first.groupBy(id_col).agg(F.sum("_n").alias("matches"), F.transform(F.array_sort(F.collect_list(F.struct("_at", "rule"))), lambda x: x.rule).alias("rules"))


def with_rules(objects: DataFrame, matches: DataFrame, id_col: str) -> DataFrame:
    """Objects with the rules that hit them, an empty list where none does."""
    names = matches.groupBy(F.col(id_col).alias("_id")).agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    return objects.join(names, F.col(id_col) == F.col("_id"), "left").withColumn("rules", F.coalesce("rules", F.array().cast("array<string>"))).drop("_id")


def export_streams(parts: DataFrame, path: str) -> None:
    """The bytes of each direction of streams, a folder for each: parts has stream_id, direction (a-to-b, b-to-a),
    offset and data, as reassembly gives them; rows keep their place, so a long stream is never one value."""
    parts.select("stream_id", "direction", "offset", "data").repartition("stream_id", "direction").sortWithinPartitions("stream_id", "direction", "offset").write.mode("overwrite").partitionBy("stream_id", "direction").parquet(path)


def ranked(rows: DataFrame, by: str, *ties: str, top: int | None = None, within: str | None = None) -> DataFrame:
    """K8 and others: rows by a measure, largest first, with ties by further columns; the first `top`, of each group of
    `within` if given (a window's group limit then cuts each task's rows before the shuffle)."""
    if within is None:
        out = rows.orderBy(F.desc(by), *ties)
        return out if top is None else out.limit(top)
    w = Window.partitionBy(within).orderBy(F.desc(by), *ties)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
