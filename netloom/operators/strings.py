"""Printable strings of payloads, their classes and totals."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import text as T

_RUN = re.compile(rb"[\x20-\x7e]{4,}")


#: Strings of a batch that a scan gives out.
STRINGS = 8192


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of runs, however many a payload has."""

    def rows(found: list[tuple]) -> pd.DataFrame:
        ids, offsets, values = zip(*found)
        return pd.DataFrame({"_id": ids, "offset": offsets, "value": [v.decode() for v in values], "length": [len(v) for v in values], "entropy": T.entropies(values)})

    for batch in batches:
        found: list[tuple] = []
        for number, payload in zip(batch["_id"], batch["_bytes"]):
            for m in _RUN.finditer(payload or b""):
                found.append((number, m.start(), m.group()))
                if len(found) == STRINGS:
                    yield rows(found)
                    found = []
        if found:
            yield rows(found)


def strings(rows: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """Runs of four or more printable bytes of every payload: id, offset, value, length, entropy, kind,
    sensitive. Offsets need a scan of the bytes, so that step is Arrow batches, which also have the bytes' entropy; what
    comes out is cut into batches of its own, as a payload may hold any number. All else is built in."""
    kind = dict(rows.dtypes)[id_col]
    found = rows.select(F.col(id_col).cast("string").alias("_id"), F.col(bytes_col).alias("_bytes")).mapInPandas(_scan, "_id string, offset int, value string, length int, entropy double")
    found = found.select(F.col("_id").cast(kind).alias(id_col), "offset", "value", "length", "entropy", F.lower("value").alias("_low"))
    found = found.withColumn("kind", T.string_class(F.col("value"), F.col("_low"))).drop("_low")
    return found.withColumn("sensitive", F.col("kind").isin(*T.SENSITIVE))


def totals(found: DataFrame) -> DataFrame:
    """A21 by class: strings, sensitive ones, bytes and mean entropy."""
    return found.groupBy("kind").agg(F.count("*").alias("found"), F.count_if("sensitive").alias("sensitive"), F.sum("length").alias("bytes"), F.avg("entropy").alias("mean_entropy"))


def summary(found: DataFrame) -> DataFrame:
    """Strings, sensitive ones, mean entropy and the most frequent class (the first by name of equal ones)."""
    by = found.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("sensitive").alias("s"), F.sum("entropy").alias("e"))
    return by.agg(F.sum("n").alias("found"), F.sum("s").alias("sensitive"), (F.sum("e") / F.sum("n")).alias("mean_entropy"), F.min_by("kind", F.struct(-F.col("n"), "kind")).alias("top_kind"))
