"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

Distinct fingerprints are laid out in tiles by the population counts of their four 16-bit quarters. Two
fingerprints within the radius have counts that differ by no more than the radius in sum, so only tile pairs
whose counts are that close meet; within a pair, numpy compares every fingerprint with every other.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import folded_words_of, free_name, materialise, table
from netloom.llm.components import components

SEED = 42
QUARTERS = 4
#: Places of a tile code are 32 apart: counts of 16 bits and steps of up to 15 never run into the next place.
PLACE = 32
#: Pairs of tiles that one task compares, about.
PAIRS_OF_TASK = 8192


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint of a text as a signed 64-bit number: bits set in over half of its shingles' hashes."""
    words = folded_words_of(text)
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # long texts in blocks
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint_column(width: int = 3):
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return of


def _steps(radius: int) -> list[int]:
    """Code differences to the tiles within the radius, one direction of each; 0 is the tile itself."""
    steps = {sum(d * PLACE**i for i, d in enumerate(ds)) for ds in product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, ds)) <= radius}
    return sorted(s for s in steps if s >= 0)


def _spanning(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that keep what a matrix of near pairs connects: all if few, else a star for each connected part."""
    if near.sum() <= near.shape[0] + near.shape[1]:
        i, j = np.nonzero(near)
        return list(zip(left[i].tolist(), right[j].tolist()))
    out, todo = [], near.any(axis=1)
    while todo.any():
        rows = np.zeros(len(left), bool)
        rows[todo.argmax()] = True
        while True:
            cols = near[rows].any(axis=0)
            more = near[:, cols].any(axis=1)
            if (more == rows).all():
                break
            rows = more
        hub = int(left[rows][0])
        out += [(hub, x) for x in (*left[rows].tolist(), *right[cols].tolist()) if x != hub]
        todo &= ~rows
    return out


def _compare(radius: int):
    def pairs(batches):
        for pdf in batches:
            found: list[tuple[int, int]] = []
            for fa, fb, same in zip(pdf.fa, pdf.fb, pdf.same):
                near = np.bitwise_count(fa.view(np.uint64)[:, None] ^ fb.view(np.uint64)[None, :]) <= radius
                if same:
                    near = np.triu(near, 1)
                if near.any():
                    found += _spanning(near | near.T, fa, fb) if same else _spanning(near, fa, fb)
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    return pairs


def near_links(prints: DataFrame, radius: int = 3, tile_rows: int = 1024) -> DataFrame:
    """Links (a, b) between fingerprints of prints(fp), fp distinct, that connect all within the radius.

    Every pair within the radius is connected by the links, though a dense group comes as stars, not as all
    its pairs. A tile over tile_rows is cut into parts by hash, each of which meets the other parts. Which parts meet
    is known from their numbers alone, so the pairs of a hot code are dealt out before any fingerprint is sent.
    """
    quarter = lambda i: F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)))
    coded = prints.select("fp", sum((quarter(i) * PLACE**i for i in range(QUARTERS)), F.lit(0)).cast("int").alias("code"))
    # at most 17 ** 4 codes: four counts of 16 bits
    parts = materialise(coded.groupBy("code").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part")
    tiles = materialise(coded.join(F.broadcast(parts), "code").groupBy("code", part).agg(F.collect_list("fp").alias("fps")))
    near = (
        parts.select(F.col("code").alias("own"), "parts", F.explode(F.array(*map(F.lit, _steps(radius)))).alias("step"))
        .join(F.broadcast(parts.select(F.col("code").alias("met"), F.col("parts").alias("others"))), F.col("own") + F.col("step") == F.col("met"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        .where("step > 0 or part <= other")
    )
    near = near.repartition(max(1, min(near.count() // PAIRS_OF_TASK, 20_000)), "own", "part", "met", "other")
    left = tiles.select(F.col("code").alias("own"), "part", F.col("fps").alias("fa"))
    right = tiles.select(F.col("code").alias("met"), F.col("part").alias("other"), F.col("fps").alias("fb"))
    met = near.join(left, ["own", "part"]).join(right, ["met", "other"])
    return met.select("fa", "fb", F.expr("step = 0 and part = other").alias("same")).mapInPandas(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """One row (id_col, fp, component_id) for each row of docs.

    Null, empty and blank texts have fingerprint 0 and are linked like any other; equal texts share one
    fingerprint, so a group of copies is one node however large. Fingerprints are what is linked, so ids may be of
    any type that has an order. component_id is the smallest id that can be reached over links of at most radius
    differing bits. Rows with a null id get a fingerprint, link nothing and have a null component_id unless their very
    fingerprint has a component. Repeated rows each get a row. An empty table gives no rows.
    """
    prints = materialise(docs.select(F.col(id_col).alias("id"), fingerprint_column(width)(F.col(text_col)).alias("fp")))
    nodes = materialise(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("id")))
    roots = components(near_links(nodes, radius))
    grouped = materialise(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "id", F.coalesce("root", "fp").alias("group")))
    least = grouped.groupBy("group").agg(F.min("id").alias("component_id"))
    of = grouped.join(least, "group").select("fp", "component_id")
    return prints.join(of, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with all their columns.

    Of repeated rows with one id one stays: the first by text. Rows with a null id stay, as nothing names them.
    """
    root = free_name(docs, "component_id")
    heads = near_duplicates(docs, id_col, text_col, radius, width).where(f"`{id_col}` = component_id").select(F.col(id_col).alias(root)).distinct()
    kept = docs.join(heads, F.col(id_col) == F.col(root), "left_semi")
    return kept.dropDuplicates([id_col]).unionByName(docs.where(F.col(id_col).isNull()))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of documents: see near_duplicates for nulls, repeats and ties.
    Extra columns are not read."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
