"""Near-duplicates by word shingles: MinHash bands find candidates, the shingles themselves decide.

Documents with the same set of shingles are one node. Nodes that share the minima of a band are candidates; the
components of candidates are small, and within each every pair's Jaccard similarity is computed exactly. With 24
bands of 6 minima a pair of similarity 0.8 is missed with probability (1 - 0.8^6)^24 = 0.0007.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import bounded, folded_words_of, free_name, materialise
from netloom.llm.components import components

SEED = 42
BANDS, ROWS = 24, 6
#: A component of candidates is cut into parts of about so many shingles and documents; each part meets the others.
PART_SHINGLES, PART_ROWS = 200_000, 512
_draw = np.random.default_rng(SEED)
_XOR = _draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_TIMES = _draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of width words; a shorter text is one shingle, a blank one none."""
    words = folded_words_of(text)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    of = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    h = np.zeros(len(of) - width + 1, np.uint64)
    for i in range(width):
        h = (h ^ of[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band: the hash of its number and its minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    low = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    for i in range(0, len(low), 4096):  # long texts in blocks
        h = (low[i : i + 4096, None] ^ _XOR) * _TIMES
        least = np.minimum(least, (h ^ (h >> np.uint32(15))).min(axis=0))
    return [xxhash.xxh64_intdigest(x.tobytes(), b) - (1 << 63) for b, x in enumerate(least.reshape(BANDS, ROWS))]


def _marks(width: int):
    @F.pandas_udf("set long, n int, keys array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            h = shingles(t, width)
            rows.append((xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63), len(h), bands(h) if len(h) else []))
        return pd.DataFrame(rows, columns=["set", "n", "keys"])

    return of


def _verified(threshold: float, width: int):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links that connect what the pairs of at least this similarity connect; each text is held against all others."""
        ids, sets = pdf["set"].to_numpy(), [shingles(t, width) for t in pdf["text"]]
        sizes = np.array([len(s) for s in sets])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        root, found = np.arange(len(ids)), []
        for i in range(len(ids)):
            mark = np.zeros(codes.max() + 1, np.int32)
            mark[codes[starts[i] : starts[i] + sizes[i]]] = 1
            both = np.add.reduceat(mark[codes], starts)
            near = np.flatnonzero(both >= threshold * (sizes + sizes[i] - both) - 1e-9)
            for j in near:
                if root[j] != root[i]:
                    found.append((ids[i], ids[j]))
                    root[root == root[j]] = root[i]
            if (root == root[0]).all():
                break
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5, linked: DataFrame | None = None) -> DataFrame:
    """One row (id_col, component_id) for each row of docs whose id is not null.

    component_id is the smallest id that can be reached over pairs of at least this Jaccard similarity of their
    shingles. Blank and null texts are copies of one another. linked(a, b) names further pairs of ids that are to be
    compared, besides those that the bands bring together.
    """
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), _marks(width)(text_col).alias("m"))
    own = materialise(own.select("id", "text_key", "m.*"))
    # texts of one set of shingles have the same keys: any of them will do
    sets = materialise(own.where("n > 0").groupBy("set").agg(F.min("n").alias("n"), F.min("text_key").alias("text_key"), F.first("keys").alias("keys")))
    keys = sets.select("set", F.explode("keys").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("set").alias("hub"), F.max("set").alias("last")).where("hub < last").select("key", "hub")
    candidates = keys.join(hubs, "key").where("`set` <> hub").select(F.col("set").alias("a"), F.col("hub").alias("b"))
    if linked is not None:
        of = lambda end: own.where("n > 0").select(F.col("id").alias(f"_{end}"), F.col("set").alias(f"_set_{end}")).distinct()
        met = linked.join(of("a"), F.col("a") == F.col("_a")).join(of("b"), F.col("b") == F.col("_b"))
        candidates = candidates.unionByName(met.select(F.col("_set_a").alias("a"), F.col("_set_b").alias("b")).where("a <> b").distinct())
    near = components(candidates)
    near = materialise(sets.select("set", "n", "text_key").join(near, F.col("set") == F.col("node")).select("set", "n", "text_key", "root"))
    parts = near.groupBy("root").agg(F.ceil(F.greatest(F.sum("n") / PART_SHINGLES, F.count("*") / PART_ROWS)).cast("int").alias("parts"))
    near = near.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int"))
    texts = docs.select(F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).join(bounded(materialise(near)), "text_key")
    texts = texts.dropDuplicates(["set"]).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).where("parts = 1 or part <> other")
    met = texts.select("set", "text", "root", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    roots = components(met.groupBy("root", "p", "q").applyInPandas(_verified(threshold, width), "a long, b long"))
    named = own.join(roots, own.set == roots.node, "left").select("id", F.coalesce("root", "set").alias("group"))
    named = materialise(named)
    least = named.groupBy("group").agg(F.min("id").alias("component_id"))
    return named.join(least, "group").select(F.col("id").alias(id_col), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5, linked: DataFrame | None = None) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with all their columns.

    Of repeated rows with one id one stays. Rows with a null id stay, as nothing names them.
    """
    root = free_name(docs, "component_id")
    heads = near_duplicates(docs, id_col, text_col, threshold, width, linked).where(f"`{id_col}` = component_id").select(F.col(id_col).alias(root)).distinct()
    kept = docs.join(heads, F.col(id_col) == F.col(root), "left_semi")
    return kept.dropDuplicates([id_col]).unionByName(docs.where(F.col(id_col).isNull()))
