"""Ties of the nearest neighbours go to the smaller id, whatever the shards and however many nodes tie."""

import numpy as np
from pyspark.sql import functions as F

from netloom.llm import hnsw


def near(spark, rows, k=5):
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(5)
    found: dict = {}
    for r in sorted(hnsw.nearest(df, F.col("vec_id") % 50 == 0, k).collect()):
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return found


def plain(rows, k=5):
    once = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q, a in once.items():
        if q % 50 == 0:
            cosine = {i: a @ b / np.linalg.norm(a) / np.linalg.norm(b) for i, b in once.items() if i != q}
            out[q] = sorted(cosine, key=lambda i: (-round(cosine[i], 12), i))[:k]
    return out


def test_one_direction_at_many_lengths(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=8)
    rows = [(0, v + 0.1)] + [(i, v * 2.0 ** (i % 60 - 30)) for i in range(1, 101)] + [(i, rng.normal(size=8)) for i in range(1001, 1060)]
    rng.shuffle(rows := list(rows))
    found = near(spark, rows)
    assert [i for _, i, _ in found[0]] == [1, 2, 3, 4, 5] and len({s for _, _, s in found[0]}) == 1
    assert [i for _, i, _ in found[50]] == [1, 2, 3, 4, 5] and [i for _, i, _ in found[100]] == [1, 2, 3, 4, 5]


def test_directions_that_tie(spark):
    """Unit vectors along the axes and their sums: many different directions at one distance; shards of a few nodes."""
    rows = [(i, np.eye(40)[i - 1]) for i in range(1, 41)] + [(50, np.ones(40)), (100, np.eye(40)[0] + np.eye(40)[1])]
    was = hnsw.SHARD_ROWS
    try:
        for size in (was, 7):
            hnsw.SHARD_ROWS = size
            assert {q: [i for _, i, _ in r] for q, r in near(spark, rows).items()} == plain(rows)
    finally:
        hnsw.SHARD_ROWS = was


def test_recall_of_full_shards(spark):
    """Two shards of 4,096 against brute force."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 32))
    vectors = centres[rng.integers(60, size=8000)] + 0.5 * rng.normal(size=(8000, 32))
    found = near(spark, list(enumerate(vectors)))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 8000, 50):
        cosine = unit @ unit[q]
        cosine[q] = -2
        hits += len(set(np.argsort(-cosine)[:5].tolist()) & {i for _, i, _ in found[q]})
    assert hits / (5 * 160) >= 0.9
