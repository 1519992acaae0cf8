"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Distinct directions are dealt to shards of bounded size. A shard's graph is flat arrays of neighbours, one for each
level; all queries descend it in step, level by level, with a beam on the lowest. Every shard answers every
query, and the shards' results are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import bounded, materialise, table

#: Vectors of a shard, queries of a block: what a task holds at once.
SHARD_ROWS, QUERY_ROWS = 4096, 512
#: Blocks of queries that come to a shard in one turn; a shard is sent once for each turn.
TURN_BLOCKS = 16
#: Neighbours of a node above the lowest level, and on it; candidates when a node is linked; width of a search.
M, M0, CANDIDATES, BEAM = 16, 32, 64, 96
#: Nodes that enter a graph in one step.
BATCH = 512


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors whose largest component is near 1, by powers of two: their cosines are those of the originals to the
    last bit, and no square under- or overflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True, initial=0))[1])


def unit_of(vectors: np.ndarray) -> np.ndarray:
    x = scaled(vectors)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


class Graph:
    """levels[l] has the neighbours of every node on level l, from the lowest, -1 for none. Nodes of upper levels come
    first in `order`, so the first is on all of them: searches enter there."""

    def __init__(self, unit: np.ndarray, levels: list[np.ndarray], order: np.ndarray):
        self.unit, self.levels, self.order = unit, levels, order

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 0) -> Graph:
        """Nodes enter in batches, which grow with the graph up to BATCH. Each is linked, on its levels, to those that
        the neighbour heuristic picks among the nearest that a search of the graph finds and those of its batch; links
        go both ways and are pruned alike."""
        unit = unit_of(vectors)
        height = np.floor(-np.log(np.random.default_rng(seed).uniform(1e-12, 1, len(unit))) / math.log(M)).astype(int)
        levels = [np.full((len(unit), M if level else M0), -1, np.int32) for level in range(height.max(initial=0) + 1)]
        graph, at = cls(unit, levels, np.argsort(-height, kind="stable")), 0
        while at < len(unit):
            batch = graph.order[at : at + min(max(at, 32), BATCH)]
            graph._insert(batch, at, height)
            at += len(batch)
        return graph

    def _insert(self, batch: np.ndarray, there: int, height: np.ndarray) -> None:
        q, entry = self.unit[batch], np.full(len(batch), self.order[0])
        tops = height[self.order[:there]]
        for level in range(len(self.levels) - 1, -1, -1):
            here = np.flatnonzero(height[batch] >= level)
            known = bool(there) and tops[0] >= level
            found = np.full((len(here), 0), -1)
            if known and level:
                entry = self._greedy(q, self.levels[level], entry)
            if known and len(here):
                found = self._beam(q[here], self.levels[level], entry[here], CANDIDATES)
            if not len(here):
                continue
            own = batch[here]
            near = q[here] @ q[here].T
            np.fill_diagonal(near, -np.inf)
            k = min(CANDIDATES // 2, len(own) - 1)
            mates = own[np.argpartition(-near, k - 1, axis=1)[:, :k]] if k else np.full((len(own), 0), -1)
            self._link(level, own, np.hstack([found, mates]))

    def _link(self, level: int, nodes: np.ndarray, candidates: np.ndarray) -> None:
        table, incoming = self.levels[level], {}
        most = table.shape[1]
        if not candidates.shape[1]:
            return
        for i, picked in zip(nodes.tolist(), self._pick(self.unit, nodes, candidates, most // 2)):
            incoming.setdefault(i, []).extend(picked.tolist())
            for j in picked.tolist():
                incoming.setdefault(j, []).append(i)
        full = []
        for j, new in incoming.items():
            new = list(dict.fromkeys([*table[j][table[j] >= 0].tolist(), *new]))
            if len(new) <= most:
                table[j, : len(new)] = new
            else:
                full.append((j, new))
        if full:
            width = max(len(x) for _, x in full)
            wide = np.array([x + [-1] * (width - len(x)) for _, x in full])
            for (j, _), picked in zip(full, self._pick(self.unit, np.array([j for j, _ in full]), wide, most)):
                table[j] = -1
                table[j, : len(picked)] = picked

    @staticmethod
    def _pick(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, most: int) -> list[np.ndarray]:
        """For each node, candidates from the nearest on that are nearer to it than to any picked before; then
        the nearest of those passed over, until there are most."""
        c = x[candidates]
        near = np.einsum("bd,bcd->bc", x[nodes], c)
        near[candidates < 0] = -np.inf
        order = np.argsort(-near, axis=1, kind="stable")
        near, candidates = np.take_along_axis(near, order, 1), np.take_along_axis(candidates, order, 1)
        c = np.take_along_axis(c, order[:, :, None], 1)
        picked = np.zeros(candidates.shape, bool)
        closest = np.full(candidates.shape, -np.inf, np.float32)  # of each candidate to those picked
        for k in range(candidates.shape[1]):
            take = (near[:, k] > -np.inf) & (near[:, k] > closest[:, k]) & (picked.sum(axis=1) < most)
            picked[:, k] = take
            if take.any():
                closest[take] = np.maximum(closest[take], np.einsum("bd,bcd->bc", c[take, k], c[take]))
        rank = np.argsort(~picked, axis=1, kind="stable")[:, :most]
        return [row[row >= 0] for row in np.take_along_axis(np.where(near > -np.inf, candidates, -1), rank, 1)]

    def _greedy(self, q: np.ndarray, neighbours: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """The node from which no neighbour is nearer, for each query."""
        rows = np.arange(len(q))
        best = np.einsum("qd,qd->q", q, self.unit[entry])
        while True:
            around = neighbours[entry]
            near = np.where(around >= 0, np.einsum("qd,qmd->qm", q, self.unit[around]), -np.inf)
            at = near.argmax(axis=1)
            better = near[rows, at] > best
            if not better.any():
                return entry
            entry, best = np.where(better, around[rows, at], entry), np.where(better, near[rows, at], best)

    def _beam(self, q: np.ndarray, neighbours: np.ndarray, entry: np.ndarray, width: int) -> np.ndarray:
        """Places of the nearest found for each query, nearest first, -1 for none."""
        unit, n, rows = self.unit, len(q), np.arange(len(q))
        ids, near, done = np.full((n, width), -1), np.full((n, width), -np.inf, np.float32), np.zeros((n, width), bool)
        ids[:, 0], near[:, 0] = entry, np.einsum("qd,qd->q", q, unit[entry])
        seen = np.zeros((n, len(unit)), bool)
        seen[rows, entry] = True
        while True:
            open_ = np.where(done | (ids < 0), -np.inf, near)
            at = open_.argmax(axis=1)
            live = np.flatnonzero(open_[rows, at] > -np.inf)
            if not len(live):
                return ids
            done[live, at[live]] = True
            around = neighbours[ids[live, at[live]]]
            new = (around >= 0) & ~seen[live[:, None], around]
            r, c = np.nonzero(new)
            seen[live[r], around[r, c]] = True
            found = np.where(new, np.einsum("qd,qmd->qm", q[live], unit[around]), -np.inf)
            all_near = np.hstack([near[live], found])
            order = np.argsort(-all_near, axis=1, kind="stable")[:, :width]
            near[live] = np.take_along_axis(all_near, order, 1)
            ids[live] = np.where(near[live] > -np.inf, np.take_along_axis(np.hstack([ids[live], around]), order, 1), -1)
            done[live] = np.take_along_axis(np.hstack([done[live], ~new]), order, 1)

    def search(self, queries: np.ndarray, k: int, beam: int = BEAM) -> np.ndarray:
        """Places of the k nearest found for each query, nearest first, -1 for none."""
        q, entry = unit_of(queries), np.full(len(queries), self.order[0])
        for neighbours in self.levels[:0:-1]:
            entry = self._greedy(q, neighbours, entry)
        return self._beam(q, self.levels[0], entry, max(beam, k))[:, :k]


INDEX = "dim int, shard int, keys binary, vectors binary, nodes int, levels array<binary>, entry int"
NEAR = "query_id long, key long, score double"


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("key")
    vectors = np.stack([np.frombuffer(v, np.float64) for v in pdf["vector"]])
    graph = Graph.build(vectors)
    return pd.DataFrame({"dim": [vectors.shape[1]], "shard": [pdf["shard"].iloc[0]], "keys": [pdf["key"].to_numpy(np.int64).tobytes()], "vectors": [vectors.tobytes()], "nodes": [len(vectors)], "levels": [[x.tobytes() for x in graph.levels]], "entry": [graph.order[0]]})


def _search(k: int):
    def search(index: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in index.itertuples():
            vectors = np.frombuffer(row.vectors, np.float64).reshape(-1, row.dim)
            levels = [np.frombuffer(x, np.int32).reshape(row.nodes, -1) for x in row.levels]
            graph, keys, own = Graph(unit_of(vectors), levels, np.array([row.entry])), np.frombuffer(row.keys, np.int64), scaled(vectors)
            norm = np.linalg.norm(own, axis=1)
            for block in blocks.itertuples():
                ids, queries = np.frombuffer(block.query_ids, np.int64), np.frombuffer(block.query_vectors, np.float64).reshape(-1, row.dim)
                found = np.sort(graph.search(queries, BEAM), axis=1)  # nodes are in the order of their keys
                q, c = np.nonzero(found >= 0)
                at, asked = found[q, c], scaled(queries)
                score = np.full(found.shape, -np.inf)
                score[q, c] = np.einsum("ij,ij->i", asked[q], own[at]) / (np.linalg.norm(asked, axis=1)[q] * norm[at])
                best = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
                found, score = np.take_along_axis(found, best, 1), np.take_along_axis(score, best, 1)
                q, c = np.nonzero(found >= 0)
                out.append(pd.DataFrame({"query_id": ids[q], "key": keys[found[q, c]], "score": score[q, c]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "key": [], "score": []})

    return search


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id")
    return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "block": [pdf["block"].iloc[0]], "query_ids": [pdf["id"].to_numpy(np.int64).tobytes()], "query_vectors": [b"".join(pdf["vector"])]})


def _usable(vectors: pd.Series) -> pd.Series:
    def of(v):
        if v is None:
            return None
        x = np.array([np.nan if c is None else c for c in v], np.float64)
        return scaled(x[None]).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None

    return pd.Series([of(v) for v in vectors], dtype=object)


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score) of the k nearest rows that are found for each row where is_query holds.

    Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components, take no
    part. Vectors meet only those of their own number of components. Vectors that are equal but for a power of two, so
    that all their cosines are the same to the last bit, are one node of a graph, and their ids are listed from it,
    smallest first: a hot direction with any number of copies costs one node. A node is known by its smallest id, so
    ties go to the smaller id at every cut; the first k + 1 nodes of a shard are enough for the first k rows. A row is never its own
    neighbour; other rows with a query's id (repeated rows) aren't either. Fewer than k candidates give fewer rows; an
    empty table gives none. Ids are whole numbers, or text that says one; others are an error.
    """
    pack = F.pandas_udf(_usable, "binary")
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), is_query.alias("is_query"), pack(vector_col).alias("vector"))
    rows = rows.where("vector is not null").withColumn("dim", (F.octet_length("vector") / 8).cast("int"))
    rows = materialise(rows)
    alike = Window.partitionBy("vector").orderBy("id")
    first = rows.withColumns({"copy": F.row_number().over(alike), "key": F.first("id").over(alike)}).where(F.col("copy") <= k + 1)
    first = materialise(first.select("key", "id", "copy", "dim", "vector"))
    nodes = first.where("copy = 1")
    # as many shards as a dimension's distinct vectors need; queries go to the shards, which are not sent about
    shards = materialise(nodes.groupBy("dim").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("shards")))
    shards = bounded(shards)
    dealt = nodes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("key", F.lit(7)), F.col("shards")).cast("int"))
    index = materialise(dealt.groupBy("dim", "shard").applyInPandas(_build, INDEX))
    queries = rows.where("is_query").dropDuplicates(["id"])
    n_blocks = max(1, math.ceil(queries.count() / QUERY_ROWS))
    blocks = materialise(queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks))).groupBy("dim", "block").applyInPandas(_block, "dim int, block long, query_ids binary, query_vectors binary"))
    asked = blocks.join(shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("turn", F.floor(F.col("block") / TURN_BLOCKS))
    told = index.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit((n_blocks - 1) // TURN_BLOCKS)).cast("array<long>")))
    near = told.groupBy("dim", "shard", "turn").cogroup(asked.groupBy("dim", "shard", "turn")).applyInPandas(_search(k), NEAR)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= k + 1)
    ids = best.select("query_id", "key", "score").join(first.select("key", "id"), "key").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return ids.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op6_hnsw(spark, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score for every fiftieth vec_id: see nearest for nulls, repeats, ties and empty tables.
    Extra columns are not read."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
