"""Packing documents into token sequences by a grouping genetic algorithm.

A chromosome is a packing, its genes whole bins. Crossover injects well-filled bins of one parent into another,
drops the bins that hold an item twice, and puts displaced items back by best fit. Items go in blocks; each block
is evolved on several islands, whose best packings migrate to the next island between epochs. Bins that stay
under-filled give their items to a further, much smaller round over all blocks.
"""

from __future__ import annotations

import base64
import json
import math
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import materialise, table

SIZE, END_ID = 1024, 2
#: Items of a block; islands and epochs; packings of an island and generations of an epoch.
BLOCK_ITEMS, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 2048, 3, 2, 6, 10
#: Islands that one task evolves.
TASK_ISLANDS = 16
#: Bins filled less than this go to the next round, which is the last when one block holds all that is left.
WELL_FILLED, ROUNDS = 0.98, 4


@lru_cache(maxsize=2)
def encoder(path: str | None = None):
    """The byte-level BPE of byte_bpe_50k.json in its form for tiktoken, which has the same ids and is faster. The
    tokens that the JSON adds to the vocabulary are found in a text and keep their ids, as `tokenizers` has it."""
    import public_tokenizers
    import tiktoken
    from tiktoken_ext.openai_public import r50k_pat_str

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("added tokens that take white space or whole words along are not provided for")
    return tiktoken.Encoding("byte_bpe_50k", pat_str=r50k_pat_str, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})


def pieces_of(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one if they fit, else the remainder first, then full ones."""
    first = n % size if n > size and n % size else min(n, size)
    return [(0, first)] + [(i, size) for i in range(first, n, size)]


def best_fit(room: list[int], lengths: list[int], size: int = SIZE) -> list[int]:
    """The bin of each length in turn: the fullest that has room, else a new one. room, what each bin has left, is
    changed and grows."""
    bins_with: dict[int, list[int]] = {}
    mask = 0  # bit r: some bin has exactly r left
    for i, r in enumerate(room):
        if r in bins_with:
            bins_with[r].append(i)
        else:
            bins_with[r] = [i]
            mask |= 1 << r
    out = []
    for s in lengths:
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            i = bins_with[r].pop()
            if not bins_with[r]:
                mask ^= 1 << r
            room[i] = r - s
        else:
            r, i = size, len(room)
            room.append(size - s)
        out.append(i)
        if not (r := r - s) or not bins_with.get(r):
            bins_with[r] = []
            mask |= 1 << r
        bins_with[r].append(i)
    return out


@dataclass
class Packing:
    """A chromosome: the bin of each item and the filling of each bin, which is one gene."""

    at: np.ndarray
    fill: np.ndarray

    @property
    def score(self) -> tuple[int, int]:
        """Fewer bins first, then fuller ones (the sum of squared fillings)."""
        return -len(self.fill), int(self.fill @ self.fill)


def packing_of(at: np.ndarray, lens: np.ndarray) -> Packing:
    return Packing(at, np.bincount(at, lens).astype(np.int64))


def put(order: np.ndarray, lens: np.ndarray, size: int = SIZE) -> Packing:
    """All items by best fit in the order given."""
    at = np.empty(len(lens), np.int64)
    at[order] = best_fit([], lens[order].tolist(), size)
    return packing_of(at, lens)


def crossover(a: Packing, b: Packing, lens: np.ndarray, rng: np.random.Generator, size: int = SIZE) -> Packing:
    """Well-filled bins of b go whole into a; bins of a that hold an item twice are dropped, some unfilled ones are
    tried anew, and what they held is put back by best fit, the longest first."""
    inject = (rng.random(len(b.fill)) < 0.5) & (b.fill >= np.median(b.fill))
    used = inject[b.at]
    dropped = (np.bincount(a.at, used, len(a.fill)) > 0) | ((rng.random(len(a.fill)) < 0.3) & (a.fill < size))
    n = int(inject.sum())
    at = np.where(used, (np.cumsum(inject) - 1)[b.at], (n + np.cumsum(~dropped) - 1)[a.at])
    displaced = np.flatnonzero(~used & dropped[a.at])
    displaced = displaced[np.argsort(-lens[displaced], kind="stable")]
    room = (size - np.concatenate([b.fill[inject], a.fill[~dropped]])).tolist()
    at[displaced] = best_fit(room, lens[displaced].tolist(), size)
    return Packing(at, size - np.array(room, np.int64))


def evolve(lens: np.ndarray, seed: int, migrants: list[np.ndarray] = (), generations: int = GENERATIONS, size: int = SIZE) -> Packing:
    """The best packing of one island after an epoch; ends early where no packing can have fewer bins."""
    rng, least = np.random.default_rng(seed), math.ceil(lens.sum() / size)
    best_first = lambda found: sorted(found, key=lambda x: x.score, reverse=True)[:POPULATION]
    population = best_first(packing_of(m, lens) for m in migrants)
    for k in range(POPULATION):
        if population and len(population[0].fill) <= least:
            break
        noise = rng.normal(1, 0.02 * k, len(lens)) if k else 1
        population = best_first([*population, put(np.argsort(-lens * noise, kind="stable"), lens, size)])
    for _ in range(generations):
        if not len(lens) or len(population[0].fill) <= least or len(population) < 2:
            break
        pairs = np.sort(rng.integers(0, len(population), (POPULATION, 2)), axis=1).tolist()  # the better of the two gives the bins
        population = best_first(population + [crossover(population[j], population[i], lens, rng, size) for i, j in pairs])
    return population[0]


def settle(lens: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(bin, which items) of the bins that best fit fills to the last token. They waste nothing, so the search goes
    on without them: it needs as few bins as it would with them if the rest reaches its own bound."""
    first = put(np.argsort(-lens, kind="stable"), lens, size)
    full = first.fill == size
    return (np.cumsum(full) - 1)[first.at], full[first.at]


def _begun(size: int):
    """Blocks with their settled items in front, and the bins of these."""

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                items, lens = np.array(row.items, np.int64), np.array(row.lens, np.int64)
                at, settled = settle(lens, size)
                order = np.argsort(~settled, kind="stable")
                n = int(settled.sum())
                out.append((row.block, items[order], lens[order], at[order][:n].astype("<i4").tobytes(), lens[order][n:]))
            yield pd.DataFrame(out, columns=["block", "items", "lens", "settled", "open"])

    return run


STATE = "block int, island int, open array<int>, at binary, n_bins int, fit double"


def _island(size: int):
    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                lens = np.array(row.open, np.int64)
                migrants = [np.frombuffer(m, "<i4").astype(np.int64) for m in (row.own, row.migrant) if m is not None]
                best = evolve(lens, 1000 * row.epoch + row.island, migrants, size=size)
                out.append((row.block, row.island, row.open, best.at.astype("<i4").tobytes(), len(best.fill), float(best.score[1])))
            yield pd.DataFrame(out, columns=["block", "island", "open", "at", "n_bins", "fit"])

    return run


def _placed(batches):
    for pdf in batches:
        for row in pdf.itertuples():
            lens, settled = np.array(row.lens, np.int64), np.frombuffer(row.settled, "<i4")
            at = np.concatenate([settled, np.frombuffer(row.at, "<i4") + (settled.max(initial=-1) + 1)])
            order = np.argsort(at, kind="stable")
            ends = np.cumsum(lens[order])
            fill = np.bincount(at, lens).astype(np.int64)
            begin = np.concatenate([[0], np.cumsum(fill)[:-1]])
            offset = np.empty(len(at), np.int64)
            offset[order] = ends - lens[order] - begin[at[order]]
            yield pd.DataFrame({"item": row.items, "len": lens, "block": row.block, "bin": at, "offset": offset, "fill": fill[at]})


def pack(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(item, sequence_id, offset) for items(item long, len int), 0 < len <= size; item is a key.

    Items meet in blocks by a hash of the key, so equal lengths or hot sources make no large block. A sequence
    is named by its round, block and bin.
    """
    out, rest = None, items.select("item", F.col("len").cast("int").alias("len"))
    for number in range(ROUNDS):
        n = rest.count()
        if not n:
            break
        blocks = math.ceil(n / BLOCK_ITEMS)
        dealt = rest.groupBy(F.pmod(F.xxhash64("item", F.lit(number)), F.lit(blocks)).cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("item", "len"))).alias("x"))
        dealt = dealt.select("block", F.col("x.item").alias("items"), F.col("x.len").alias("lens"))
        dealt = materialise(dealt.mapInPandas(_begun(size), "block int, items array<long>, lens array<int>, settled binary, open array<int>"))
        tasks, none = max(1, min(math.ceil(blocks * ISLANDS / TASK_ISLANDS), 20_000)), F.lit(None).cast("binary")
        state = dealt.select("block", "open", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), none.alias("own"), none.alias("migrant"), F.lit(0).alias("epoch"))
        state = materialise(state.repartition(tasks, "block", "island").mapInPandas(_island(size), STATE))
        for epoch in range(1, EPOCHS):
            best = state.select(F.col("block").alias("of"), F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("to"), F.col("at").alias("migrant"))
            met = state.join(best, (F.col("block") == F.col("of")) & (F.col("island") == F.col("to")))
            met = met.select("block", "open", "island", F.col("at").alias("own"), "migrant", F.lit(epoch).alias("epoch"))
            state = materialise(met.repartition(tasks, "block", "island").mapInPandas(_island(size), STATE))
        best = state.groupBy("block").agg(F.min_by("at", F.struct("n_bins", -F.col("fit"), "island")).alias("at"))
        placed = materialise(dealt.join(best, "block").mapInPandas(_placed, "item long, len int, block int, bin int, offset long, fill long"))
        last = blocks == 1 or number == ROUNDS - 1
        done = placed if last else placed.where(F.col("fill") >= WELL_FILLED * size)
        name = F.lit(number << 56) + F.col("block").cast("long") * (1 << 24) + F.col("bin")
        done = done.select("item", name.alias("sequence_id"), "offset")
        out = done if out is None else out.unionByName(done)
        if last:
            break
        rest = placed.where(F.col("fill") < WELL_FILLED * size).select("item", "len")
    return out if out is not None else items.select("item", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).where("false")


def _tokenised(path: str | None, size: int):
    @F.pandas_udf("n long, crcs array<long>")
    def tokenised(texts: pd.Series) -> pd.DataFrame:
        encode, end = encoder(path).encode_to_numpy, np.array([END_ID], "<u4")
        rows = []
        for text in texts:
            ids = np.concatenate([encode(text, allowed_special="all").astype("<u4"), end]) if text else end
            rows.append((len(ids), [zlib.crc32(ids[a : a + n].tobytes()) for a, n in pieces_of(len(ids), size)]))
        return pd.DataFrame(rows, columns=["n", "crcs"])

    return tokenised


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, tokenizer: str | None = None) -> DataFrame:
    """One row (id_col, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of docs.

    A text is its ids and the end id; null and empty texts are the end id alone. Rows are told apart whatever
    their id, so null and repeated ids do no harm. Full pieces are sequences of their own, with negative numbers.
    An empty table gives no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("id"), _tokenised(tokenizer, size)(F.col(text_col)).alias("t"))
    rows = materialise(rows.select("item", "id", "t.n", "t.crcs"))
    head = F.when((F.col("n") > size) & (F.col("n") % size > 0), F.col("n") % size).otherwise(F.least("n", F.lit(size)))
    cut = rows.select("item", "id", "n", head.alias("head"), F.posexplode("crcs").alias("piece", "ids_crc32"))
    start = F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.col("head") + (F.col("piece") - 1) * size).cast("long")
    cut = cut.select("item", "id", "piece", start.alias("start"), F.when(F.col("piece") == 0, F.col("head")).otherwise(F.lit(size)).cast("long").alias("length"), "ids_crc32")
    full = cut.where(F.col("length") == size).withColumns({"sequence_id": -F.monotonically_increasing_id() - 1, "offset": F.lit(0).cast("long")})
    short = cut.where(F.col("length") < size)
    places = pack(short.select("item", F.col("length").alias("len")), size)
    both = short.join(places, "item").unionByName(full)
    return both.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """A row for each piece of each row of documents: see packed for nulls, repeats and empty tables. Equal lengths are
    told apart by their place in the block; extra columns are not read."""
    return packed(table(spark, sf_dir, "documents"))
