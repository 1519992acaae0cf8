"""Periodic runs of words: stretches in which a text repeats itself at a fixed distance.

A run is a longest stretch whose words equal those a period earlier, the period being the smallest of the stretch, and
the stretch at least two periods and min_length words long. Periods below SHORT are found by comparing each word with
the one q places on, for each q. Longer ones come by scales, each for the periods from P to below 2 P:

* Word grams of 3 P / 4 words are hashed, and of each P / 4 neighbouring grams the least is the window's minimizer. A
  run holds some window and its copy one period on, so both minimizers are there, at that distance: pairs of equal
  minimizers at P to 2 P words are the seeds.
* Grams inside a run of a period under P / 4 are no candidates, as equal ones would stand side by side there. All other
  equal grams are P / 4 words or more apart, so a minimizer has at most eight partners, whatever the text.
* Seeds of one distance are walked from left to right, each as far as the next seed, so a stretch is walked over once.
  Words are compared, never hashes.

All texts of a slice of a batch are one array with a word of its own between any two; no text is shuffled.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.common import free_name, table

#: Lags from here on are found by minimizers; a power of two, 16 at least.
SHORT = 16
#: Runs of fewer words are not looked at (and min_length isn't below it for the periods from SHORT on).
MIN_LENGTH = 12
#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values."""
    at = np.flatnonzero(equal)
    if not len(at):
        return at, at
    breaks = np.flatnonzero(np.diff(at) > 1)
    return at[np.r_[0, breaks + 1]], at[np.r_[breaks, len(at) - 1]] + 1


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each window of width, a power of two."""
    step = 1
    while step < width:
        x = pick(x[:-step], x[step:])
        step *= 2
    return x


def _grams(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k neighbouring words; equal words have equal hashes."""
    n = len(x)
    power, inverse = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    power[0] = inverse[0] = 1
    np.cumprod(power, out=power)
    np.cumprod(inverse, out=inverse)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mixed(x.view(np.uint64)) * power, out=sums[1:])
    return _mixed((sums[k:] - sums[:-k]) * inverse[: n - k + 1])


def _minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """Places of the grams that are the least of some window; grams of the top value are none."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    none = np.zeros(width - 1, np.uint64)
    least = np.concatenate([none, _sliding(grams, width, np.minimum), none])
    return np.flatnonzero((_sliding(least, width, np.maximum) == grams) & (grams != _TOP))


def _walk(x: np.ndarray, at: np.ndarray, lag: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """From each place on (step 1) or back (-1): the first place that differs from the one a lag on, or the limit."""
    at, open_ = at.copy(), np.arange(len(at))
    last = len(x) - 1
    while len(open_):
        many = int(np.clip((1 << 18) // len(open_), 16, 1 << 14))
        places = at[open_, None] + step * np.arange(many)
        ahead = places + lag[open_, None]
        same = (x[np.clip(places, 0, last)] == x[np.clip(ahead, 0, last)]) & (ahead <= last) & (places >= 0)
        same &= places < limit[open_, None] if step > 0 else places > limit[open_, None]
        whole = same.all(axis=1)
        at[open_] += step * np.where(whole, many, same.argmin(axis=1))
        open_ = open_[whole]
    return at


def _seeded(x: np.ndarray, owner: np.ndarray, grams: np.ndarray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distance, place) of pairs of equal minimizers of one text that are scale to 2 * scale apart."""
    at = _minimizers(grams, scale // 4)
    order = np.argsort(grams[at], kind="stable")
    at = at[order]
    keys = grams[at]
    for t in itertools.count(1):
        far = at[t:] - at[:-t]
        near = (keys[t:] == keys[:-t]) & (far < 2 * scale)
        if not near.any():
            return
        near &= (far >= scale) & (owner[at[t:]] == owner[at[:-t]])
        if near.any():
            yield far[near], at[:-t][near]


def _extended(x: np.ndarray, lag: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, lag) of the longest stretches of words that equal those a lag on, around the seeds."""
    order = np.lexsort((at, lag))
    lag, at = lag[order], at[order]
    followed = np.r_[lag[1:] == lag[:-1], False]
    limit = np.where(followed, np.r_[at[1:], 0], len(x))
    end = _walk(x, at, lag, limit, 1)
    tail = ~(followed & (end == limit))
    head = np.r_[True, tail[:-1]]
    start = _walk(x, at[head] - 1, lag[head], np.full(head.sum(), -1), -1) + 1
    return start, end[tail], lag[head]


def runs_of(x: np.ndarray, owner: np.ndarray, sizes: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, length, period), by start and then period, of the runs in an array of word numbers.

    owner names the text of each place and sizes the places of each text, one for the end mark that no other place
    repeats included.
    """
    floor = min(min_length, MIN_LENGTH)
    found = []
    for q in range(1, min(SHORT, len(x))):
        start, end = _stretches(x[:-q] == x[q:])
        held = (end - start >= q) & (end - start + q >= floor)
        found.append(np.c_[start, end - start + q, np.full(len(start), q)][held])
    found = [np.concatenate(found)] if found else [np.zeros((0, 3), np.int64)]
    scale = SHORT
    while 2 * scale < sizes.max(initial=0):
        k, width = 3 * scale // 4, scale // 4
        live = np.flatnonzero((sizes > 2 * scale)[owner])
        words = x[live]
        grams = _grams(words, k)
        known = np.concatenate(found)
        inner = known[(known[:, 2] < width) & (known[:, 1] >= k)]
        edges = np.zeros(len(x) + 1, np.int64)
        np.add.at(edges, inner[:, 0], 1)
        np.add.at(edges, inner[:, 0] + inner[:, 1] - k + 1, -1)
        grams[np.cumsum(edges)[live[: len(grams)]] > 0] = _TOP
        seeds = list(_seeded(words, owner[live], grams, scale))
        if seeds:
            start, end, lag = _extended(words, np.concatenate([s[0] for s in seeds]), np.concatenate([s[1] for s in seeds]))
            held = end - start >= lag
            found.append(np.c_[live[start[held]], (end - start + lag)[held], lag[held]])
        scale *= 2
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs):  # of the lags of one stretch the smallest is its period, the others are multiples of it
        runs = runs[np.r_[True, (np.diff(runs[:, :2], axis=0) != 0).any(axis=1)]]
        runs = runs[runs[:, 1] >= min_length]
        runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs


def _slices(texts: list[bytes | None]) -> Iterator[slice]:
    begin = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text or b"") > SLICE_BYTES:
            yield slice(begin, i)
            begin, held = i, 0
        held += len(text or b"") + 1
    yield slice(begin, len(texts))


def runs_in(texts: list[bytes | None], min_length: int = MIN_LENGTH) -> tuple[list[np.ndarray], list[bytes]]:
    """The runs of each text (start counted in its words) and its words without those that repeat a run's first period."""
    words = [t.split() if t else [] for t in texts]
    sizes = np.array([len(w) + 1 for w in words])
    ends = np.cumsum(sizes)
    x = np.empty(sizes.sum(), np.int64)
    inside = np.ones(len(x), bool)
    inside[ends - 1] = False
    x[inside] = pa.array(itertools.chain.from_iterable(words), pa.binary(), size=int(inside.sum())).dictionary_encode().indices.to_numpy()
    x[ends - 1] = -1 - np.arange(len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    runs = runs_of(x, owner, sizes, min_length)
    edges = np.zeros(len(x) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(edges[:-1]) == 0
    parts = np.searchsorted(runs[:, 0], np.r_[0, ends])
    runs = runs.copy()
    runs[:, 0] -= (ends - sizes)[owner[runs[:, 0]]]
    by_text = [runs[a:b] for a, b in itertools.pairwise(parts)]
    left = [b" ".join(w if not len(r) else itertools.compress(w, kept[e - s : e - 1])) for w, r, s, e in zip(words, by_text, sizes, ends)]
    return by_text, left


_RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def periodic_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """docs with the runs of each text, by start and then period, and the text without their repeats, in new last columns `runs` and `collapsed`.

    A word goes if some run holds it beyond that run's first period; the others are joined by one space. Null and empty
    texts have no words: no runs and an empty collapsed text. Each row is looked at on its own, so repeated rows get
    equal results; an empty table gives no rows. Where docs has a column `runs` or `collapsed`, the new one's name gets
    an underscore. Memory is bounded by SLICE_BYTES of text or the longest text; the time grows with n log n.
    """
    runs_col, left_col = free_name(docs, "runs"), free_name(docs, "collapsed")
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(f"`{runs_col}` {_RUNS}, `{left_col}` string").fields])
    place = docs.columns.index(text_col)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            for part in _slices(texts):
                runs, left = runs_in(texts[part], min_length)
                flat = np.concatenate([*runs, np.zeros((0, 3), np.int64)])
                structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32)), structs)
                columns = batch.slice(part.start, part.stop - part.start).columns
                yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(left, pa.binary()).cast(pa.string())], names=[f.name for f in schema])

    return docs.mapInArrow(work, schema)


def _planted(doc_id: object, text: str | None) -> str | None:
    """The contract's planted run: in a tenth of the texts the words from one place on repeat a stretch there."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    words = text.encode().split() if text and h % 10 == 0 else []
    if not words:
        return text
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]).decode()


def planted(doc_id: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([_planted(i, t) for i, t in zip(doc_id, text)], dtype=object)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, after the contract's runs were planted (a null doc_id counts as the empty text there)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.pandas_udf(planted, "string")(F.col("doc_id").cast("string"), "text").alias("text"))
    found = periodic_runs(docs).drop("text")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), (r.period.cast("string"))))
    joined = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(joined.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")
    ).select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
