"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells source x language x topic are raked until their sums meet the targets of each source,
each language and each topic; documents are then drawn with probabilities that the fitted weights calibrate.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import bounded, materialise, table

#: Targets are the observed shares to this power, normed: small groups gain, large ones lose.
TEMPERATURE = 0.7
#: A sweep fits each dimension once; fitting ends when every margin is this near its target.
TOLERANCE = 1e-3
#: Share of all tokens that the mixture aims at.
KEEP = 0.5
SEED = 8
#: So many cells are fitted at once on the driver, a few MB; more stay a distributed table. Both fit the same way.
CELLS = 100_000

DIMENSIONS = ("source", "lang", "topic")


def measured(text_col: str):
    """A struct column (n_tokens, topic) of whole texts, null counting as empty. The topic is a coarse one, from the
    text's form: tables, figures, many lines, or prose by length; a table with topics of its own names that column."""

    def topic(text: str, data: bytes) -> str:
        size = len(text) + 1
        if (data.count(b"|") + data.count(b"\t")) * 50 > size:
            return "table"
        if sum(map(data.count, DIGITS)) * 20 > size:
            return "figures"
        if data.count(b"\n") * 60 > size:
            return "lines"
        return "long prose" if size > 6000 else "prose" if size > 600 else "note"

    @F.pandas_udf("n_tokens long, topic string")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            data = (text or "").encode("utf-8")
            rows.append((len(data.split()), topic(text or "", data)))
        return pd.DataFrame(rows, columns=["n_tokens", "topic"])

    return of(F.col(text_col))


DIGITS = [b"%d" % d for d in range(10)]


def _targeted(cells: DataFrame, dimensions: tuple[str, ...], targets: dict[str, DataFrame] | None, temperature: float) -> DataFrame:
    """cells with tokens and, for each dimension d, target_d: the share that the cell's value is to have."""
    whole = cells.where("tokens > 0").select(*dimensions, "tokens")
    for d in dimensions:
        name, of = f"target_{d}", F.col(d).alias("_of")
        seen = whole.groupBy(of).agg(F.sum("tokens").alias("_sum"))
        if targets and d in targets:
            # one target a value: a null value meets a null target
            given = targets[d].groupBy(F.col(d).alias("_given")).agg(F.max("target").cast("double").alias("_goal"))
            seen = seen.join(given, F.col("_of").eqNullSafe(F.col("_given")), "left").select("_of", F.coalesce("_goal", F.lit(0.0)).alias(name))
        else:
            seen = seen.select("_of", F.pow(F.col("_sum").cast("double"), F.lit(temperature)).alias(name))
        seen = materialise(seen)
        norm = seen.agg(F.sum(name).alias("t")).first()["t"] or 1.0
        whole = whole.join(bounded(seen.select("_of", (F.col(name) / F.lit(norm)).alias(name))), F.col(d).eqNullSafe(F.col("_of"))).drop("_of")
    return materialise(whole)


def _fit_few(weight: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray], tolerance: float) -> np.ndarray:
    """Raking of cells in arrays: codes has the value of each cell in each dimension, goals the target of each value."""
    was = np.inf
    while True:
        off = 0.0
        for code, goal in zip(codes, goals):
            total = np.bincount(code, weight, len(goal))
            off = max(off, float(np.max(np.abs(total - goal) / np.maximum(goal, 1e-12), initial=0.0)))
            weight = weight * np.divide(goal, total, out=np.zeros_like(goal), where=total > 0)[code]
        if off <= tolerance or not _goes_on(off, was):
            return weight
        was = off


def _goes_on(off: float, was: float) -> bool:
    """Whether fitting gets nearer; if it doesn't, the targets contradict one another on these cells."""
    if off < was * (1 - 1e-6):
        return True
    warnings.warn(f"the targets can't all be met: some margin stays {off:.2%} of its target away", stacklevel=2)
    return False


def _fit_many(whole: DataFrame, dimensions: tuple[str, ...], tolerance: float) -> DataFrame:
    """The same over a distributed table: a dimension's sums are grouped and joined back, so no value's cells meet in
    one task, and each step is cut off as a table."""
    was = np.inf
    while True:
        off = 0.0
        for d in dimensions:
            sums = materialise(whole.groupBy(F.col(d).alias("_of")).agg(F.sum("weight").alias("_sum"), F.max(f"target_{d}").alias("_goal")))
            off = max(off, sums.agg(F.max(F.abs(F.col("_sum") - F.col("_goal")) / F.greatest("_goal", F.lit(1e-12))).alias("x")).first()["x"] or 0.0)
            factor = sums.select("_of", F.when(F.col("_sum") > 0, F.col("_goal") / F.col("_sum")).otherwise(F.lit(0.0)).alias("_factor"))
            whole = whole.join(bounded(factor), F.col(d).eqNullSafe(F.col("_of"))).withColumn("weight", F.col("weight") * F.col("_factor")).drop("_of", "_factor")
            whole = materialise(whole)
        if off <= tolerance or not _goes_on(off, was):
            return whole
        was = off


def rake(cells: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, targets: dict[str, DataFrame] | None = None, temperature: float = TEMPERATURE, tolerance: float = TOLERANCE, few: int = CELLS) -> DataFrame:
    """cells(dimensions.., tokens) with fitted `weight`, whose sum is 1.

    targets[d] is a table (d, target), any positive numbers; without one, d's targets are its observed shares to
    the power `temperature`. Targets are normed over the values that have tokens. Sweeps go on until every margin is
    within the tolerance of its target, or, with a warning, until they bring it no nearer, where the targets contradict
    one another on the cells there are. A value without a target has weight 0.
    """
    whole = _targeted(cells, dimensions, targets, temperature)
    if whole.limit(few + 1).count() <= few:
        rows = whole.collect()
        codes, goals = [], []
        for d in dimensions:
            value: dict = {}
            codes.append(np.array([value.setdefault(r[d], len(value)) for r in rows], np.int64))
            goal = np.zeros(len(value))
            goal[codes[-1]] = [r[f"target_{d}"] for r in rows]
            goals.append(goal)
        weight = _fit_few(np.array([float(r["tokens"]) for r in rows]), codes, goals, tolerance) if rows else np.zeros(0)
        kinds = {f.name: f for f in whole.schema.fields}
        schema = ", ".join(f"`{c}` {kinds[c].dataType.simpleString()}" for c in (*dimensions, "tokens")) + ", weight double"
        fitted = cells.sparkSession.createDataFrame([(*(r[d] for d in dimensions), r["tokens"], float(w)) for r, w in zip(rows, weight)], schema)
    else:
        fitted = _fit_many(whole.withColumn("weight", F.col("tokens").cast("double")), dimensions, tolerance).select(*dimensions, "tokens", "weight")
    total = fitted.agg(F.sum("weight").alias("w")).first()["w"]
    return fitted.withColumn("weight", F.col("weight") / F.lit(total or 1.0))


def probabilities(cells: DataFrame, keep: float = KEEP) -> DataFrame:
    """cells with `probability`: the chance of a cell's documents such that expected tokens follow the weights.

    min(1, s weight / tokens) with the scale s at which the expected tokens are `keep` of all (or all that the
    weighted cells have): cells whose weight is beyond their tokens are taken whole, and s makes up for them.
    """
    rate = F.col("weight") / F.col("tokens")
    total = cells.agg(F.sum("tokens").alias("n"), F.sum(F.when(F.col("weight") > 0, F.col("tokens"))).alias("most"), F.max(rate).alias("top")).first()
    if not total["n"] or not total["top"]:
        return cells.withColumn("probability", F.lit(0.0))
    goal, low, high = min(keep * total["n"], total["most"]), 0.0, None
    scale = goal
    while True:  # the expectation rises with s; each round tries 16 of them in one pass over the cells
        tries = [scale * 2**i for i in range(16)] if high is None else [low + (high - low) * i / 17 for i in range(1, 17)]
        got = cells.agg(*(F.sum(F.least(F.lit(1.0), F.lit(s) * rate) * F.col("tokens")).alias(f"g{i}") for i, s in enumerate(tries))).first()
        near = min(range(16), key=lambda i: abs(got[i] - goal))
        scale = tries[near]
        if abs(got[near] - goal) <= 1e-3 * goal:
            return cells.withColumn("probability", F.least(F.lit(1.0), F.lit(scale) * rate))
        below = [s for i, s in enumerate(tries) if got[i] < goal]
        above = [s for i, s in enumerate(tries) if got[i] >= goal]
        low, high = max([low, *below]), min([x for x in (high, *above) if x is not None], default=None)
        scale = tries[-1] * 2 if high is None else scale


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, DataFrame] | None = None, keep: float = KEEP, seed: int = SEED, topic_col: str | None = None) -> DataFrame:
    """docs with n_tokens, topic, weight, probability and sampled for each row; topic is topic_col where one is named.

    Columns of docs by these names are replaced. A null source or language is a value of its own. Empty and null texts have no tokens: their probability is 0.
    A row is sampled if a hash of seed and id (null ids: of the text), spread over 0 to 1, is below its
    probability, so a rerun draws the same rows and repeated rows share their fate.
    """
    rows = docs.withColumn("_measured", measured(text_col))
    rows = rows.withColumns({"n_tokens": F.col("_measured.n_tokens"), "topic": F.col(topic_col or "_measured.topic")}).drop("_measured")
    slim = materialise(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))
    cells = materialise(probabilities(rake(slim, targets=targets), keep))
    cells = cells.select(*(F.col(c).alias(f"_of_{c}") for c in (*DIMENSIONS, "weight", "probability")))
    on = [F.col(d).eqNullSafe(F.col(f"_of_{d}")) for d in DIMENSIONS]
    chance = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.col(text_col))), F.lit(1 << 53)) / F.lit(float(1 << 53))
    out = rows.join(bounded(cells), on, "left")
    out = out.withColumns({"weight": F.coalesce("_of_weight", F.lit(0.0)), "probability": F.when(F.col("n_tokens") > 0, F.coalesce("_of_probability", F.lit(0.0))).otherwise(F.lit(0.0))})
    return out.drop(*cells.columns).withColumn("sampled", chance < F.col("probability"))


def sample(docs: DataFrame, **how) -> DataFrame:
    """The sampled rows of docs, with its own columns."""
    clash = {c: f"_mix_{c}" for c in docs.columns if c.lower() in ("n_tokens", "topic", "weight", "probability", "sampled")}
    out = mixed(docs.withColumnsRenamed(clash), **how).where("sampled")
    return out.select(*(F.col(clash.get(c, c)).alias(c) for c in docs.columns))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, sampled of every row of documents: see mixed for
    nulls and repeated rows. Nothing is ordered, so there are no ties; extra columns are not read; an empty table gives
    no rows."""
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", *DIMENSIONS, "n_tokens", "weight", "probability", "sampled")
