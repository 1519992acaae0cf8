"""Sliding windows over a key's packets and the latch that raises one alert a burst.

No window takes all rows of a key: a key's rows are cut into buckets of time, so that a key with a third of all
rows is many groups. What crosses a bucket's border is carried by one row for each key and bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.sources.scratch import kept

ORDER = ("timestamp", "no")


def in_buckets(rows: DataFrame, seconds: float) -> DataFrame:
    return rows.withColumn("_bucket", F.floor(F.col("timestamp") / float(seconds)))


def of_bucket(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what facts knows of their key and bucket; a null key is a value of its own."""
    on = [*keys, "_bucket"]
    there = facts.withColumnsRenamed({k: f"_of_{k}" for k in on})
    return rows.join(there, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in on], "left").drop(*(f"_of_{k}" for k in on))


def with_first(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows (`_own`) and, beside them, one row for what facts knows of each key and bucket, which a window that is ordered by `_own` meets
    first: rows are then shuffled once, for the window, where a join would shuffle them before it as well."""
    return rows.withColumn("_own", F.lit(True)).unionByName(facts.withColumn("_own", F.lit(False)), allowMissingColumns=True)


def _numbered(spans: DataFrame, keys: list[str], gap: float, name: str) -> DataFrame:
    """The session of each bucket of a key: spans has _first and _last, the times of the bucket's rows."""
    w = Window.partitionBy(*keys).orderBy("_bucket")
    new = F.coalesce(F.col("_first") - F.lag("_last").over(w) > gap, F.lit(False)).cast("int")
    return spans.withColumn("_new", new).select(*keys, "_bucket", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(name))


def sessions(rows: DataFrame, keys: list[str], gap: float, name: str = "session", among: DataFrame | None = None) -> DataFrame:
    """rows with the number of the key's session: a new one begins after more than gap seconds without a row.

    Rows of one bucket of that width are never so far apart, so sessions break between buckets only. If rows are
    part of a table whose every row keeps a session alive, `among` is that table.
    """
    spans = in_buckets(among or rows, gap).groupBy(*keys, "_bucket").agg(F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"))
    return of_bucket(in_buckets(rows, gap), _numbered(spans, keys, gap, name), keys).drop("_bucket")


def sliding(rows: DataFrame, keys: list[str], seconds: float, distinct: str | None = None, name: str = "hits") -> DataFrame:
    """Rows with how many rows, or distinct values, their key has in the last seconds up to each of them.

    Every row, or every stay of a value, comes once and goes once, and running sums count those that are there: linear
    however many rows a window holds. Null values count as none.
    """
    wide = F.lit(float(seconds))
    event = lambda at, no, step, row: F.struct(at.alias("timestamp"), no.alias("no"), F.lit(step).alias("_step"), row.alias("_row"))
    own = F.struct(*rows.columns)
    kind = rows.select(own.alias("r")).schema["r"].dataType
    none = F.lit(None).cast(kind)
    at, no, last = F.col("timestamp"), F.col("no") * 2, F.lit(1 << 62)
    if distinct is None:
        moves = rows.select(*keys, F.inline(F.array(event(at - wide, no, 1, own), event(at, last, -1, none))))
    else:
        asked = rows.select(*keys, F.inline(F.array(event(at - wide, no + 1, 0, own))))
        moves = _stays(rows, keys, distinct, seconds, none).unionByName(asked)
    return running(moves, keys, {name: F.col("_step")}, 4 * seconds).where(F.col("_row").isNotNull()).select("_row.*", name)


def _stays(rows: DataFrame, keys: list[str], distinct: str, seconds: float, none: Column) -> DataFrame:
    """A row for each time a value comes to a key and each time it goes, as sliding places them."""
    parts = in_buckets(rows, seconds).where(F.col(distinct).isNotNull()).groupBy(*keys, distinct, "_bucket").agg(F.min(F.struct("timestamp", "no")).alias("_f"), F.max("timestamp").alias("_last"))
    parts = parts.select("*", F.col("_f.timestamp").alias("_first"))
    w, wide = Window.partitionBy(*keys, distinct).orderBy("_bucket"), F.lit(float(seconds))
    comes = F.coalesce(F.col("_first") - wide > F.lag("_last").over(w), F.lit(True))
    goes = F.coalesce(F.lead("_first").over(w) - wide > F.col("_last"), F.lit(True))
    come = F.struct((F.col("_first") - wide).alias("timestamp"), (F.col("_f.no") * 2).alias("no"), F.lit(1).alias("_step"), none.alias("_row"))
    go = F.struct(F.col("_last").alias("timestamp"), F.lit(1 << 62).alias("no"), F.lit(-1).alias("_step"), none.alias("_row"))
    moves = parts.withColumns({"_comes": comes, "_goes": goes})
    return moves.select(*keys, F.inline(F.array_compact(F.array(F.when(F.col("_comes"), come), F.when(F.col("_goes"), go)))))


def running(rows: DataFrame, keys: list[str], measures: dict[str, Column], seconds: float = 60.0) -> DataFrame:
    """Rows with sums of measures over the key's rows up to the present one: the sums of all buckets before
    the row's, and the sum within it."""
    dated = in_buckets(rows.withColumns({f"_x_{m}": x for m, x in measures.items()}), seconds)
    sums = dated.groupBy(*keys, "_bucket").agg(*(F.sum(f"_x_{m}").alias(f"_x_{m}") for m in measures))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "_bucket", *(F.coalesce(F.sum(f"_x_{m}").over(earlier), F.lit(0)).alias(f"_before_{m}") for m in measures))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_own", *ORDER).rowsBetween(Window.unboundedPreceding, 0)
    out = with_first(dated, before).withColumns({m: F.max(f"_before_{m}").over(inside) + F.sum(f"_x_{m}").over(inside) for m in measures})
    return out.where("_own").drop("_own", "_bucket", *(f"_x_{m}" for m in measures), *(f"_before_{m}" for m in measures))


def previous(rows: DataFrame, keys: list[str], columns: dict[str, Column], seconds: float = 60.0) -> DataFrame:
    """Rows with what columns were in the key's row before, null in its first: that of the same bucket, or else the
    last of the bucket before, carried by one row for each key and bucket."""
    dated = in_buckets(rows.withColumn("_x", F.struct(*(c.alias(n) for n, c in columns.items()))), seconds)
    ends = dated.groupBy(*keys, "_bucket").agg(F.max_by("_x", F.struct(*ORDER)).alias("_x"))
    carried = ends.select(*keys, "_bucket", F.lag("_x").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_x")).where("_x is not null")
    out = with_first(dated, carried).withColumn("_lag", F.lag("_x").over(Window.partitionBy(*keys, "_bucket").orderBy("_own", *ORDER)))
    return out.where("_own").withColumns({n: F.col("_lag")[n] for n in columns}).drop("_own", "_bucket", "_x", "_lag")


def last_of(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The last k rows of each key. Spark limits every task's rows to k a key before the shuffle, and merges what is
    left: a busy key costs k rows a task, however long it is."""
    back = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in ORDER))
    return rows.withColumn("_rank", F.row_number().over(back)).where(F.col("_rank") <= k).drop("_rank")


def with_lookback(rows: DataFrame, keys: list[str], k: int, seconds: float = 600.0) -> DataFrame:
    """rows by `_bucket`, each bucket of a key with copies (`_lent`) of the k rows before it: what looks back k rows is
    then a window of one bucket.

    A bucket's last k rows are a state that merges: the last k before a bucket are those of the k buckets with rows before it.
    """
    dated = in_buckets(rows, seconds)
    own = [*keys, "_bucket"]
    ends = last_of(dated, own, k).groupBy(*own).agg(F.collect_list(F.struct(*(c for c in dated.columns if c not in own))).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(-k, -1)
    latest = F.slice(F.reverse(F.array_sort(F.transform(F.flatten(F.collect_list("_rows").over(before)), lambda r: F.struct(*(r[c].alias(f"_{c}") for c in ORDER), r.alias("row"))))), 1, k)
    lent = ends.select(*own, latest.alias("_l")).select(*own, F.explode("_l").alias("_l")).select(*own, "_l.row.*", F.lit(True).alias("_lent"))
    return dated.withColumn("_lent", F.lit(False)).unionByName(lent)


def first_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's first row. An aggregation, so a task keeps one row a key before the shuffle."""
    return rows.groupBy(*(F.col(k).alias(f"_by_{k}") for k in keys)).agg(F.min_by(F.struct(*rows.columns), F.struct(*ORDER)).alias("_row")).select("_row.*")


def reaching(rows: DataFrame, keys: list[str], threshold: int, distinct: str | None = None) -> DataFrame:
    """The rows of keys that can reach the threshold at all, in any window; a null key is a value of its own. The
    counts are made before the shuffle and are small, so hot keys do no harm."""
    measure = F.count_distinct(distinct) if distinct else F.count("*")
    enough = rows.groupBy(*(F.col(k).alias(f"_of_{k}") for k in keys)).agg(measure.alias("_n")).where(F.col("_n") >= threshold)
    return rows.join(enough, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], "left_semi")


def _reached(rows: DataFrame, keys: list[str], threshold: int, seconds: float, rearm: list[str], once: bool) -> DataFrame:
    """The rows at which a key has threshold rows within the window, with the session of `rearm`.

    A window touches two neighbouring buckets of its width at most, so counts by bucket tell which rows can matter.
    Of those, a row is a hit if the one threshold - 1 before it is near enough; to ask that, each bucket is lent the
    rows of the one before it.
    """
    spans = in_buckets(rows, seconds).groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"), F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"))
    w = Window.partitionBy(*keys).orderBy("_bucket")
    beside = lambda f, step: F.coalesce(F.when(f("_bucket").over(w) == F.col("_bucket") + step, f("_n").over(w)), F.lit(0))
    before, after = beside(F.lag, -1), beside(F.lead, 1)
    dense = spans.select(*keys, "_bucket", (F.col("_n") + before >= threshold).alias("_own"), (F.col("_n") + after >= threshold).alias("_lends")).where("_own or _lends")
    few = of_bucket(in_buckets(rows, seconds), dense, keys).where("_own or _lends")
    to = F.array_compact(F.array(F.when(F.col("_own"), F.col("_bucket")), F.when(F.col("_lends"), F.col("_bucket") + 1)))
    lent = few.withColumn("_in", F.explode(to)).drop("_own", "_lends")
    back = F.lag("timestamp", threshold - 1).over(Window.partitionBy(*keys, "_in").orderBy(*ORDER))
    hits = lent.withColumn("_back", back).where("_in = _bucket").where(F.col("timestamp") - F.lit(float(seconds)) <= F.col("_back")).drop("_back", "_in", "_bucket")
    if once:
        return hits
    if rearm == keys:
        return of_bucket(in_buckets(hits, seconds), _numbered(spans.drop("_n"), keys, seconds, "session"), keys).drop("_bucket")
    return sessions(hits, rearm, seconds, among=rows)


def _reached_distinct(rows: DataFrame, keys: list[str], threshold: int, seconds: float, distinct: str, rearm: list[str], once: bool) -> DataFrame:
    """The rows at which a key comes to threshold distinct values within the window, with the session of `rearm`.

    A value is there from its first row until the window after its last one before a pause. Rows are summed up by
    key, value and bucket before anything is ordered, so no copy of a row, and no hot key, reaches a window. Running
    sums of values that come and go then count those that are there; a count grows only where a value comes.
    """
    parts = in_buckets(rows, seconds).groupBy(*keys, distinct, "_bucket").agg(F.min_by(F.struct(*rows.columns), F.struct(*ORDER)).alias("_row"), F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"))
    w, wide = Window.partitionBy(*keys, distinct).orderBy("_bucket"), F.lit(float(seconds))
    comes = F.coalesce(F.col("_first") - wide > F.lag("_last").over(w), F.lit(True))
    goes = F.coalesce(F.lead("_first").over(w) - wide > F.col("_last"), F.lit(True))
    # what comes is placed a window early, what goes at its last row, so that both stand where their difference counts
    come = F.struct((F.col("_first") - wide).alias("timestamp"), F.col("_row.no").alias("no"), F.lit(1).alias("_step"), F.col("_row").alias("_row"))
    go = F.struct(F.col("_last").alias("timestamp"), F.lit(1 << 62).alias("no"), F.lit(-1).alias("_step"), F.lit(None).cast(parts.schema["_row"].dataType).alias("_row"))
    moves = parts.where(F.col(distinct).isNotNull()).withColumns({"_comes": comes, "_goes": goes})
    moves = moves.select(*keys, F.inline(F.array_compact(F.array(F.when(F.col("_comes"), come), F.when(F.col("_goes"), go)))))
    hits = running(moves, keys, {"_there": F.col("_step")}, 4 * seconds).where((F.col("_step") == 1) & (F.col("_there") >= threshold)).select("_row.*")
    if once:
        return hits
    spans = parts.groupBy(*rearm, "_bucket").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    return of_bucket(in_buckets(hits, seconds), _numbered(spans, rearm, seconds, "session"), rearm).drop("_bucket")


def latched(rows: DataFrame, keys: list[str], threshold: int, seconds: float, distinct: str | None = None, rearm: list[str] | None = None, once: bool = False) -> DataFrame:
    """The first row at which a key has threshold rows (or distinct values) within the window, without its bytes.

    Another alert of the key needs a gap of more than the window in the rows of `rearm` (the key unless given, else
    some of its columns); with once there is none. A null key is a value of its own, null values count as no value.
    """
    rows = rows.drop("bytes")
    hits = _reached_distinct(rows, keys, threshold, seconds, distinct, rearm or keys, once) if distinct else _reached(rows, keys, threshold, seconds, rearm or keys, once)
    return first_of(hits, keys if once else [*keys, "session"]).drop("session")


def _next_places(rows: DataFrame, keys: list[str], place: str, distance: int) -> DataFrame:
    """(keys, place, to): the key's first place that is `distance` or more beyond each place.

    Places and what is asked for are ordered together, last ones first, by buckets; what the next bucket with places begins with
    is one row for each key and bucket.
    """
    own = rows.select(*keys, F.col(place).alias("place")).distinct()
    asked = own.select(*keys, (F.col("place") + distance).alias("at"), F.lit(None).cast("long").alias("here"), F.col("place").alias("by"))
    both = own.select(*keys, F.col("place").alias("at"), F.col("place").cast("long").alias("here"), F.lit(None).cast("long").alias("by")).unionByName(asked)
    both = both.withColumn("_bucket", F.floor(F.col("at") / (64 * distance)))
    heads = both.groupBy(*keys, "_bucket").agg(F.min("here").alias("_head"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    facts = heads.select(*keys, "_bucket", F.min("_head").over(later).alias("_later"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(F.desc("at"), F.desc_nulls_last("here")).rowsBetween(Window.unboundedPreceding, 0)
    found = of_bucket(both, facts, keys).withColumn("to", F.coalesce(F.min("here").over(inside), F.col("_later")))
    return found.where("by is not null and to is not null").select(*keys, F.col("by").alias("place"), "to")


def spaced_by(rows: DataFrame, keys: list[str], place: str, distance: int) -> DataFrame:
    """(keys, place): of each key's places the first, and from one that is taken on always the first that is `distance` or more beyond it.

    What follows a place is a jump. Jumps are joined with themselves, so they double in each round, and those that are taken are
    joined with them: the rounds are the logarithm of the longest chain, and a key with all rows is as many tasks as its rows need.
    Both sides are shuffled whatever their size: broadcasts of that many rounds would add up in the driver.
    """
    jumps = kept(_next_places(rows, keys, place, distance))
    taken = kept(rows.groupBy(*keys).agg(F.min(place).cast("long").alias("place")))
    many = taken.count()
    renamed = lambda df, name: df.withColumnsRenamed({c: f"_{name}_{c}" for c in df.columns})
    met = lambda name, of: [F.col(k).eqNullSafe(F.col(f"_{name}_{k}")) for k in keys] + [F.col(of) == F.col(f"_{name}_place")]
    while True:
        beyond = renamed(jumps, "j").hint("merge")
        reached = taken.join(beyond, met("j", "place")).select(*keys, F.col("_j_to").alias("place"))
        taken = kept(taken.unionByName(reached).distinct())
        if (now := taken.count()) == many:
            return taken
        many = now
        jumps = kept(jumps.join(beyond, met("j", "to")).select(*keys, "place", F.col("_j_to").alias("to")))


def folded(rows: DataFrame, keys: list[str], step: Callable[[dict, tuple], list[tuple]], schema: str, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Each key's rows in order through step(state, row), which changes the state and returns output rows.

    The state is an empty dict at each new key. Rows are sorted by Spark, which spills, and come in Arrow batches, so
    a task holds one batch and one state, however long a key is. A key is one task's work: where a state dies after a
    pause, put the number of the session (`sessions`) among the keys, so that a busy key is many.
    """
    columns = [c.split()[0] for c in schema.split(", ")]
    keyed = rows.withColumn("_key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, {}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name="Row"):
                if row[-1] != key:
                    key, state = row[-1], {}
                out += step(state, row)
            if out:
                yield pd.DataFrame(out, columns=columns)

    return keyed.repartition("_key").sortWithinPartitions("_key", *order).mapInPandas(run, schema)
