"""TCP payloads in order, and segments that come after a reset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.decode import _kept
from netloom.operators.detect import _alerts
from netloom.operators.fields import _number, layout
from netloom.operators.ranges import carried, in_cells, intervals, on
from netloom.operators.windows import first_of, previous, running, sessions
from netloom.sources.scratch import kept

ENDS = ["src", "src_port", "dst", "dst_port"]


def segments(packets: DataFrame) -> DataFrame:
    """TCP segments with flags, seq and payload (which may be empty), cut at the length that IPv4 gives."""
    rows = _kept(layout(packets)).where("_proto = 6 and _v is not null and src_port is not null and dst_port is not null")
    head = (F.shiftright(_number(F.col("_l4") + 12, 1), 4) * 4).cast("int")
    end = F.when(F.col("_v") == 4, F.least(F.length("bytes"), F.col("_ip") + _number(F.col("_ip") + 2, 2).cast("int"))).otherwise(F.length("bytes"))
    rows = _kept(rows.withColumns({"flags": _number(F.col("_l4") + 13, 1).cast("int"), "seq": _number(F.col("_l4") + 4, 4), "_from": F.col("_l4") + head, "_to": end})).where("seq is not null and flags is not null")
    return rows.select("no", "timestamp", *ENDS, "flags", "seq", F.substring(F.col("bytes"), F.col("_from") + 1, F.greatest(F.col("_to") - F.col("_from"), F.lit(0))).alias("payload"))


def placed(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """rows with `place`, the sequence number counted from the key's first row on: steps from row to row, forward or back by
    the shorter way, are summed up, so numbers go on over their wrap at 32 bits."""
    rows = previous(rows, keys, {"_was": F.col(seq)})
    step = F.pmod(F.col(seq) - F.col("_was") + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    return running(rows.withColumn("_step", F.coalesce(step, F.lit(0))), keys, {"place": F.col("_step")}).drop("_was", "_step")


def reassembled(packets: DataFrame) -> DataFrame:
    """The payload of each direction in order: rows of place in the stream and new bytes.

    A byte is there as soon as it and all bytes before it have come: the largest, over the places up to it, of the time of
    the first segment that covers a place. Of the segments that had come by then, the one that begins first
    gives it (of those that begin alike the longest, then the first). Numbers wrap at 32 bits; a SYN begins anew; what is behind a gap
    at the end is left out. A row with `closed` comes for a reset, and for a FIN, which takes a number of its own, once
    all bytes before it are there; the payload of a reset doesn't count. Ranges are cut and summed up by blocks of
    places, so a long direction is many tasks; payloads are only fetched for what they give.
    """
    every = kept(segments(packets))
    flag = lambda bit: F.col("flags").bitwiseAND(bit) > 0
    slim = kept(every.select("no", "timestamp", *ENDS, "flags", (F.col("seq") + flag(2).cast("int")).alias("seq"), F.length("payload").alias("size")))
    keys = [*ENDS, "epoch"]
    rows = kept(placed(running(slim, ENDS, {"epoch": flag(2).cast("int")}), keys))
    firsts = rows.groupBy(*(F.col(c).alias(f"_k_{c}") for c in keys)).agg(F.min(F.struct("timestamp", "no")).alias("_first"))
    first_no = lambda found: found.join(firsts, on(keys, "_k_")).withColumn("first_no", F.col("_first.no"))

    came = F.struct("timestamp", "no")
    pieces = rows.where(~flag(4)).groupBy(*keys, "place", "size", flag(1).cast("int").alias("fin")).agg(F.min(came).alias("came"))
    pieces = pieces.withColumns({"start": F.greatest("place", F.lit(0)), "end": F.col("place") + F.col("size") + F.col("fin")})
    covers = kept(intervals(in_cells(pieces.where("end > 0")), keys))
    spot = [*keys, "_cell", "lo"]
    there = covers.groupBy(*spot, "hi").agg(F.min("came").alias("came"))
    there = carried(there, keys, "lo", {"_covered": F.col("hi") - F.col("lo")}, {"when": F.col("came")}).where("_covered = hi")
    there = there.select(*(F.col(c).alias(f"_t_{c}") for c in spot), "when")
    rank = F.struct(F.col("place"), (-F.col("size")).alias("shorter"), (-F.col("fin")).alias("open"), F.col("came"))
    given = covers.join(there, on(spot, "_t_")).where(F.col("came") <= F.col("when")).groupBy(*spot, "hi", "when").agg(F.min(rank).alias("by"))
    given = kept(given.groupBy(*keys, F.col("by.came.no").alias("no"), F.col("by.place").alias("place"), (-F.col("by.shorter")).alias("size")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("when").alias("when")))

    ended = (F.col("hi") > F.col("place") + F.col("size")).cast("int")
    given = carried(given.withColumns({"ended": ended, "new": F.col("hi") - F.col("lo") - ended}), keys, "lo", {"_ends": F.col("ended")})
    given = kept(given.withColumn("offset", F.col("lo") - F.col("_ends") + F.col("ended")))
    data = F.substring(F.col("payload"), (F.col("lo") - F.col("place") + 1).cast("int"), F.col("new").cast("int"))
    filled = given.join(every.select(F.col("no").alias("_no"), "payload"), F.col("no") == F.col("_no"))
    pair = lambda at, data, closed: F.struct(at.alias("offset"), F.col("no"), data.alias("data"), F.lit(closed).alias("closed"))
    none = F.lit(b"").cast("binary")
    both = F.array_compact(F.array(F.when(F.col("new") > 0, pair(F.col("offset"), data, False)), F.when(F.col("ended") > 0, pair(F.col("offset") + F.col("new"), none, True))))
    out = [*ENDS, "first_no", "offset", "no", "data", "closed"]
    streams = first_no(filled.select(*keys, F.inline(both))).select(*out)

    moves = given.select(*keys, "when.timestamp", "when.no", F.col("new").alias("bytes"), F.lit(False).alias("reset"))
    resets = rows.where(flag(4)).select(*keys, "timestamp", "no", F.lit(0).cast("long").alias("bytes"), F.lit(True).alias("reset"))
    cut = running(moves.unionByName(resets), keys, {"offset": F.col("bytes")}).where("reset")
    return streams.unionByName(first_no(cut).withColumns({"data": none, "closed": F.lit(True)}).select(*out))


def epochs(packets: DataFrame, idle: float = 300.0) -> DataFrame:
    """segments, the payload's size in its place, with their flow (both directions), its session and epoch: a SYN or five idle minutes begin it anew.
    SYNs are counted by running sums over buckets of time, so a long flow is many groups."""
    return of_epochs(kept(segments(packets).withColumn("payload", F.length("payload"))).withColumnRenamed("payload", "size"), idle)


def of_epochs(rows: DataFrame, idle: float = 300.0) -> DataFrame:
    """epochs of segments that are a table already, with their payload or its size."""
    if "payload" in rows.columns:
        rows = rows.withColumn("size", F.length("payload")).drop("payload")
    end = lambda ip, port: F.concat_ws(":", ip, F.col(port).cast("string"))
    rows = rows.withColumn("flow", F.array_join(F.array_sort(F.array(end("src", "src_port"), end("dst", "dst_port"))), "|"))
    return running(sessions(rows, ["flow"], idle), ["flow", "session"], {"epoch": F.col("flags").bitwiseAND(2)})


def after_reset(packets: DataFrame, idle: float = 300.0) -> DataFrame:
    """Payload on a flow that was reset; once until the flow begins anew."""
    key = ["flow", "session", "epoch"]
    reset = F.col("flags").bitwiseAND(4)
    rows = running(epochs(packets, idle), key, {"_resets": reset})
    hit = rows.where((F.col("_resets") - reset > 0) & (F.col("size") > 0))
    return _alerts(first_of(hit, key), "TCP payload after reset", "HIGH", F.concat_ws(" ", "src", F.lit("->"), "dst"), F.col("flow"))
