"""Findings to incidents, their packets, and what would be done about them: tables only, nothing acts on a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.packet import ipv4_number
from netloom.operators.windows import folded, sessions
from netloom.sources.scratch import kept

KEY = ("source", "detector", "attacker", "target")


def incidents(findings: DataFrame, packets: DataFrame, severity: str = "CRIT") -> DataFrame:
    """I4: pending incidents: findings of a severity by source, detector, attacker and target, with a stable id."""
    rows = findings.where(F.col("severity") == severity).select("no", "timestamp", "source", F.col("signature").alias("detector"), "detail")
    rows = rows.join(packets.select("no", F.col("src").alias("attacker"), F.col("dst").alias("target")), "no")
    out = rows.groupBy(*KEY).agg(
        F.count("*").alias("findings"), F.min("no").alias("first_no"), F.max("no").alias("last_no"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"), F.min_by("detail", "no").alias("summary"),
    )
    return out.withColumn("incident_id", F.sha2(F.concat_ws("|", *KEY), 256))


def history(found: DataFrame, packets: DataFrame, before: int = 500, most: int = 2000) -> DataFrame:
    """Each incident's packets: those with the attacker at either end, the earliest `before` of those ahead of
    its first finding and all later ones, the last `most` in all. The limits are the feature; a window's group limit cuts
    each task's rows before the shuffle."""
    ends = packets.select("no", "timestamp", F.explode(F.array_distinct(F.array("src", "dst"))).alias("attacker"))
    ends = ends.join(found.select(F.col("attacker").alias("_a")).distinct(), F.col("attacker") == F.col("_a"), "left_semi")
    # an attacker's packets are ranked once, whatever the number of its incidents: its first `before` and last `most` will do
    by = lambda order: F.row_number().over(Window.partitionBy("attacker").orderBy(order))
    first = ends.withColumn("_k", by(F.col("no"))).where(F.col("_k") <= before)
    last = ends.withColumn("_k", by(F.desc("no"))).where(F.col("_k") <= most)
    rows = found.select("incident_id", "attacker", "first_no").join(first.withColumn("_early", F.lit(True)).unionByName(last.withColumn("_early", F.lit(False))), "attacker")
    kept = rows.where(F.col("_early") == (F.col("no") < F.col("first_no"))).select("incident_id", "no", "timestamp", "attacker")
    return kept.withColumn("_k", F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("no")))).where(F.col("_k") <= most).drop("_k")


def independent(found: DataFrame, detectors: int = 2) -> DataFrame:
    """Attackers and targets of two or more different critical detectors."""
    return found.groupBy("attacker", "target").agg(F.count_distinct(F.struct("source", "detector")).alias("detectors")).where(F.col("detectors") >= detectors)


def is_blockable(address: Column) -> Column:
    """an address that isn't unspecified, loopback, multicast or broadcast; null if it is no address."""
    n, low = ipv4_number(address), F.lower(address)
    v4 = ~((n == 0) | (F.shiftright(n, 24) == 127) | (F.shiftright(n, 28) == 14) | (n == (1 << 32) - 1))
    v6 = F.when(low.rlike("^[0-9a-f:.]*:[0-9a-f:.]*$"), ~(low.rlike("^[0:]*[01]?$") | low.startswith("ff")))
    return F.coalesce(v4, v6)


def admitted(rows: DataFrame, most: int, expires: float) -> DataFrame:
    """The incidents that get one of `most` places, each of which is held for `expires` seconds: in the order of their times, an
    incident that finds all places held is turned away. After a pause of that length all places are free, so each stretch between
    such pauses is a group of its own; its state is `most` times."""

    def step(state: dict, r) -> list[tuple]:
        held = [t for t in state.get("held", ()) if r.timestamp < t]
        state["held"] = held
        if len(held) >= most:
            return []
        held.append(r.timestamp + expires)
        return [(r.incident_id,)]

    timed = rows.select("incident_id", F.col("first_time").alias("timestamp"), F.col("incident_id").alias("no"), F.lit(0).alias("_all"))
    return folded(sessions(timed, ["_all"], expires), ["_all", "session"], step, "incident_id string")


def decisions(found: DataFrame, protected: DataFrame | None = None, mode: str = "preview", most: int = 32, stopped: bool = False, expires: float = 900.0, now: float | None = None) -> DataFrame:
    """What a policy says about each incident, by mode: monitor, preview, manual or automatic.

    protected has address. Automatic needs two independent detectors of the same pair; of the incidents that pass
    all else, in the order of their first times, those apply that find fewer than `most` active. One is active for `expires`
    seconds; where `now` is given, those whose time is over by then are expired.
    """
    rows = found.join(independent(found).select("attacker", "target", F.lit(True).alias("_gate")), ["attacker", "target"], "left")
    if protected is None:
        rows = rows.withColumn("_kept", F.lit(False))
    else:
        rows = rows.join(protected.select(F.col("address").alias("attacker"), F.lit(True).alias("_kept")).distinct(), "attacker", "left")
    able, gate = is_blockable(F.col("attacker")), F.coalesce("_gate", F.lit(False))
    refused = F.when(able.isNull(), "attacker is not a valid address").when(~able, "special-purpose address is protected").when(F.coalesce("_kept", F.lit(False)), "address is on the protection list")
    answer = {"monitor": F.lit("observed"), "preview": F.lit("previewed"), "manual": F.lit("pending approval")}.get(mode)
    if answer is None:
        answer = F.lit("rejected") if stopped else F.when(gate, "applied").otherwise("pending approval")
    rows = rows.withColumn("_refused", refused).withColumn("status", F.when(F.col("_refused").isNotNull(), "rejected").otherwise(answer))
    out = rows.select("incident_id", *KEY, F.coalesce("_refused", F.lit(mode)).alias("reason"), "status", "first_time")
    if mode == "automatic" and not stopped:
        out = kept(out)
        let = admitted(out.where("status = 'applied'"), most, expires).select(F.col("incident_id").alias("_id"))
        over = F.lit(False) if now is None else F.col("first_time") + expires <= now
        state = F.when(F.col("_id").isNull(), "rejected").when(over, "expired").otherwise("applied")
        out = out.join(let, F.col("incident_id") == F.col("_id"), "left")
        full = (F.col("status") == "applied") & F.col("_id").isNull()
        out = out.withColumn("reason", F.when(full, "most active blocks reached").otherwise(F.col("reason")))
        out = out.withColumn("status", F.when(F.col("status") == "applied", state).otherwise(F.col("status"))).drop("_id")
    return out.drop("first_time")


def restored(fresh: DataFrame, earlier: DataFrame) -> DataFrame:
    """New correlated findings with the dispositions that earlier ones were given; findings of either stay."""
    key = ["source", "signature", "correlation_key"]
    old = earlier.select(*key, "disposition", F.col("hit_count").alias("_old"))
    return fresh.join(old, key, "full_outer").select(*key, (F.coalesce("hit_count", F.lit(0)) + F.coalesce("_old", F.lit(0))).alias("hit_count"), F.coalesce("disposition", F.lit("open")).alias("disposition"))
