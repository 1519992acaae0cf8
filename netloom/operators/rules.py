"""User rules: conditions in JSON become Spark expressions, and all rules see the packets in one pass."""

from __future__ import annotations

import json
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.packet import _sure, byte

TEXT = {"src": "src", "ip.src": "src", "dst": "dst", "ip.dst": "dst", "proto": "protocol", "protocol": "protocol", "info": "info"}
NUMBER = {"len": "length", "frame.len": "length", "tcp.srcport": "src_port", "tcp.dstport": "dst_port", "port": "dst_port"}
COMPARE = {"Lt": operator.lt, "Le": operator.le, "Eq": operator.eq, "Ge": operator.ge, "Gt": operator.gt, "Ne": operator.ne}


def condition(tree: dict) -> Column:
    """{"Contains": {field, value}}, Equals, Num {field, op, value}, And [...], Or [...], Not. Text is compared
    whatever the case; an unknown text field is empty, an unknown or missing number is no match."""
    ((kind, body),) = tree.items()
    if kind in ("And", "Or"):
        parts = [condition(t) for t in body]
        return reduce(operator.and_ if kind == "And" else operator.or_, parts, F.lit(kind == "And"))
    if kind == "Not":
        return ~condition(body)
    if kind == "Num":
        value = byte("bytes", 22) if body["field"] == "ip.ttl" else F.col(NUMBER[body["field"]]) if body["field"] in NUMBER else None
        return F.lit(False) if value is None else _sure(COMPARE[body["op"]](value, F.lit(body["value"])))
    text = F.lower(F.coalesce(TEXT[body["field"]], F.lit(""))) if body["field"] in TEXT else F.lit("")
    return F.contains(text, F.lit(body["value"].lower())) if kind == "Contains" else text == body["value"].lower()


def load(spark, path: str) -> list[dict]:
    """The rules of all JSON files of a path, each an object or an array. Rules are few and become the plan."""
    rules: list[dict] = []
    for row in spark.read.text(path, wholetext=True).collect():
        found = json.loads(row["value"])
        rules += found if isinstance(found, list) else [found]
    return rules


def hits(packets: DataFrame, rules: list[dict]) -> DataFrame:
    """D-RULE: one row for each action of each enabled rule that a packet meets: an alert with its severity, a tag
    (INFO) or a log line (LOW)."""

    def action(rule: dict, tree: dict) -> Column:
        ((kind, body),) = tree.items()
        severity = {"Tag": "INFO", "Log": "LOW"}.get(kind) or body.get("severity", "MED")
        return F.struct(F.lit(rule["id"]).alias("rule_id"), F.lit(rule["name"]).alias("signature"), F.lit(kind).alias("action"), F.lit(severity).alias("severity"), F.lit(body.get("message") or body.get("tag") or "").alias("detail"))

    all_hits = [F.when(condition(r["condition"]), action(r, a)) for r in rules if r.get("enabled", True) for a in r["actions"]]
    if not all_hits:
        all_hits = [F.lit(None).cast("struct<rule_id:string,signature:string,action:string,severity:string,detail:string>")]
    return packets.select("no", "timestamp", F.lit("RULE").alias("source"), F.inline(F.array_compact(F.array(*all_hits))))


def rule_counts(packets: DataFrame, rules: list[dict]) -> DataFrame:
    """Packets that meet each enabled rule; a rule without any has no row."""
    one = [F.when(condition(r["condition"]), F.lit(r["id"])) for r in rules if r.get("enabled", True)] or [F.lit(None).cast("string")]
    return packets.select(F.explode(F.array_compact(F.array(*one))).alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("hits"))
