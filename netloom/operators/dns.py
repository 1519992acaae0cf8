"""DNS messages, the integrity of their transactions, and names used as tunnels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import text as T
from netloom.operators.behaviour import is_dns
from netloom.operators.decode import _kept
from netloom.operators.fields import _number, layout
from netloom.operators.windows import folded, sessions


def _question(message: bytes) -> tuple[str, int, int] | None:
    """Name, type and class of the first question; pointers are followed, 128 steps at most."""
    at, labels, end = 12, [], None
    for _ in range(128):
        if at >= len(message):
            return None
        n = message[at]
        if n >= 0xC0:
            if at + 1 >= len(message):
                return None
            end, at = end or at + 2, (n & 0x3F) << 8 | message[at + 1]
        elif n == 0:
            end = end or at + 1
            if end + 4 > len(message):
                return None
            return ".".join(labels).lower(), int.from_bytes(message[end : end + 2]), int.from_bytes(message[end + 2 : end + 4])
        else:
            labels.append(message[at + 1 : at + 1 + n].decode("latin-1"))
            at += 1 + n
    return None


def messages(packets: DataFrame, named: bool = True) -> DataFrame:
    """UDP packets of port 53 with id, response, question (name/type/class) and a hash of the message.
    Only the name needs Python, in Arrow batches of the payloads that the header bytes let through; without it, all
    messages of twelve bytes or more come, whatever they ask."""

    @F.pandas_udf("string")
    def question(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda b: None if (q := _question(bytes(b))) is None else "/".join(map(str, q)))

    rows = _kept(layout(packets).where("(src_port = 53 or dst_port = 53)")).where("_proto = 17")
    rows = _kept(rows.withColumn("_dns", F.substring(F.col("bytes"), F.col("_l4") + 9, F.length("bytes")))).where("length(_dns) >= 12")
    head = lambda k: F.conv(F.hex(F.substring("_dns", k, 2)), 16, 10).cast("int")
    if not named:
        return rows.select("no", "timestamp", "src", "dst", "src_port", "dst_port", head(1).alias("id"), (head(3).bitwiseAND(0x8000) != 0).alias("response"))
    out = rows.where(head(5) > 0).select("no", "timestamp", "src", "dst", "src_port", "dst_port", head(1).alias("id"), (head(3).bitwiseAND(0x8000) != 0).alias("response"), question("_dns").alias("question"), F.xxhash64("_dns").alias("hash"))
    return out.where("question is not null")


def transactions(packets: DataFrame, wait: float = 30.0, settle: float = 5.0) -> DataFrame:
    """Answers nobody asked for, to another question, from another server, or in conflict with one that
    was accepted less than five seconds ago. The fold's key is the client, its port and the message's id, cut where
    nothing comes for longer than a request lives."""
    m = messages(packets)
    ask = ~F.col("response") & (F.col("dst_port") == 53)
    rows = m.where(ask | (F.col("response") & (F.col("src_port") == 53)))
    end = lambda a, b: F.when(F.col("response"), F.col(a)).otherwise(F.col(b))
    rows = rows.withColumns({"client": end("dst", "src"), "port": end("dst_port", "src_port"), "server": end("src", "dst")})
    rows = sessions(rows, ["client", "port", "id"], wait)

    def step(state: dict, r) -> list[tuple]:
        now, key = r.timestamp, f"{r.client}|{r.port}|{r.id}"
        alert = lambda name, severity, detail: (r.no, now, "DNS", name, severity, detail, key)
        if not r.response:
            state["asked"] = (now, r.server, r.question)
            return []
        done, asked = state.get("done"), state.get("asked")
        if done and now - done[0] <= settle:
            return [] if (done[1], done[2]) == (r.server, r.hash) else [alert("Conflicting DNS responses", "CRIT", f"replies from {done[1]} and {r.server}")]
        state.pop("asked", None)
        if not asked or now - asked[0] > wait:
            return [alert("Unsolicited DNS response", "HIGH", f"{r.server} answers {r.client}")]
        state["done"] = (now, r.server, r.hash)
        found = []
        if asked[2] != r.question:
            found.append(alert("DNS transaction question mismatch", "CRIT", f"{asked[2]} became {r.question}"))
        if asked[1] != r.server:
            found.append(alert("Unexpected DNS responder", "CRIT", f"asked {asked[1]}, answered by {r.server}"))
        return found

    return folded(rows, ["client", "port", "id", "session"], step, "no long, timestamp double, source string, signature string, severity string, detail string, correlation_key string")


def tunnels(packets: DataFrame, least: float = 8.0) -> DataFrame:
    """D-DNS-T: domains whose sub-domains look like data: a tenth of the queries, the highest entropy of a
    sub-domain and a tenth of its greatest length make the score; above 12 it is HIGH. suspicious is the plainer
    test (D-DNS-T2): over 20 sub-domains, entropy over 3.5 or length over 30."""
    rows = packets.where(is_dns()).withColumn("_name", T.domain(F.col("info"))).where("_name is not null").withColumn("apex", T.apex(F.col("_name")))
    sub = F.when(F.length("_name") > F.length("apex"), F.expr("substring(_name, 1, length(_name) - length(apex) - 1)")).otherwise("")
    names = rows.groupBy("apex", sub.alias("sub")).agg(F.count("*").alias("n")).withColumn("_entropy", T.entropy(F.col("sub").cast("binary")))
    sums = names.groupBy("apex").agg(F.sum("n").alias("queries"), F.max("_entropy").alias("max_entropy"), F.max(F.length("sub")).alias("max_length"), F.count_if(F.col("sub") != "").alias("subdomains"))
    score = F.col("queries") / 10 + F.col("max_entropy") + F.col("max_length") / 10
    suspicious = (F.col("subdomains") > 20) | (F.col("max_entropy") > 3.5) | (F.col("max_length") > 30)
    return sums.withColumns({"score": score, "severity": F.when(score > 12, "HIGH").when(score >= least, "MED"), "suspicious": suspicious})
