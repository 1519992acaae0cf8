"""Steps whose work or memory once grew faster than their rows: results by plain walks, and the bounds that the steps keep."""

import random
from collections import Counter
from math import log2

import pandas as pd
from pyspark.sql import functions as F

from netloom.functions import text as T
from netloom.operators import fields, handshake, objects, processes, strings, windows
from netloom.sources import scratch
from netloom.streaming import live

PACKET = "no long, timestamp double, src string, dst string, protocol string, length int, src_port int, dst_port int"
OWNER = "seq long, protocol string, local_ip string, local_port int, remote_ip string, remote_port int, pid int, process string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_owners_of_a_port_are_not_paired_with_all_its_packets(spark):
    rnd = random.Random(3)
    ips, ports = ["10.0.0.1", "10.0.0.2", "::", "0.0.0.0"], [0, 443, 53]
    packets = [(k, float(k), rnd.choice([*ips, None]), rnd.choice(ips), rnd.choice(["UDP", "TCP", "HTTP"]), 60, rnd.choice([22, 53, None]), rnd.choice([443, 22, 0])) for k in range(200)]
    owners = [(k, rnd.choice(["tcp", "UDP"]), rnd.choice([*ips, None]), rnd.choice([22, 53, 443]), rnd.choice(ips), rnd.choice([*ports, None]), k % 7, f"p{k}") for k in range(150)]
    found = processes.attributed(spark.createDataFrame(packets, PACKET), spark.createDataFrame(owners, OWNER))
    wanted = set()
    for no, _, src, dst, protocol, _, sp, dp in packets:
        best = None
        for out, ip, port, far, far_port in ((True, src, sp, dst, dp), (False, dst, dp, src, sp)):
            for seq, proto, lip, lport, rip, rport, pid, process in owners:
                fits = sp is not None and dp is not None and proto.upper() == ("UDP" if protocol == "UDP" else "TCP") and lport == port
                fits = fits and lip is not None and rip is not None and rport is not None
                fits = fits and (lip in processes.ANY or lip == ip) and (rport == 0 or rport == far_port) and (rip in processes.ANY or rip == far)
                if fits and (best is None or (out, seq) > best[:2]):
                    best = (out, seq, pid, process)
        if best:
            wanted.add((no, best[2], best[3], best[0]))
    assert {(r.no, r.pid, r.process, r.outbound) for r in found.collect()} == wanted and wanted
    joins = [line for line in plan(found).splitlines() if "Join Inner" in line]
    assert joins and not any(" OR " in line for line in joins)  # equality alone decides what meets
    empty = processes.attributed(spark.createDataFrame(packets, PACKET), spark.createDataFrame([], OWNER))
    assert empty.count() == 0


def test_xor_keys_of_counts(spark):
    rnd = random.Random(5)
    data = [bytes(rnd.choice(b"abc XYZ~\x00\x7f") ^ k for _ in range(rnd.choice([0, 15, 16, 40, 600]))) for k in range(256)] + [None, bytes(range(256)) * 3, b"\x80" * 5000]

    def walk(d):
        d = (d or b"")[:512]
        if len(d) < 16 or sum(32 <= x < 127 for x in d) / len(d) > 0.75:
            return None
        score, key = max((sum(32 <= x ^ k < 127 for x in d) / len(d), k) for k in range(1, 256))
        return (key, score) if score > 0.70 else None

    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "id int, d binary").select("id", T.xor_key(F.col("d")).alias("x"))
    assert {r.id: r.x and tuple(r.x) for r in df.collect()} == {i: walk(d) for i, d in enumerate(data)}
    assert "lambda" not in plan(df)  # no key is tried on each byte


def test_entropy_of_counts(spark, monkeypatch):
    rnd = random.Random(6)
    data = [bytes(rnd.choices(range(rnd.choice([1, 2, 256])), k=rnd.choice([0, 1, 9, 400, 3000]))) for _ in range(300)] + [None]
    wanted = [log2(len(d)) - sum(c * log2(c) for c in Counter(d).values()) / len(d) if d else 0.0 for d in data]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "id int, d binary").select("id", T.entropy(F.col("d")).alias("e"))
    assert all(abs(r.e - wanted[r.id]) < 1e-9 for r in df.collect())
    assert "lambda" not in plan(df)
    monkeypatch.setattr(T, "_BYTES", 1000)  # long ones in pieces
    monkeypatch.setattr(T, "_ROWS", 7)
    assert all(abs(a - b) < 1e-9 for a, b in zip(T.entropies(data), wanted))


def test_strings_come_in_batches_of_their_own():
    page = b"\x00".join(b"abcd%d" % k for k in range(30_000))
    out = list(strings._scan(iter([pd.DataFrame({"_id": ["1", "2", "3"], "_bytes": [page, None, page]})])))
    assert sum(map(len, out)) == 60_000 and max(map(len, out)) <= strings.STRINGS
    first = out[0]
    assert first["offset"].tolist()[:3] == [0, 6, 12] and first["value"][2] == "abcd2" and first["length"][2] == 5


def test_stream_sessions_measure_gaps_as_numbers(spark):
    at = [n / 40 for n in range(40 * 1000, 40 * 5000) if (n + 40) / 40 - n / 40 != 1.0]
    assert any(t + 1 - t > 1 or (round(t * 40) + 40) / 40 - t > 1 for t in at) and any((round(t * 40) + 40) / 40 - t < 1 for t in at)
    rows = [(f"{k}", 2 * k + i, t, (round(t * 40) + 40 * i) / 40) for k, t in enumerate(at) for i in (0, 1)]
    df = spark.createDataFrame([(s, no, x) for s, no, _, x in rows], "src string, no long, timestamp double").withColumn("event_time", live._event_time(1_700_000_000))
    found = {r.src: r.hits for r in live.bursts(df, ["src"], 2, 1).collect()}
    assert found == {str(k): 2 for k, t in enumerate(at) if (round(t * 40) + 40) / 40 - t <= 1}


def test_only_the_fields_asked_for_are_made(spark):
    p = spark.createDataFrame([(1, 0.5, 60, "TCP", None, bytearray(bytes(12) + b"\x08\x00E" + bytes(60)))], "no long, timestamp double, length int, protocol string, vlan_id int, bytes binary")
    every = fields.fields(p)
    some = fields.fields(p, ("Ethernet",), ("eth.type", "ip.ttl"))
    assert some.collect() == every.where("path = 'eth.type'").collect() and every.where("layer is null").count() == 0
    assert "lambda" not in plan(some)  # few fields are compiled


def test_rounds_of_spaced_alerts_broadcast_nothing(spark, monkeypatch):
    rounds = []

    def kept(df):
        if "_j_" in plan(df):
            rounds.append(df._jdf.queryExecution().executedPlan().toString())
        return scratch.kept(df)

    monkeypatch.setattr(windows, "kept", kept)
    rows = spark.createDataFrame([(k % 2, k * 3) for k in range(2000)], "k int, p long")
    assert windows.spaced_by(rows, ["k"], "p", 12).count() == 1000
    assert len(rounds) > 6 and not any("Broadcast" in r for r in rounds)


def test_long_rows_come_to_patterns_in_small_batches(spark, monkeypatch):
    def sizes(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [pdf["d"].map(len).sum()]})

    rows = spark.range(0, 1000, 1, 1).select(F.expr("cast(repeat(if(id < 0, 'x', 'ab'), 5000) as binary) AS d"))
    found = [r.n for r in scratch.kept(rows.mapInPandas(sizes, "n long"), 100_000).collect()]
    assert sum(found) == 10_000_000 and max(found) <= 200_000
    asked = []
    monkeypatch.setattr(objects, "kept", lambda df, batch: asked.append((batch, plan(df))) or scratch.kept(df, batch))
    monkeypatch.setattr(objects, "HITS", 7)
    rule = {"rule": "r", "pattern": "$a", "kind": "literal", "text": "abab", "nocase": False, "condition": "any"}
    hits = objects.pattern_hits(rows.limit(3).withColumn("id", F.lit(1)), [rule], "id", "d", most=41)
    assert sorted(r.offset for r in hits.collect()) == sorted([*range(0, 40, 4)] * 3)
    assert asked[0][0] == objects.SCANNED_BYTES and "substring" in asked[0][1]  # what no rule looks at stays in the JVM


def test_a_hello_is_parsed_once(spark):
    p = spark.createDataFrame([(1, 0.5, "TCP", bytearray(b"\x16\x03"))], "no long, timestamp double, protocol string, bytes binary")
    assert plan(handshake.hellos(p).select("no", "random")).count("ArrowEvalPython") == 1


def test_windows_of_buckets_shuffle_rows_once(spark):
    rows = spark.createDataFrame([(no % 2, no, no * 40.0) for no in range(9)], "k int, no long, timestamp double")
    sums = windows.running(rows, ["k"], {"n": F.lit(1)})
    lags = windows.previous(rows, ["k"], {"was": F.col("no")})
    assert {(r.no, r.n) for r in sums.collect()} == {(no, no // 2 + 1) for no in range(9)}
    assert {(r.no, r.was) for r in lags.collect()} == {(no, no - 2 if no > 1 else None) for no in range(9)}
    assert "Join" not in plan(sums) and "Join" not in plan(lags)
