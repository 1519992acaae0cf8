"""Reassembly and contradictions against walks over the segments in their order."""

import random
import time

import pytest
from pyspark.sql import functions as F

from netloom.operators import fragments, ranges, streams
from tests.test_sessions import made, packet, tcp


def walk(rows):
    """One direction, segment by segment: (no of the first, offset, no, bytes, closed)."""
    state, out = {}, []
    for no, seq, data, flags in rows:
        fin = bool(flags & 1)
        if flags & 2:
            state.clear()
            seq = (seq + 1) % 2**32
        if "next" not in state:
            state.update(next=seq, at=0, wait={}, epoch=no)
        if flags & 4:
            out.append((state["epoch"], state["at"], no, b"", True))
            continue
        held = state["wait"].get(seq)
        if (data or fin) and (held is None or (len(data), fin) > (len(held[1]), held[2])):
            state["wait"][seq] = (no, data, fin)
        while True:
            ready = [(s, (state["next"] - s) % 2**32) for s in state["wait"]]
            ready = [(s, back) for s, back in ready if back < 1 << 31]
            if not ready or (state["next"] - seq) % 2**32 >= 1 << 31:
                break
            for s, back in sorted(ready, key=lambda x: -x[1]):
                k, held, fin = state["wait"].pop(s)
                new = held[(state["next"] - s) % 2**32 :]
                if new:
                    out.append((state["epoch"], state["at"], k, new, False))
                    state["next"] = (state["next"] + len(new)) % 2**32
                    state["at"] += len(new)
                if fin and state["next"] == (s + len(held)) % 2**32:
                    state["next"] = (state["next"] + 1) % 2**32
                    out.append((state["epoch"], state["at"], k, b"", True))
    return out


def random_direction(rnd):
    start, text, rows = rnd.choice([5, 2**32 - 20, 2**31 - 10]), bytes(rnd.randrange(97, 123) for _ in range(700)), []
    span = rnd.choice([30, 60, 600])
    for _ in range(rnd.randrange(2, 40)):
        at, n = rnd.randrange(span), rnd.choice([0, 1, 3, 9, 20, 300])
        flags = rnd.choices([16, 17, 2, 4], [30, 1 if at + n >= span else 0, 1, 1])[0]
        rows.append(((start + at) % 2**32, text[at : at + n] if rnd.random() < 0.9 else b"?" * n, flags))
        if flags & 2:
            start, rows[-1] = (start + at) % 2**32, ((start + at) % 2**32, rows[-1][1], 2)
    if rnd.random() < 0.5:
        rows.append(((start + span) % 2**32, b"", 17))
        rnd.shuffle(rows)
    return rows


def test_reassembly_is_the_walk(spark):
    rnd, no, packets, expected = random.Random(8), 0, [], []
    for k in range(40):
        rows = []
        for seq, data, flags in random_direction(rnd):
            no += 1
            rows.append((no, seq, data, flags))
            packets.append(packet(no, float(no * (1 + k % 3 * 30)), src=f"10.0.1.{k}", bytes_=tcp(seq, data, flags)))
        expected += [(f"10.0.1.{k}", *r) for r in walk(rows)]
    got = [(r.src, r.first_no, r.offset, r.no, bytes(r.data), r.closed) for r in streams.reassembled(made(spark, packets)).collect()]
    assert sorted(got) == sorted(expected) and sum(r[-1] for r in expected) > 10 and len({r[0] for r in expected}) > 30


def test_one_long_direction_is_many_tasks(spark):
    """A stream of 3 MB in disorder, every segment twice: blocks of places, not the stream, are what a window holds."""
    n, size = 3000, 1000
    order = list(range(n)) * 2
    random.Random(2).shuffle(order)
    frames = [packet(i, float(i) / 100, bytes_=tcp(7 + k * size, bytes([k % 251]) * size, 24)) for i, k in enumerate([0, *order], 1)]
    began = time.time()
    found = streams.reassembled(made(spark, frames)).select("offset", F.length("data").alias("n")).orderBy("offset").collect()
    assert sum(r.n for r in found) == n * size and [r.offset for r in found] == [i * size for i in range(n)] and time.time() - began < 120


def first_contradiction(pieces):
    known = {}
    for no, start, data in pieces:
        if any(known.get(start + i, b) != b for i, b in enumerate(data)):
            return no
        known.update({start + i: b for i, b in enumerate(data)})
    return None


def test_contradictions_are_the_walk(spark):
    rnd, rows, expected = random.Random(3), [], {}
    for key in range(60):
        text = bytes(rnd.randrange(97, 100) for _ in range(900))
        pieces = []
        for i in range(rnd.randrange(1, 30)):
            at, n = rnd.randrange(0, 600), rnd.choice([0, 1, 7, 100, 300])
            data = bytearray(text[at : at + n])
            if data and rnd.random() < 0.08:
                data[rnd.randrange(len(data))] = 33
            pieces.append((len(rows) + i, at, bytes(data)))
        expected[key] = first_contradiction(pieces)
        rows += [(no, float(no // 3), key if key else None, at, data) for no, at, data in pieces]
    found = fragments.contradicted(spark.createDataFrame(rows, "no long, timestamp double, key int, start long, data binary").repartition(4), ["key"]).collect()
    assert {r.key or 0: r.no for r in found} == {k: v for k, v in expected.items() if v is not None} and 10 < len(found) < 60


@pytest.mark.parametrize("kind", ["copies", "steps"])
def test_floods_stay_linear(spark, kind):
    """40,000 copies of one piece, or pieces that begin one byte after the other; one byte contradicts at the end."""
    n, text = 40_000, b"abcdefgh" * 8000
    at = lambda i: 0 if kind == "copies" else i
    rows = [(i, float(i), 1, at(i), text[at(i) : at(i) + 64]) for i in range(n)] + [(n, float(n), 1, at(n - 1), b"x")]
    began = time.time()
    (hit,) = fragments.contradicted(spark.createDataFrame(rows, "no long, timestamp double, key int, start long, data binary").repartition(8), ["key"]).collect()
    assert hit.no == n and time.time() - began < 90


def test_retransmissions_over_the_wrap(spark):
    start = 2**32 - 6
    parts = [(start, b"abcdefgh"), ((start + 4) % 2**32, b"efgh"), (0, b"gH")]
    p = made(spark, [packet(k, k, bytes_=tcp(seq, data, 24)) for k, (seq, data) in enumerate(parts)])
    assert [r.no for r in fragments.conflicting_retransmission(p).collect()] == [2]


def test_carried_over_blocks(spark):
    rows = [(k, p, (p * 7 + k) % 5) for k in range(3) for p in range(0, 5000, 13)]
    got = ranges.carried(spark.createDataFrame(rows, "k int, p long, v int"), ["k"], "p", {"total": F.col("v")}, {"top": F.col("v") * F.col("p")}, block=100)
    for k in range(3):
        total, top = 0, 0
        for r in sorted((r for r in got.collect() if r.k == k), key=lambda r: r.p):
            total, top = total + r.v, max(top, r.v * r.p)
            assert (r.total, r.top) == (total, top)
