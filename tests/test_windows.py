"""Bursts and windows against a plain walk over the rows, and their time on one key that has them all."""

import random
import time

import pytest
from pyspark.sql import functions as F

from netloom.operators.windows import last_of, latched, previous, sliding, spaced_by, with_lookback

SCHEMA = "no long, timestamp double, src string, dst string, port int"


@pytest.fixture(scope="module")
def packets(spark):
    rng, at, rows = random.Random(9), 0.0, []
    for no in range(1, 1500):
        at += rng.choice([0, 0.1, 0.3, 0.5, 1.0, 2.5, 12.0])
        rows.append((no, at, rng.choice(["a", "b", None]), rng.choice(["x", "y"]), rng.choice([1, 2, 3, 4, 5, 6, None])))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def walk(rows, key, threshold, seconds, value, rearm, once):
    """One alert a key when its rows of the last seconds come to the threshold; anew after a pause of the rearm key."""
    seen, last, fired, found = {}, {}, {}, []
    for row in rows:
        no, at = row[0], row[1]
        k, r = key(row), rearm(row)
        if r in last and at - last[r] > seconds and not once:
            fired = {x: f for x, f in fired.items() if f[0] != r}
        last[r] = at
        held = seen.setdefault(k, [])
        held.append((at, value(row)))
        near = [v for t, v in held if t >= at - seconds and v is not None]
        if (len(set(near)) if value is not one else len(near)) >= threshold and k not in fired:
            fired[k] = (r,)
            found.append(no)
    return found


def one(row):
    return row[0]


@pytest.mark.parametrize("once", [False, True])
@pytest.mark.parametrize("threshold, seconds", [(4, 2.0), (8, 5.0)])
def test_counts(packets, threshold, seconds, once):
    rows, df = packets
    key = lambda r: (r[2], r[3])
    got = sorted(r.no for r in latched(df, ["src", "dst"], threshold, seconds, once=once).collect())
    assert got == walk(rows, key, threshold, seconds, one, key, once)


@pytest.mark.parametrize("once", [False, True])
@pytest.mark.parametrize("threshold, seconds", [(3, 2.0), (5, 6.0)])
def test_distinct_values(packets, threshold, seconds, once):
    rows, df = packets
    got = sorted(r.no for r in latched(df, ["src", "dst"], threshold, seconds, "port", ["src"], once).collect())
    assert got == walk(rows, lambda r: (r[2], r[3]), threshold, seconds, lambda r: r[4], lambda r: r[2], once)


def test_sliding_and_previous(packets):
    rows, df = packets
    hits = {r.no: r.hits for r in sliding(df, ["src"], 2.0).collect()}
    kinds = {r.no: r.hits for r in sliding(df, ["src"], 2.0, "port").collect()}
    before = {r.no: r.was for r in previous(df, ["src"], {"was": F.col("port")}, 3.0).collect()}
    for i, row in enumerate(rows):
        own = [r for r in rows[: i + 1] if r[2] == row[2]]
        near = [r for r in own if r[1] >= row[1] - 2.0]
        assert hits[row[0]] == len(near) and kinds[row[0]] == len({r[4] for r in near} - {None}) and before[row[0]] == (own[-2][4] if len(own) > 1 else None)


def test_one_key_with_all_rows(spark):
    flood = spark.range(200_000).selectExpr("id as no", "id / 200000D as timestamp", "'a' as src", "'x' as dst", "cast(id % 500 as int) as port").cache()
    assert flood.count() == 200_000
    began = time.time()
    assert [r.no for r in latched(flood, ["src", "dst"], 100, 1.0).collect()] == [99]
    assert [r.no for r in latched(flood, ["src", "dst"], 300, 15.0, "port").collect()] == [299]
    assert sliding(flood, ["src"], 1.0).agg(F.max("hits")).first()[0] == 200_000
    assert time.time() - began < 60


def test_lookback_is_a_window_of_rows(packets):
    from pyspark.sql import Window

    rows, df = packets
    whole = Window.partitionBy("src", "dst").orderBy("timestamp", "no").rowsBetween(-7, 0)
    part = Window.partitionBy("src", "dst", "_bucket").orderBy("timestamp", "no").rowsBetween(-7, 0)
    facts = [F.count("port"), F.sum("port"), F.min("no"), F.min("timestamp")]
    expected = df.select("no", *(f.over(whole).alias(f"f{i}") for i, f in enumerate(facts))).collect()
    for seconds in (3.0, 50.0):
        lent = with_lookback(df, ["src", "dst"], 7, seconds)
        assert lent.groupBy("src", "dst", "_bucket").count().agg(F.max("count")).first()[0] < 120
        got = lent.select("no", "_lent", *(f.over(part).alias(f"f{i}") for i, f in enumerate(facts))).where("not _lent").drop("_lent").collect()
        assert sorted(got) == sorted(expected)


def test_last_rows_are_cut_before_the_shuffle(packets):
    rows, df = packets
    found = last_of(df, ["src"], 5)
    assert sorted(r.no for r in found.collect()) == sorted(no for k in ("a", "b", None) for no in [r[0] for r in rows if r[2] == k][-5:])
    assert found._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


def test_beacon_scores_are_those_of_the_last_60(spark):
    import statistics

    from netloom.operators.behaviour import beacon_scores

    rng, rows, expected = random.Random(2), [], {}
    for k in range(12):
        at, times, sizes = 5.0, [], []
        for i in range(rng.choice([3, 8, 61, 300])):
            at += rng.choice([0.0, 1.0, 1.0, 1.1, 2.0]) if k % 2 else 2.0
            times.append(at)
            sizes.append(100 + (rng.randrange(50) if k % 3 else 0))
            rows.append((len(rows), at, f"10.0.0.{k}", "10.0.9.9", 4000, 80, "TCP", None, sizes[-1]))
        gaps = [b - a for a, b in zip(times, times[1:]) if b - a > 0.001][-60:]
        spread = lambda x: min(1.0, statistics.pstdev(x) / statistics.fmean(x)) if x and statistics.fmean(x) > 0 else 1.0
        even = 1 - spread(sizes[-60:]) if len(sizes[-60:]) >= 5 else 0.5
        score = 0.5 * (1 - spread(gaps)) + 0.3 * even + 0.2 * min((times[-1] - times[0]) / 60, 1.0)
        expected[f"10.0.0.{k}"] = score if len(gaps) >= 5 and statistics.fmean(gaps) >= 0.5 else 0.0
    df = spark.createDataFrame(rows, "no long, timestamp double, src string, dst string, src_port int, dst_port int, protocol string, vlan_id int, length int").repartition(5)
    found = {r.a_ip if r.a_ip != "10.0.9.9" else r.b_ip: r.beacon_score for r in beacon_scores(df).collect()}
    assert found == pytest.approx(expected)


def greedy(places, distance):
    out = []
    for p in sorted(set(places)):
        if not out or p - out[-1] >= distance:
            out.append(p)
    return out


@pytest.mark.parametrize("distance", [1, 7, 100])
def test_spacing_is_greedy(spark, distance):
    rng = random.Random(distance)
    places = {k: [rng.randrange(3000) for _ in range(n)] for k, n in (("a", 900), ("b", 30), ("c", 1), (None, 60))}
    df = spark.createDataFrame([(k, p) for k, ps in places.items() for p in ps], "k string, p long").repartition(4)
    found = [(r.k, r.place) for r in spaced_by(df, ["k"], "p", distance).collect()]
    assert len(found) == len(set(found)) and {k: sorted(p for x, p in found if x == k) for k in places} == {k: greedy(ps, distance) for k, ps in places.items()}


def test_spacing_of_one_long_key(spark):
    df = spark.range(0, 1_000_000, 1, 8).selectExpr("'k' as k", "id * 3 + id % 2 as p")
    began = time.time()
    found = sorted(r.place for r in spaced_by(df, ["k"], "p", 1000).collect())
    assert found == greedy([i * 3 + i % 2 for i in range(1_000_000)], 1000) and time.time() - began < 150


def test_admission_with_expiry(spark):
    from netloom.operators.incidents import admitted, decisions

    rng, at, rows = random.Random(1), 0.0, []
    for i in range(300):
        at += rng.choice([0.0, 1.0, 5.0, 120.0])
        rows.append((f"i{i:03}", at))
    expected, held = [], []
    for i, t in rows:
        held = [e for e in held if t < e]
        if len(held) < 4:
            held.append(t + 60.0)
            expected.append(i)
    df = spark.createDataFrame(rows, "incident_id string, first_time double").repartition(3)
    assert sorted(r.incident_id for r in admitted(df, 4, 60.0).collect()) == expected and 50 < len(expected) < 250
    found = [(f"{d}{k}", "IDS", d, f"203.0.113.{k}", "10.0.0.1", float(10 * k)) for k in range(1, 6) for d in ("x", "y")] + [("z", "IDS", "x", "203.0.113.99", "10.0.0.1", 0.0)]
    out = decisions(spark.createDataFrame(found, "incident_id string, source string, detector string, attacker string, target string, first_time double"), spark.createDataFrame([("203.0.113.2",)], "address string"), "automatic", 3, expires=25.0, now=60.0)
    status = {r.incident_id: (r.status, r.reason) for r in out.collect()}
    # x1, y1 from 10 to 35; 2 is protected; x3 from 30 to 55, y3 finds all held; x4, y4 from 40; both of 50 find x3, x4, y4
    full = ("rejected", "most active blocks reached")
    assert status == {"z": ("pending approval", "automatic"), "x1": ("expired", "automatic"), "y1": ("expired", "automatic"), "x2": ("rejected", "address is on the protection list"), "y2": ("rejected", "address is on the protection list"),
        "x3": ("expired", "automatic"), "y3": full, "x4": ("applied", "automatic"), "y4": ("applied", "automatic"), "x5": full, "y5": full}
