"""Periodic runs against a comparison of all lags, and op11's digests against plain Python."""

import hashlib
import random
import time
import zlib

import pytest

from netloom.llm import periodic_runs
from tests.llm.test_queries import TEXT_OF, TEXTS, folder, rows, words  # noqa: F401


def plain_runs(w, min_length=12):
    """Every stretch of every lag, walked over word by word; of the lags of one stretch the smallest."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] == w[i + q]:
                j = i
                while j + q < n and w[j] == w[j + q]:
                    j += 1
                if j - i >= q and j - i + q >= min_length:
                    found.setdefault((i, j - i + q), q)
                i = j
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def made(rnd):
    n, signs = rnd.choice([0, 1, 11, 12, 40, 200, 500]), rnd.choice([1, 2, 3, 50])
    w = [f"w{rnd.randrange(signs)}" for _ in range(n)]
    if n > 20 and rnd.random() < 0.7:
        p = rnd.randrange(1, n // 2)
        unit = w[:p] if rnd.random() < 0.5 else (w[: max(1, p // 7)] * p)[: p - 1] + ["x"]  # runs within the period
        w = (unit * n)[:n]
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(n)] = "y"
        w = [f"w{rnd.randrange(signs)}" for _ in range(rnd.randrange(30))] + w
    return w


def test_runs_are_those_of_all_lags():
    rnd = random.Random(5)
    a, b = ["a"], ["a", "b"]
    while len(b) < 600:
        a, b = b, b + a
    thue = ["ab"[bin(i).count("1") % 2] for i in range(512)]
    cases = [made(rnd) for _ in range(150)] + [b, thue, sum((["a"] * k + ["b"] for k in range(1, 30)), []), (["a"] * 40 + ["b"]) * 12]
    for at in range(0, len(cases), 11):
        part = cases[at : at + 11]
        runs, left = periodic_runs.runs_in([" ".join(w).encode() for w in part])
        for w, r, rest in zip(part, runs, left):
            expected = plain_runs(w)
            assert [tuple(x) for x in r.tolist()] == expected and rest.decode() == collapsed(w, expected)


@pytest.mark.parametrize("min_length", [4, 30])
def test_shortest_run_is_a_parameter(min_length):
    rnd = random.Random(9)
    for w in (made(rnd) for _ in range(30)):
        (runs,), _ = periodic_runs.runs_in([" ".join(w).encode()], min_length)
        assert [tuple(x) for x in runs.tolist()] == plain_runs(w, min_length)


def test_long_repetitive_texts_take_linear_time():
    for unit in (["a"], ["a"] * 100 + ["b"], [str(i) for i in range(37)]):
        began = time.time()
        (runs,), _ = periodic_runs.runs_in([" ".join(unit * (300_000 // len(unit))).encode()])
        assert time.time() - began < 20 and [0, 300_000 // len(unit) * len(unit), len(unit)] in runs.tolist()


def test_operator_keeps_columns_and_names(spark):
    docs = spark.createDataFrame([("x", "a b " * 8, 1), (None, None, None), (None, "", 2)], "runs string, body string, collapsed int")
    found = periodic_runs.periodic_runs(docs, "body").collect()
    assert sorted(map(str, found)) == sorted(map(str, [r for r in found if r.body is None] + [r for r in found if r.body == ""] + [r for r in found if r.runs == "x"]))
    one = next(r for r in found if r.runs == "x")
    assert one.asDict(True) | {"body": ""} == {"runs": "x", "body": "", "collapsed": 1, "runs_": [{"start": 0, "length": 16, "period": 2}], "collapsed_": "a b"}
    assert all(r.runs_ == [] and r.collapsed_ == "" for r in found if r.runs is None)


def expected_row(doc_id, text):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    w = words(text)
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w) if len(w) < 1000 else [(0, len(w), 1)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), s, n, q, runs and 1000 * n // q or None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(w, runs)))


def test_op11(spark, rows, folder):  # noqa: F811
    found = sorted(map(str, (tuple(r) for r in rows("op11_runs"))))
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert found == sorted(str(expected_row(r.doc_id, r.text)) for r in docs)


def test_op11_on_the_given_documents(spark):
    at = "/root/testdata/sf0.001"
    docs = [r for r in spark.read.parquet(f"{at}/documents.parquet").collect() if len(words(r.text)) < 500]
    found = {r.doc_id: tuple(r) for r in periodic_runs.op11_runs(spark, at).collect()}
    assert all(found[r.doc_id] == expected_row(r.doc_id, r.text) for r in docs) and sum(r[1] > 0 for r in found.values()) > 5
