"""Repair plans against every plan there is, op12 against DuckDB and against plain Python."""

import hashlib
import itertools
import random
import re
import time
import zlib
from functools import lru_cache

import duckdb

from netloom.llm import conversation_repair as repair
from tests.llm.test_queries import TURNS, folder, rows  # noqa: F401


def all_plans(codes, most):
    """(cost, audit) of the least plan of at most so many insertions between rows, by trying all of them."""

    @lru_cache(None)
    def least(i, initials_so_far):
        if not re.fullmatch("s?(ua)*u?", initials_so_far):
            return (10**9, "")
        ends = [(0, "")] if i == len(codes) and re.fullmatch("(s?(ua)+)?", initials_so_far) else []
        tries = [(3, "I", i, "u"), (3, "I", i, "a")] if not initials_so_far.endswith("!") else []
        if i < len(codes):
            code, extra = codes[i], 3 if codes[i].isupper() else 0
            tries.append((4, "D", i + 1, ""))
            if code != "x":
                tries += [(3 + extra, "R", i + 1, "u"), (3 + extra, "R", i + 1, "a")]
                if code.lower() in "sua":
                    tries.append((extra, "K", i + 1, code.lower()))
        for cost, letter, j, initial in tries:
            if len(initials_so_far) < most:
                c, audit = least(j, initials_so_far + initial) if j > i or len(initials_so_far) < most - 1 else (10**9, "")
                ends.append((c + cost, letter + audit))
        return min(ends, default=(10**9, ""))

    return least(0, "")


def test_plans_are_the_least_of_all():
    for n in range(4):
        for codes in itertools.product("xsuaoSUA", repeat=n):
            assert repair.plan("".join(codes)) == all_plans("".join(codes), 2 * n + 3), codes
    rnd = random.Random(3)
    for _ in range(60):
        codes = "".join(rnd.choice("xsuuaaoSUA") for _ in range(rnd.randrange(4, 8)))
        assert repair.plan(codes) == all_plans(codes, 2 * len(codes) + 3), codes


def test_long_conversations():
    began = time.time()
    cost, audit = repair.plan("ua" * 5000)
    assert (cost, audit) == (0, "K" * 10_000)
    assert repair.plan("u" * 3000)[0] == 4500 and time.time() - began < 30  # every second one is given to the assistant


def plain(turns):
    """op12 row by row."""
    by_conv = {}
    for conv, turn, role, text in turns:
        kept = by_conv.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn is not None, turn or 0, role.encode(), text.encode())] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, kept in by_conv.items():
        kept.sort()
        at = sorted({t for there, t, _, _ in kept if there})
        codes, counts, seen = "", dict.fromkeys(("blank", "duplicate", "truncated"), 0), set()
        for _, _, role, text in kept:
            fault = "blank" if not text.split() else "duplicate" if (role, text) in seen else "truncated" if text.split()[-1][-1:] not in (b".", b"!", b"?") else None
            seen.add((role, text))
            letter = role[:1].decode() if role[:1] in (b"s", b"u", b"a") else "o"
            codes += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
            if fault:
                counts[fault] += 1
        firsts = [r.decode()[:1] for _, _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(firsts))
        cost, audit = repair.plan(codes)
        out, left = [], iter(kept)
        for letter in audit:
            due = "assistant" if out and out[-1][0] == "u" else "user"
            if letter == "I":
                out.append(f"{due}:")
                continue
            _, _, role, text = next(left)
            if letter != "D":
                out.append(f"{due if letter == 'R' else role.decode()}:{text.decode()}")
        yield (conv, at[-1] - at[0] + 1 - len(at) if at else 0, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_op12(rows):  # noqa: F811
    assert sorted(map(str, (tuple(r) for r in rows("op12_repair")))) == sorted(map(str, plain(TURNS)))


def test_sql_says_the_same(spark, folder, rows):  # noqa: F811
    for at, found in ((folder.removeprefix("file://"), rows("op12_repair")), ("/root/testdata/sf0.01", repair.op12_repair(spark, "/root/testdata/sf0.01").collect())):
        con = duckdb.connect()
        con.sql(f"create view conversations as select conv_id, turn, role, text from '{at}/conversations.parquet{'' if '/root' in at else '/*.parquet'}'")
        assert sorted(map(str, con.sql(repair.OP12_SQL).fetchall())) == sorted(map(str, (tuple(r) for r in found)))


def test_repaired_rows(spark):
    given = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "user", "Hm?"), (1, 2, "user", "So?"), (2, 5, "tool", "x")], "conv_id long, turn long, role string, text string")
    checked = repair.checked(given)
    found = sorted(map(tuple, repair.repaired(checked, repair.planned(checked)).collect()))
    # the assistant speaks first, so a user is put before it; of two user rows the second is given to the assistant. The tool's row goes
    assert found == [("v1", 1, "user", ""), ("v1", 2, "assistant", "Hello."), ("v1", 3, "user", "Hm?"), ("v1", 4, "assistant", "So?")]
    assert repair.plan("auu") == (6, "IKKR") and repair.plan("O") == (4, "D")
    assert repair.plan("auu") == all_plans("auu", 9)
