"""The automaton against `re`, pattern by pattern, and pattern rules against their definition."""

import random
import re
import time

from netloom.operators import objects
from netloom.operators.automaton import Automaton, Pattern


def expression(p):
    text = p.text.lower() if p.nocase else p.text
    return re.compile(b"".join(re.escape(bytes([b])) if exact else b"." for b, exact in zip(text, p.mask)), re.S)


def by_re(patterns, payloads):
    return sorted((k, i, m.start()) for k, d in enumerate(payloads) for i, p in enumerate(patterns) if p.text for m in expression(p).finditer(d.lower() if p.nocase else d))


def made(rnd, signs):
    text = bytes(rnd.choice(signs) for _ in range(rnd.randrange(7)))
    return Pattern.literal(text, rnd.random() < 0.5) if rnd.random() < 0.7 else Pattern(text, tuple(rnd.random() < 0.6 for _ in text))


def test_hits_are_those_of_re():
    rnd = random.Random(4)
    for _ in range(250):
        signs = rnd.choice([b"ab", b"abAB", bytes(range(256))])
        patterns = [made(rnd, signs) for _ in range(rnd.randrange(1, 40))]
        payloads = [bytes(rnd.choice(signs) for _ in range(rnd.choice([0, 1, 6, 60, 2500]))) for _ in range(rnd.randrange(1, 6))]
        assert [tuple(h) for h in Automaton(patterns).hits(payloads).tolist()] == by_re(patterns, payloads)


def test_hex_with_gaps():
    p = Pattern.hex("4D 5A ?? ?? 50")
    assert p == Pattern(b"MZ\0\0P", (True, True, False, False, True))
    payloads = [b"MZMZxPP MZ\n\rP", b"MZ", b""]
    assert [tuple(h) for h in Automaton([p]).hits(payloads).tolist()] == by_re([p], payloads)


def test_thousands_of_patterns_in_one_pass():
    rnd = random.Random(6)
    patterns = [Pattern.literal(bytes(rnd.choice(b"abcdefghijkl") for _ in range(rnd.randrange(4, 20))), i % 2 == 0) for i in range(5000)]
    payloads = [bytes(rnd.choice(b"abcdefghijklmnop") for _ in range(2000)) for _ in range(20)]
    few, many = Automaton(patterns[:10]), Automaton(patterns)
    times = []
    for automaton in (few, many):
        began = time.time()
        automaton.hits(payloads * 50)
        times.append(time.time() - began)
    assert times[1] < 10 * times[0] + 1
    assert [tuple(h) for h in many.hits(payloads).tolist()] == by_re(patterns, payloads)


def rule(name, pattern, text, condition, kind="literal", nocase=False):
    return {"rule": name, "pattern": pattern, "kind": kind, "text": text, "nocase": nocase, "condition": condition}


def test_conditions(spark):
    rules = [
        rule("any", "$a", "one", "any"), rule("any", "$b", "two", "any"), rule("all", "$a", "one", "all"), rule("all", "$b", "TWO", "all", nocase=True),
        rule("named", "$a", "one", "$b"), rule("named", "$b", "three", "$b"), rule("none", "$a", "one", "$z"), rule("true", "$a", "one", "true"), rule("hex", "$h", "6f ?? 65", "any", "hex"), rule("empty", "$e", "", "any"),
    ]
    data = [(0, b"one one"), (1, b"two one"), (2, b"three one"), (3, None), (4, b""), (5, b"x" * 100 + b"one")]
    rows = spark.createDataFrame(data, "id int, data binary")
    found = {(r.id, r.rule, r.pattern, r.offset) for r in objects.pattern_hits(rows, rules, "id", most=100).collect()}
    assert found == {
        (0, "any", "$a", 0), (0, "any", "$a", 4), (0, "true", "$a", 0), (0, "true", "$a", 4), (0, "hex", "$h", 0), (0, "hex", "$h", 4),
        (1, "any", "$b", 0), (1, "any", "$a", 4), (1, "all", "$b", 0), (1, "all", "$a", 4), (1, "true", "$a", 4), (1, "hex", "$h", 4),
        (2, "any", "$a", 6), (2, "named", "$a", 6), (2, "named", "$b", 0), (2, "true", "$a", 6), (2, "hex", "$h", 6),
    }
    table = spark.createDataFrame([tuple(r.values()) for r in rules], objects.RULES)
    assert {(r.id, r.rule, r.pattern, r.offset) for r in objects.pattern_hits(rows, objects.rules_of(table), "id", most=100).collect()} == found
