"""Terms that disclose an entity, beyond its own line."""

import math
import random
import re
import time

from netloom.llm import pii


def test_terms_of_the_whole_document(spark):
    held = [f"note {i}\nName: Zorblax\nEmail: z@corp.com\nthing{i} was seen by Zorblax\nask about it" for i in range(6)]
    same = [f"item{i}\nwrite one two three four five six Quuxor q@corp.com" for i in range(4)]  # the contact line word for word
    rest = [f"note filler{i}\nName: other\nEmail: none\nwas seen by ask about it write one two three four five six" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(held + same + rest)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    for i in range(6):
        assert clean[i] == f"note {i}\nName: \nEmail: <EMAIL>\nthing{i} was seen by \nask about it"
    for i in range(4):
        assert clean[6 + i] == f"item{i}\nwrite one two three four five six  <EMAIL>"
    assert all(clean[10 + i] == rest[i] for i in range(200))


def test_spans_are_those_of_the_patterns():
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def holds(kind, m):
        digits = re.sub("[^0-9]", "", m)
        luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]

    rng = random.Random(7)
    for alphabet, n in (("12.", 60), ("0123456789.. ", 90), ("a1.@-% ", 60), ("+1(). -", 60), ("4 1-", 70)):
        for _ in range(400):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))
            expected = [(k, *m.span()) for k in pii.KINDS for m in re.finditer(plain[k], text) if holds(k, m[0])]
            assert pii.base_spans(text) == expected, text


def test_long_texts_take_linear_time():
    for text, n in (("7" * 1_000_000, 0), ("1.2." * 250_000, 125_000), ("a@" * 500_000, 0), ("+" * 500_000 + "1" * 500_000, 0), (" ".join(f"u{i}@host{i}.org" for i in range(10_000)), 10_000)):
        began = time.time()
        spans = pii.base_spans(text)
        pii._words(text, spans)
        assert time.time() - began < 5 and len(spans) == n


def test_disclosure_against_counts_by_hand(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.sample(words, rng.randint(2, 5)) + rng.choices(["a@b.co", "c@d.org", "10.0.0.1", ""], k=1)) for _ in range(120)]
    texts += [texts[0], texts[0], None, ""]
    found = {(r.doc_id): {(t.kind, texts[r.doc_id][t.start : t.end]) for t in r.terms or []} for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    parts = [(set(re.findall("w[0-9]+", t or "")), set(re.findall(r"\S*[@.]\S*", t or ""))) for t in texts]
    n, marks = len(texts), {}
    for e in {e for _, es in parts for e in es}:
        for w in words:
            with_both = [i for i, (ws, es) in enumerate(parts) if w in ws and e in es]
            n_e, n_w = sum(e in es for _, es in parts), sum(w in ws for ws, _ in parts)
            if len({texts[i] for i in with_both}) >= pii.SUPPORT:
                ratio = math.log2(n * len(with_both) / (n_e * n_w)) / math.log2(n / n_e)
                if ratio >= pii.GENERALISE:
                    marks[e, w] = "remove" if ratio >= pii.REMOVE else "generalise"
    assert len(texts) == len(found) and all(found[i] == {(marks[e, w], w) for e in es for w in ws if (e, w) in marks} for i, (ws, es) in enumerate(parts))
    tied = [f"only{i % 2} word{i} x@y.zz" for i in range(4)] + ["other"] * 4  # each of two terms with half of the entity's texts
    kinds = {r.doc_id: sorted((t.kind, t.start) for t in r.terms or []) for r in pii.find(spark.createDataFrame(list(enumerate(tied)), "doc_id long, text string")).collect()}
    assert len({str(kinds[i]) for i in range(4)}) == 1


def test_an_address_book_held_twice(spark):
    """10,000 addresses and 10,000 names in two texts: one class of entities meets the names once a text."""
    import time

    book = " ".join(f"name{i} p{i}@x{i % 97}.org" for i in range(10_000))
    rows = [(0, book), (1, f"{book} and more"), *((i, f"short text {i} with words") for i in range(2, 52))]
    began = time.time()
    found = {r.doc_id: r.terms for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).where("size(terms) > 0").collect()}
    assert {k: len(v) for k, v in found.items()} == {0: 10_000, 1: 10_000} and {t.kind for t in found[0]} == {"remove"} and time.time() - began < 60


def test_classes_give_what_entities_give(spark):
    """Terms by class against counts entity by entity, texts drawn at random with copies."""
    import math
    import random
    from collections import Counter

    rnd = random.Random(11)
    base = [" ".join([f"a{rnd.randrange(6)}@h.org" for _ in range(rnd.randrange(4))] + [f"t{rnd.randrange(25)}" for _ in range(8)] + [f"u{i}" for i in range(rnd.randrange(3))]) for i in range(40)]
    texts = base + [rnd.choice(base) for _ in range(15)] + ["filler words here"] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n, entities, words = len(texts), {}, {}
    for t in set(texts):
        entities[t] = {w for w in t.split() if "@" in w}
        words[t] = {w for w in t.split() if "@" not in w}
    copies = Counter(texts)
    expected = set()
    for e in set().union(*entities.values()):
        there = [t for t in entities if e in entities[t]]
        n_e = sum(copies[t] for t in there)
        for w in set().union(*(words[t] for t in there)) if len(there) >= 2 else ():
            both = [t for t in there if w in words[t]]
            n_et, n_t = sum(copies[t] for t in both), sum(copies[t] for t in words if w in words[t])
            ratio = math.log2(n * n_et / (n_e * n_t)) / math.log2(n / n_e)
            if len(both) >= 2 and ratio >= pii.GENERALISE:
                expected |= {(t, w, "remove" if ratio >= pii.REMOVE else "generalise") for t in both}
    got = {(texts[r.doc_id], texts[r.doc_id][t.start : t.end], t.kind) for r in pii.find(docs).where("terms is not null").collect() for t in r.terms}
    assert got == expected and len(expected) > 3
