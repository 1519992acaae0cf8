"""The operators against brute force and exact round trips on small tables, with nulls, repeats and empty tables."""

import base64
import hashlib
import io
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from netloom.llm import hnsw, lm_automaton, mixing, packing, pii, quality_crf, quality_divergence, simhash, warc
from netloom.llm.common import id_crc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, root string, id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ta", "ro", "mi", "Élu", "so", "den"]) for _ in range(rng.randint(1, 3)))
    prose = [" ".join(word() for _ in range(rng.randint(3, 90))) + ".\n" + " ".join(word() for _ in range(20)) for _ in range(40)]
    return [*prose, prose[0], prose[0] + " ta", None, "", "  \n\t ", "ta", "# $ %" * 50, "ro " * 3000, "+1 (201) 555-0123 a@b.co 10.0.0.1 4111 1111 1111 1111"]


def whole(text):
    """The ids of the contract: by the named library from the named file."""
    import public_tokenizers
    from tokenizers import Tokenizer

    named = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return np.array([*named.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or ""), "x", "y") for i, t in enumerate(texts())]
    rows += [rows[1], (None, "no id at all", "en", None, 5, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def test_simhash_against_all_pairs(docs):
    found = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert len(found) == docs.count()

    def brute(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = WORD.findall(w)
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    by_id = {r.doc_id: brute(r.text) for r in docs.collect() if r.doc_id is not None}
    assert all(fp % (1 << 64) == by_id[i] for i, fp, _ in found if i is not None)
    root = {i: i for i in by_id}
    for _ in by_id:
        for i in by_id:
            root[i] = min(root[j] for j in by_id if (by_id[i] ^ by_id[j]).bit_count() <= 3)
    assert all(c == root[i] for i, _, c in found if i is not None)


def test_links_survive_a_cut_tile(spark):
    rng = np.random.default_rng(0)
    prints = {int(x) for x in rng.integers(-(1 << 62), 1 << 62, 60)}
    prints |= {x ^ (1 << int(b)) for x in list(prints)[:30] for b in rng.integers(0, 60, 4)}
    rows = [(p, i) for i, p in enumerate(sorted(prints))]
    links = simhash.near_links(spark.createDataFrame(rows, "fp long, id long"), 3, tile_rows=2)
    got = {r.node: r.root for r in simhash.components(links).collect()}
    root = {p: p for p, _ in rows}
    for _ in range(8):
        for p in root:
            root[p] = min(root[q] for q in root if ((p ^ q) % (1 << 64)).bit_count() <= 3)
    assert all(got.get(p, p) == root[p] for p in root)


def test_simhash_takes_ids_of_any_type(spark, docs):
    named = docs.select(F.concat(F.lit("d"), F.lpad("doc_id", 4, "0")).alias("doc_id"), "text")
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(named).where("doc_id is not null").collect()}
    numbers = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).where("doc_id is not null").collect()}
    assert found == {f"d{i:04d}": f"d{c:04d}" for i, c in numbers.items()}


def test_dropping_near_duplicates_keeps_columns(docs):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 40 not in ids and 0 in ids and ids.count(1) == 1 and None in ids


def test_field_marginals_are_exact():
    rng = np.random.default_rng(1)
    field = quality_crf.LineField(rng.normal(size=quality_crf.N_FEATURES) * 0.3, rng.normal(size=(2, 2)))
    x, _ = quality_crf.line_features("one two.\nthree # four\n\nfive five five")
    s, n = quality_crf.with_neighbours(x) @ field.emission, len(x)
    assert np.allclose(s, quality_crf.emissions(x, field.emission))
    weight = {y: np.exp(sum(s[i] for i in range(n) if y >> i & 1) + sum(field.transitions[y >> i & 1, y >> (i + 1) & 1] for i in range(n - 1))) for y in range(1 << n)}
    exact = [sum(w for y, w in weight.items() if y >> i & 1) / sum(weight.values()) for i in range(n)]
    assert np.allclose(field.marginals(x), exact)


def test_field_learns_and_scores_all(spark, docs):
    good, bad = "The reader finds a calm sentence here.\nAnd one more, with words.", "@@ ## $$ ## @@\n%% && ## ||"
    rows = [(i, good if i % 2 else bad, i % 2) for i in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    field = quality_crf.fit(table.drop("quality"), table.drop("text"))
    scores = {r.doc_id: r.s for r in table.withColumn("s", quality_crf.scored(table, field)).collect()}
    assert all((s >= 0.5) == bool(i % 2) for i, s in scores.items())
    assert all(0 <= r.s <= 1 for r in docs.select(quality_crf.scored(docs, field).alias("s")).collect())
    assert quality_crf.fit(table.drop("quality").limit(0), table.drop("text")).score("") == 0.5


def test_lm_against_dictionaries(docs):
    got = lm_automaton.lm_scores(docs, id_crc("doc_id") % 7 == 2).collect()
    assert len(got) == docs.count()
    fold = lambda t: [w.encode().lower() for w in WORD.findall(t or "")] + [b"\n"]
    rows = [(r.doc_id, fold(r.text)) for r in docs.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c, pair, history = Counter(), Counter(), Counter()
    for i, t in rows:
        if not held(i):
            c.update(t)
            pair.update(zip([None, *t], t))
            history.update([None, *t[:-1]])
    n, v, k = sum(c.values()), len(c), lm_automaton.PRIOR
    p = lambda w: (c[w] + 1) / (n + v + 1)
    expected = sorted((str(i), len(t), sum(c[w] > 0 for w in t), round(sum(np.log10(p(w)) for w in t), 6), round(sum(np.log10((pair[h, w] + k * p(w)) / (history[h] + k)) for h, w in zip([None, *t], t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got) == expected
    assert {r.train_tokens for r in got} == {n}
    assert lm_automaton.lm_scores(docs.limit(0), F.lit(False)).count() == 0


def test_base_counts_and_divergence(docs):
    for text in texts():
        w = WORD.findall(text or "")
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")) if w else 0, len(lines) - len(set(lines)), len(covered))
        assert quality_divergence.base_counts(text) == expected
    p, q = np.array([3.0, 1, 0]), np.array([1.0, 1, 2])
    assert quality_divergence.js_distance(p, p) == 0 and 0 < quality_divergence.js_distance(p, q) < 1
    refs = quality_divergence.references(docs, least=100)
    by_hand: dict = {}
    for r in docs.collect():
        w = [x.encode().lower().decode() for x in WORD.findall(r.text or "")]
        for key in {None, r.lang}:
            by_hand.setdefault(key, Counter()).update(w)
    for r in refs.collect():
        expected = sorted(by_hand[r.key].items(), key=lambda x: (-x[1], x[0]))[: quality_divergence.COMMON]
        assert list(zip(r.words, r.counts)) == expected and r.total == sum(by_hand[r.key].values())
        assert sum(r.chars) == sum(len((d.text or "").encode()) for d in docs.collect() if r.key in (None, d.lang))
    assert {r.key for r in refs.collect()} == {None, "en"} and {r.key for r in quality_divergence.references(docs).collect()} == {None}
    out = quality_divergence.judged(docs, refs).select("doc_id", "judged.*").collect()
    assert len(out) == docs.count() and not any(r.kept and r.base_failed for r in out)
    known = {r.key: quality_divergence.reference(r.words, r.counts, r.total, r.chars) for r in refs.collect()}
    for d, r in zip(sorted(docs.collect(), key=str), sorted(quality_divergence.judged(docs, refs).collect(), key=str)):
        assert r.judged.kept == (not r.judged.base_failed and not known[d.lang].diverges(d.text))
    joined = quality_divergence.judged(docs, refs, held=0).select("doc_id", "judged.*").collect()
    assert sorted(map(str, joined)) == sorted(map(str, out))
    assert quality_divergence.judged(docs.limit(0), quality_divergence.references(docs.limit(0))).count() == 0


def test_any_number_of_languages(spark):
    rows = [(i, " ".join(f"{w}{i}" for w in "one two three four five six seven eight nine ten".split() * 3), f"l{i}") for i in range(513)]
    many = spark.createDataFrame([*rows, (900, rows[0][1], "l1"), (901, rows[0][1], "rare"), (902, rows[0][1], None)], "doc_id long, text string, lang string")
    refs = quality_divergence.references(many, least=30)
    assert refs.count() == 514 + 1
    kept = {r.doc_id: r.judged.kept for r in quality_divergence.judged(many, refs).collect()}
    assert not any(kept[i] for i in range(513))  # all repeat their words: the base fails


def test_pii_patterns_and_terms(spark, docs):
    text = "x@y a.b+c@d-e.org.uk, 10.0.0.256 1.2.3.4.5; +44 (20) 7946-0958; 4111-1111-1111-1111; 4111111111111112; @z.com"
    assert pii.joined(pii.base_spans(text)) == ",".join(
        f"{k}:{text.index(s)}:{text.index(s) + len(s)}" for k, s in [("email", "a.b+c@d-e.org.uk"), ("ip", "1.2.3.4"), ("card", "4111-1111-1111-1111"), ("phone", "+44 (20) 7946-0958")]
    )
    lines = [f"line {i} ask Zorblax at z@corp.com about thing{i}" for i in range(6)] + [f"filler line at {i} about ask" for i in range(200)]
    table = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = {r.doc_id: r.terms for r in pii.find(table).collect()}
    assert all([lines[i][t.start : t.end] for t in found[i]] == ["Zorblax"] for i in range(6)) and not any(found[i] for i in range(6, 206))
    clean = {r.doc_id: r.text for r in pii.sanitise(table).collect()}
    assert clean[0] == "line 0 ask  at <EMAIL> about thing0" and clean[50] == lines[50]
    assert pii.sanitise(docs).count() == docs.count() and pii.sanitise(docs).columns == docs.columns and pii.find(docs.limit(0)).count() == 0


def test_packing_is_whole_and_gapless(docs):
    rows = packing.packed(docs).collect()
    ends: dict[int, list] = {}
    for r in rows:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in ends.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SIZE
    assert sum(r.piece == 0 for r in rows) == docs.count()
    expected = sorted((str(d.doc_id), k, a, n, zlib.crc32(whole(d.text)[a : a + n].tobytes())) for d in docs.collect() for k, (a, n) in enumerate(packing.pieces_of(len(whole(d.text)))))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    assert packing.packed(docs.limit(0)).count() == 0


def test_ids_are_those_of_the_named_tokenizer():
    odd = ["q <|endoftext|> q", "<|endoftext|><|endoftext|>", "a  <|endoftext|>\n\n b", "<|endoftext", "don't  stop\u00a0\u3000 1\u00bd \u0661\u0662 na\u00efve \U0001f600 a\u200bb\t\r\n  x ", "\ufeffx", "  ", "\u1680\u2028y"]
    encode = packing.encoder().encode_to_numpy
    assert all([*encode(t, allowed_special="all"), packing.END_ID] == whole(t).tolist() for t in [*odd, *filter(None, texts())])


@pytest.mark.parametrize("low, high, n", [(250, 500, 120), (300, 520, 60)])
def test_crossover_beats_the_packing_it_starts_from(low, high, n):
    lens = np.random.default_rng(0).integers(low, high, n)
    start = packing.put(np.argsort(-lens, kind="stable"), lens)
    first = packing.evolve(lens, 1, generations=0)
    best = packing.evolve(lens, 1, generations=40)
    assert len(best.fill) < len(start.fill) and best.score > first.score
    assert (np.bincount(best.at, lens) == best.fill).all() and best.fill.max() <= packing.SIZE


def test_genes_stay_whole():
    rng = np.random.default_rng(5)
    lens = rng.integers(1, 700, 300)
    a, b = packing.put(np.arange(300), lens), packing.evolve(lens, 1)
    child = packing.crossover(a, b, lens, rng)
    assert (np.bincount(child.at, lens) == child.fill).all() and child.fill.max() <= packing.SIZE and len(child.at) == 300
    genes = lambda x: {frozenset(np.flatnonzero(x.at == i)) for i in range(len(x.fill))}
    assert genes(child) & genes(b)
    at, settled = packing.settle(lens)
    assert all(lens[settled & (at == i)].sum() == packing.SIZE for i in range(at[settled].max() + 1))


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400 + i, x[0].tolist()) for i in range(20)]
    rows += [(500, None), (501, [0.0] * 8), (502, [1.0, None] + [0.0] * 6), (503, [float("nan")] * 8), (None, x[1].tolist()), (504, [1.0, 2.0])]
    got: dict[int, list] = {}
    for r in hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    ids, all_x = [r[0] for r in rows[:420]], np.array([r[1] for r in rows[:420]])
    unit = all_x / np.linalg.norm(all_x, axis=1, keepdims=True)
    hits = total = 0
    for i in ids:
        if i % 20 == 0:
            near = sorted((j for j in ids if j != i), key=lambda j: (-round(float(unit[ids.index(i)] @ unit[ids.index(j)]), 12), j))[:5]
            hits, total = hits + len(set(near) & set(got[i])), total + 5
    assert hits / total >= 0.9 and got[0] == [400, 401, 402, 403, 404] and 500 not in got


def test_nearest_over_many_shards_and_dimensions(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 128)
    monkeypatch.setattr(hnsw, "QUERY_ROWS", 16)
    monkeypatch.setattr(hnsw, "TURN_BLOCKS", 2)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1600, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + d, [1.0] * (20 + d)) for d in range(60)] + [(6000 + d, [1.0] * (19 + d) + [2.0]) for d in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for k in (5, 200):
        got: dict[int, list] = {}
        for r in hnsw.nearest(table, (F.col("vec_id") % 50 == 0) | (F.col("vec_id") >= 5000), k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        hits = [len(set(np.argsort(-(unit @ unit[i]), kind="stable")[1 : k + 1].tolist()) & {j for j, _ in got[i]}) / k for i in range(0, 1600, 50)]
        assert np.mean(hits) >= 0.9 and all(len(got[i]) == k for i in range(0, 1600, 50))
        for i in range(60):  # a dimension with two vectors
            assert [j for j, _ in got[5000 + i]] == [6000 + i]
    assert all(s == float(x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j]))) or abs(s - unit[i] @ unit[j]) < 1e-12 for i in (0, 50) for j, s in got[i])


def test_nearest_of_extreme_vectors(spark):
    rows = [(0, [1e-200, 1e-200]), (1, [1e-200, 2e-200]), (2, [1e200, 1e200]), (3, [1.0, 2.0]), (4, [5e-324, 0.0]), (5, [1e308, -1e308])]
    got = [(r.vec_id, round(r.score, 6)) for r in hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(2, 1.0), (1, 0.948683), (3, 0.948683), (4, 0.707107), (5, 0.0)]
    assert hnsw.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).count() == 0


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "é" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    archives = warc.write_archives(pages, f"file://{tmp_path}/w")
    got = {r.record_id: r for r in warc.read_archives(archives).collect()}
    assert {k[-2]: r.type for k, r in got.items()} == {"1": "revisit", "2": "response", "3": "revisit", "4": "response", "5": "response"}
    five = next(r for k, r in got.items() if k.endswith(":5>"))
    assert bytes(five.payload).decode() == "é" * 500 and five.payload_digest == base64.b32encode(hashlib.sha1(("é" * 500).encode()).digest()).decode()
    assert warc.read_archives(warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def plain(block, kind="resource", **more):
    return warc.record_bytes([("WARC-Type", kind), ("WARC-Block-Digest", "sha1:" + warc.digest32(block)), *more.items()], block)


def test_salvage_recovers_later_records():
    good = [warc.member(plain(b"x" * i)) for i in (5, 6, 7)]
    broken = bytearray(good[1])
    broken[len(broken) // 2] ^= 0xFF
    cases = [([good[0], bytes(broken), good[2]], [5, 7]), ([good[0], b"junk", plain(b"x" * 6), good[2][:-9]], [5, 6]), ([plain(b"x" * 5)[:-7], plain(b"x" * 7)], [7]), ([b""], [])]
    cases += [([plain(b"x" * 5).replace(b"xxxxx", b"xxxxy"), good[2]], [7]), ([warc.member(plain(b"x" * 5) + b"more"), good[2]], [7]), ([plain(b""), warc.member(plain(b""))], [0, 0])]
    for parts, expected in cases:
        reader = warc.Salvage(io.BytesIO(b"".join(parts)))
        records = list(reader)
        assert [r.payload_bytes for r in records] == expected and all(r.payload == b"x" * n for r, n in zip(records, expected))
        assert sum(r.length for r in records) + sum(n for _, n, _ in reader.gaps) == len(b"".join(parts))


def test_salvage_against_every_cut():
    """Whatever byte is cut or changed, records that are whole elsewhere come back."""
    parts = [warc.member(plain(b"one")), plain(b"two" * 3), warc.member(plain(b"GET / HTTP/1.1\r\n\r\nbody", "response", **{"Content-Type": "application/http"}))]
    data = b"".join(parts)
    sizes = [r.payload_bytes for r in warc.Salvage(io.BytesIO(data))]
    assert sizes == [3, 9, 4]
    ends = np.cumsum([len(p) for p in parts])
    for at in range(len(data)):
        hit = int(np.searchsorted(ends, at, side="right"))
        for odd in (data[:at] + data[at + 1 :], data[:at] + bytes([data[at] ^ 0x20]) + data[at + 1 :]):
            found = [r.payload_bytes for r in warc.Salvage(io.BytesIO(odd))]
            assert [n for k, n in enumerate(sizes) if k != hit] == found or sizes == found, (at, found)


class Counting(io.BytesIO):
    most = total = 0

    def read(self, n=-1):
        out = super().read(n)
        Counting.most, Counting.total = max(Counting.most, len(out)), Counting.total + len(out)
        return out


def test_salvage_is_bounded_and_linear():
    false_length = plain(b"x" * 9).replace(b"Content-Length: 9", b"Content-Length: 19999999")
    filler = b"".join(plain(b"y" * 1000) for _ in range(20_000))
    Counting.most = Counting.total = 0
    records = sum(1 for _ in warc.Salvage(Counting(false_length + filler), with_payload=False))
    assert records == 20_000 and Counting.most <= 2 * warc.PIECE and Counting.total < 3 * len(filler)
    big = warc.member(plain(b"z" * (1 << 26)))  # inflates to 64 MB
    reader = warc.Salvage(Counting(big), with_payload=False)
    assert [r.payload_bytes for r in reader] == [1 << 26] and not reader.gaps
    for junk in (b"WARC/1.0\r\n" * 100_000, b"WARC/1.1\r\na: b\r\n" * 50_000, warc.GZIP * 100_000, b"WARC/1." * 100_000):
        began = time.time()
        reader = warc.Salvage(io.BytesIO(junk + plain(b"end")))
        assert [r.payload for r in reader] == [b"end"] and reader.gaps[0][:2] == (0, len(junk)) and time.time() - began < 8


def test_raking_meets_margins(spark, docs):
    cells = spark.createDataFrame([(s, x, t, 10 + 3 * s + 7 * x + t) for s in range(3) for x in range(2) for t in range(2)], "source long, lang long, topic long, tokens long")
    target = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 2.0)], "source long, target double")
    out = mixing.rake(cells, targets={"source": target}).toPandas()
    assert np.allclose(out.groupby("source").weight.sum(), [0.25, 0.25, 0.5], atol=2e-3) and abs(out.weight.sum() - 1) < 1e-9
    many = mixing.rake(cells, targets={"source": target}, few=0).toPandas()
    key = ["source", "lang", "topic"]
    assert np.allclose(out.sort_values(key).weight, many.sort_values(key).weight)
    share = cells.toPandas().groupby("lang").tokens.sum() ** mixing.TEMPERATURE
    assert np.allclose(out.groupby("lang").weight.sum(), share / share.sum(), atol=2e-3)
    mixed = mixing.mixed(docs).toPandas()
    assert len(mixed) == docs.count() and mixed.probability.between(0, 1).all() and not mixed[mixed.n_tokens == 0].sampled.any()
    for text, topic in (("a|b|c", "table"), ("1 2 3 4 5", "figures"), ("a\nb\nc", "lines"), ("é" * 700, "prose"), ("x" * 7000, "long prose"), (None, "note"), ("", "note")):
        row = spark.createDataFrame([(text,)], "text string").select(mixing.measured("text").alias("m")).first().m
        assert (row.n_tokens, row.topic) == (len((text or "").split()), topic)
    # expected tokens follow the weights, and the draw follows the probabilities
    big = spark.range(20000).selectExpr("id as doc_id", "concat('a b ', id % 7) as text", "concat('s', id % 2) as source", "if(id % 10 = 0, 'x', 'y') as lang")
    drawn = mixing.mixed(big).toPandas()
    goal = mixing.KEEP * drawn.n_tokens.sum()
    assert abs((drawn.probability * drawn.n_tokens).sum() - goal) <= 2e-3 * goal and abs((drawn.sampled * drawn.n_tokens).sum() - goal) < 0.03 * goal
    assert np.allclose(drawn.groupby("lang").sampled.mean(), drawn.groupby("lang").probability.mean(), atol=0.03)
    with pytest.warns(UserWarning, match="can't all be met"):
        odd = spark.createDataFrame([(0, 0, 0, 5), (1, 1, 0, 5)], "source long, lang long, topic long, tokens long")
        mixing.rake(odd, targets={"source": target, "lang": spark.createDataFrame([(0, 3.0), (1, 1.0)], "lang long, target double")})
    assert mixing.sample(docs).columns == docs.columns and mixing.sample(docs.limit(0)).count() == 0
