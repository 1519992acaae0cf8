"""Every query of the subpackage over small tables of a folder: contracted columns, nulls, repeats, clashing names, empty tables."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from netloom.llm import packing, pii, quality_divergence
from netloom.llm.queries import queries

PROSE = "The council met on Monday to talk about the bridge. Engineers found cracks in two piers.\nRepairs will take longer than was hoped, and the road stays closed."
JUNK = "@@ ## $$ ## @@ %% && ##\n!! ## && %% ## @@"
TEXTS = [PROSE, PROSE, f"{PROSE} More words follow here.", JUNK, None, "", " \n\t", "mail a.b@c.org or 10.0.0.1, card 4111 1111 1111 1111, +44 20 7946 0958", "word " * 5000, "é ÀB äö 漢字", "a <|endoftext|> b"] + [f"note {i}: {PROSE[i : i + 90]} {i * i}" for i in range(24)]
TURNS = [(c, t, ["system", "user", "assistant", "tool", None, ""][(c * 7 + t * 5) % 6 if c % 4 else 1 + t % 2], [None, "", "So it is.", "And then", " ok! \n", f"Turn {t}?"][(c + t * 3) % 6]) for c in range(60) for t in range(c % 9)]
TURNS += [(None, 1, "user", "Who?"), (None, None, "assistant", None), (7, None, "user", "first."), (7, None, "user", "first."), TURNS[20]]
CLASH = ("score", "held_out", "n_words", "kept", "n_email", "spans", "piece", "sequence_id", "offset", "fingerprint", "component_id", "n_tokens", "topic", "weight", "probability", "sampled", "id", "key", "root", "terms", "predicted", "runs", "collapsed", "ids", "decoded", "row", "data", "slab", "words")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('tables')}"
    documents = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)]
    documents += [documents[1], (None, PROSE, "en", "s1", 5), (None, None, None, None, None)]
    extra = ", ".join(f"`{c}` string" for c in CLASH)
    rows = [(*d, *["x"] * len(CLASH)) for d in documents]
    spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 0 if i == 3 else 1, 0) for i in range(0, len(TEXTS), 1) if i not in (4, 5, 6)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    page = lambda i: f"<html><body><nav><a href=x>Home</a></nav><article><h1>T{i}</h1><p>{PROSE}</p></article><footer>foot</footer></body></html>"
    pages = [(i, f"http://h/{i}", page(i)) for i in range(30)] + [(30, None, page(1)), (31, "u", None), (32, "u", ""), (None, "u", page(2)), (5, "http://h/5", page(5))]
    spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, text string, n_chars int").write.parquet(f"{at}/pages.parquet")
    rng = np.random.default_rng(3)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(230, 6)))] + [(300, None), (350, [0.0] * 6), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6), (50, rng.normal(size=6).tolist())]
    spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<double>, score string").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(*r, "x", "x") for r in TURNS], "conv_id long, turn long, role string, text string, audit string, place string").repartition(3).write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.fixture(scope="module")
def rows(spark, folder):
    known, held = queries(), {}

    def get(name):
        if name not in held:
            held[name] = known[name](spark, folder).collect()
        return held[name]

    return get


def whole(text):
    """The ids of the contract: by the named library from the named file."""
    import public_tokenizers
    from tokenizers import Tokenizer

    named = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return np.array([*named.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def all_ids(found, column="doc_id"):
    return sorted(("" if r[column] is None else str(r[column])) for r in found)


DOC_IDS = sorted([str(i) for i in range(len(TEXTS))] + ["1", "", ""])
TEXT_OF = dict(enumerate(TEXTS))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_op1_columns(rows):
    found = rows("op1_quality")
    assert all_ids(found) == DOC_IDS and all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)


def test_op2_columns(rows):
    found = rows("op2_lm")
    assert all_ids(found) == DOC_IDS and all(r.held_out == (crc(r.doc_id) % 7 == 2) and r.score <= 0 and r.base_score <= 0 for r in found)
    assert all(r.n_tokens == len(words(TEXT_OF.get(r.doc_id))) + 1 for r in found if r.doc_id is not None)


def test_op3_columns(rows):
    found = rows("op3_divergence")
    assert all_ids(found) == DOC_IDS
    for r in found:
        if r.doc_id is not None:
            expected = quality_divergence.base_counts(TEXT_OF[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected and r.base_failed == quality_divergence.base_failed(expected[0], expected[4]) and not (r.kept and r.base_failed)


def test_op4_columns(rows):
    found = rows("op4_pii")
    assert all_ids(found) == DOC_IDS
    for r in found:
        if r.doc_id is not None:
            base = pii.base_spans(TEXT_OF[r.doc_id])
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
            assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest() and r.spans.startswith(pii.joined(base))
    assert [next(r for r in found if r.doc_id == 7)[f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1]


def test_op5_columns(rows):
    found = rows("op5_packing")
    expected = [(str(i) if i is not None else "", k, a, n, zlib.crc32(whole(t)[a : a + n].tobytes())) for i, t in [*enumerate(TEXTS), (1, TEXTS[1]), (None, PROSE), (None, None)] for k, (a, n) in enumerate(packing.pieces_of(len(whole(t))))]
    assert sorted(("" if r.doc_id is None else str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(expected)
    places: dict[int, list] = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 1024 and [a for a, _ in sorted(p)] == np.cumsum([0] + [n for _, n in sorted(p)])[:-1].tolist() for p in places.values())


def test_op6_columns(rows, spark, folder):
    found = rows("op6_hnsw")
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    assert {r.query_id for r in found} == {i for i in range(0, 230, 50)} and all(r.vec_id != r.query_id for r in found)
    by_query: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        by_query.setdefault(r.query_id, []).append((r.score, r.vec_id))
    once = {r.vec_id: np.array(r.embedding) for r in table if r.vec_id is not None and r.vec_id < 230 and r.vec_id != 50}
    hits = total = 0
    for q, near in by_query.items():
        assert near == sorted(near, key=lambda x: (-x[0], x[1])) and len(near) == 5
        if q != 50:
            cosine = {i: float(once[q] @ v / np.linalg.norm(once[q]) / np.linalg.norm(v)) for i, v in once.items() if i != q}
            hits, total = hits + len(set(sorted(cosine, key=lambda i: -cosine[i])[:5]) & {i for _, i in near} | set()) , total + 5
            assert all(abs(s - cosine[i]) < 1e-12 for s, i in near if i in cosine)
    assert hits / total >= 0.8  # a query's own neighbours may include the doubled id 50


def test_op7_columns(rows):
    found = rows("op7_html")
    assert len(found) == 35 and all(r.n_chars == len(r.text) for r in found) and {r.text for r in found if r.page_id in (31, 32)} == {""}
    good = "\n".join(" ".join(PROSE.split("\n")).split("\n"))
    assert sum(r.text == f"T{r.page_id}\n{good}" for r in found if r.page_id is not None and r.page_id < 30) >= 28


def test_op8_columns(rows):
    found = rows("op8_mixing")
    assert all_ids(found) == DOC_IDS and all(0 <= r.probability <= 1 and r.n_tokens == len(words(TEXT_OF.get(r.doc_id))) for r in found if r.doc_id is not None)
    assert abs(sum({(r.source, r.lang, r.topic): r.weight for r in found}.values()) - 1) < 1e-9


def test_op9_columns(rows, spark, folder):
    found = {}
    for r in rows("op9_warc"):
        found.setdefault(r.page_id, []).append(r)
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert sum(map(len, found.values())) == len(pages)
    largest: dict[bytes, int] = {}
    for p in pages:
        if p.page_id is not None:
            data = (p.html or "").encode()
            largest[data] = max(largest.get(data, -1), p.page_id)
    for p in pages:
        data = (p.html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        for r in found[p.page_id]:
            assert (r.payload_bytes, r.payload_digest) == (len(data), digest)
            if p.page_id is not None:
                head = largest[data]
                assert (r.record_type, r.refers_to) == (("response", None) if p.page_id == head else ("revisit", head))


def test_op10_columns(rows):
    found = rows("op10_simhash")
    assert all_ids(found) == DOC_IDS

    def brute(text):
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"

    assert all(r.fingerprint == brute(TEXT_OF[r.doc_id]) for r in found if r.doc_id is not None)
    component = {r.doc_id: r.component_id for r in found}
    assert component[1] == component[0] == 0 and component[4] == component[5] == component[6] == 4


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    for name, query in queries().items():
        assert query(spark, f"file://{tmp_path}").count() == 0, name


def test_pipeline_runs_whole(spark, folder):
    """run() is its stages one after the other, and each stage's rows are those of a plain version of it."""
    from netloom.llm import near_copies, quality_crf
    from netloom.llm.common import table

    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    field = quality_crf.fit(docs, table(spark, folder, "labels"))
    good = corpus_pipeline.quality(spark, docs, folder).cache()
    assert sorted(map(str, good.collect())) == sorted(str(r) for r in docs.collect() if field.score(r.text) >= 0.5)
    kept = near_copies.drop_near_copies(docs).cache()
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [words((t or "").lower())] for i in range(max(1, len(w) - 4))} if words(t) else set()
    ids = sorted({r.doc_id for r in docs.collect() if r.doc_id is not None})
    root = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            a = shingles(TEXT_OF[i])
            root[i] = min(root[j] for j in ids if (not a and not shingles(TEXT_OF[j])) or (a and len(a & shingles(TEXT_OF[j])) >= 0.8 * len(a | shingles(TEXT_OF[j])) - 1e-9) or i == j)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [i for i in ids if root[i] == i]
    clean = corpus_pipeline.privacy(spark, docs, folder).collect()
    assert len(clean) == docs.count() and next(r.text for r in clean if r.doc_id == 7) == "mail <EMAIL> or <IP>, card <CARD>, <PHONE>"
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in clean)
    some = corpus_pipeline.mixture(spark, docs, folder)
    assert some.columns == docs.columns and set(map(str, some.collect())) <= set(map(str, docs.collect()))
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and {r.doc_id for r in out} <= set(ids) | {None}
