"""The pipeline's near copies against all pairs."""

import random

import corpus_pipeline
from netloom.llm import minhash

WORDS = [f"w{i}" for i in range(3000)]


def shingles(text, width=5):
    words = text.lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def test_stage_meets_all_pairs(spark, monkeypatch):
    rng = random.Random(7)
    texts = []
    for _ in range(20):
        base = rng.choices(WORDS, k=rng.randint(60, 400))
        texts.append(base)
        for edits in (1, 2, 4, 8, 16, 30):
            copy = list(base)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = "edited"
            texts.append(copy)
    texts = [" ".join(t) for t in texts] + ["", " ", "one two", "One  two"]
    root, sets = list(range(len(texts))), [shingles(t) for t in texts]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) / len(a | b) >= 0.8 and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = {i for i, r in enumerate(root) if i == r}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want
    monkeypatch.setattr(minhash, "PART_ROWS", 3)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == dict(enumerate(root))
