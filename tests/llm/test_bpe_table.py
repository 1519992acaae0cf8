"""Ids and texts against the tokenizers library itself."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from netloom.llm import bpe_table
from tests.llm.test_queries import folder, rows  # noqa: F401

ODD = [
    "", " ", "  ", "a", " a  b ", "it's we'll I'D they've 'tis", "<|endoftext|>", "a  <|endoftext|><|endoftext|> b!!<|endoftext|>", "<|endoftext", "x\n\n\ny \t z\r\n", "漢字かな 한글 ١٢٣ ½ Ⅷ", "  x　\u0085y",
    "emoji 👩‍👩‍👧 ü é", "new letters ࡰᲉ\U00010d40 \U0001e4d0a͸ <|endoftext|>", "￾￿ ﷐", "1a2b 3.14 --- ___", "\x00\x01\x7f", "ab" * 3000, "'s's 'S", " ​﻿",
]


@pytest.fixture(scope="module")
def named():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected(named, text):
    ids = named.encode(text or "", add_special_tokens=False).ids
    return ids, named.decode(ids, skip_special_tokens=False)


def test_texts_as_the_library(spark, named):
    docs = spark.createDataFrame([(t, i, "x") for i, t in enumerate([*ODD, None])], "body string, ids int, decoded string").repartition(3)
    for words in (1, 50, 1 << 23):  # many slabs, and one
        found = bpe_table.bpe_round_trip(docs, "body", slab_words=words).collect()
        assert len(found) == len(ODD) + 1
        for r in found:
            assert (r.ids_, r.decoded_) == expected(named, [*ODD, None][r.ids]), r.ids


def test_every_character(spark, named):
    """All of Unicode, a few hundred characters a text, between letters, digits and spaces."""
    marks = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c}a{c} {c}1  {c}" for c in marks[i : i + 400]) for i in range(0, len(marks), 400)]
    found = bpe_table.bpe_round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(found) == len(texts) and all(r.decoded == texts[r.doc_id] and r.ids == expected(named, texts[r.doc_id])[0] for r in found)


def test_decode_takes_any_ids(spark, named):
    given = [(0, [464, 50256, 995]), (1, []), (2, None), (3, [160, 254, 120, 160]), (4, [99999, 464])]
    found = {r["n"]: r.text_ for r in bpe_table.decode(spark.createDataFrame([(n, i, "x") for n, i in given], "n int, ids array<int>, text string")).collect()}
    assert found == {n: named.decode([i for i in ids or [] if i < 50257], skip_special_tokens=False) for n, ids in given}


def test_only_plain_byte_level_bpe():
    with pytest.raises(ValueError, match="byte-level"):
        bpe_table.definition_of(public_tokenizers.path("word_bpe_49k.json"))


def row_of(named, doc_id, text):
    ids, decoded = expected(named, text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(ids), sha(",".join(map(str, ids))), sha(decoded))


def test_op13(spark, rows, folder, named):  # noqa: F811
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert sorted(map(str, (tuple(r) for r in rows("op13_bpe")))) == sorted(str(row_of(named, r.doc_id, r.text)) for r in docs)


def test_op13_on_the_given_documents(spark, named):
    at = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet").collect()
    assert {tuple(r) for r in bpe_table.op13_bpe(spark, at).collect()} == {row_of(named, r.doc_id, r.text) for r in docs}
