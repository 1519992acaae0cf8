"""Byte-level BPE of whole texts through a table of distinct words, and back through a table of pieces.

Spark's own regular expressions split the texts into the words that BPE works on. What is shuffled is prepared in slabs of
a few million words: a slab numbers its distinct words, most frequent first, and holds each text as numbers, so a word
leaves the slab once, not once a place. The slabs' words meet by buckets of their hash, where each distinct word is
encoded once, and the ids go back to the slabs, where numbers become ids place by place. Slabs are written in buckets, so the
ids come to the texts, and the texts stay where they are. Decoding joins the
slab's distinct ids with the table of pieces and puts the pieces in the ids' places.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import arrow_batches, bounded, free_name, in_buckets, materialise, table

#: Words of a slab: a slab and its result are one task's memory. Buckets of the words' hashes: a bucket's distinct words are.
SLAB_WORDS, BUCKETS = 3 << 20, 1024
#: Bytes of texts that come to a task, and texts that its slab takes on, at once.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 500
#: Words of a slab that are packed at once, and words whose ids are put in place at once.
PACKED_WORDS, PLACED_WORDS = 1 << 20, 1 << 18

_SPACE = r"\t-\r\x85\p{Z}"
#: The words of byte-level BPE: contractions, letters, numbers and other signs with a space before them, white space.
#: White space is all but its last character where a word follows.
WORDS = rf" ?\p{{L}}++| ?\p{{N}}++|'(?:[stmd]|re|ve|ll)| ?[^{_SPACE}\p{{L}}\p{{N}}]++|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Characters that this JVM's Unicode doesn't know; the tokenizer's may. Their texts are split by the library.
UNKNOWN = r"\p{Cn}"


@lru_cache(maxsize=2)
def _loaded(definition: str):
    """The tokenizer and its added tokens, longest first."""
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_str(definition)
    loaded.no_truncation()
    loaded.no_padding()
    added = {t["content"]: t["id"] for t in json.loads(definition)["added_tokens"]}
    return loaded, dict(sorted(added.items(), key=lambda t: -len(t[0])))


def definition_of(path: str | None = None) -> str:
    """The text of a tokenizer's file; path None is the public byte_bpe_50k.json. Tasks get the text, not the path."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    known = json.loads(definition)
    plain = known["normalizer"] is None and known["model"]["type"] == "BPE" and known["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in known["added_tokens"]):
        raise ValueError("only byte-level BPE without a normalizer, prefix space or added tokens that take white space along")
    return definition


def _alphabet() -> dict[int, str]:
    """Byte to character, as byte-level vocabularies write them: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_CHARS = str.maketrans({chr(b): c for b, c in _alphabet().items()})
_BYTES = str.maketrans({c: chr(b) for b, c in _alphabet().items()})


def _as_bytes(piece: str) -> bytes:
    """The bytes that a piece of the vocabulary stands for; one with other characters stands for its own."""
    plain = piece.translate(_BYTES)
    return plain.encode("latin-1") if plain.isascii() or max(plain) <= "\xff" else piece.encode("utf-8")


def words_of(text: str | Column, definition: str) -> Column:
    """The words of a text in order; an added token is a word. Null has none."""
    text = F.col(text) if isinstance(text, str) else text
    words = lambda c: F.regexp_extract_all(c, F.lit(WORDS), F.lit(0))
    added = _loaded(definition)[1]
    if added:
        any_of = "|".join(re.escape(t) for t in added)
        marks = F.regexp_extract_all(text, F.lit(any_of), F.lit(0))
        cut = F.flatten(F.zip_with(F.split(text, any_of, -1), marks, lambda part, mark: F.concat(words(part), F.array_compact(F.array(mark)))))
        found = F.when(text.rlike(any_of), cut).otherwise(words(text))
    else:
        found = words(text)
    return F.coalesce(found, F.array().cast("array<string>"))


def library_words(text: str, definition: str) -> list[str]:
    """words_of by the library's own splitter."""
    loaded, added = _loaded(definition)
    parts = re.split("(" + "|".join(map(re.escape, added)) + ")", text) if added else [text]
    return [w for part in parts for w in ([part] if part in added else [part[a:b] for _, (a, b) in loaded.pre_tokenizer.pre_tokenize_str(part)])]


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers of a few bits mostly, 28 at most: seven bits a byte, the last byte of a number below 128, compressed."""
    n = 1 + (numbers >= 1 << 7) + (numbers >= 1 << 14) + (numbers >= 1 << 21)
    starts = np.cumsum(n) - n
    out = np.empty(n.sum(), np.uint8)
    for k in range(4):
        longer = n > k
        out[starts[longer] + k] = (numbers[longer] >> 7 * k) & 127 | (n[longer] > k + 1) << 7
    return zstandard.compress(out.tobytes(), 3)


def _unpacked(data: bytes) -> np.ndarray:
    read = np.frombuffer(zstandard.decompress(data), np.uint8).astype(np.int32)
    ends = np.flatnonzero(read < 128)
    starts = np.r_[0, ends + 1][: len(ends)]
    out = read[starts] & 127
    for k in range(1, 4):
        longer = ends - starts >= k
        out[longer] |= (read[starts[longer] + k] & 127) << 7 * k
    return out


def _slabs(definition: str, slab_words: int):
    """Texts as numbers: a slab is rows of kind 0 (the bucket of each number's word), 1 (a text's place among the slab's words,
    and its size), 2 (a bucket's words, in the order of their numbers, and the sizes of these in bytes) and 3 (numbers from a place on).
    A slab's own number is drawn at random, so the rows are to be written once."""

    def rows(slab, kind, n, row_type, **columns):
        out = pa.schema([("slab", pa.int64()), ("kind", pa.int32()), ("row", row_type), ("place", pa.int64()), ("size", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary()), ("sizes", pa.binary())])
        given = {"slab": pa.array(np.full(n, slab)), "kind": pa.array(np.full(n, kind, np.int32)), **columns}
        return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(n, f.type) for f in out], schema=out)

    def slab_of(held):
        row_type = held[0][0].type
        slab = int(np.random.default_rng().integers(1 << 63))
        coded = pa.concat_arrays([words for _, _, words in held]).dictionary_encode()
        index, words = coded.indices.to_numpy(), coded.dictionary
        order = np.argsort(-np.bincount(index, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words))
        codes, words = rank[index], words.take(pa.array(order)).to_pylist()
        buckets = (pd.util.hash_array(np.asarray(words, object), categorize=False) % BUCKETS).astype(np.int32) if words else np.zeros(0, np.int32)
        yield rows(slab, 0, 1, row_type, data=pa.array([_packed(buckets)]))
        at = 0
        for row, sizes, _ in held:
            yield rows(slab, 1, len(row), row_type, row=row, place=pa.array(at + np.cumsum(sizes) - sizes), size=pa.array(sizes))
            at += int(sizes.sum())
        for at in range(0, len(codes), PACKED_WORDS):
            yield rows(slab, 3, 1, row_type, place=pa.array([at]), data=pa.array([_packed(codes[at : at + PACKED_WORDS])]))
        by_bucket = np.argsort(buckets, kind="stable")
        held_buckets, starts = np.unique(buckets[by_bucket], return_index=True)
        parts = [[words[i].encode() for i in part] for part in np.split(by_bucket, starts[1:])] if words else []
        data = [zstandard.compress(b"".join(part), 3) for part in parts]
        sizes = [_packed(np.array([len(w) for w in part])) for part in parts]
        yield rows(slab, 2, len(parts), row_type, bucket=pa.array(held_buckets, pa.int32()), data=pa.array(data, pa.binary()), sizes=pa.array(sizes, pa.binary()))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in (part for whole in batches for part in (whole.slice(at, BATCH_ROWS) for at in range(0, whole.num_rows, BATCH_ROWS))):
            words, raw = batch.column("words"), batch.column("raw")
            if raw.null_count < len(raw):
                own = [library_words(r, definition) if r is not None else w for r, w in zip(raw.to_pylist(), words.to_pylist())]
                words = pa.array(own, words.type)
            held.append((batch.column("row"), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64), words.flatten()))
            size += len(held[-1][2])
            if size >= slab_words:
                yield from slab_of(held)
                held, size = [], 0
                pa.default_memory_pool().release_unused()
        if held:
            yield from slab_of(held)

    return work


_BLOCK = "slab long, bucket int, counts binary, ids binary"


def _encoded(definition: str):
    """_BLOCK rows for the words of (slab, bucket), sorted by bucket: each distinct word of a bucket is encoded once."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, added = _loaded(definition)
        bucket, ids_of = None, {}
        for batch in batches:
            counts, ids = [], []
            for now, data, sizes in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), batch.column("sizes").to_pylist()):
                if now != bucket:
                    bucket, ids_of = now, {w.encode(): [i] for w, i in added.items()}
                data, ends = zstandard.decompress(data), np.cumsum(_unpacked(sizes)).tolist()
                words = [data[a:b] for a, b in zip([0, *ends], ends)]
                for word in words:
                    if word not in ids_of:
                        ids_of[word] = [t.id for t in loaded.model.tokenize(word.decode("latin-1").translate(_CHARS))]
                found = [ids_of[w] for w in words]
                counts.append(_packed(np.array([len(f) for f in found])))
                ids.append(_packed(np.array([i for f in found for i in f])))
            yield pa.RecordBatch.from_arrays([batch.column("slab"), batch.column("bucket"), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())], names=["slab", "bucket", "counts", "ids"])

    return work


def _used(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slab, id) of the ids that blocks hold, each once a batch and slab."""
    for batch in batches:
        held: dict[int, list] = {}
        for slab, ids in zip(batch.column("slab").to_pylist(), batch.column("ids").to_pylist()):
            held.setdefault(slab, []).append(_unpacked(ids))
        for slab, ids in held.items():
            once = np.unique(np.concatenate(ids)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(once), slab)), pa.array(once)], names=["slab", "id"])


def _gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of values that begin at starts, one after the other."""
    return values[np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]


def _joined(packed: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int32), *(_unpacked(p) for p in packed.to_pylist())])


def _texts(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    joined = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    try:
        return joined.cast(pa.large_string())
    except pa.ArrowInvalid:  # ids that are no text's
        return pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.large_string())


def _placed(texts: pa.Table, found: pa.Table) -> pa.Table:
    """A slab's texts with the ids of their words and the text that the ids' pieces make."""
    schema = pa.schema([("row", texts.schema.field("row").type), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    if not texts.num_rows:
        return schema.empty_table()
    of_kind = lambda kind: texts.filter(pc.equal(texts["kind"], kind))
    order = np.argsort(_joined(of_kind(0)["data"]), kind="stable")
    codes = _joined(of_kind(3).sort_by("place")["data"])
    blocks = found.filter(pc.is_valid(found["bucket"])).sort_by("bucket")
    counts, ids = np.zeros(len(order), np.int64), _joined(blocks["ids"])
    counts[order] = here = _joined(blocks["counts"])
    starts = np.zeros(len(order), np.int64)
    starts[order] = np.cumsum(here) - here
    pieces = found.filter(pc.is_valid(found["id"]))
    known = [(i, _as_bytes(p)) for i, p in zip(pieces["id"].to_pylist(), pieces["piece"].to_pylist())]
    piece_at, piece_size = np.zeros((2, max((i for i, _ in known), default=0) + 1), np.int64)
    at = 0
    for i, data in known:
        piece_at[i], piece_size[i] = at, len(data)
        at += len(data)
    piece_data = np.frombuffer(b"".join(d for _, d in known), np.uint8)
    done = []

    texts = of_kind(1).select(["row", "place", "size"]).sort_by([("place", "ascending"), ("size", "ascending")]).combine_chunks()
    places, sizes = texts["place"].to_numpy(), texts["size"].to_numpy()
    ends = places + sizes
    begin = 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, places[begin] + PLACED_WORDS, side="right")))
        here = codes[places[begin] : ends[end - 1]]
        mine = _gathered(ids, starts[here], counts[here])
        data = _gathered(piece_data, piece_at[mine], piece_size[mine])
        id_ends = np.r_[0, np.cumsum(counts[here])][ends[begin:end] - places[begin]]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, id_ends].astype(np.int32)), pa.array(mine.astype(np.int32)))
        decoded = _texts(data, np.r_[0, np.cumsum(piece_size[mine])][id_ends]).cast(pa.string())
        rows = texts["row"].slice(begin, end - begin).combine_chunks()
        done.append(pa.Table.from_arrays([rows, lists, decoded], schema=schema))
        begin = end
    return pa.concat_tables([schema.empty_table(), *done])


def pieces(spark: SparkSession, definition: str) -> DataFrame:
    """(id, piece) of the vocabulary and the added tokens: as many rows as the tokenizer's file has."""
    known = _loaded(definition)[0].get_vocab(with_added_tokens=True)
    return spark.createDataFrame(pd.DataFrame({"id": list(known.values()), "piece": list(known)}), "id int, piece string")


def bpe_round_trip(docs: DataFrame, text_col: str = "text", path: str | None = None, slab_words: int = SLAB_WORDS) -> DataFrame:
    """docs without the text, with new last columns `ids` and `decoded`: the tokenizer's ids of each whole text, without special
    tokens added, and the text that these ids stand for. path is the tokenizer's file (byte_bpe_50k.json if none).

    A text that holds an added token's string has that token there. Null and empty texts have no ids and decode to an
    empty text; repeated rows get equal results; an empty table gives no rows. Where docs has a column `ids` or
    `decoded`, the new one's name gets an underscore. Memory is bounded by a slab of words, or by the longest text.
    """
    spark, definition = docs.sparkSession, definition_of(path)
    keep = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    text = F.col(f"`{text_col}`")
    odd = F.coalesce(text.rlike(UNKNOWN), F.lit(False))
    split = docs.select(
        F.struct(*keep, F.lit(True).alias(free_name(docs, "_row"))).alias("row"),
        F.when(odd, F.array().cast("array<string>")).otherwise(words_of(text, definition)).alias("words"), F.when(odd, text).alias("raw"),
    )
    row = split.schema["row"].dataType
    columns = f"slab long, kind int, row {row.simpleString()}, place long, size long, bucket int, data binary, sizes binary"
    with arrow_batches(spark, BATCH_BYTES):
        coded = in_buckets(split.mapInArrow(_slabs(definition, slab_words), columns), "slab", "zstd")
    words = coded.where("kind = 2").select("slab", "bucket", "data", "sizes").repartition("bucket").sortWithinPartitions("bucket")
    blocks = materialise(words.mapInArrow(_encoded(definition), _BLOCK))
    used = blocks.select("slab", "ids").mapInArrow(_used, "slab long, id int").distinct().join(bounded(pieces(spark, definition)), "id")
    found = blocks.unionByName(used.select("slab", "id", "piece"), allowMissingColumns=True)
    texts = coded.where("kind <> 2").select("slab", "kind", "row", "place", "size", "data")
    placed = texts.groupBy("slab").cogroup(found.groupBy("slab")).applyInArrow(_placed, f"row {row.simpleString()}, ids array<int>, decoded string")
    return placed.select(*(F.col(f"row.`{c}`") for c in docs.columns if c != text_col), F.col("ids").alias(free_name(docs, "ids")), F.col("decoded").alias(free_name(docs, "decoded")))


def decode(rows: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """rows with a new last column `text`, what the ids of a row stand for, special tokens and all. Null and empty ids are an
    empty text; an id that the tokenizer doesn't have stands for nothing. The pieces meet again row by row: one row's ids are what a task holds."""
    key, text = free_name(rows, "_row"), free_name(rows, "text")
    named = materialise(rows.withColumn(key, F.expr("uuid()")))
    each = named.select(key, F.posexplode(ids_col).alias("_place", "id")).join(bounded(pieces(rows.sparkSession, definition_of(path))), "id")
    joined = each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "piece"))), lambda p: p.piece), "").alias(text))
    read = F.pandas_udf(lambda s: s.map(lambda p: _as_bytes(p).decode("utf-8", "replace")), "string")
    return named.join(joined, key, "left").select(*(F.col(f"`{c}`") for c in rows.columns), F.coalesce(read(F.coalesce(text, F.lit(""))), F.lit("")).alias(text))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and hashes of the ids of every document and of the text that they decode to."""
    found = bpe_round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
