"""Language-model scoring by a weighted backoff automaton.

N-grams (here words and pairs) with Dirichlet smoothing become an automaton: a state for each history, an arc
for each pair that training has, and from each state a failure arc to the root, whose arcs are the smoothed
words. P(w | h) = (c(hw) + K P(w)) / (c(h) + K) is the arc's weight, and for a pair that training lacks the
failure arc's K / (c(h) + K) times the root's P(w) = (c(w) + 1) / (N + V + 1); both sum to one over w. A text is
scored in one pass from left to right that carries the state and adds up log10 weights.

The corpus is counted without a row for each token: documents go in blocks, a block sends each of its distinct
n-grams with its count to the n-gram's bucket, the bucket adds up and answers each block, and the block builds
the part of the automaton that its documents can reach. Buckets are ranges of the n-gram's hash, as many as the
corpus needs, so no frequent word makes one large.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import arrow_batches, folded_words_of, id_crc, in_buckets, materialise, table

#: Tokens of a block, n-grams of a bucket: what a task holds at once.
BLOCK_TOKENS, BUCKET_NGRAMS = 600_000, 1_200_000
#: Bytes of texts, or of blocks, that a task is given at once: what a worker has taken it keeps for the later stages.
BATCH_BYTES = 4 << 20
#: K: the weight of the shorter history, in tokens.
PRIOR = 300.0
#: No word holds a line break, so these stand for the end of a text and for what is before its first word.
END, START = b"\n", b"\n\n"

BLOCKS = "block long, ids array<string>, held array<boolean>, lengths binary, tokens binary, hashes binary, n_train long, n_ngrams long"
SENT = "bucket int, block long, gram int, keys binary, counts binary"
ANSWERS = "block long, bucket int, gram int, width int, counts binary, n_distinct long"
SCORES = "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def planes(values: np.ndarray) -> bytes:
    """Bytes of the same place side by side: the leading bytes of sorted keys and small counts repeat, and pack well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit key for each pair of word hashes, spread evenly."""
    with np.errstate(over="ignore"):
        x = left * np.uint64(0x9E3779B97F4A7C15) + right * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x165667B19E3779F9)
        return x ^ (x >> np.uint64(29))


class Block:
    """Documents as numbers: tokens (each text's words, then END) are places in hashes; place 0 is END, 1 START."""

    def __init__(self, ids, held, lengths, tokens, hashes):
        self.ids, self.held, self.lengths, self.tokens, self.hashes = ids, held, lengths, tokens, hashes

    @classmethod
    def of(cls, ids, held, texts) -> Block:
        place = {END: 0, START: 1}
        tokens, lengths = [], []
        for text in texts:
            words = [place.setdefault(w, len(place)) for w in folded_words_of(text)]
            words.append(0)
            lengths.append(len(words))
            tokens.append(np.array(words, np.int32))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, place), np.uint64, len(place))
        return cls(list(ids), list(held), np.array(lengths, np.int64), np.concatenate(tokens), hashes)

    def row(self, block: int) -> dict:
        trained = self.train_mask()
        return {"block": block, "ids": self.ids, "held": self.held, "lengths": self.lengths.tobytes(), "tokens": planes(self.tokens), "hashes": self.hashes.tobytes(), "n_train": int(trained.sum()), "n_ngrams": len(self.hashes) + len(np.unique(self.codes()))}

    @classmethod
    def read(cls, row) -> Block:
        return cls(row.ids, row.held, np.frombuffer(row.lengths, np.int64), unplanes(row.tokens, np.int32), np.frombuffer(row.hashes, np.uint64))

    def train_mask(self) -> np.ndarray:
        return np.repeat(~np.asarray(self.held, bool), self.lengths)

    def codes(self) -> np.ndarray:
        """history * words + word of each token."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[np.cumsum(self.lengths) - self.lengths] = 1
        return before.astype(np.int64) * len(self.hashes) + self.tokens

    def ngrams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(n, sorted keys, their codes, their counts in training) for n = 1 and 2."""
        trained = self.train_mask()
        order = np.argsort(self.hashes, kind="stable")
        yield 1, self.hashes[order], order, np.bincount(self.tokens[trained], minlength=len(self.hashes))[order]
        codes, place = np.unique(self.codes(), return_inverse=True)
        counts = np.bincount(place[trained], minlength=len(codes))
        keys = pair_keys(self.hashes[codes // len(self.hashes)], self.hashes[codes % len(self.hashes)])
        order = np.argsort(keys, kind="stable")
        yield 2, keys[order], codes[order], counts[order]


class BackoffAutomaton:
    """States are words (the history), root arcs the smoothed words, arcs the pairs that training has.

    arcs has a weight for each (state * words + word) of the sorted `codes`, not a number where there is no arc.
    """

    def __init__(self, words: int, word_counts: np.ndarray, codes: np.ndarray, pair_counts: np.ndarray, n: int, v: int, train_docs: int, prior: float = PRIOR):
        history = word_counts.astype(float)
        history[1] = train_docs  # every training text is a continuation of START, every other word of itself
        unigram = (word_counts + 1) / (n + v + 1)
        self.root = np.log10(unigram).tolist()
        self.failure = np.log10(prior / (history + prior)).tolist()
        self.codes = codes
        weights = np.log10((pair_counts + prior * unigram[codes % words]) / (history[codes // words] + prior))
        self.arcs = np.where(pair_counts > 0, weights, np.nan)

    def arcs_of(self, codes: np.ndarray) -> list[float]:
        return self.arcs[np.searchsorted(self.codes, codes)].tolist()

    def score(self, tokens: list[int], arcs: list[float]) -> float:
        """log10 probability of a text's tokens, from left to right; arcs has the arc from the state before each
        token, which is the last token's. Without one the failure arc leads to the root and its arc on."""
        total, state, root, failure = 0.0, 1, self.root, self.failure
        for word, weight in zip(tokens, arcs):
            total += weight if weight == weight else failure[state] + root[word]
            state = word
        return total


def _blocks(batches):
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    ids, held, texts, size = [], [], [], 0
    for pdf in batches:
        for i, h, t in zip(pdf.id, pdf.held, pdf.text):
            ids.append(i)
            held.append(bool(h))
            texts.append(t)
            size += len(t or "") // 6 + 1
            if size >= BLOCK_TOKENS:
                yield pd.DataFrame([Block.of(ids, held, texts).row(number)])
                number, ids, held, texts, size = number + 1, [], [], [], 0
    if ids:
        yield pd.DataFrame([Block.of(ids, held, texts).row(number)])


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the key, so that a block's answers by bucket line up with its sorted keys."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _send(buckets: int):
    def send(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                for gram, keys, _, counts in Block.read(row).ngrams():
                    edges = np.searchsorted(_bucket_of(keys, buckets), np.arange(buckets + 1))
                    parts = [(b, row.block, gram, planes(keys[i:j]), planes(counts[i:j].astype(np.uint32))) for b, (i, j) in enumerate(zip(edges, edges[1:])) if j > i]
                    yield pd.DataFrame(parts, columns=["bucket", "block", "gram", "keys", "counts"])

    return send


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for (bucket, gram), rows in pdf.groupby(["bucket", "gram"]):
        keys, place = np.unique(np.concatenate([unplanes(k, np.uint64) for k in rows["keys"]]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([unplanes(c, np.uint32) for c in rows["counts"]]), minlength=len(keys)).astype(np.int64)
        width = 4 if counts.max(initial=0) < 1 << 32 else 8
        told = counts.astype(f"u{width}")
        at = 0
        for block, k in zip(rows["block"], rows["keys"]):
            n = len(k) // 8
            out.append((block, bucket, gram, width, planes(told[place[at : at + n]]), 0))
            at += n
        out.append((-1, bucket, gram, width, b"", int((counts > 0).sum())))
    return pd.DataFrame(out, columns=["block", "bucket", "gram", "width", "counts", "n_distinct"])


def _score(n: int, v: int, prior: float):
    def score(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in blocks.itertuples():
            block = Block.read(row)
            words = len(block.hashes)
            known = {g: np.concatenate([unplanes(c, f"u{w}") for c, w in zip(x["counts"], x["width"])]).astype(np.int64) for g, x in answers.sort_values("bucket").groupby("gram")}
            (_, _, places, _), (_, _, keyed, _) = block.ngrams()
            counts = np.zeros(words, np.int64)
            counts[places] = known[1]
            order = np.argsort(keyed)
            automaton = BackoffAutomaton(words, counts, keyed[order], known[2][order], n, v, int(counts[0]), prior)
            codes = block.codes()
            base = np.log10((counts + 1) / (n + 1 * (v + 1)))[block.tokens]
            at = 0
            for i, held, length in zip(block.ids, block.held, block.lengths.tolist()):
                tokens = block.tokens[at : at + length]
                out.append((i, bool(held), length, int((counts[tokens] > 0).sum()), math.fsum(base[at : at + length]), automaton.score(tokens.tolist(), automaton.arcs_of(codes[at : at + length]))))
                at += length
        return pd.DataFrame(out, columns=[x.split()[0] for x in SCORES.split(", ")])

    return score


def lm_scores(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR) -> DataFrame:
    """One row (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    held_out is a boolean column; rows where it is true are scored but not learnt from (null: learnt from).
    Null and empty texts are the END token alone. Repeated rows each count and each get a row. An empty table
    gives no rows; if all rows are held out, N is 0 and every token has the one unseen token's probability.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        blocks = materialise(rows.mapInPandas(_blocks, BLOCKS))
    sums = blocks.agg(F.sum("n_train").alias("n"), F.sum("n_ngrams").alias("g")).first()
    n, buckets = sums["n"] or 0, max(1, math.ceil((sums["g"] or 0) / BUCKET_NGRAMS))
    sent = blocks.select("block", "ids", "held", "lengths", "tokens", "hashes").mapInPandas(_send(buckets), SENT)
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        answers = in_buckets(sent.groupBy("bucket").applyInPandas(_answer, ANSWERS), "block")  # they go to blocks without another shuffle
    v = answers.where("block = -1 and gram = 1").agg(F.sum("n_distinct").alias("v")).first()["v"] or 0
    scores = blocks.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInPandas(_score(n, v, prior), SCORES)
    return scores.select(F.col("id").cast(kind).alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op2_lm(spark, sf_dir: str) -> DataFrame:
    """A row for each row of documents: see lm_scores for nulls, repeats and empty tables. Null ids count as the empty
    text for the split. Nothing is ordered, so there are no ties; extra columns are not read."""
    return lm_scores(table(spark, sf_dir, "documents"), id_crc("doc_id") % 7 == 2)
