"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line gets the label good or bad. Its emission sees the line's own features and those of the lines before
and after it; two transition weights tie neighbouring labels. A document's score is the mean of its lines'
marginal probability of good, weighted by their length.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import id_crc, table

#: The classes of bytes that line features count; a byte of none of them is in class 0.
CLASSES = {1: b"#*$%&|<>", 2: b".!?", 3: b",;:'\"()-", 4: b"0123456789", 5: b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 6: b" \t\r\x0b\x0c", 7: bytes(range(128, 256)), 8: b"=_/\\@{}[]^~`+"}
CLASS_OF = np.zeros(256, np.int64)
for _k, _bytes in CLASSES.items():
    CLASS_OF[list(_bytes)] = _k
N_CLASSES = len(CLASSES) + 1
N_LINE = N_CLASSES + 7
#: Own features, those of the line before and after (zeros at the ends), and a constant.
N_FEATURES = 3 * N_LINE + 1
#: At most this many labelled documents are used for training, those first by a hash of their id.
TRAIN_DOCS = 3000
#: Lines of a training document that are learnt from: a run of them, whose place in a longer document is drawn by hash.
TRAIN_LINES = 256


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x N_LINE, length of each line in bytes). A null text is an empty one: one empty line."""
    data = (text or "").encode("utf-8")
    lines = data.split(b"\n")
    n = len(lines)
    length = np.fromiter(map(len, lines), np.int64, n)
    rows = np.repeat(np.arange(n), length)
    raw = np.frombuffer(data.replace(b"\n", b""), np.uint8)
    own = np.zeros((n, N_LINE))
    own[:, :N_CLASSES] = np.bincount(rows * N_CLASSES + CLASS_OF[raw], minlength=n * N_CLASSES).reshape(n, -1) / np.maximum(length, 1)[:, None]
    seen: set[bytes] = set()
    for i, line in enumerate(lines):
        words = line.split()
        k = len(words)
        if k:
            repeats = sum(map(bytes.__eq__, words, words[1:]))
            own[i, N_CLASSES:] = (math.log1p(k) / 5, 1 - len(set(words)) / k, repeats / k, min(length[i] / k / 20, 3), line in seen, words[-1][-1:] in b".!?", 1)
            seen.add(line)
    return own, length


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """(lines x N_FEATURES): what the emission sees of each line."""
    pad = np.zeros((1, N_LINE))
    return np.hstack([own, np.vstack([pad, own[:-1]]), np.vstack([own[1:], pad]), np.ones((len(own), 1))])


def emissions(own: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """with_neighbours(own) @ weights, without laying the neighbours beside each line of a long document."""
    parts = own @ weights[:-1].reshape(3, N_LINE).T
    out = parts[:, 0] + weights[-1]
    out[1:] += parts[:-1, 1]
    out[:-1] += parts[1:, 2]
    return out


@dataclass
class LineField:
    """Weights of the emission (good against bad) and transitions[from, to], labels 0 bad and 1 good."""

    emission: np.ndarray
    transitions: np.ndarray

    def marginals(self, own: np.ndarray) -> list[float]:
        """P(good) of each line by the forward-backward recursion, in odds of good against bad."""
        odds = np.exp(np.clip(emissions(own, self.emission), -30, 30)).tolist()
        (bb, bg), (gb, gg) = np.exp(self.transitions).tolist()
        ahead, r = [], None
        for e in odds:  # odds of good given this line and all before it
            r = e if r is None else e * (bg + gg * r) / (bb + gb * r)
            ahead.append(r)
        out, back = [0.0] * len(odds), 1.0
        for i in range(len(odds) - 1, -1, -1):  # back: the same for all lines after
            p = ahead[i] * back
            out[i] = p / (1 + p)
            p = odds[i] * back
            back = (gb + gg * p) / (bb + bg * p)
        return out

    def score(self, text: str | None) -> float:
        """The length-weighted share of good lines. A text without characters is one empty line."""
        own, length = line_features(text)
        weights = length + (1 if length.sum() == 0 else 0)
        return float(np.dot(self.marginals(own), weights) / weights.sum())


def train(sequences: list[np.ndarray], labels: list[int], rounds: int = 150, l2: float = 1e-3) -> LineField:
    """Maximise the mean log-likelihood a line of the documents' labels, each standing for all its lines.

    Adam on exact gradients from forward-backward, all documents in step. Without documents, or with one
    label only, the field still is a valid model: its weights go where the data leads, from zero.
    """
    emission, transitions = np.zeros(N_FEATURES), np.zeros((2, 2))
    if not sequences:
        return LineField(emission, transitions)
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    xs, ys = [sequences[i] for i in order], np.array([labels[i] for i in order])
    n_lines = np.array([len(x) for x in xs])
    start = np.concatenate([[0], np.cumsum(n_lines)])
    flat, y_flat = np.vstack(xs), np.repeat(ys, n_lines)
    steps = [start[: int((n_lines > t).sum())] + t for t in range(n_lines[0])]  # rows of the t-th lines
    total, theta = len(flat), np.zeros(N_FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    observed = np.zeros((2, 2))
    for y, n in zip(ys, n_lines):
        observed[y, y] += n - 1
    for k in range(1, rounds + 1):
        w, a = theta[:N_FEATURES], np.exp(theta[N_FEATURES:].reshape(2, 2))
        psi = np.stack([np.ones(total), np.exp(np.clip(flat @ w, -30, 30))], axis=1)
        alpha, beta = np.empty((total, 2)), np.full((total, 2), 0.5)
        for t, rows in enumerate(steps):
            now = psi[rows] if t == 0 else psi[rows] * (alpha[rows - 1] @ a)
            alpha[rows] = now / now.sum(axis=1, keepdims=True)
        expected = np.zeros((2, 2))
        for rows in reversed(steps[1:]):
            onward = psi[rows] * beta[rows]
            pair = alpha[rows - 1][:, :, None] * a[None] * onward[:, None, :]
            expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            before = onward @ a.T
            beta[rows - 1] = before / before.sum(axis=1, keepdims=True)
        good = alpha * beta
        good = good[:, 1] / good.sum(axis=1)
        grad = np.concatenate([flat.T @ (y_flat - good), (observed - expected).ravel()]) / total - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return LineField(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))


def _features_of(batches):
    for pdf in batches:
        for label, text in zip(pdf.label, pdf.text):
            x = with_neighbours(line_features(text)[0])
            if len(x) > TRAIN_LINES:
                first = zlib.crc32(text.encode("utf-8")) % (len(x) - TRAIN_LINES + 1)
                x = x[first : first + TRAIN_LINES]
            yield pd.DataFrame({"label": [label], "n": [len(x)], "x": [x.astype("<f4").tobytes()]})


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineField:
    """A field from at most train_docs labelled rows, those first by a hash of their id, and TRAIN_LINES lines of each,
    so what reaches the driver is bounded however long the texts are.

    Labels other than 0 and 1 and rows without id are not used; of repeated rows of an id one is, the first by text.
    Texts become features on the executors.
    """
    some = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    some = some.orderBy(F.xxhash64("id"), "id").limit(train_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(some), "id").groupBy("id", "label").agg(F.min("text").alias("text")).mapInPandas(_features_of, "label int, n int, x binary").collect()
    rows.sort(key=lambda r: (r["n"], bytes(r["x"]), r["label"]))  # the same sums whatever the partitions
    return train([np.frombuffer(r["x"], "<f4").reshape(r["n"], N_FEATURES).astype(float) for r in rows], [r["label"] for r in rows])


def scored(docs: DataFrame, field: LineField, text_col: str = "text"):
    """A column of scores of whole texts, 0 to 1."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([field.score(t) for t in texts], dtype="float64")

    return score(F.col(text_col))


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from: those whose crc32 of the id mod 3 is not 1."""
    return labels.where(id_crc("doc_id") % 3 != 1)


def keep_good(docs: DataFrame, field: LineField, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is 0.5 or more."""
    return docs.where(scored(docs, field, text_col) >= 0.5)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents. Null and empty texts are one empty line; repeated
    rows have one score each; a null id counts as the empty text for the split. Nothing is ordered, so there are no
    ties; extra columns are not read; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    field = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    out = docs.select("doc_id", (id_crc("doc_id") % 3 == 1).alias("held_out"), scored(docs, field).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
