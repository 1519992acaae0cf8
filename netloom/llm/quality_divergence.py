"""Quality rules by distribution divergence.

A text's histograms of character classes and of the language's common words are held against the language's
own, by Jensen-Shannon distance. Short texts are too noisy for that, so each distance has a length from which
it counts, and allows for the distance that chance alone makes at the text's length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import folded_words_of, materialise, table, words_of
from netloom.llm.word_counts import word_counts

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
#: Character classes: space, lower, upper, digit, sentence marks, other marks, symbols, other ASCII, beyond ASCII.
CLASSES = (SPACE, b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".!?", b",;:'\"()-", SYMBOLS)
CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _k, _bytes in enumerate(CLASSES):
    CLASS_OF[list(_bytes)] = _k
CLASS_OF[128:] = len(CLASSES) + 1
N_CLASSES = len(CLASSES) + 2
IS_SPACE, IS_SYMBOL = np.isin(np.arange(256), list(SPACE)), np.isin(np.arange(256), list(SYMBOLS))
WORD_MIN, CHAR_MIN = 50, 200
#: Distances beyond chance: fluent texts of the language stay below 0.08 and 0.27 on the sample tables.
WORD_LIMIT, CHAR_LIMIT = 0.16, 0.29
COMMON = 64
#: Words that a language must have in the corpus before it has a reference: of fewer, a text would be held against
#: little but itself. Texts of such languages aren't judged by distance.
REFERENCE_WORDS = 20_000
#: References that tasks hold at once; of more, each text is joined with its own.
HELD_REFERENCES = 4096
#: Parts in which a language's common words are looked for before the best of all parts.
PARTS = 16


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text; null counts as empty."""
    words = words_of(text)
    if not words:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8")
    raw = np.frombuffer(data, np.uint8)
    word_chars = int(((raw & 0xC0) != 0x80).sum() - IS_SPACE[raw].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), word_chars, int(IS_SYMBOL[raw].sum()), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """How many words lie in a window of width words that the text has twice or more, all its places counted."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    rank = ids  # of the window that begins here; windows of 2, 3.. words are renumbered, so equal ranks are equal windows
    for k in range(1, width):
        _, rank = np.unique(rank[: len(words) - k] * len(number) + ids[k:], return_inverse=True)
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """The root of the Jensen-Shannon divergence in bits, 0 to 1, of two histograms; 1 if one of them is empty."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda x: float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum())
    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def chance(k: int, n: int) -> float:
    """The distance that n draws from k classes show from their own source, roughly: the mean divergence's root."""
    return ((k - 1) / (8 * np.log(2) * max(n, 1))) ** 0.5


@dataclass
class Reference:
    words: dict[bytes, int]
    word_share: np.ndarray  # of the common words, and last of all others
    char_share: np.ndarray

    def distances(self, text: str) -> tuple[float, int, float, int]:
        """(word distance, words, character distance, bytes)."""
        words, raw = folded_words_of(text), np.frombuffer(text.encode("utf-8"), np.uint8)
        other = len(self.words)
        hist = np.bincount([self.words.get(w, other) for w in words], minlength=other + 1)
        return js_distance(hist, self.word_share), len(words), js_distance(np.bincount(CLASS_OF[raw], minlength=N_CLASSES), self.char_share), len(raw)

    def diverges(self, text: str) -> bool:
        word, n_words, char, n_chars = self.distances(text)
        return (n_words >= WORD_MIN and word > WORD_LIMIT + chance(len(self.words) + 1, n_words)) or (n_chars >= CHAR_MIN and char > CHAR_LIMIT + chance(N_CLASSES, n_chars))


def _class_counts(batches):
    held: dict[str | None, np.ndarray] = {}
    columns = ["key", *(f"c{i}" for i in range(N_CLASSES))]
    for pdf in batches:
        for key, text in zip(pdf.key, pdf.text):
            counts = np.bincount(CLASS_OF[np.frombuffer((text or "").encode("utf-8"), np.uint8)], minlength=N_CLASSES)
            key = key if isinstance(key, str) else None
            held[key] = held.get(key, 0) + counts
        if len(held) > 10_000:
            yield pd.DataFrame([(k, *c.tolist()) for k, c in held.items()], columns=columns)
            held = {}
    yield pd.DataFrame([(k, *c.tolist()) for k, c in held.items()], columns=columns)


def references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", common: int = COMMON, least: int = REFERENCE_WORDS) -> DataFrame:
    """A row (key, words, counts, total, chars) for each language of at least `least` words and, with a null key, for
    the whole corpus: the common words, most frequent first, their counts, that of all words, and of bytes by class.
    All texts count."""
    keyed = docs.select(F.col(lang_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    counts = materialise(word_counts(keyed, "text", "key"))
    # every (language, word) and, from them, the corpus as a language of its own
    corpus = counts.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("key"), "word", "n")
    both = counts.where("key is not null").select("key", "word", "n").unionByName(corpus)
    totals = both.groupBy("key").agg(F.sum("n").alias("total")).where(F.col("key").isNull() | (F.col("total") >= least))
    # the best of each part, then of all parts: no group has more than PARTS * common rows, however many words there are
    part = both.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(PARTS)))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "word"))
    few = part.withColumn("rank", rank("key", "part")).where(F.col("rank") <= common)
    top = few.withColumn("rank", rank("key")).where(F.col("rank") <= common).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    classes = materialise(keyed.mapInPandas(_class_counts, "key string, " + ", ".join(f"c{i} long" for i in range(N_CLASSES))))
    sums = [F.sum(f"c{i}").alias(f"c{i}") for i in range(N_CLASSES)]
    chars = classes.where("key is not null").groupBy("key").agg(*sums).unionByName(classes.agg(*sums).select(F.lit(None).cast("string").alias("key"), "*"))
    chars = chars.select(F.col("key").alias("_key"), F.array(*(f"c{i}" for i in range(N_CLASSES))).alias("chars"))
    out = totals.withColumnRenamed("key", "_of").join(top, F.col("_of").eqNullSafe(F.col("key"))).drop("_of")
    out = out.join(chars, F.col("key").eqNullSafe(F.col("_key"))).drop("_key")
    return materialise(out.select("key", F.col("top.word").alias("words"), F.col("top.n").alias("counts"), "total", "chars"))


def reference(words, counts, total: int, chars) -> Reference:
    counts = np.array(counts, float)
    return Reference({w.encode("utf-8"): i for i, w in enumerate(words)}, np.append(counts, max(0, total - counts.sum())), np.array(chars, float))


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def _row(text: str | None, ref: Reference | None) -> tuple:
    counts = base_counts(text)
    failed = base_failed(counts[0], counts[4])
    return (*counts, failed, not failed and not (ref and ref.diverges(text)))


def judged(docs: DataFrame, refs: DataFrame, lang_col: str = "lang", text_col: str = "text", into: str = "judged", held: int = HELD_REFERENCES) -> DataFrame:
    """docs with a struct column of RESULT for each row. Null and empty texts have no words and fail. A text meets its
    language's reference, one without a language the corpus's; a language without a reference, too rare for one, has
    texts that no distance fails. Repeated rows are judged alike, and nothing is ordered, so there are no ties."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    if refs.limit(held + 1).count() <= held:
        known = {r["key"]: reference(r["words"], r["counts"], r["total"], r["chars"]) for r in refs.collect()}

        @F.pandas_udf(RESULT)
        def judge(langs: pd.Series, texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([_row(t, known.get(k if isinstance(k, str) else None)) for k, t in zip(langs, texts)], columns=names)

        return docs.withColumn(into, judge(F.col(lang_col).cast("string"), F.col(text_col)))

    @F.pandas_udf(RESULT)
    def judge_with(texts: pd.Series, own: pd.DataFrame) -> pd.DataFrame:
        made: dict = {}
        rows = []
        for text, key, words, counts, total, chars in zip(texts, own["key"], own["words"], own["counts"], own["total"], own["chars"]):
            key = key if isinstance(key, str) else None
            if words is not None and key not in made:
                made[key] = reference(words, counts, int(total), chars)
            rows.append(_row(text, made[key] if words is not None else None))
        return pd.DataFrame(rows, columns=names)

    own = refs.select(F.struct("key", "words", "counts", "total", "chars").alias("_own"))
    met = docs.join(own, F.col(lang_col).cast("string").eqNullSafe(F.col("_own.key")), "left")
    return met.withColumn(into, judge_with(F.col(text_col), F.col("_own"))).drop("_own")


def op3_divergence(spark, sf_dir: str) -> DataFrame:
    """doc_id and RESULT of every row of documents: see judged for nulls, repeats and rare languages. Extra columns are
    not read; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return judged(docs, references(docs)).select("doc_id", "judged.*")
