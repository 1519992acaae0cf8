"""Counts of words over a whole corpus, summed on the executors before anything is shuffled."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import folded_words_of

#: Distinct (key, word) pairs that a task holds before it hands its counts on: bounded memory, whole counts.
HELD = 250_000


def _counts(by_line: bool, by_text: bool):
    def count(batches):
        held: dict[str | None, Counter] = {}

        def flush():
            rows = [(k, w.decode("utf-8"), n) for k, c in held.items() for w, n in c.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["key", "word", "n"])

        size = 0
        for pdf in batches:
            for key, text in zip(pdf.key, pdf.text):
                counter = held.setdefault(key if isinstance(key, str) else None, Counter())
                size -= len(counter)
                if by_line:
                    for line in (text or "").split("\n"):
                        counter.update(set(folded_words_of(line)))
                elif by_text:
                    counter.update(set(folded_words_of(text)))
                else:
                    counter.update(folded_words_of(text))
                size += len(counter)
                if size > HELD:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return count


def word_counts(docs: DataFrame, text_col: str = "text", key_col: str | None = None, by_line: bool = False, by_text: bool = False) -> DataFrame:
    """(key, word, n): how often each lower-cased (A-Z) word occurs in the texts of a key, or in how many lines or texts.

    key is the text of key_col, null where that is null or no column is named.
    """
    key = F.col(key_col).cast("string") if key_col else F.lit(None).cast("string")
    rows = docs.select(key.alias("key"), F.col(text_col).alias("text")).mapInPandas(_counts(by_line, by_text), "key string, word string, n long")
    return rows.groupBy("key", "word").agg(F.sum("n").alias("n"))
