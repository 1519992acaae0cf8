"""The corpus pipeline: documents to packed training sequences. Part of the subpackage of its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import mixing, near_copies, packing, pii, quality_crf
from netloom.llm.common import materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field, learnt from the labels of these documents, scores 0.5 or more. Null and empty
    texts are one empty line and are scored too; repeated rows share their fate."""
    return quality_crf.keep_good(docs, quality_crf.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies (Jaccard 0.8 or more of five-word shingles, found by SimHash tiles and MinHash
    bands) the document with the smallest id. Rows with a null id stay; null and blank texts are copies."""
    return near_copies.drop_near_copies(docs)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and the terms that disclose them taken out of the text; n_chars is the new text's.
    A null text stays null, with n_chars null."""
    from pyspark.sql import functions as F

    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents that meets the token shares of sources, languages and topics. Null sources and
    languages are values of their own; documents without words are never drawn."""
    return mixing.sample(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 1024 tokens. Null and empty texts are the end id alone."""
    return packing.packed(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("privacy", privacy), ("mixture", mixture), ("sequences", sequences)]

#: SQL can't express the line field, the near copies or the packing; tests hold near_duplicates() against brute force, not run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, from the documents table on; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
