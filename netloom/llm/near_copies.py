"""Near-copies for the pipeline: fingerprints and shingles find them, the shingles decide, one of each group stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm import minhash, simhash
from netloom.llm.common import materialise

#: Words of a shingle, and the Jaccard similarity from which two documents are near-copies.
WIDTH, SIMILARITY = 5, 0.8


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """The rows of docs that no smaller id is a near-copy of, with all their columns.

    Candidates are documents whose SimHash fingerprints of five-word shingles link within radius bits. A pair at a
    similarity of 0.8 differs in about ten bits, where fingerprints of unlike texts begin to meet too; MinHash bands
    make up for what the radius leaves out. Of all candidates the Jaccard similarity itself decides, so unlike texts
    stay. Null, empty and blank texts are copies of one another. Of repeated rows with one id one stays; rows with a
    null id stay, as nothing names them.
    """
    rows = docs.select(id_col, text_col)
    prints = simhash.near_duplicates(rows, id_col, text_col, radius, WIDTH)
    linked = materialise(prints.where(f"`{id_col}` <> component_id").select(F.col(id_col).alias("a"), F.col("component_id").alias("b")))
    return minhash.drop_near_duplicates(docs, id_col, text_col, SIMILARITY, WIDTH, linked)
