"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A broadcast side holds this many rows at most; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one that driver and executors share; it goes when the driver ends.

    Where spark.checkpoint.dir names none, a local run takes a new temporary folder; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="netloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    own = f"{path.rstrip('/')}/netloom-{spark.sparkContext.applicationId}"
    if own not in _LEFT_BEHIND:
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(own)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
        _LEFT_BEHIND.add(own)
    return own


_LEFT_BEHIND: set[str] = set()


def materialise(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write df to a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_buckets(df: DataFrame, column: str, codec: str = "snappy") -> DataFrame:
    """As materialise, with the rows of a value of the column in one of as many buckets as a shuffle has partitions: grouping and joining by
    the column need no shuffle of this side. The table's name is given back at once; its files go as all others."""
    spark, name = df.sparkSession, f"netloom_{uuid.uuid4().hex}"
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(many, column).option("path", f"{shared_dir(spark)}/{name}").option("compression", codec).format("parquet").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Batches of at most so many bytes for what is run within: where rows are long, a batch of thousands is a task's largest piece of memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """df marked for broadcast if it is counted to be small enough, else as it is. df should be cheap to count. Where rows
    hold lists, weight is their length, and the lists' entries are what is counted."""
    if weight is None:
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    return F.broadcast(df) if (df.agg(F.sum(weight + 1).alias("n")).first()["n"] or 0) <= rows else df


def id_crc(col: str | Column) -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit("")).cast("binary"))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that df doesn't have, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def words_of(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text as UTF-8 (null: none); bytes.split() cuts at these characters exactly."""
    return text.encode("utf-8").split() if text else []


def folded_words_of(text: str | None) -> list[bytes]:
    """As words_of, A-Z in lower case and nothing else."""
    return text.encode("utf-8").lower().split() if text else []
