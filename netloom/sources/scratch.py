"""Where queries put files that they read again: below the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder's path; it goes when the driver ends. Where spark.checkpoint.dir names none, a local run takes a temporary one; on a cluster that is
    an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="netloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    own = f"{path.rstrip('/')}/netloom-files-{spark.sparkContext.applicationId}"
    if own not in _LEFT_BEHIND:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
        _LEFT_BEHIND.add(own)
    return f"{own}/{uuid.uuid4().hex}"


_LEFT_BEHIND: set[str] = set()


def kept(df: DataFrame, batch: int | None = None) -> DataFrame:
    """df as a table there, read back: a plan that asks for df several times has it worked out once, and a lost executor doesn't
    take it along. Where rows that go to Python may be long, `batch` is how many bytes of them go there at once."""
    spark, path, name = df.sparkSession, folder(df.sparkSession), "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, batch or was)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, was)
    return spark.read.schema(df.schema).parquet(path)
