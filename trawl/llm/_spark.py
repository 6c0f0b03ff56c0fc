"""Session helpers: the shared folder, written tables, and how many groups a shuffle of blocks gets."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark removes the shuffle files of a query as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a new local folder in local mode (one machine, as in tests); on a cluster that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="trawl-"))
        named = context.getCheckpointDir()
    return named


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, was)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the shared folder, so that a lost executor costs no recomputation of what
    came before. The shuffle files that made them go at once; the table goes with `drop`.
    """
    spark = df.sparkSession
    path = new_table_path(spark, "table")
    with _shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_written"] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that `cut` wrote; nothing may read them any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.__dict__["_written"])
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame, text_col: str) -> int:
    """The size of the rows: Catalyst's estimate from file sizes, or, where it has none, half the bytes of the texts."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # Spark's default for what it knows nothing of
        size = (df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0) // 2
    return size


def groups_for(df: DataFrame, bytes_each: int, text_col: str = "text", least: int = 64) -> int:
    """How many hash groups the blocks of a frame are dealt to, so that one group stays small at any input size."""
    return int(max(least, -(-input_bytes(df, text_col) // bytes_each)))
