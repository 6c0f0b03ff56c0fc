"""A collection kept up to date by a stream of changes: each micro-batch writes a new version of the Parquet table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from trawl.operators.collection import apply_changes


class Collection:
    """Versions of a table below one path; version N is what the batches up to N left, so a replayed batch changes nothing."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: str = "order", required: list[str] | None = None):
        self.spark, self.path, self.key, self.order, self.required = spark, path.rstrip("/"), key, order, required

    def _folder(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def version(self) -> int:
        """The last complete version, -1 if there is none."""
        fs, at = self._folder()
        if not fs.exists(at):
            return -1
        names = [s.getPath() for s in fs.listStatus(at)]
        jvm = self.spark._jvm
        return max((int(p.getName().split("=")[1]) for p in names if p.getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))), default=-1)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={self.version() if version is None else version}")

    def create(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/version=0")

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Writes version batch + 1 from version batch; a batch that is already in is left out."""
        if self.version() > batch:
            return
        after = apply_changes(self.read(), changes, self.key, self.order, self.required)
        after.write.mode("overwrite").parquet(f"{self.path}/version={batch + 1}")

    def follow(self, stream: DataFrame, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
        """Applies every micro-batch of a streaming frame of changes."""
        return stream.writeStream.foreachBatch(lambda df, n: self.apply(prepare(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
