"""Written tables, and components of small and large graphs by least labels, with pointer jumping, each round a written table."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir, or a local one in local mode if that is unset."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="trawl-"))
        named = context.getCheckpointDir()
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, so later steps survive a lost executor."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def there(df: DataFrame) -> bool:
    """Whether all files of a table, or of a union of tables, are still there."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    return all(p.getFileSystem(conf).exists(p) for p in paths)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label: the least id that edges (a, b) lead to from each node (id)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = written(nodes.select("id", F.col("id").alias("label")))
    while True:
        offered = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("offer"))
        next_ = labels.join(offered, "id", "left").select("id", F.least("label", F.coalesce("offer", "label")).alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        next_ = written(next_.join(jump, "label", "left").select("id", F.least("label", F.coalesce("further", "label")).alias("label")))
        changed = next_.join(labels.withColumnRenamed("label", "old"), "id").filter("label <> old").limit(1).count()
        labels = next_
        if not changed:
            return labels
