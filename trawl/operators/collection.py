"""Collections of segments: a later segment's keys replace earlier rows; change batches collapse to the last per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words for the two kinds of change.
UPSERTS, DELETES = ("c", "create", "i", "insert", "u", "update", "r", "read", "upsert"), ("d", "delete")


def operation(op: Column) -> Column:
    """upsert or delete; a missing word is an upsert, an unknown one an error."""
    word = F.lower(F.trim(op))
    return F.when(op.isNull() | word.isin(*UPSERTS), "upsert").when(word.isin(*DELETES), "delete").otherwise(F.raise_error(F.concat(F.lit("unknown operation: "), op)))


def collapse(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last change of each key. The last is found by an aggregate, so a key with many changes combines before the shuffle."""
    rest = [c for c in changes.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select(key, "_last.*").select(changes.columns)


def require(changes: DataFrame, fields: list[str]) -> DataFrame:
    """The same changes; a batch with an upsert that lacks a required field fails as a whole."""
    for name in fields:
        missing = (F.col("op") == "upsert") & (F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) == "")
        changes = changes.withColumn(name, F.when(missing, F.raise_error(F.lit(f"{name} is empty")).cast(changes.schema[name].dataType)).otherwise(F.col(name)))
    return changes


def apply_changes(live: DataFrame, changes: DataFrame, key: str, order: str, required: list[str] | None = None) -> DataFrame:
    """live with a batch of changes (op, order, key and the columns of live). Deletes of absent keys do nothing."""
    last = collapse(require(changes.withColumn("op", operation(F.col("op"))), required or []), key, order)
    fresh = last.filter("op = 'upsert'").select(live.columns)
    return live.join(last.select(key), key, "left_anti").select(live.columns).unionByName(fresh)


def reselect(changes: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Changes with each upsert read again from the source of truth; one that is no longer there becomes a delete."""
    keys = changes.select(key, "op", "order")
    rows = keys.join(truth, key, "left").withColumn("_there", F.lit(True) if not truth.columns else F.col(next(c for c in truth.columns if c != key)).isNotNull())
    return rows.withColumn("op", F.when((F.col("op") == "upsert") & ~F.col("_there"), "delete").otherwise(F.col("op"))).drop("_there")


def shadow(segments: DataFrame, key: str, segment: str = "seg") -> DataFrame:
    """Rows with `deleted`: those whose key a later segment has. Rows without a key are never replaced."""
    last = segments.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(segment).alias("_last"))
    joined = segments.join(last, key, "left")
    return joined.withColumn("deleted", F.coalesce(F.col(segment) < F.col("_last"), F.lit(False))).select(*segments.columns, "deleted")


def push(live: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """live and a new segment, without the older rows whose keys it uses again."""
    return live.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def statistics(segments: DataFrame, segment: str = "seg", ratio: float = 0.2) -> DataFrame:
    """segments, docs, deleted, live, deleted_ratio, skew (largest over mean) and needs_compaction of rows with `deleted`."""
    each = segments.groupBy(segment).agg(F.count("*").alias("n"), F.count(F.when(F.col("deleted"), 1)).alias("d"))
    all_ = each.agg(F.count("*").alias("segments"), F.coalesce(F.sum("n"), F.lit(0)).alias("docs"), F.coalesce(F.sum("d"), F.lit(0)).alias("deleted"), F.max("n").alias("most"))
    share = F.when(F.col("docs") > 0, F.col("deleted") / F.col("docs")).otherwise(0.0)
    skew = F.when(F.col("docs") > 0, F.col("most") * F.col("segments") / F.col("docs")).otherwise(0.0)
    return all_.select("segments", "docs", "deleted", (F.col("docs") - F.col("deleted")).alias("live"), F.round(share, 9).alias("deleted_ratio"), F.round(skew, 9).alias("skew"), (share > ratio).alias("needs_compaction"))


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's newest live row, as key and doc: the one of the highest order."""
    live = rows.filter(~F.col("deleted")) if "deleted" in rows.columns else rows
    return live.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(order).alias("doc"))


def append_segment(rows: DataFrame, path: str) -> int:
    """Writes rows as the next segment below a path and gives its number. The committer makes its files seen at once."""
    n = next_segment(rows.sparkSession, path)
    rows.write.mode("errorifexists").parquet(f"{path}/seg={n}")
    return n


def next_segment(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return max((int(n.removeprefix("seg=")) + 1 for n in names if n.startswith("seg=")), default=0)


def open_segments(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The live rows of all segments below a path: a key's rows of the last segment that has it."""
    return shadow(spark.read.parquet(path), key).filter("NOT deleted").drop("deleted")
