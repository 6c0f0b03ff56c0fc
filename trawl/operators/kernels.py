"""Columnar analytics on nullable doubles: filters, aggregates, stable sorts, top-k, group codes, row-set algebra.

Missing means null or NaN everywhere. All of it is plain expressions, so scans are pruned, aggregates combine before
the shuffle and top-k never sorts a whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written

FILTERS = ("eq", "ne", "lt", "le", "gt", "ge", "between", "not_between", "in", "not_in", "is_null", "is_not_null")
AGGREGATES = ("sum", "avg", "count", "count_distinct", "min", "max", "first", "last")


def present(value: Column) -> Column:
    """The value, with NaN as null."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def condition(op: str, value: Column, *operands: float) -> Column:
    """One of FILTERS as a filter: plain comparisons, so that they reach the scan; not true for a missing value.

    Spark orders NaN above all numbers, so only comparisons without an upper bound have to leave it out.
    """
    v = value.cast("double")
    number = ~F.isnan(v)
    return {
        "eq": lambda x: v == x,
        "ne": lambda x: (v != x) & number,
        "lt": lambda x: v < x,
        "le": lambda x: v <= x,
        "gt": lambda x: (v > x) & number,
        "ge": lambda x: (v >= x) & number,
        "between": lambda x, y: (v >= x) & (v <= y),
        "not_between": lambda x, y: ((v < x) | (v > y)) & number,
        "in": lambda *xs: v.isin(*xs),
        "not_in": lambda *xs: ~v.isin(*xs) & number,
        "is_null": lambda: v.isNull() | F.isnan(v),
        "is_not_null": lambda: v.isNotNull() & number,
    }[op](*operands)


def predicate(op: str, value: Column, *operands: float) -> Column:
    """The same as a mask: never null, and false for a missing value, also under a negation."""
    return F.coalesce(condition(op, value, *operands), F.lit(False))


def aggregate(op: str, value: Column, row_id: Column) -> Column:
    """One of AGGREGATES over the values present: the sum of none is 0, other aggregates but counts are null."""
    v = present(value)
    order = F.when(v.isNotNull(), row_id)
    return {
        "sum": F.coalesce(F.sum(v), F.lit(0.0)),
        "avg": F.avg(v),
        "count": F.count(v),
        "count_distinct": F.count_distinct(v),
        "min": F.min(v),
        "max": F.max(v),
        "first": F.min_by(v, order),
        "last": F.max_by(v, order),
    }[op]


def sort_order(keys: Sequence[tuple[str, bool, bool]], row_id: str) -> list[Column]:
    """Order of (column, descending, missing first) keys, the most significant first, and of row_id under ties."""
    out = []
    for name, descending, missing_first in keys:
        v = F.col(name)
        out.append((v.desc_nulls_first() if missing_first else v.desc_nulls_last()) if descending else (v.asc_nulls_first() if missing_first else v.asc_nulls_last()))
    return [*out, F.col(row_id).asc()]


def stable_sort(df: DataFrame, keys: Sequence[tuple[str, bool, bool]], row_id: str) -> DataFrame:
    return df.orderBy(*sort_order(keys, row_id))


def top_k(df: DataFrame, k: int, keys: Sequence[tuple[str, bool, bool]], row_id: str) -> DataFrame:
    """The first k rows of the stable sort: each task keeps k, so no full sort or shuffle."""
    return stable_sort(df, keys, row_id).limit(max(0, k))


def group_codes(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """The distinct keys with their rows and a dense code in order of first appearance; missing values are one group.

    The codes rank the groups, not the rows: one row a group reaches the final window.
    """
    groups = df.groupBy(*keys).agg(F.min(row_id).alias("first_row"), F.count("*").alias("n_rows"))
    return with_ranks(groups, F.col("first_row"), "code")


def with_ranks(groups: DataFrame, order: Column, name: str) -> DataFrame:
    """Ranks from 0 in the given total order, by range partitions and their sizes: no window over all rows.

    The ranges are sampled, so they are written before their sizes are counted; else rows and sizes would come from
    two samples. A file holds rows of one range in order, and each row its place.
    """
    ranged = groups.withColumn("_order", order).repartitionByRange("_order").sortWithinPartitions("_order")
    ranged = written(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("_part").alias("_of"), (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))  # one row a partition
    return ranged.join(F.broadcast(before), F.col("_part") == F.col("_of")).withColumn(name, F.col("_before") + F.col("_at")).drop("_order", "_part", "_at", "_of", "_before")


def row_sets(op: str, a: Column, b: Column) -> Column:
    """and, or, not, and_not, xor of two masks that are never null."""
    return {"and": a & b, "or": a | b, "not": ~a, "and_not": a & ~b, "xor": a != b}[op]


def range_clustered(df: DataFrame, column: str, path: str) -> None:
    """Writes rows in ranges of a column, sorted, so that a range query reads the few row groups that can have it."""
    df.repartitionByRange(column).sortWithinPartitions(column).write.mode("overwrite").parquet(path)


def range_query(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    """Rows with lo <= column < hi. On a table of range_clustered, statistics prune the rest."""
    return df.filter((F.col(column) >= lo) & (F.col(column) < hi))


def lookup(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df for a batch of keys, with the rank of each key among df's distinct ones (null if it has none)."""
    ranks = with_ranks(df.select(F.col(column).alias("_k")).distinct(), F.col("_k"), "rank")
    return keys.join(ranks, F.col(key) == F.col("_k"), "left").drop("_k")


def ranks(df: DataFrame, position: str, symbol: str) -> DataFrame:
    """df with `rank`: how many earlier positions have the same symbol. One symbol's rows are ranked by range partitions."""
    return with_ranks(df, F.struct(symbol, position), "_all").join(
        with_ranks(df.groupBy(F.col(symbol).alias("_s")).agg(F.count("*").alias("_n")), F.col("_s"), "_o").withColumn("_before", F.sum("_n").over(Window.orderBy("_s")) - F.col("_n")).select("_s", "_before"),  # one row a symbol
        F.col(symbol).eqNullSafe(F.col("_s")),
    ).withColumn("rank", F.col("_all") - F.col("_before")).drop("_all", "_s", "_before")
