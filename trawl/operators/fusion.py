"""Fusing ranked results: reciprocal ranks, normalised scores, and a literal arm before a fuzzy one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rrf(arms: list[DataFrame], limit: int, k: int = 60) -> DataFrame:
    """doc_id, score: the sum of 1 / (k + rank) over arms (doc_id, rank from 1)."""
    rows = reduce(DataFrame.unionByName, (a.select("doc_id", "rank") for a in arms))
    return rows.groupBy("doc_id").agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 12).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(limit)


def scaled(arm: DataFrame) -> DataFrame:
    """Scores of an arm (doc_id, score) from 0 to 1; one row alone has 1, equal scores of several rows 0."""
    ends = arm.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("*").alias("n"))  # one row
    value = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).when(F.col("n") == 1, 1.0).otherwise(0.0)
    return arm.crossJoin(F.broadcast(ends)).select("doc_id", value.alias("score"))


def convex(a: DataFrame, b: DataFrame, alpha: float, limit: int) -> DataFrame:
    """doc_id, score: alpha of the first arm's scaled score and the rest of the second's."""
    rows = scaled(a).withColumn("score", F.col("score") * alpha).unionByName(scaled(b).withColumn("score", F.col("score") * (1 - alpha)))
    return rows.groupBy("doc_id").agg(F.round(F.sum("score"), 12).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(limit)


def fused(arms: dict[str, tuple[DataFrame, float]], admissible: DataFrame, limit: int) -> DataFrame:
    """doc_id, score, agreement and a flag for each arm.

    Arms are scaled before `admissible` (doc_id, the hard predicates) is applied. The weights of the arms with rows
    are shared out to 1; an arm without rows or weight takes no part. Order: score, agreement, document.
    """
    live = {name: (arm, w) for name, (arm, w) in arms.items() if w > 0 and arm.limit(1).count()}
    total = sum(w for _, w in live.values()) or 1.0
    spark = admissible.sparkSession
    rows = reduce(DataFrame.unionByName, (scaled(a).select("doc_id", (F.col("score") * (w / total)).alias("score"), F.lit(n).alias("arm")) for n, (a, w) in live.items()), spark.createDataFrame([], "doc_id long, score double, arm string"))
    out = rows.join(admissible.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.round(F.sum("score"), 12).alias("score"), F.count_distinct("arm").alias("agreement"), *(F.bool_or(F.col("arm") == n).alias(f"by_{n}") for n in arms))
    return out.orderBy(F.col("score").desc(), F.col("agreement").desc(), "doc_id").limit(limit)


def literal_first(literal: DataFrame, fuzzy: DataFrame, limit: int) -> DataFrame:
    """label, place: the literal arm (label, rank), then the fuzzy one, each label once."""
    rows = literal.select("label", "rank", F.lit(0).alias("arm")).unionByName(fuzzy.select("label", "rank", F.lit(1).alias("arm")))
    once = rows.groupBy("label").agg(F.min(F.struct("arm", "rank")).alias("at"))
    return once.orderBy("at", "label").limit(limit).withColumn("place", F.row_number().over(Window.orderBy("at", "label"))).select("label", "place")  # limit rows


def literal_match(rows: DataFrame, column: str, typed: str, limit: int) -> DataFrame:
    """label, rank: equal labels first, then those that begin with what was typed, then word begins, then any part."""
    from trawl.functions.text import fold

    own, q = fold(F.col(column)), fold(F.lit(typed))
    tier = F.when(own == q, 0).when(own.startswith(q), 1).when(F.instr(own, F.concat(F.lit(" "), q)) > 0, 2).when(own.contains(q), 3)
    best = rows.select(F.col(column).alias("label"), tier.alias("tier")).filter("tier IS NOT NULL").distinct().orderBy("tier", "label").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("tier", "label"))).select("label", "rank")  # limit rows
