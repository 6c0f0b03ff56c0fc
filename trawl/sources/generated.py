"""Seeded tables for tests and timings: the same rows for the same seed, however they are partitioned.

A value depends on its row's number and the seed alone, by a hash, so rows are made where they are needed.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "red blue green apple pear plum bread milk coffee tea sugar salt rice fish soap paper large small fresh dry".split()


def unit(seed: int, *by: Column) -> Column:
    """A number from 0 to under 1 for each combination of values."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *by), 11) / F.lit(float(1 << 53))


def sequential(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select("id", F.col("id").alias("key"))


def uniform(spark: SparkSession, n: int, seed: int, top: int = 1 << 40) -> DataFrame:
    return spark.range(n).select("id", F.floor(unit(seed, F.col("id")) * top).cast("long").alias("key"))


def lognormal(spark: SparkSession, n: int, seed: int, sigma: float = 2.0, scale: float = 1e6) -> DataFrame:
    """Keys whose logarithms are normal, from two uniform numbers."""
    x, y = unit(seed, F.col("id"), F.lit(0)), unit(seed, F.col("id"), F.lit(1))
    normal = F.sqrt(-2 * F.log(1 - x)) * F.cos(2 * pi * y)
    return spark.range(n).select("id", F.floor(F.exp(normal * sigma) * scale).cast("long").alias("key"))


def clustered(spark: SparkSession, n: int, seed: int, clusters: int = 1000, width: int = 100) -> DataFrame:
    """Keys in narrow clusters far from each other, which are hard to tell from their place."""
    cluster = F.floor(unit(seed, F.col("id"), F.lit(0)) * clusters)
    return spark.range(n).select("id", (F.floor(unit(seed, cluster) * (1 << 40)) + F.floor(unit(seed, F.col("id"), F.lit(1)) * width)).cast("long").alias("key"))


def texts(spark: SparkSession, n: int, seed: int, words: int = 8) -> DataFrame:
    """doc_id and a text of some words; frequent ones come first in WORDS."""
    each = F.transform(F.sequence(F.lit(1), F.lit(words)), lambda k: F.get(F.array(*map(F.lit, WORDS)), F.floor(F.pow(unit(seed, F.col("id"), k), F.lit(2.0)) * len(WORDS)).cast("int")))
    return spark.range(n).select(F.col("id").alias("doc_id"), F.array_join(each, " ").alias("text"))


def queries(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """query_id and a text of two words."""
    return texts(spark, n, seed + 1, 2).withColumnRenamed("doc_id", "query_id")
