"""Connected components of an edge table: union-find in each partition, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, drop

#: Edges of one partition's union-find.
EDGES_EACH = 1 << 19


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as a star for each of its components, whose centre is the least node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            parent.setdefault(ra, ra)
            parent.setdefault(rb, rb)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    pairs = [(x, r) for x in parent if (r := root(x)) != x]
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["u", "v"])


def _with_least(sides: DataFrame) -> DataFrame:
    """(u, v) with the least neighbour m of u. Keyed by a second column as well, so that a hub's rows are an exchange that adaptive execution may split."""
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m", F.xxhash64("u").alias("k"))
    return sides.withColumn("h", F.xxhash64("u")).join(least, (F.col("u") == F.col("w")) & (F.col("h") == F.col("k"))).select("u", "v", "m")


def connected_components(edges: DataFrame, each: int = EDGES_EACH) -> DataFrame:
    """id, label (the least id of its component) of every node of the edges (columns a and b), as a written table.

    Self-loops and nulls are left out, so a node without other edges has no row. Edges are dealt to one partition for
    every `each` of them and contracted to stars there. Stars of one partition are the components; stars of several are
    joined in rounds, whose number grows with the logarithm of the largest component. Each round ends in a written table.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").selectExpr("greatest(a, b) u", "least(a, b) v")
    parts = max(1, -(-edges.count() // each))
    dealt = edges.coalesce(1) if parts == 1 else edges.repartition(parts)
    now = cut(dealt.mapInArrow(_forest, "u long, v long").distinct() if parts > 1 else dealt.mapInArrow(_forest, "u long, v long"))
    state = None
    while parts > 1:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").selectExpr("v u", "least(u, m) v").distinct()
        least = _with_least(large)
        new = cut(least.selectExpr("explode(array(named_struct('u', u, 'v', m), named_struct('u', v, 'v', m))) e").select("e.u", "e.v").filter("u <> v").distinct())
        drop(now)
        now = new
        was, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.col("v").cast("decimal(20,0)"))).first()
        if was == state:
            break
    labels = now.select(F.col("u").alias("id"), F.col("v").alias("label"))
    labels = cut(labels.union(now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()))
    drop(now)
    return labels
