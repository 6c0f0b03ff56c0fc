"""Point in polygon as an equi-join on grid cells, with an exact even-odd test where a cell is on a border.

Polygons are rows of rings (poly_id, ring, outer, points array<struct<x, y>>). `cells` has the cells of a fixed grid that
a polygon's border runs through, and those that lie inside as a whole; `locate` joins points on their cell, answers
from inner cells at once and tests edges only in border cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(rings: DataFrame) -> DataFrame:
    """poly_id, ring, outer, x1, y1, x2, y2 of every edge; non-finite corners are dropped, rings of fewer than 3 have none."""
    bad = lambda v: F.isnan(v) | (F.abs(v) == float("inf")) | v.isNull()
    own = rings.withColumn("p", F.filter("points", lambda p: ~(bad(p["x"]) | bad(p["y"])))).filter(F.size("p") >= 3)
    own = own.select("poly_id", "ring", "outer", "p", F.posexplode("p").alias("i", "a")).withColumn("b", F.get("p", (F.col("i") + 1) % F.size("p")))
    return own.select("poly_id", "ring", "outer", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))


def crosses(x: Column, y: Column) -> Column:
    """Whether a ray to the right from (x, y) crosses the edge, ends half open."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)


def cell_of(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    return F.floor(x / size).cast("long"), F.floor(y / size).cast("long")


def boxes(rings: DataFrame) -> DataFrame:
    """poly_id, x1, y1, x2, y2 of each polygon's box; non-finite corners don't count."""
    return edges(rings).groupBy("poly_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x1").alias("x2"), F.max("y1").alias("y2"))


def box_has(x: Column, y: Column) -> Column:
    return x.between(F.col("x1"), F.col("x2")) & y.between(F.col("y1"), F.col("y2"))


def box_hits(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a box has a point in common with the row's."""
    return (F.col("x1") <= x2) & (F.col("x2") >= x1) & (F.col("y1") <= y2) & (F.col("y2") >= y1)


def box_cells(rings: DataFrame, size: float) -> DataFrame:
    """poly_id, cx, cy of the grid cells that a polygon's box meets."""
    own = boxes(rings)
    (x1, y1), (x2, y2) = cell_of(F.col("x1"), F.col("y1"), size), cell_of(F.col("x2"), F.col("y2"), size)
    return own.select("poly_id", F.explode(F.sequence(x1, x2)).alias("cx"), F.sequence(y1, y2).alias("ys")).select("poly_id", "cx", F.explode("ys").alias("cy"))


def border_cells(rings: DataFrame, size: float) -> DataFrame:
    """poly_id, cx, cy of the grid cells that an edge runs through: column by column, from where it enters to where it leaves."""
    e = edges(rings).withColumns({"ax": F.least("x1", "x2"), "bx": F.greatest("x1", "x2")})
    e = e.select("*", F.explode(F.sequence(F.floor(F.col("ax") / size).cast("long"), F.floor(F.col("bx") / size).cast("long"))).alias("cx"))
    at = lambda x: F.when(F.col("x1") == F.col("x2"), F.lit(None)).otherwise(F.col("y1") + (F.col("y2") - F.col("y1")) * (x - F.col("x1")) / (F.col("x2") - F.col("x1")))
    enter, leave = at(F.greatest("ax", F.col("cx") * size)), at(F.least("bx", (F.col("cx") + 1) * size))
    lo, hi = F.coalesce(F.least(enter, leave), F.least("y1", "y2")), F.coalesce(F.greatest(enter, leave), F.greatest("y1", "y2"))
    slack = size * 1e-9  # rounding must not lose a cell that the edge just touches
    return e.select("poly_id", "cx", F.explode(F.sequence(F.floor((lo - slack) / size).cast("long"), F.floor((hi + slack) / size).cast("long"))).alias("cy")).distinct()


def cells(rings: DataFrame, size: float) -> DataFrame:
    """poly_id, cx, cy, inner: border cells, and the cells inside (in some outer ring and in no hole), told by their middles.

    A row of middles is cut by each edge at most once, so a cell is inside a ring if an odd number of cuts lies to its right.
    """
    border = border_cells(rings, size)
    rows = edges(rings).select("*", F.explode(F.sequence(F.floor(F.least("y1", "y2") / size).cast("long"), F.floor(F.greatest("y1", "y2") / size).cast("long"))).alias("cy")).withColumn("y", (F.col("cy") + 0.5) * size)
    cuts = rows.filter((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))).select("poly_id", "ring", "outer", "cy", ((F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")).alias("at"))
    whole = box_cells(rings, size).join(border, ["poly_id", "cx", "cy"], "left_anti").withColumn("x", (F.col("cx") + 0.5) * size)
    odd = whole.join(cuts, ["poly_id", "cy"]).groupBy("poly_id", "cx", "cy", "ring").agg(F.first("outer").alias("outer"), (F.count(F.when(F.col("at") > F.col("x"), 1)) % 2 == 1).alias("odd"))
    inside = odd.groupBy("poly_id", "cx", "cy").agg(F.bool_or(F.col("outer") & F.col("odd")).alias("ok"), F.bool_or(~F.col("outer") & F.col("odd")).alias("hole")).filter("ok AND NOT hole")
    return border.withColumn("inner", F.lit(False)).unionByName(inside.select("poly_id", "cx", "cy", F.lit(True).alias("inner")))


def locate(points: DataFrame, rings: DataFrame, size: float, id_col: str = "point_id", made: DataFrame | None = None) -> DataFrame:
    """The id and poly_id (the least that holds the point, null for none) of each point (id, x, y).

    In a polygon: in some outer ring and in no hole. Points of null or NaN coordinates are in none. made: `cells` of the
    rings, if they are kept.
    """
    cx, cy = cell_of(F.col("x"), F.col("y"), size)
    own = points.select(F.col(id_col).alias("_p"), "x", "y", cx.alias("cx"), cy.alias("cy"))
    pairs = own.join(cells(rings, size) if made is None else made, ["cx", "cy"]).select("_p", "x", "y", "poly_id", "inner")
    in_ring = pairs.filter("NOT inner").join(edges(rings), "poly_id").groupBy("_p", "poly_id", "ring").agg(F.first("outer").alias("outer"), (F.count(F.when(crosses(F.col("x"), F.col("y")), 1)) % 2 == 1).alias("inside"))
    in_poly = in_ring.groupBy("_p", "poly_id").agg(F.bool_or(F.col("outer") & F.col("inside")).alias("ok"), F.bool_or(~F.col("outer") & F.col("inside")).alias("hole")).filter("ok AND NOT hole")
    least = in_poly.select("_p", "poly_id").union(pairs.filter("inner").select("_p", "poly_id")).groupBy("_p").agg(F.min("poly_id").alias("poly_id"))
    return points.select(F.col(id_col).alias("_p")).join(least, "_p", "left").select(F.col("_p").alias(id_col), "poly_id")


def write_cells(rings: DataFrame, size: float, path: str) -> None:
    """The rings and their cells as tables below a path, cells in the order of the Hilbert curve."""
    rings.write.mode("overwrite").parquet(f"{path}/rings")
    keyed = cells(rings, size).withColumn("key", hilbert_key(F.col("cx") + (1 << 15), F.col("cy") + (1 << 15)))
    keyed.withColumn("size", F.lit(size)).repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{path}/cells")


def read_cells(spark, path: str) -> tuple[DataFrame, DataFrame, float]:
    """Rings, cells and the grid's size, as write_cells left them."""
    made = spark.read.parquet(f"{path}/cells")
    r = made.select("size").first()
    return spark.read.parquet(f"{path}/rings"), made.drop("size"), r["size"] if r else 1.0


def in_view(rings: DataFrame, size: float, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """poly_id of polygons with a cell, of the border or inside, in the view (a superset of those in it)."""
    import math

    lo, hi = [math.floor(v / size) for v in (x1, y1)], [math.floor(v / size) for v in (x2, y2)]
    return cells(rings, size).filter(F.col("cx").between(lo[0], hi[0]) & F.col("cy").between(lo[1], hi[1])).select("poly_id").distinct()


def in_cover(key: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a key is in one of a cover's ranges: comparisons that reach the scan of a table sorted by it."""
    out = F.lit(False)
    for lo, hi in ranges:
        out = out | ((key >= lo) & (key < hi))
    return out


def hilbert_key(x: Column, y: Column, order: int = 16) -> Column:
    """`hilbert` of two cell numbers as a column."""
    one, mask = F.lit(1).cast("long"), F.lit((1 << order) - 1).cast("long")

    def step(s: Column, k: Column) -> Column:
        a, b = F.call_function("shiftright", s["x"], k).bitwiseAND(one), F.call_function("shiftright", s["y"], k).bitwiseAND(one)
        x, y = F.when((a == 1) & (b == 0), mask - s["x"]).otherwise(s["x"]), F.when((a == 1) & (b == 0), mask - s["y"]).otherwise(s["y"])
        return F.struct((s["key"] * 4 + (a * 3).bitwiseXOR(b)).alias("key"), F.when(b == 0, y).otherwise(x).alias("x"), F.when(b == 0, x).otherwise(y).alias("y"))

    start = F.struct(F.lit(0).cast("long").alias("key"), x.cast("long").alias("x"), y.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(order - 1), F.lit(0), F.lit(-1)), start, step, lambda s: s["key"])


def morton(x: Column, y: Column, order: int = 16) -> Column:
    """Interleaved bits of two cell numbers: the key by which files are clustered."""
    out = F.lit(0).cast("long")
    for k in range(order):
        for v, at in ((x, 2 * k), (y, 2 * k + 1)):
            bit = F.shiftright(v.cast("long"), k).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(bit, at))
    return out


def hilbert(order: int, x: int, y: int) -> int:
    """Place of a cell on the Hilbert curve of 4 ** order cells."""
    out = 0
    for k in reversed(range(order)):
        a, b = (x >> k) & 1, (y >> k) & 1
        out = out * 4 + ((3 * a) ^ b)
        if b == 0:
            if a == 1:
                x, y = ~x, ~y
            x, y = y, x
    return out


def cover(order: int, x1: int, y1: int, x2: int, y2: int, budget: int) -> list[tuple[int, int]]:
    """At most `budget` ranges of Hilbert keys that hold every cell of a box: quadrants split while ranges are left."""
    side = 1 << order
    parts = [(0, 0, side)]

    def ranges(parts: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        keys = sorted((hilbert(order, x, y) // (s * s) * (s * s), s * s) for x, y, s in parts)
        out: list[tuple[int, int]] = []
        for at, n in keys:
            if out and out[-1][1] == at:
                out[-1] = (out[-1][0], at + n)
            else:
                out.append((at, at + n))
        return out

    while True:
        partly = [p for p in parts if p[2] > 1 and not (x1 <= p[0] and y1 <= p[1] and p[0] + p[2] - 1 <= x2 and p[1] + p[2] - 1 <= y2)]
        if not partly:
            return ranges(parts)
        x, y, s = max(partly, key=lambda p: (p[2], -p[0], -p[1]))
        half = s // 2
        split = [(x + i * half, y + j * half, half) for i in (0, 1) for j in (0, 1)]
        split = [p for p in split if p[0] <= x2 and p[0] + half > x1 and p[1] <= y2 and p[1] + half > y1]
        tried = [p for p in parts if p != (x, y, s)] + split
        if len(ranges(tried)) > budget:
            return ranges(parts)
        parts = tried
