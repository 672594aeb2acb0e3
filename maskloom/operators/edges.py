"""Sets of edges (id, ax, ay, bx, by): which meet, and which parts of them lie in a region."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions import geometry as G
from maskloom.operators import region, spatial
from maskloom.operators.spatial import BOX


def _boxed(e: DataFrame) -> DataFrame:
    row = {c: F.col(c) for c in ("ax", "ay", "bx", "by")}
    return e.withColumns(dict(zip(BOX, G.edge_box(row), strict=True)))


def interacting(a: DataFrame, b: DataFrame, tile: int = 256) -> DataFrame:
    """Edges of a whose box shares a point with that of an edge of b."""
    hit = spatial.interacting(_boxed(a), _boxed(b).select(*BOX), "id", tile)
    return hit.select(*a.columns)


def covered(e: DataFrame, rects: DataFrame, inside: bool = True, tile: int = 512) -> DataFrame:
    """(id, ax, ay, bx, by): the parts of edges along an axis that lie in the merged region, its border included, or (inside = False) the others.

    Parts are as long as can be and keep their edge's direction. Edges at other angles come back whole, unless there is no region to be inside of.
    """
    row = {c: F.col(c) for c in ("ax", "ay", "bx", "by")}
    flat = G.is_horizontal(row)
    axis = _boxed(e.filter(G.is_axis_aligned(row))).withColumns({"lo": F.when(flat, F.least("ax", "bx")).otherwise(F.least("ay", "by")), "hi": F.when(flat, F.greatest("ax", "bx")).otherwise(F.greatest("ay", "by"))})
    p = spatial.pairs(axis.select("id", "lo", "hi", "ay", "by", *BOX), region.merged(rects.select(*BOX), None, tile), 0)
    level = F.col("a_ay") == F.col("a_by")
    low = F.greatest(F.when(level, F.col("b_x0")).otherwise(F.col("b_y0")), F.col("a_lo"))
    high = F.least(F.when(level, F.col("b_x1")).otherwise(F.col("b_y1")), F.col("a_hi"))
    held = p.select(F.col("a_id").alias("id"), low.alias("s"), high.alias("t")).filter("s < t")
    w = Window.partitionBy("id").orderBy("s", "t")
    far = F.max("t").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = held.withColumn("far", far).withColumn("new", (F.col("far").isNull() | (F.col("s") > F.col("far"))).cast("int")).withColumn("n", F.sum("new").over(w))
    islands = islands.groupBy("id", "n").agg(F.min("s").alias("s"), F.max("t").alias("t"))
    if not inside:
        ends = axis.select("id", F.col("lo").alias("s"), F.col("lo").alias("t")).unionAll(islands.select("id", "s", "t")).unionAll(axis.select("id", F.col("hi").alias("s"), F.col("hi").alias("t")))
        islands = ends.withColumn("next", F.lead("s").over(Window.partitionBy("id").orderBy("s", "t"))).select("id", F.col("t").alias("s"), F.col("next").alias("t")).filter("s < t")
    j = islands.join(axis.select("id", "ax", "ay", "bx", "by"), "id")
    level, ahead = F.col("ay") == F.col("by"), (F.col("bx") - F.col("ax") + F.col("by") - F.col("ay")) > 0
    first, last = F.when(ahead, F.col("s")).otherwise(F.col("t")), F.when(ahead, F.col("t")).otherwise(F.col("s"))
    made = j.select("id", F.when(level, first).otherwise(F.col("ax")).alias("ax"), F.when(level, F.col("ay")).otherwise(first).alias("ay"), F.when(level, last).otherwise(F.col("bx")).alias("bx"), F.when(level, F.col("by")).otherwise(last).alias("by"))
    rest = e.filter(~G.is_axis_aligned(row)).select("id", "ax", "ay", "bx", "by")
    if inside:
        rest = rest.withColumn("k", F.lit(0)).join(rects.limit(1).select(F.lit(0).alias("k")), "k", "left_semi").drop("k")
    return made.unionAll(rest)
