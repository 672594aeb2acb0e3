"""Iterative plans: connected components, longest and shortest propagation over levels, hierarchy expansion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions import geometry as G
from maskloom.plans.tables import materialize


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, comp): the least node that the links (a, b) connect each node with. Large-star and small-star rounds.

    The minima are dealt anew before they are joined, so that Spark can split the join of a node of very many links.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = None
    for _ in range(most):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).repartition(n)
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).repartition(n)
        ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        e = materialize(large.join(low, "a").select(F.explode(ends).alias("x")).select("x.*").filter("a <> b").distinct(), "links")
        now = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the links did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def propagate(edges: DataFrame, start: DataFrame, step: Column, combine: Callable[[Column], Column] = F.max, most: int = 10_000) -> DataFrame:
    """(node, value): the best value of any path from the start nodes (node, value); edges are (src, dst, ...).

    step: the value after an edge, from `value` and the edge's columns. combine: max or min. One join and one
    aggregation for each level; paths longer than `most` edges mean a cycle.
    """
    front = materialize(start.select("node", "value"), "front")
    all_ = front
    for _ in range(most):
        front = materialize(front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node"), step.alias("value")).groupBy("node").agg(combine("value").alias("value")), "front")
        if front.isEmpty():
            return all_.groupBy("node").agg(combine("value").alias("value"))
        all_ = all_.unionAll(front)
    raise ValueError("the graph has a cycle")


def levels(edges: DataFrame) -> DataFrame:
    """(node, value): the topological level of each node, the longest path from a node without predecessors."""
    nodes = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).distinct()
    sources = nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    out = propagate(edges, sources.withColumn("value", F.lit(0).cast("bigint")), F.col("value") + 1)
    if nodes.join(out, "node", "left_anti").isEmpty():
        return out
    raise ValueError("the graph has a cycle")


def flatten(instances: DataFrame, top: int, depth: int = 64) -> DataFrame:
    """(cell, depth, rot, mirror, dx, dy): every placement under a top cell, with composed transforms; the top itself at depth 0.

    One join for each level of the hierarchy; instances are (parent, child, rot, mirror, dx, dy) and must be free of cycles.
    More than `depth` levels are an error.
    """
    spark = instances.sparkSession
    rot, mirror, dx, dy = G.compose([F.col(f"t.{c}") for c in ("rot", "mirror", "dx", "dy")], [F.col(f"i.{c}") for c in ("rot", "mirror", "dx", "dy")])
    level = spark.createDataFrame([(top, 0, 0, False, 0, 0)], "cell bigint, depth int, rot int, mirror boolean, dx bigint, dy bigint")
    out = level
    for _ in range(depth):
        level = materialize(level.alias("t").join(instances.alias("i"), F.col("t.cell") == F.col("i.parent")).select(F.col("i.child").alias("cell"), (F.col("t.depth") + 1).alias("depth"), rot.cast("int").alias("rot"), mirror.alias("mirror"), dx.alias("dx"), dy.alias("dy")), "placements")
        if level.isEmpty():
            return out
        out = out.unionAll(level)
    if level.join(instances, level["cell"] == instances["parent"], "left_semi").isEmpty():
        return out
    raise ValueError(f"the hierarchy is deeper than {depth} levels")
