"""Routed nets: antenna ratios at gates, wires on tracks, shapes of routes, small jogs, and edits of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions import geometry as G
from maskloom.operators import region
from maskloom.operators.spatial import BOX


def gate_antennas(segments: DataFrame, gates: DataFrame, rules: DataFrame) -> DataFrame:
    """(net, gate, layer, area, gate_area, ratio): gates where a layer's metal over the gate's area is beyond the layer's limit.

    segments: (net, pos, layer, to_layer, length), a via where to_layer is not null. A via up from a layer shields it from the wires that follow
    in the order of pos. gates: (net, gate, layer, area); layers below a gate's own don't count, nor gates without area. rules: (layer, width, limit).
    Metal is summed by net and layer before it meets the gates.
    """
    up = segments.filter("to_layer > layer").groupBy("net", "layer").agg(F.min("pos").alias("shield"))
    wires = segments.filter("to_layer is null").join(up, ["net", "layer"], "left").filter("shield is null or pos < shield")
    metal = wires.groupBy("net", "layer").agg(F.sum("length").alias("length")).join(rules, "layer")
    metal = metal.select("net", "layer", (F.col("length") * F.col("width")).cast("double").alias("metal"), "limit")
    g = gates.filter("area > 0").select("net", "gate", F.col("layer").alias("own"), F.col("area").cast("double").alias("gate_area"))
    met = metal.join(g, "net").filter("layer >= own").withColumn("ratio", F.col("metal") / F.col("gate_area"))
    return met.filter("ratio > limit").select("net", "gate", "layer", F.col("metal").alias("area"), "gate_area", "ratio")


def on_tracks(wires: DataFrame, grids: DataFrame) -> DataFrame:
    """Wires (layer, points, ...) with their vertices on the tracks of their layer (layer, x_origin, x_pitch, y_origin, y_pitch); those of one point left go.

    A layer without a grid keeps its wires.
    """
    j = wires.join(grids, "layer", "left")
    points = G.snapped_path(F.col("points"), (F.col("x_origin"), F.col("x_pitch")), (F.col("y_origin"), F.col("y_pitch")))
    return j.withColumn("points", points).filter("points is not null").select(*wires.columns)


def small_jogs(polygons: DataFrame, least: int, by: list[str] | None = None, tile: int = 512) -> DataFrame:
    """(by, x0, y0, x1, y1): the merged squares about the middles of edges along an axis that are shorter than `least`; polygons have `points`."""
    if least <= 0:
        raise ValueError("the least length must be positive")
    e = polygons.select(*(by or []), F.explode(G.edges_of(F.col("points"))).alias("e"))
    short = e.filter(G.is_axis_aligned(F.col("e")) & (G.length_squared(F.col("e")) < least * least))
    x, y = G.midpoint(F.col("e"))
    half = least // 2
    squares = short.select(*(by or []), (x - half).alias("x0"), (y - half).alias("y0"), (x + half).alias("x1"), (y + half).alias("y1"))
    return region.merged(squares, by, tile)


def clipped_shapes(shapes: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """Shapes (kind, x0, y0, x1, y1, ...) that meet a box: kind box cut to it, text by its anchor (x0, y0), others whole. Borders count."""
    b = tuple(F.lit(v).cast("bigint") for v in box)
    own = tuple(F.col(c) for c in BOX)
    held = F.when(F.col("kind") == "text", G.contains(*b, F.col("x0"), F.col("y0"))).otherwise(G.touches(own, b))
    cut = {c: F.when(F.col("kind") == "box", v).otherwise(F.col(c)) for c, v in zip(BOX, G.intersection(own, b), strict=True)}
    return shapes.filter(held).withColumns(cut)


def clipped_instances(instances: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """Instances (dx, dy, ...) whose origin is in a box."""
    return instances.filter(G.contains(*[F.lit(v).cast("bigint") for v in box], F.col("dx"), F.col("dy")))


def replaced_instances(instances: DataFrame, which: Column, replacement: int) -> DataFrame:
    """Instances with another child where a condition holds; null is no."""
    return instances.withColumn("child", F.when(which, F.lit(replacement).cast("bigint")).otherwise(F.col("child")))
