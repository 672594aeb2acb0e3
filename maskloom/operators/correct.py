"""Mask corrections, lithography checks and fill on rectangles, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.operators.spatial import BOX, pairs


def _boxes(df: DataFrame, keep: list[str], *boxes) -> DataFrame:
    made = F.array_compact(F.array(*[F.when(ok, F.struct(F.lit(side).alias("side"), *[v.alias(c) for v, c in zip(box, BOX, strict=True)])) for ok, side, box in boxes]))
    return df.withColumn("__b", F.explode(made)).select(*keep, "__b.*")


def serifs(rects: DataFrame, size: int) -> DataFrame:
    """(id, side, box): a square of side `size` about each corner."""
    h = size // 2
    one = lambda side, x, y: (F.lit(True), side, (F.col(x) - h, F.col(y) - h, F.col(x) - h + size, F.col(y) - h + size))
    return _boxes(rects, ["id"], one("ll", "x0", "y0"), one("lr", "x1", "y0"), one("ul", "x0", "y1"), one("ur", "x1", "y1"))


def hammerheads(rects: DataFrame, width: int, depth: int) -> DataFrame:
    """(id, side, box): caps over line ends, which are sides of at most 1.5 * width, reaching `depth` beyond the end and to each side."""
    x0, y0, x1, y1 = (F.col(c) for c in BOX)
    short_x, short_y = (x1 - x0) * 2 <= 3 * width, (y1 - y0) * 2 <= 3 * width
    return _boxes(rects, ["id"], (short_y, "left", (x0 - depth, y0 - depth, x0, y1 + depth)), (short_y, "right", (x1, y0 - depth, x1 + depth, y1 + depth)), (short_x, "bottom", (x0 - depth, y0 - depth, x1 + depth, y0)), (short_x, "top", (x0 - depth, y1, x1 + depth, y1 + depth)))


def assist_bars(rects: DataFrame, least: int, gap: int, width: int) -> DataFrame:
    """(id, side, box): bars of `width` at a distance of `gap` outside every side of at least `least`."""
    x0, y0, x1, y1 = (F.col(c) for c in BOX)
    tall, wide = y1 - y0 >= least, x1 - x0 >= least
    return _boxes(rects, ["id"], (tall, "left", (x0 - gap - width, y0, x0 - gap, y1)), (tall, "right", (x1 + gap, y0, x1 + gap + width, y1)), (wide, "bottom", (x0, y0 - gap - width, x1, y0 - gap)), (wide, "top", (x0, y1 + gap, x1, y1 + gap + width)))


def near_corners(rects: DataFrame, reach: int, by: list[str] | None = None) -> DataFrame:
    """(a_id, b_id, squared): corners of different rectangles, equal in the columns `by`, with 0 < distance < reach, each pair of corners once.

    Tiles of twice the reach: a corner meets those of four tiles, five times what is near it, however many there are.
    """
    by = by or []
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(x).alias("x"), F.col(y).alias("y")) for i, (x, y) in enumerate((("x0", "y0"), ("x0", "y1"), ("x1", "y1"), ("x1", "y0")))]))
    points = rects.withColumn("c", corner).select("id", *by, "c.*").select("id", *by, "k", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    d = (F.col("a_x0") - F.col("b_x0")) * (F.col("a_x0") - F.col("b_x0")) + (F.col("a_y0") - F.col("b_y0")) * (F.col("a_y0") - F.col("b_y0"))
    return pairs(points, points, reach, 2 * reach, on=by).filter("a_id < b_id").withColumn("squared", d).filter((F.col("squared") > 0) & (F.col("squared") < reach * reach)).select("a_id", "b_id", "a_k", "b_k", "squared")


def fill(metal: DataFrame, core: tuple[int, int, int, int], tile: int, pitch: int, keep_out: int) -> DataFrame:
    """(i, j, box): squares of side `tile` on a grid of `pitch` in the core that stay `keep_out` away from all metal.

    The grid is not crossed with the metal: each shape names the grid places that it blocks.
    """
    x0, y0, x1, y1 = core
    nx, ny = (x1 - x0 - tile) // pitch + 1, (y1 - y0 - tile) // pitch + 1
    grid = metal.sparkSession.range(nx * ny).select((F.col("id") % nx).alias("i"), F.floor(F.col("id") / nx).alias("j"))
    span = lambda lo, hi, at, n: F.sequence(F.greatest(F.floor((F.col(lo) - keep_out - tile - at) / F.lit(pitch)) + 1, F.lit(0)), F.least(F.ceil((F.col(hi) + keep_out - at) / F.lit(pitch)) - 1, F.lit(n - 1)))
    ok = lambda lo, hi, at, n: F.least(F.ceil((F.col(hi) + keep_out - at) / F.lit(pitch)) - 1, F.lit(n - 1)) >= F.greatest(F.floor((F.col(lo) - keep_out - tile - at) / F.lit(pitch)) + 1, F.lit(0))
    blocked = metal.filter(ok("x0", "x1", x0, nx) & ok("y0", "y1", y0, ny)).withColumn("i", F.explode(span("x0", "x1", x0, nx))).withColumn("j", F.explode(span("y0", "y1", y0, ny))).select("i", "j").distinct()
    free = grid.join(blocked, ["i", "j"], "left_anti")
    return free.select("i", "j", (F.col("i") * pitch + x0).alias("x0"), (F.col("j") * pitch + y0).alias("y0"), (F.col("i") * pitch + x0 + tile).alias("x1"), (F.col("j") * pitch + y0 + tile).alias("y1"))


def via_cuts(vias: DataFrame, cut: int, pitch: int) -> DataFrame:
    """(id, i, j, box): n by n cuts of vias (id, x, y, n), centred on their place."""
    half = F.floor(((F.col("n") - 1) * pitch + cut) / F.lit(2))
    v = vias.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return v.select("id", "i", "j", (F.col("x") - half + F.col("i") * pitch).alias("x0"), (F.col("y") - half + F.col("j") * pitch).alias("y0"), (F.col("x") - half + F.col("i") * pitch + cut).alias("x1"), (F.col("y") - half + F.col("j") * pitch + cut).alias("y1"))
