"""Exact boolean algebra on sets of rectangles, tile by tile, as slab rectangles.

In a tile each rectangle is +1 and -1 at its corners. Running sums of these give both operands' coverage of each cell between neighbouring
borders, and a predicate on it keeps the cell. A tile has no more cells than units, so that its work and rows don't grow with the square of its rectangles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from maskloom.operators.spatial import BOX
from maskloom.plans.groups import Rows, by_key, numbers, pieces

UNION = lambda a, b: (a > 0) | (b > 0)
INTERSECTION = lambda a, b: (a > 0) & (b > 0)
DIFFERENCE = lambda a, b: (a > 0) & (b <= 0)
XOR = lambda a, b: (a > 0) != (b > 0)


def _clipped(df: DataFrame, side: int, tile: int, by: list[str]) -> DataFrame:
    df = df.filter("x1 > x0 and y1 > y0")
    df = df.withColumn("tx", F.explode(F.sequence(F.floor(F.col("x0") / tile), F.floor((F.col("x1") - 1) / tile))))
    df = df.withColumn("ty", F.explode(F.sequence(F.floor(F.col("y0") / tile), F.floor((F.col("y1") - 1) / tile))))
    low = lambda d: F.greatest(F.col(f"{d}0"), F.col(f"t{d}") * tile).cast("bigint").alias(f"{d}0")
    high = lambda d: F.least(F.col(f"{d}1"), (F.col(f"t{d}") + 1) * tile).cast("bigint").alias(f"{d}1")
    return df.select(*by, "tx", "ty", F.lit(side).alias("side"), low("x"), low("y"), high("x"), high("y"))


def boolean(a: DataFrame, b: DataFrame, keep, by: list[str] | None = None, tile: int = 512) -> DataFrame:
    """(by, x0, y0, x1, y1): disjoint rectangles that cover exactly where keep(coverage by a, coverage by b) holds.

    Rectangles end at tile borders. by: columns whose values are regions of their own, such as a layer.
    Rows with a null in `by` belong to no region. Coordinates are whole numbers.
    """
    by = by or []
    key = [*by, "tx", "ty"]
    rows = _clipped(a, 0, tile, by).unionAll(_clipped(b, 1, tile, by))
    rows = rows.dropna(subset=by) if by else rows
    schema = StructType([*[rows.schema[c] for c in by], *[StructField(c, LongType()) for c in BOX]])
    return by_key(rows, *key).mapInArrow(_sweep(keep, by, to_arrow_schema(schema)), schema)


def _corners(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Places with what the coverage of either side changes by there; those of one place are added up."""
    x, y, da, db = (np.concatenate(v) for v in zip(*held, strict=True))
    order = np.lexsort((y, x))
    x, y, da, db = x[order], y[order], da[order], db[order]
    first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    return [x[first], y[first], np.add.reduceat(da, first), np.add.reduceat(db, first)]


def _rectangles(x: np.ndarray, y: np.ndarray, da: np.ndarray, db: np.ndarray, keep) -> dict[str, np.ndarray]:
    """Rectangles of the places where keep holds: runs along y between neighbouring x, and equal runs beside each other as one."""
    xs, i = np.unique(x, return_inverse=True)
    ys, j = np.unique(y, return_inverse=True)
    cover = np.zeros((2, len(xs), len(ys)), np.int64)
    np.add.at(cover[0], (i, j), da)
    np.add.at(cover[1], (i, j), db)
    a, b = cover.cumsum(1).cumsum(2)
    kept = np.zeros((len(xs), len(ys) + 1), np.int8)
    kept[:-1, 1:-1] = keep(a, b)[:-1, :-1]
    steps = np.diff(kept, axis=1)
    (col, lo), (_, hi) = np.nonzero(steps > 0), np.nonzero(steps < 0)
    order = np.lexsort((col, hi, lo))
    col, lo, hi = col[order], lo[order], hi[order]
    new = np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (col[1:] != col[:-1] + 1)][: len(col)]
    first, last = np.flatnonzero(new), np.flatnonzero(np.r_[new[1:], True][: len(col)])
    return {"x0": xs[col[first]], "y0": ys[lo[first]], "x1": xs[col[last] + 1], "y1": ys[hi[first]]}


def _sweep(keep, by: list[str], schema: pa.Schema, most: int = 1 << 18):
    """The rectangles of each tile. Of a tile's rows only corners are held, each place once, so that a crowded tile takes no more than its own area."""

    def run(batches):
        out, at, held = Rows(schema, by), None, []
        for key, rows in pieces(batches, [*by, "tx", "ty"]):
            if at is not None and key != at:
                yield from out.add(at[: len(by)], **_rectangles(*_corners(held), keep))
                held = []
            at = key
            x0, y0, x1, y1, side = numbers(rows, *BOX, "side")
            one = np.repeat([1, -1, -1, 1], len(x0))
            side = np.tile(side, 4)
            held.append([np.concatenate([x0, x0, x1, x1]), np.concatenate([y0, y1, y0, y1]), np.where(side == 0, one, 0), np.where(side == 1, one, 0)])
            if len(held) > 1 and sum(len(h[0]) for h in held[1:]) > max(most, len(held[0][0])):
                held = [_corners(held)]
        if at is not None:
            yield from out.add(at[: len(by)], **_rectangles(*_corners(held), keep))
        yield from out.rest()

    return run


def merged(a: DataFrame, by: list[str] | None = None, tile: int = 512) -> DataFrame:
    return boolean(a, a.limit(0), UNION, by, tile)


def sized(a: DataFrame, delta: int, by: list[str] | None = None, tile: int = 512) -> DataFrame:
    """The region grown by delta on all sides, corners kept square. Needs delta >= 0; a shrink is the growth of the complement."""
    if delta < 0:
        raise ValueError("delta must not be negative")
    grown = a.withColumns({"x0": F.col("x0") - delta, "y0": F.col("y0") - delta, "x1": F.col("x1") + delta, "y1": F.col("y1") + delta})
    return merged(grown, by, tile)


def shrunk(a: DataFrame, delta: int, by: list[str] | None = None, tile: int = 512) -> DataFrame:
    """The region less all points nearer than delta to its outside: the complement in a frame grows, and is taken away."""
    by = by or []
    frame = a.groupBy(*by).agg(*[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    frame = frame.withColumns({"x0": F.col("x0") - 2 * delta, "y0": F.col("y0") - 2 * delta, "x1": F.col("x1") + 2 * delta, "y1": F.col("y1") + 2 * delta})
    outside = boolean(frame, a, DIFFERENCE, by, tile)
    return boolean(a, sized(outside, delta, by, tile), DIFFERENCE, by, tile)


def area(rects: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rects.groupBy(*(by or [])).agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))


def waived(violations: DataFrame, waivers: DataFrame, tile: int = 512) -> DataFrame:
    """Violations (rule, box) less the waivers of the same rule."""
    return boolean(violations, waivers, DIFFERENCE, ["rule"], tile)


def waiver_hits(violations: DataFrame, waivers: DataFrame, tile: int = 512) -> DataFrame:
    """(rule, waiver, area): what each waiver takes of its rule's violations, which can overlap."""
    whole = merged(violations, ["rule"], tile)
    keyed = whole.join(waivers.select("rule", "waiver").distinct(), "rule")
    return area(boolean(keyed, waivers, INTERSECTION, ["rule", "waiver"], tile), ["rule", "waiver"])


