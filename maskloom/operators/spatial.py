"""Spatial joins on boxes: both sides are dealt to square tiles, and a pair counts in one tile only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.functions import geometry as G
from maskloom.plans.groups import Rows, by_key, numbers, pieces

BOX = ("x0", "y0", "x1", "y1")


def _tiled(df: DataFrame, tile: int, prefix: str, mark: str) -> DataFrame:
    """Copies of the rows for each tile that their box meets, with its place and whether it is the first one of the box in either direction."""
    for d in "xy":
        low, high = F.floor(F.col(f"{prefix}{d}0") / tile), F.floor(F.col(f"{prefix}{d}1") / tile)
        df = df.withColumn(f"{mark}l{d}", low).withColumn(f"{mark}t{d}", F.explode(F.sequence(low, high))).withColumn(f"{mark}f{d}", F.col(f"{mark}t{d}") == F.col(f"{mark}l{d}")).drop(f"{mark}l{d}")
    return df


def pairs(a: DataFrame, b: DataFrame, distance: int = 0, tile: int = 256, on: list[str] | None = None, coarse: int = 32) -> DataFrame:
    """All pairs of boxes of a and b whose boxes, a's grown by `distance`, share a point; columns under a_ and b_.

    on: columns that must be equal too. A box that spans more than `coarse` tiles is joined on tiles `coarse` times as
    wide, so that no box is copied to many tiles; a tile about as wide as the boxes and the distance keeps what is compared in proportion to what is found; the tile that holds the low corner of the
    common box owns the pair, so no pair comes twice. Rows with a null corner are empty boxes and join nothing.
    """
    on = on or []
    left = a.select([F.col(c).alias(f"a_{c}") for c in a.columns]).dropna(subset=[f"a_{c}" for c in BOX])
    right = b.select([F.col(c).alias(f"b_{c}") for c in b.columns]).dropna(subset=[f"b_{c}" for c in BOX])
    for c, sign in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1)):
        left = left.withColumn(f"__g{c}", F.col(f"a_{c}") + sign * distance)
    wide = lambda p: F.greatest(F.col(f"{p}x1") - F.col(f"{p}x0"), F.col(f"{p}y1") - F.col(f"{p}y0")) > tile * coarse
    parts = [
        (left.filter(~wide("__g")), right.filter(~wide("b_")), tile),
        (left.filter(wide("__g")), right, tile * coarse),
        (left.filter(~wide("__g")), right.filter(wide("b_")), tile * coarse),
    ]
    out = None
    for x, y, size in parts:
        x, y = _tiled(x, size, "__g", "__a"), _tiled(y, size, "b_", "__b")
        same = (F.col("__atx") == F.col("__btx")) & (F.col("__aty") == F.col("__bty"))
        for c in on:
            same = same & (F.col(f"a_{c}") == F.col(f"b_{c}"))
        near = G.touches([F.col(f"__g{c}") for c in BOX], [F.col(f"b_{c}") for c in BOX])
        # the common box begins in the first tile of one of the two
        own = (F.col("__afx") | F.col("__bfx")) & (F.col("__afy") | F.col("__bfy"))
        # a small file names many copies: dealt by tile they meet in all tasks, broadcast only in those that read the file
        y = y.hint("merge") if size == tile else y
        part = x.join(y, same & near & own).select(*[f"a_{c}" for c in a.columns], *[f"b_{c}" for c in b.columns])
        out = part if out is None else out.unionAll(part)
    return out


def _labels(cover: np.ndarray) -> np.ndarray:
    """A number for each covered cell of a grid, equal where cells are connected by their sides; -1 elsewhere."""
    at = np.nonzero(cover)
    first = cover.copy()
    first[:, 1:] &= ~cover[:, :-1]
    row = (np.cumsum(first.ravel()) - 1).reshape(cover.shape)[at]
    first = cover.copy()
    first[1:] &= ~cover[:-1]
    col = (np.cumsum(first.T.ravel()) - 1).reshape(cover.T.shape).T[at]
    label = np.arange(int(row.max(initial=-1)) + 1)
    while True:
        least = np.full(int(col.max(initial=-1)) + 1, len(label))
        np.minimum.at(least, col, label[row])
        new = label.copy()
        np.minimum.at(new, row, least[col])
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.full(cover.shape, -1)
    out[at] = label[row]
    return out


def _tile_links(x0, y0, x1, y1, ids: np.ndarray, tx: int, ty: int, tile: int, corners: bool) -> dict[str, np.ndarray]:
    """(a, b): each box of a tile and the least box that it is connected with there.

    Cells are the borders' places and what lies between two, so that boxes share a cell where they share a point. Without corners
    the crossings of two borders are no cells.
    """

    def places(lo, hi, start):
        lo, hi = np.maximum(lo, start), np.minimum(hi, start + tile)
        at = np.unique(np.concatenate([lo, hi]))
        return 2 * np.searchsorted(at, lo), 2 * np.searchsorted(at, hi) - (hi == start + tile), 2 * len(at)

    (i0, i1, n), (j0, j1, m) = places(x0, x1, tx * tile), places(y0, y1, ty * tile)
    step = np.zeros((n + 1, m + 1), np.int32)
    for i, j, d in ((i0, j0, 1), (i1 + 1, j0, -1), (i0, j1 + 1, -1), (i1 + 1, j1 + 1, 1)):
        np.add.at(step, (i, j), d)
    cover = step.cumsum(0).cumsum(1)[:-1, :-1] > 0
    if not corners:
        cover[::2, ::2] = False
    label = _labels(cover)
    if corners:
        box, own = np.arange(len(ids)), label[i0, j0]
    else:  # a box without area is no connected set of cells: it has those of all its cells
        flat = np.flatnonzero((i0 == i1) | (j0 == j1))
        full = np.flatnonzero((i0 < i1) & (j0 < j1))
        own = [label[i0[full] + 1, j0[full] + 1]]
        box = [full]
        for k in flat:
            v = np.unique(label[i0[k] : i1[k] + 1, j0[k] : j1[k] + 1])
            own.append(v[v >= 0])
            box.append(np.full(len(own[-1]), k))
        box, own = np.concatenate(box), np.concatenate(own)
    least = np.full(label.size, np.iinfo(np.int64).max)
    np.minimum.at(least, own, ids[box])
    a, b = ids[box], least[own]
    return {"a": a[a != b], "b": b[a != b]}


def links(rects: DataFrame, by: list[str] | None = None, corners: bool = True, tile: int = 256) -> DataFrame:
    """(a, b): links that connect the ids of boxes that share a point, equal in the columns `by`, directly or through others; one row a box and tile at most.

    corners: whether a common corner alone connects. Not all pairs are named: in a tile each box is linked with the least one of its set.
    Ids and coordinates are whole numbers.
    """
    by = by or []
    r = rects.select(*by, F.col("id").cast("bigint").alias("id"), *[F.col(c).cast("bigint").alias(c) for c in BOX]).dropna().filter("x1 >= x0 and y1 >= y0")
    for d in "xy":
        r = r.withColumn(f"t{d}", F.explode(F.sequence(F.floor(F.col(f"{d}0") / tile), F.floor(F.col(f"{d}1") / tile))))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        out, at, held = Rows(schema, []), None, []
        flush = lambda: out.add((), **_tile_links(*(np.concatenate(v) for v in zip(*held, strict=True)), *at[-2:], tile, corners))
        for key, rows in pieces(batches, [*by, "tx", "ty"]):
            if at is not None and key != at:
                yield from flush()
                held = []
            at = key
            held.append(numbers(rows, *BOX, "id"))
        if at is not None:
            yield from flush()
        yield from out.rest()

    return by_key(r, *by, "tx", "ty").mapInArrow(run, "a bigint, b bigint")


def _selected(a: DataFrame, b: DataFrame, key: str, test, anti: bool, tile: int) -> DataFrame:
    hit = pairs(a.select(key, *BOX), b.select(*BOX), 0, tile)
    hit = hit.filter(test([F.col(f"a_{c}") for c in BOX], [F.col(f"b_{c}") for c in BOX])).select(F.col(f"a_{key}").alias(key)).distinct()
    return a.join(hit, key, "left_anti" if anti else "left_semi")


def interacting(a: DataFrame, b: DataFrame, key: str = "id", tile: int = 256) -> DataFrame:
    """Rows of a whose box shares a point with a box of b."""
    return _selected(a, b, key, G.touches, False, tile)


def not_interacting(a: DataFrame, b: DataFrame, key: str = "id", tile: int = 256) -> DataFrame:
    return _selected(a, b, key, G.touches, True, tile)


outside = not_interacting  # touching disqualifies


def overlapping(a: DataFrame, b: DataFrame, key: str = "id", tile: int = 256) -> DataFrame:
    """Rows of a whose box overlaps a box of b by more than a border."""
    return _selected(a, b, key, G.overlaps, False, tile)


def not_overlapping(a: DataFrame, b: DataFrame, key: str = "id", tile: int = 256) -> DataFrame:
    return _selected(a, b, key, G.overlaps, True, tile)


def inside(a: DataFrame, b: DataFrame, key: str = "id", tile: int = 256) -> DataFrame:
    """Rows of a whose box lies in one box of b, borders allowed."""
    return _selected(a, b, key, G.within, False, tile)


def with_text(a: DataFrame, texts: DataFrame, label: str, key: str = "id", tile: int = 256) -> DataFrame:
    """Rows of a whose box holds the anchor of a text of that label."""
    points = texts.filter(F.col("label") == label).select(F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return interacting(a, points, key, tile)


def query_window(a: DataFrame, x0: int, y0: int, x1: int, y1: int, contained: bool = False) -> DataFrame:
    """Boxes that share a point with a window, or lie in it."""
    window = [F.lit(v) for v in (x0, y0, x1, y1)]
    return a.filter((G.within if contained else G.touches)([F.col(c) for c in BOX], window))


def bounds(df: DataFrame, *by: str) -> DataFrame:
    """The least box over the rows, or over those of each key."""
    return df.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
