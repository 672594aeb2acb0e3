"""Rules on merged polygons: overlapping and abutting rectangles are one shape, and rules pair the edges of its border.

An edge is (axis, at, lo, hi, inner): it lies on x = at (axis v) or y = at (axis h), from lo to hi, and inner is 1 where the shape is on
the greater side of it, -1 where it is on the lesser. Edges are maximal, those of holes among them. A rule gives pairs of parallel edges
with a common extent: the first edge (at, lo, hi), the second (to, to_lo, to_hi) and their distance; these span the violation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.operators import region
from maskloom.operators.spatial import BOX, bounds, links, pairs
from maskloom.plans.graph import components

EDGE = ["axis", "at", "lo", "hi", "inner"]


def parts(rects: DataFrame, by: list[str] | None = None, tile: int = 256) -> DataFrame:
    """The rectangles with `part`, the least id of the polygon that they merge into. A common corner alone joins nothing."""
    by = by or []
    comp = components(links(rects, by, False, tile)).select(F.col("node").alias("id"), F.col("comp").alias("part"))
    return rects.join(comp, "id", "left").withColumn("part", F.coalesce("part", "id"))


def edges(rects: DataFrame, by: list[str] | None = None, tile: int = 512) -> DataFrame:
    """(by, axis, at, lo, hi, inner): the border of the merged shapes of each value of by.

    Along each line the sides of the merged slabs are +1 or -1; where two slabs abut they cancel, and what is left is the border.
    """
    by = by or []
    slabs = region.merged(rects.select(*by, *BOX), by, tile)
    side = lambda axis, at, lo, hi, sign: F.struct(F.lit(axis).alias("axis"), F.col(at).alias("at"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.lit(sign).alias("s"))
    sides = F.explode(F.array(side("v", "x0", "y0", "y1", 1), side("v", "x1", "y0", "y1", -1), side("h", "y0", "x0", "x1", 1), side("h", "y1", "x0", "x1", -1)))
    line = [*by, "axis", "at"]
    ends = F.explode(F.array(F.struct(F.col("e.lo").alias("p"), F.col("e.s").alias("d")), F.struct(F.col("e.hi").alias("p"), (-F.col("e.s")).alias("d"))))
    steps = slabs.select(*by, sides.alias("e")).select(*by, "e.axis", "e.at", ends.alias("x")).groupBy(*line, F.col("x.p").alias("p")).agg(F.sum("x.d").alias("d")).filter("d <> 0")
    w = Window.partitionBy(*line).orderBy("p")
    # steps of zero are gone, so that a border that goes on with the same sign is one edge already
    return steps.select(*line, F.col("p").alias("lo"), F.lead("p").over(w).alias("hi"), F.sum("d").over(w).cast("int").alias("inner")).filter("inner <> 0").select(*by, *EDGE)


def _boxes(e: DataFrame) -> DataFrame:
    v = F.col("axis") == "v"
    return e.withColumns({"x0": F.when(v, F.col("at")).otherwise(F.col("lo")), "x1": F.when(v, F.col("at")).otherwise(F.col("hi")), "y0": F.when(v, F.col("lo")).otherwise(F.col("at")), "y1": F.when(v, F.col("hi")).otherwise(F.col("at"))})


def _met(first: DataFrame, second: DataFrame, least: int, by: list[str], tile: int) -> DataFrame:
    """Pairs of edges (a_*, b_*) of one axis with 0 < b.at - a.at < least and a common extent; `from` and `until` bound it."""
    p = pairs(_boxes(first), _boxes(second), least, tile, on=[*by, "axis"])
    p = p.withColumn("dist", F.col("b_at") - F.col("a_at")).withColumn("from", F.greatest("a_lo", "b_lo")).withColumn("until", F.least("a_hi", "b_hi"))
    p = p.filter((F.col("dist") > 0) & (F.col("dist") < least) & (F.col("from") < F.col("until")))
    return p.withColumns({c: F.col(f"a_{c}") for c in [*by, "axis"]})


def _pair(p: DataFrame, by: list[str], a: tuple[Column, Column], b: tuple[Column, Column], *more: str) -> DataFrame:
    return p.select(*by, *more, "axis", F.col("a_at").alias("at"), a[0].alias("lo"), a[1].alias("hi"), F.col("b_at").alias("to"), b[0].alias("to_lo"), b[1].alias("to_hi"), "dist")


def _whole(p: DataFrame, by: list[str], *more: str) -> DataFrame:
    return _pair(p, by, (F.col("a_lo"), F.col("a_hi")), (F.col("b_lo"), F.col("b_hi")), *more)


def _slack(least: int) -> Column:
    """How far along an edge a point may be and still be nearer than `least` to the end of one at a distance of dist."""
    d = F.col("dist").cast("double")
    return F.round(F.sqrt(F.greatest(F.lit(float(least) ** 2) - d * d, F.lit(0.0)))).cast("bigint")


def space(rects: DataFrame, least: int, by: list[str] | None = None, tile: int = 256) -> DataFrame:
    """(by, part, to_part, axis, at, lo, hi, to, to_lo, to_hi, dist): edges of different polygons that face each other nearer than `least`."""
    by = by or []
    e = edges(parts(rects, by), [*by, "part"])
    p = _met(e.filter("inner < 0"), e.filter("inner > 0"), least, by, tile).filter("a_part <> b_part")
    return _whole(p.withColumnsRenamed({"a_part": "part", "b_part": "to_part"}), by, "part", "to_part")


def separation(a: DataFrame, b: DataFrame, least: int, tile: int = 256) -> DataFrame:
    """(axis, at, lo, hi, to, to_lo, to_hi, dist): edges of two regions that face each other nearer than `least`."""
    ea, eb = edges(a), edges(b)
    one = lambda x, y: _whole(_met(x.filter("inner < 0"), y.filter("inner > 0"), least, [], tile), [])
    return one(ea, eb).unionAll(one(eb, ea))


def _with_corners(e: DataFrame, by: list[str]) -> DataFrame:
    """Edges with bend_lo and bend_hi: whether the border turns away from the shape's inside at that end, so that the corner is concave."""
    other = F.when(F.col("axis") == "v", "h").otherwise("v")
    ends = e.withColumn("z", F.explode(F.array(F.struct(F.col("lo").alias("p"), F.lit(1).alias("goes")), F.struct(F.col("hi").alias("p"), F.lit(-1).alias("goes")))))
    # the edge across that ends here: it runs from the point to greater (1) or lesser (-1) places
    across = ends.select(*by, other.alias("axis"), F.col("z.p").alias("at"), F.col("at").alias("p"), F.col("z.goes").alias("goes"))
    turn = across.groupBy(*by, "axis", "at", "p").agg(F.min("goes").alias("g0"), F.max("goes").alias("g1"))
    at = lambda c, name: turn.withColumnRenamed("p", c).select(*by, "axis", "at", c, F.col("g0").alias(f"{name}0"), F.col("g1").alias(f"{name}1"))
    key = [*by, "axis", "at"]
    e = e.join(at("lo", "l"), [*key, "lo"], "left").join(at("hi", "h"), [*key, "hi"], "left")
    away = lambda n: F.when(F.col("inner") > 0, F.col(f"{n}0") < 0).otherwise(F.col(f"{n}1") > 0)
    return e.withColumn("bend_lo", F.coalesce(away("l"), F.lit(False))).withColumn("bend_hi", F.coalesce(away("h"), F.lit(False))).select(*by, *EDGE, "bend_lo", "bend_hi")


def width(rects: DataFrame, least: int, by: list[str] | None = None, tile: int = 256) -> DataFrame:
    """(by, part, axis, at, lo, hi, to, to_lo, to_hi, dist): opposite edges of a polygon nearer than `least`, over their common extent.

    Beyond a concave corner of one edge the other counts as far as it is nearer than `least` to that corner.
    """
    by = [*(by or []), "part"]
    e = _with_corners(edges(parts(rects, by[:-1]), by), by)
    p = _met(e.filter("inner > 0"), e.filter("inner < 0"), least, by, tile).withColumn("slack", _slack(least))

    def ends(own: str, other: str):
        low = F.when((F.col("from") == F.col(f"{other}_lo")) & F.col(f"{other}_bend_lo"), F.greatest(F.col("from") - F.col("slack"), F.col(f"{own}_lo"))).otherwise(F.col("from"))
        high = F.when((F.col("until") == F.col(f"{other}_hi")) & F.col(f"{other}_bend_hi"), F.least(F.col("until") + F.col("slack"), F.col(f"{own}_hi"))).otherwise(F.col("until"))
        return low, high

    return _pair(p, by, ends("a", "b"), ends("b", "a"))


def enclosing(outer: DataFrame, inner: DataFrame, least: int, tile: int = 256) -> DataFrame:
    """(axis, at, lo, hi, to, to_lo, to_hi, dist): edges of the inner region (at) that have an edge of the outer one (to) of the same direction
    outside of them, nearer than `least`; the outer edge counts as far as it is nearer than `least` to the inner one's ends."""
    eo, ei = edges(outer), edges(inner)
    out = None
    for sign in (1, -1):
        first, second = (eo, ei) if sign > 0 else (ei, eo)
        p = _met(first.filter(f"inner = {sign}"), second.filter(f"inner = {sign}"), least, [], tile).withColumn("slack", _slack(least))
        o, i = ("a", "b") if sign > 0 else ("b", "a")
        made = p.select(
            "axis", F.col(f"{i}_at").alias("at"), F.col(f"{i}_lo").alias("lo"), F.col(f"{i}_hi").alias("hi"), F.col(f"{o}_at").alias("to"),
            F.greatest(F.col(f"{i}_lo") - F.col("slack"), F.col(f"{o}_lo")).alias("to_lo"), F.least(F.col(f"{i}_hi") + F.col("slack"), F.col(f"{o}_hi")).alias("to_hi"), "dist",
        )
        out = made if out is None else out.unionAll(made)
    return out


def overlap(a: DataFrame, b: DataFrame, least: int, tile: int = 256) -> DataFrame:
    """(axis, at, lo, hi, to, to_lo, to_hi, dist): edges of two polygons, one of each region, whose boxes meet, with less than `least` between them that
    is inside both; each counts as far as it is nearer than `least` to the ends of the common extent."""
    pa, pb = parts(a), parts(b)
    ea, eb = edges(pa, ["part"]), edges(pb, ["part"])
    meet = pairs(bounds(pa, "part"), bounds(pb, "part"), 0, tile).select("a_part", "b_part").distinct()
    out = None
    for x, y, swap in ((ea, eb, False), (eb, ea, True)):
        p = _met(x.filter("inner > 0"), y.filter("inner < 0"), least, [], tile).withColumn("slack", _slack(least))
        keys = meet.select(F.col("a_part").alias("b_part"), F.col("b_part").alias("a_part")) if swap else meet
        p = p.join(keys, ["a_part", "b_part"], "left_semi")
        reach = lambda s: (F.greatest(F.col("from") - F.col("slack"), F.col(f"{s}_lo")), F.least(F.col("until") + F.col("slack"), F.col(f"{s}_hi")))
        made = _pair(p, [], reach("a"), reach("b"))
        out = made if out is None else out.unionAll(made)
    return out


def density_tiles(
    rects: DataFrame, window: tuple[int, int], step: tuple[int, int], low: float, high: float, boundary: DataFrame | None = None, origin: tuple[int, int] | None = None, count: tuple[int, int] | None = None, ignore_padding: bool = False, inside: bool = False, singletons: bool = True, tile: int = 512
) -> DataFrame:
    """(ix, iy, x0, y0, x1, y1, density): windows whose share of merged area is outside the band from low to high, or inside it.

    Tiles of `step` cover the box of the shapes and the boundary, enlarged by what a window reaches over its tile, and are centred on it unless an
    origin is given; each is measured over its window. The share is of the window's area or, with ignore_padding, of the boundary's area in it;
    windows without boundary are left out then. A plan of one tile gives nothing if singletons is false. Windows without shapes are listed too.
    """
    eps = 1e-10
    solid = region.merged(rects.select(*BOX), None, tile)
    box = bounds(rects.filter("x1 > x0 and y1 > y0"))
    edge = box if boundary is None else bounds(boundary.filter("x1 > x0 and y1 > y0"))
    lows = [F.least(F.col("l.x0"), F.col("b.x0")), F.least(F.col("l.y0"), F.col("b.y0")), F.greatest(F.col("l.x1"), F.col("b.x1")), F.greatest(F.col("l.y1"), F.col("b.y1"))]
    frame = box.withColumn("k", F.lit(0)).alias("l").join(edge.withColumn("k", F.lit(0)).alias("b"), "k").select(*[c.alias(n) for c, n in zip(lows, BOX, strict=True)]).dropna()  # one row each
    over = [max(0.0, 0.5 * (w - s)) for w, s in zip(window, step, strict=True)]
    reach = [int(o + 0.5) for o in over]
    for i, d in enumerate("xy"):
        wide = F.col(f"{d}1") - F.col(f"{d}0") + 2 * over[i]
        n = F.lit(max(1, count[i])) if count else F.greatest(F.ceil(wide / F.lit(float(step[i])) - eps), F.lit(1))
        frame = frame.withColumn(f"n{d}", n.cast("bigint"))
        start = F.lit(origin[i]) if origin else F.floor(0.5 + (F.col(f"{d}0") + F.col(f"{d}1")) * 0.5 - F.col(f"n{d}") * (0.5 * step[i]) + eps)
        frame = frame.withColumn(f"s{d}", start.cast("bigint"))
    if not singletons:
        frame = frame.filter("nx > 1 or ny > 1")
    span = lambda d: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"n{d}") - 1))
    grid = frame.withColumn("ix", span("x")).repartition(F.col("ix")).withColumn("iy", span("y"))
    at = lambda d, i, end: F.col(f"s{d}") + (F.col(f"i{d}") + end) * step[i] + (reach[i] if end else -reach[i])
    grid = grid.select("ix", "iy", at("x", 0, 0).alias("x0"), at("y", 1, 0).alias("y0"), at("x", 0, 1).alias("x1"), at("y", 1, 1).alias("y1"))

    def covered(shapes: DataFrame, name: str) -> DataFrame:
        """Area of shapes in each window; every shape names its windows by arithmetic, so that no join on positions is needed."""
        s = shapes.withColumn("k", F.lit(0)).join(frame.select("sx", "sy", "nx", "ny", F.lit(0).alias("k")), "k")
        for i, d in enumerate("xy"):
            first = F.floor((F.col(f"{d}0") - reach[i] - F.col(f"s{d}")) / F.lit(step[i])) if reach[i] else F.floor((F.col(f"{d}0") - F.col(f"s{d}")) / F.lit(step[i]))
            last = F.ceil((F.col(f"{d}1") + reach[i] - F.col(f"s{d}")) / F.lit(step[i])) - 1
            lo, hi = F.greatest(first, F.lit(0)), F.least(last, F.col(f"n{d}") - 1)
            s = s.filter(lo <= hi).withColumn(f"i{d}", F.explode(F.sequence(lo, hi)))
        cut = lambda d, i: F.least(F.col(f"{d}1"), at(d, i, 1)) - F.greatest(F.col(f"{d}0"), at(d, i, 0))
        return s.filter((cut("x", 0) > 0) & (cut("y", 1) > 0)).groupBy("ix", "iy").agg(F.sum(cut("x", 0) * cut("y", 1)).alias(name))

    out = grid.join(covered(solid, "area"), ["ix", "iy"], "left")
    whole = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    if ignore_padding:
        out = out.join(covered(region.merged(boundary.select(*BOX), None, tile) if boundary is not None else box, "of"), ["ix", "iy"])
        whole = F.col("of")
    out = out.withColumn("density", F.coalesce("area", F.lit(0)) / whole.cast("double"))
    held = (F.col("density") > low - eps) & (F.col("density") < high + eps)
    return out.filter(held if inside else ~held).select("ix", "iy", *BOX, "density")
