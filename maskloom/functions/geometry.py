"""Column functions on boxes, transforms and polygons. Coordinates are whole database units; products are exact decimals.

A box is four columns x0, y0, x1, y1; an empty box is null. A polygon is an array of struct<x, y>. A transform mirrors
about the x axis, then rotates by quarter turns, then moves.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(19,0)"


def width(x0: Column, x1: Column) -> Column:
    return F.coalesce(x1 - x0, F.lit(0))


def contains(x0, y0, x1, y1, x, y) -> Column:
    """Closed: a point on the border is inside; nothing is in an empty box."""
    return F.coalesce((x >= x0) & (x <= x1) & (y >= y0) & (y <= y1), F.lit(False))


def touches(a, b) -> Column:
    """Closed overlap of two boxes (tuples of four columns)."""
    return F.coalesce((a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3]), F.lit(False))


def overlaps(a, b) -> Column:
    """Open overlap: a common border alone does not count."""
    return F.coalesce((a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3]), F.lit(False))


def within(a, b) -> Column:
    """Whether box a lies in box b, borders allowed."""
    return F.coalesce((a[0] >= b[0]) & (a[2] <= b[2]) & (a[1] >= b[1]) & (a[3] <= b[3]), F.lit(False))


def intersection(a, b) -> tuple[Column, ...]:
    """The common box; null where there is none. A box of no width is one."""
    ok = touches(a, b)
    return tuple(F.when(ok, f(x, y)) for f, x, y in zip((F.greatest, F.greatest, F.least, F.least), a, b, strict=True))


def union(a, b) -> tuple[Column, ...]:
    """The least box over both; an empty box changes nothing."""
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def rotate(rot: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point turned by rot quarter turns."""
    r = F.pmod(rot, F.lit(4))
    return F.when(r == 0, x).when(r == 1, -y).when(r == 2, -x).otherwise(y), F.when(r == 0, y).when(r == 1, x).when(r == 2, -y).otherwise(-x)


def apply(rot: Column, mirror: Column, dx: Column, dy: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """The transform of a point."""
    px, py = rotate(rot, x, F.when(mirror, -y).otherwise(y))
    return px + dx, py + dy


def apply_box(rot, mirror, dx, dy, box) -> tuple[Column, ...]:
    """The box over a transformed box."""
    ax, ay = apply(rot, mirror, dx, dy, box[0], box[1])
    bx, by = apply(rot, mirror, dx, dy, box[2], box[3])
    return F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by)


def compose(a, b) -> tuple[Column, ...]:
    """The transform (rot, mirror, dx, dy) that applies b and then a."""
    rot = F.pmod(a[0] + F.when(a[1], -b[0]).otherwise(b[0]), F.lit(4))
    dx, dy = apply(a[0], a[1], a[2], a[3], b[2], b[3])
    return rot, a[1] != b[1], dx, dy


def inverse(t) -> tuple[Column, ...]:
    """The transform that undoes t; a mirrored one keeps its rotation."""
    rot = F.when(t[1], t[0]).otherwise(F.pmod(-t[0], F.lit(4)))
    zero = F.lit(0).cast("bigint")
    x, y = apply(rot, t[1], zero, zero, t[2], t[3])
    return rot, t[1], -x, -y


def box_polygon(x0, y0, x1, y1) -> Column:
    """A box as a polygon, clockwise from its lowest and then leftmost corner."""
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x0, y1), (x1, y1), (x1, y0))])


def _next(points: Column) -> Column:
    return F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))


def double_area(points: Column) -> Column:
    """Twice the signed area, positive counter-clockwise, as decimal(38,0)."""
    terms = F.zip_with(points, _next(points), lambda p, q: p["x"].cast(WIDE) * q["y"].cast(WIDE) - q["x"].cast(WIDE) * p["y"].cast(WIDE))
    return F.aggregate(terms, F.lit(0).cast("decimal(38,0)"), lambda a, t: (a + t).cast("decimal(38,0)"))


def perimeter(points: Column) -> Column:
    """The sum of edge lengths, each rounded to a whole unit."""
    steps = F.zip_with(points, _next(points), lambda p, q: F.round(F.hypot((q["x"] - p["x"]).cast("double"), (q["y"] - p["y"]).cast("double"))).cast("bigint"))
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, t: a + t)


def canonical(points: Column) -> Column:
    """The ring clockwise, from its lowest and then leftmost point."""
    turned = F.when(double_area(points) > 0, F.reverse(points)).otherwise(points)
    keys = F.transform(turned, lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x")))
    at = F.array_position(keys, F.array_min(keys)).cast("int")
    return F.concat(F.slice(turned, at, F.size(turned)), F.slice(turned, 1, at - 1))


def bounds(points: Column) -> tuple[Column, ...]:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def transformed(points: Column, rot, mirror, dx, dy) -> Column:
    def one(p):
        x, y = apply(rot, mirror, dx, dy, p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(points, one)


def point_in_ring(points: Column, x: Column, y: Column) -> Column:
    """Whether a point is in a ring, its border included."""
    pairs = F.zip_with(points, _next(points), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    cross = lambda e: (e["q"]["x"] - e["p"]["x"]).cast(WIDE) * (y - e["p"]["y"]).cast(WIDE) - (x - e["p"]["x"]).cast(WIDE) * (e["q"]["y"] - e["p"]["y"]).cast(WIDE)
    on = F.exists(pairs, lambda e: (cross(e) == 0) & (x >= F.least(e["p"]["x"], e["q"]["x"])) & (x <= F.greatest(e["p"]["x"], e["q"]["x"])) & (y >= F.least(e["p"]["y"], e["q"]["y"])) & (y <= F.greatest(e["p"]["y"], e["q"]["y"])))
    hits = F.filter(pairs, lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & F.when(e["q"]["y"] > e["p"]["y"], cross(e) > 0).otherwise(cross(e) < 0))
    return on | (F.size(hits) % 2 == 1)


def edges_of(points: Column) -> Column:
    """The ring's edges as struct<ax, ay, bx, by>, without those of no length."""
    made = F.zip_with(points, _next(points), lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))
    return F.filter(made, lambda e: (e["ax"] != e["bx"]) | (e["ay"] != e["by"]))


def length_squared(e) -> Column:
    dx, dy = (e["bx"] - e["ax"]).cast(WIDE), (e["by"] - e["ay"]).cast(WIDE)
    return dx * dx + dy * dy


def angle(e) -> Column:
    """Degrees of an edge from 0 to below 180."""
    return F.pmod(F.degrees(F.atan2((e["by"] - e["ay"]).cast("double"), (e["bx"] - e["ax"]).cast("double"))), F.lit(180.0))


def path_box(points: Column, path_width: Column) -> Column:
    """Bounds of a path: its points' by half the width (whole units) on each side; extensions don't count."""
    half = F.floor(path_width / 2).cast("bigint")
    x0, y0, x1, y1 = bounds(points)
    return F.struct((x0 - half).alias("x0"), (y0 - half).alias("y0"), (x1 + half).alias("x1"), (y1 + half).alias("y1"))


def snap(value: Column, origin: int, pitch: int) -> Column:
    """The nearest track of a grid."""
    return (F.round((value - origin) / F.lit(pitch)) * pitch + origin).cast("bigint")


def bus_parts(name: Column) -> Column:
    """struct<base, hi, lo> of `A[3:0]` or `A[3]`; null where the name is no bus."""
    pattern = r"^(.*)\[(-?[0-9]+)(?::(-?[0-9]+))?\]$"
    hi = F.try_to_number(F.nullif(F.regexp_extract(name, pattern, 2), F.lit("")), F.lit("S999999999")).cast("int")
    lo = F.try_to_number(F.nullif(F.regexp_extract(name, pattern, 3), F.lit("")), F.lit("S999999999")).cast("int")
    return F.when(hi.isNotNull(), F.struct(F.regexp_extract(name, pattern, 1).alias("base"), hi.alias("hi"), F.coalesce(lo, hi).alias("lo")))


def bus_names(bus: Column) -> Column:
    """Scalar names of a bus in declared order."""
    step = F.when(bus["hi"] >= bus["lo"], F.lit(-1)).otherwise(F.lit(1))
    return F.transform(F.sequence(bus["hi"], bus["lo"], step), lambda i: F.concat(bus["base"], F.lit("["), i.cast("string"), F.lit("]")))


def bilinear(axis1: Column, axis2: Column, values: Column, slew: Column, load: Column) -> Column:
    """A two-axis table at (slew, load), linear between its points and clamped at its edges; 0 for an empty table."""
    n1, n2 = F.size(axis1), F.size(axis2)

    def bracket(axis, n, v):
        below = F.size(F.filter(axis, lambda x: x <= v))
        at = F.greatest(F.least(below, n - 1), F.lit(1))
        a, b = F.get(axis, at - 1), F.get(axis, F.least(at, n - 1))
        return at, F.when(b > a, F.greatest(F.least((v - a) / (b - a), F.lit(1.0)), F.lit(0.0))).otherwise(F.lit(0.0))

    i, f = bracket(axis1, n1, slew)
    j, g = bracket(axis2, n2, load)
    at = lambda a, b: F.get(values, F.least(a, n1 - 1) * n2 + F.least(b, n2 - 1))
    low = at(i - 1, j - 1) * (1 - g) + at(i - 1, j) * g
    high = at(i, j - 1) * (1 - g) + at(i, j) * g
    return F.when((n1 > 0) & (n2 > 0), low * (1 - f) + high * f).otherwise(F.lit(0.0))


def black_mttf_years(j: Column, j_ref: float, mttf_ref: float, n: float) -> Column:
    """Black's equation against a reference current density; unbounded for no current."""
    return F.when(j <= 0, F.lit(float("inf"))).otherwise(mttf_ref * F.pow(F.lit(j_ref) / j, F.lit(n)))


def midpoint(e) -> tuple[Column, Column]:
    """The middle of an edge, towards zero where it lies between two units."""
    half = lambda v: (F.signum(v) * F.floor(F.abs(v) / F.lit(2))).cast("bigint")
    return half(e["ax"] + e["bx"]), half(e["ay"] + e["by"])


def edge_box(e) -> tuple[Column, ...]:
    return F.least(e["ax"], e["bx"]), F.least(e["ay"], e["by"]), F.greatest(e["ax"], e["bx"]), F.greatest(e["ay"], e["by"])


def is_horizontal(e) -> Column:
    return (e["ay"] == e["by"]) & (e["ax"] != e["bx"])


def is_vertical(e) -> Column:
    return (e["ax"] == e["bx"]) & (e["ay"] != e["by"])


def is_axis_aligned(e) -> Column:
    return is_horizontal(e) | is_vertical(e)


def _proper(e) -> Column:
    return (e["ax"] != e["bx"]) | (e["ay"] != e["by"])


def has_angle(e, degrees: float, tolerance: float, other: bool = False) -> Column:
    """Whether an edge runs within a tolerance of an angle, either way round, or (other) whether it doesn't; edges of no length do neither."""
    off = F.abs(angle(e) - F.lit(float(degrees))) % F.lit(180.0)
    near = F.when(off > 90, 180.0 - off).otherwise(off) <= tolerance
    return _proper(e) & (~near if other else near)


def length_at_least(e, least: int) -> Column:
    return length_squared(e) >= F.lit(least * least).cast("decimal(38,0)")


def length_at_most(e, most: int) -> Column:
    return length_squared(e) <= F.lit(most * most).cast("decimal(38,0)")


def _edge(ax, ay, bx, by) -> Column:
    return F.struct(*[F.round(v).cast("bigint").alias(n) for v, n in ((ax, "ax"), (ay, "ay"), (bx, "bx"), (by, "by"))])


def _along(e) -> tuple[Column, Column, Column]:
    dx, dy = (e["bx"] - e["ax"]).cast("double"), (e["by"] - e["ay"]).cast("double")
    return dx, dy, F.sqrt(dx * dx + dy * dy)


def edge_center(e, length: int) -> Column:
    """The piece of a length about the middle of an edge; shorter edges whole; null for edges and pieces of no length."""
    dx, dy, n = _along(e)
    x, y = midpoint(e)
    t = F.lit(float(length)) / (2 * n)
    piece = _edge(x - dx * t, y - dy * t, x + dx * t, y + dy * t)
    whole = F.struct(*[e[n_].alias(n_) for n_ in ("ax", "ay", "bx", "by")])
    return F.when(_proper(e) & F.lit(length > 0), F.when(F.floor(n) <= length, whole).otherwise(piece))


def edge_extended(e, before: int, after: int) -> Column:
    """An edge made longer at its start and end, in whole units; an edge of no length stays."""
    dx, dy, n = _along(e)
    ux, uy = dx / n, dy / n
    whole = F.struct(*[e[n_].alias(n_) for n_ in ("ax", "ay", "bx", "by")])
    return F.when(_proper(e), _edge(e["ax"] - ux * before, e["ay"] - uy * before, e["bx"] + ux * after, e["by"] + uy * after)).otherwise(whole)


def path_outline(points: Column, path_width: Column, before: Column, after: Column) -> Column:
    """The polygon of a straight path of two points along an axis: half the width, towards zero, on each side, longer by `before` and `after` at its ends."""
    a, b = F.get(points, F.lit(0)), F.get(points, F.lit(1))
    half = F.floor(path_width / 2).cast("bigint")
    sx, sy = F.signum(b["x"] - a["x"]).cast("bigint"), F.signum(b["y"] - a["y"]).cast("bigint")
    x0, y0, x1, y1 = a["x"] - sx * before, a["y"] - sy * before, b["x"] + sx * after, b["y"] + sy * after
    left, low = F.least(x0, x1) - F.abs(sy) * half, F.least(y0, y1) - F.abs(sx) * half
    right, high = F.greatest(x0, x1) + F.abs(sy) * half, F.greatest(y0, y1) + F.abs(sx) * half
    return F.when((F.size(points) == 2) & (path_width > 0) & (F.abs(sx) + F.abs(sy) == 1), box_polygon(left, low, right, high))


def turned(angle_: Column, rot: Column, mirror: Column) -> Column:
    """A port's direction (0 east, then counter-clockwise in quarter turns) under a transform: a mirror swaps north and south before the turn."""
    return F.pmod(F.when(mirror, -angle_).otherwise(angle_) + rot, F.lit(4))


def repeats(rows: Column, cols: Column, offsets: Column) -> Column:
    """Placements of a repetition: rows times columns, or one more than its offsets."""
    return F.when(offsets.isNotNull(), F.size(offsets) + 1).otherwise(rows * cols).cast("bigint")


def repeat_box(row, col, rows: Column, cols: Column) -> tuple[Column, ...]:
    """The box over the origin and the far corner of a regular repetition, of steps row and col (x, y); null if it has no placement."""
    x, y = col[0] * (cols - 1) + row[0] * (rows - 1), col[1] * (cols - 1) + row[1] * (rows - 1)
    zero, ok = F.lit(0).cast("bigint"), (rows > 0) & (cols > 0)
    return tuple(F.when(ok, f(v, zero)) for f, v in ((F.least, x), (F.least, y), (F.greatest, x), (F.greatest, y)))


def expanded(box, x: Column, y: Column) -> tuple[Column, ...]:
    """The least box over a box and a point; of an empty box, the point."""
    return union(box, (x, y, x, y))


def _snapped(value: Column, origin: Column, pitch: Column) -> Column:
    off = value - origin
    whole = F.signum(off) * F.floor((F.abs(off) + F.floor(pitch / 2)) / F.greatest(pitch, F.lit(1)))
    return F.when(pitch > 1, origin + whole.cast("bigint") * pitch).otherwise(value)


def snapped_path(points: Column, x_grid, y_grid) -> Column:
    """The vertices of a wire on the nearest tracks of (origin, pitch) grids, halves away from the origin, repeated ones dropped; null if one vertex is left.

    A grid that is null or has a pitch of one or less leaves its coordinate as it is.
    """
    on = lambda v, grid: F.coalesce(_snapped(v, *grid), v).cast("bigint")
    moved = F.transform(points, lambda p: F.struct(on(p["x"], x_grid).alias("x"), on(p["y"], y_grid).alias("y")))
    kept = F.filter(F.arrays_zip(moved.alias("p"), F.concat(F.array(F.lit(None).cast("struct<x: bigint, y: bigint>")), moved).alias("before")), lambda z: z["p"].isNotNull() & ~z["p"].eqNullSafe(z["before"]))
    return F.when(F.size(kept) >= 2, F.transform(kept, lambda z: z["p"]))


def polygon_issues(points: Column) -> Column:
    """What is wrong with a ring, in a fixed order: duplicate_vertex, zero_area, self_intersecting (edges along the axes that cross), wrong_winding.

    Under three points it is zero_area alone. An area of half a unit counts as none.
    """
    n, area = F.size(points), double_area(points)
    pairs = F.zip_with(points, _next(points), lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))
    repeated = F.exists(pairs, lambda e: (e["ax"] == e["bx"]) & (e["ay"] == e["by"]))

    def crosses(h, v):
        flat = (h["ay"] == h["by"]) & (v["ax"] == v["bx"])
        x = (v["ax"] > F.least(h["ax"], h["bx"])) & (v["ax"] < F.greatest(h["ax"], h["bx"]))
        return flat & x & (h["ay"] > F.least(v["ay"], v["by"])) & (h["ay"] < F.greatest(v["ay"], v["by"]))

    crossed = F.exists(pairs, lambda h: F.exists(pairs, lambda v: crosses(h, v)))  # neighbours share an end, so they never cross
    found = F.array(F.when(repeated, "duplicate_vertex"), F.when(F.abs(area) < 2, "zero_area"), F.when(crossed, "self_intersecting"), F.when(area >= 2, "wrong_winding"))
    return F.when(n < 3, F.array(F.lit("zero_area"))).otherwise(F.array_compact(found))


def lookup_table(body: Column) -> Column:
    """struct<index_1, index_2, values> of the text of a timing table: numbers in quoted rows, or without quotes; what is not named is empty.

    The last statement of a name holds. Text that is no number is an error.
    """

    def numbers(name):
        payload = F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(body, F.lit(rf"(?:^|[;{{\s]){name}\s*\(([^)]*)\)"), F.lit(1))), -1)
        rows = F.when(F.contains(payload, F.lit('"')), F.array_join(F.regexp_extract_all(payload, F.lit('"([^"]*)"'), F.lit(1)), ",")).otherwise(payload)
        return F.transform(F.filter(F.split(rows, ","), lambda t: F.regexp_like(t, F.lit(r"\S"))), lambda t: F.regexp_replace(t, r"\s", "").cast("double")).alias(name)

    return F.struct(numbers("index_1"), numbers("index_2"), numbers("values"))


def table_at(body: Column, slew: Column, load: Column) -> Column:
    """The value of a timing table's text at (slew, load); null without a table."""
    # the table is bound once: each use of its columns would read the text again
    value = F.transform(F.array(lookup_table(body)), lambda t: bilinear(t["index_1"], t["index_2"], t["values"], slew, load))
    return F.when(body.isNotNull(), F.get(value, F.lit(0)))
