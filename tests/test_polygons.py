"""Rules on merged polygons against borders, shapes and windows that a raster of unit squares gives."""

import math
import random

import pytest

from maskloom.operators import polygons

SCHEMA = "id bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint"
SPAN = 40


def some(n, seed, size=9):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.randrange(SPAN), rng.randrange(SPAN)
        rows.append((i, x, y, x + rng.randint(1, size), y + rng.randint(1, size)))
    return rows


def cells(rows):
    return {(x, y) for _, x0, y0, x1, y1 in rows for x in range(x0, x1) for y in range(y0, y1)}


def shapes(full):
    """Unit squares that share sides, as sets."""
    left, out = set(full), []
    while left:
        todo = [left.pop()]
        own = set(todo)
        while todo:
            x, y = todo.pop()
            for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if q in left:
                    left.discard(q)
                    own.add(q)
                    todo.append(q)
        out.append(own)
    return out


def border(full):
    """Maximal edges (axis, at, lo, hi, inner) of a set of unit squares."""
    units = {}
    for x, y in full:
        for key, beyond in ((("v", x, 1, y), (x - 1, y)), (("v", x + 1, -1, y), (x + 1, y)), (("h", y, 1, x), (x, y - 1)), (("h", y + 1, -1, x), (x, y + 1))):
            if beyond not in full:
                units.setdefault(key[:3], []).append(key[3])
    out = set()
    for (axis, at, inner), places in units.items():
        places.sort()
        start = last = places[0]
        for p in [*places[1:], None]:
            if p != last + 1:
                out.add((axis, at, start, last + 1, inner))
                start = p
            last = p
    return out


def facing(first, second, least):
    for a in first:
        for b in second:
            d, lo, hi = b[1] - a[1], max(a[2], b[2]), min(a[3], b[3])
            if a[0] == b[0] and 0 < d < least and lo < hi:
                yield a, b, d, lo, hi


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def got(df, *names):
    rows = [tuple(r[n] for n in names) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


PAIR = ("axis", "at", "lo", "hi", "to", "to_lo", "to_hi", "dist")
A, B = some(45, 1), some(45, 2)


def test_edges(spark):
    assert got(polygons.edges(frame(spark, A), tile=16), *polygons.EDGE) == border(cells(A))


def test_parts(spark):
    rows = [*A, (900, 100, 100, 105, 105), (901, 105, 105, 110, 110), (902, 105, 100, 107, 103)]
    part = {r.id: r.part for r in polygons.parts(frame(spark, rows), tile=16).collect()}
    want = {}
    for own in shapes(cells(rows)):
        ids = [i for i, x, y, _, _ in rows if (x, y) in own]
        want |= dict.fromkeys(ids, min(ids))
    assert part == want


def test_space(spark):
    want = set()
    kinds = [border(s) for s in shapes(cells(A))]
    for i, p in enumerate(kinds):
        for j, q in enumerate(kinds):
            if i != j:
                want |= {(a[0], *a[1:4], *b[1:4], d) for a, b, d, _, _ in facing([e for e in p if e[4] < 0], [e for e in q if e[4] > 0], 6)}
    assert got(polygons.space(frame(spark, A), 6, tile=16), *PAIR) == want and want


def test_separation(spark):
    ea, eb = border(cells(A)), border(cells(B))
    want = {(a[0], *a[1:4], *b[1:4], d) for x, y in ((ea, eb), (eb, ea)) for a, b, d, _, _ in facing([e for e in x if e[4] < 0], [e for e in y if e[4] > 0], 5)}
    assert got(polygons.separation(frame(spark, A), frame(spark, B), 5, tile=16), *PAIR) == want and want


def test_width(spark):
    want = set()
    for own in shapes(cells(A)):
        concave = set()
        for x, y in {(x + i, y + j) for x, y in own for i in (0, 1) for j in (0, 1)}:
            if sum(q in own for q in ((x - 1, y - 1), (x, y - 1), (x - 1, y), (x, y))) == 3:
                concave.add((x, y))
        e = border(own)
        for a, b, d, lo, hi in facing([x for x in e if x[4] > 0], [x for x in e if x[4] < 0], 6):
            at = lambda line, p, axis=a[0]: (line, p) if axis == "v" else (p, line)
            far = round(math.sqrt(36 - d * d))
            ends = [
                max(lo - far, a[2]) if at(b[1], lo) in concave else lo, min(hi + far, a[3]) if at(b[1], hi) in concave else hi,
                max(lo - far, b[2]) if at(a[1], lo) in concave else lo, min(hi + far, b[3]) if at(a[1], hi) in concave else hi,
            ]
            want.add((a[0], a[1], *ends[:2], b[1], *ends[2:], d))
    assert got(polygons.width(frame(spark, A), 6, tile=16), *PAIR) == want and want


def test_abutting_rectangles_are_one_shape(spark):
    three = frame(spark, [(i, 30 * i, 0, 30 * i + 30, 100) for i in range(3)])
    assert polygons.width(three, 40).count() == 0 and polygons.space(three, 40).count() == 0
    assert got(polygons.width(three, 91), *PAIR) == {("v", 0, 0, 100, 90, 0, 100, 90)}


def test_enclosing_and_overlap(spark):
    ea, eb = border(cells(A)), border(cells(B))
    far = lambda d, least: round(math.sqrt(least * least - d * d))
    want = set()
    for sign in (1, -1):
        o, i = [e for e in ea if e[4] == sign], [e for e in eb if e[4] == sign]
        for a, b, d, _, _ in facing(o, i, 4) if sign > 0 else facing(i, o, 4):
            x, y = (a, b) if sign > 0 else (b, a)
            want.add((y[0], *y[1:4], x[1], max(y[2] - far(d, 4), x[2]), min(y[3] + far(d, 4), x[3]), d))
    assert got(polygons.enclosing(frame(spark, A), frame(spark, B), 4, tile=16), *PAIR) == want and want
    want = set()
    box = lambda s: (min(x for x, _ in s), min(y for _, y in s), max(x for x, _ in s) + 1, max(y for _, y in s) + 1)
    for p in shapes(cells(A)):
        for q in shapes(cells(B)):
            m, n = box(p), box(q)
            if m[0] <= n[2] and n[0] <= m[2] and m[1] <= n[3] and n[1] <= m[3]:
                for x, y in ((border(p), border(q)), (border(q), border(p))):
                    for a, b, d, lo, hi in facing([e for e in x if e[4] > 0], [e for e in y if e[4] < 0], 4):
                        f = far(d, 4)
                        want.add((a[0], a[1], max(lo - f, a[2]), min(hi + f, a[3]), b[1], max(lo - f, b[2]), min(hi + f, b[3]), d))
    assert {tuple(r[n] for n in PAIR) for r in polygons.overlap(frame(spark, A), frame(spark, B), 4, tile=16).collect()} == want and want


@pytest.mark.parametrize("window,step,inside,ignore", [((10, 10), (10, 10), False, False), ((16, 12), (8, 6), False, False), ((9, 9), (7, 7), True, True)])
def test_density_windows(spark, window, step, inside, ignore):
    full, frame_ = cells(A), cells([(0, 5, 5, 30, 45)])
    xs, ys = [x for x, _ in full], [y for _, y in full]
    box = (min(xs), min(ys), max(xs) + 1, max(ys) + 1)
    box = (min(box[0], 5), min(box[1], 5), max(box[2], 30), max(box[3], 45)) if ignore else box
    want = {}
    over = [max(0.0, (w - s) / 2) for w, s in zip(window, step, strict=True)]
    r = [int(o + 0.5) for o in over]
    n = [max(1, math.ceil((box[2 + i] - box[i] + 2 * over[i]) / step[i] - 1e-10)) for i in (0, 1)]
    s = [math.floor(0.5 + (box[i] + box[2 + i]) / 2 - n[i] * step[i] / 2 + 1e-10) for i in (0, 1)]
    for ix in range(n[0]):
        for iy in range(n[1]):
            w = (s[0] + ix * step[0] - r[0], s[1] + iy * step[1] - r[1], s[0] + (ix + 1) * step[0] + r[0], s[1] + (iy + 1) * step[1] + r[1])
            held = {(x, y) for x in range(w[0], w[2]) for y in range(w[1], w[3])}
            of = len(held & frame_) if ignore else len(held)
            if of:
                d = len(held & full) / of
                if (0.1 - 1e-10 < d < 0.5 + 1e-10) == inside:
                    want[ix, iy] = (*w, round(d, 9))
    edge = frame(spark, [(0, 5, 5, 30, 45)]) if ignore else None
    rows = polygons.density_tiles(frame(spark, A), window, step, 0.1, 0.5, edge, ignore_padding=ignore, inside=inside, tile=16).collect()
    assert {(r.ix, r.iy): (r.x0, r.y0, r.x1, r.y1, round(r.density, 9)) for r in rows} == want and want
    single = frame(spark, [(0, 0, 0, 8, 8)])
    assert polygons.density_tiles(single, (10, 10), (10, 10), 0.9, 1.0, singletons=False).count() == 0
    assert polygons.density_tiles(single, (10, 10), (10, 10), 0.9, 1.0).first().density == 0.64
