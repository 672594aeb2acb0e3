"""Edge sets, net annotation and the scalar functions of edges, paths and repetitions, by expected values."""

import random

from pyspark.sql import functions as F

from maskloom.functions import geometry as G
from maskloom.operators import edges, timing

EDGE = "id bigint, ax bigint, ay bigint, bx bigint, by bigint"


def test_scalars(spark):
    row = {c: F.col(c) for c in ("ax", "ay", "bx", "by")}
    df = spark.createDataFrame([(0, 0, 0, 9, 0), (1, 0, 0, -3, -4), (2, 5, 5, 5, 5), (3, 2, 30, 2, 0)], EDGE)
    x, y = G.midpoint(row)
    got = df.select("id", x.alias("x"), y.alias("y"), G.is_axis_aligned(row).alias("flat"), G.has_angle(row, 0, 0.1).alias("level"), G.has_angle(row, 0, 0.1, True).alias("steep"), G.length_at_least(row, 5).alias("long"), G.length_at_most(row, 5).alias("short"), G.edge_center(row, 6).alias("mid"), G.edge_extended(row, 5, 10).alias("ext")).orderBy("id").collect()
    assert [(r.x, r.y, r.flat, r.level, r.steep, r.long, r.short) for r in got] == [(4, 0, True, True, False, True, False), (-1, -2, False, False, True, True, True), (5, 5, False, False, False, False, True), (2, 15, True, False, True, True, False)]
    assert [None if r.mid is None else tuple(r.mid) for r in got] == [(1, 0, 7, 0), (0, 0, -3, -4), None, (2, 18, 2, 12)]
    assert [tuple(r.ext) for r in got] == [(-5, 0, 19, 0), (3, 4, -9, -12), (5, 5, 5, 5), (2, 35, 2, -10)]
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (10, 0))])
    outline = df.select(G.path_outline(points, F.lit(5), F.lit(2), F.lit(0)).alias("p")).first().p
    assert [tuple(q) for q in outline] == [(-2, -2), (-2, 2), (10, 2), (10, -2)]
    assert df.select(G.path_outline(points, F.lit(0), F.lit(0), F.lit(0)).alias("p")).first().p is None


def test_parts_of_edges(spark):
    rng = random.Random(6)
    rows = [(i, *(rng.randrange(30) for _ in range(2))) for i in range(40)]
    wires = [(i, x, y, x, rng.randrange(30)) if i % 2 else (i, x, y, rng.randrange(30), y) for i, x, y in rows]
    wires = [w for w in wires if w[1:3] != w[3:5]] + [(99, 0, 0, 7, 9)]
    boxes = [(x, y, x + rng.randint(1, 9), y + rng.randint(1, 9)) for x, y in ((rng.randrange(30), rng.randrange(30)) for _ in range(12))]
    e, r = spark.createDataFrame(wires, EDGE), spark.createDataFrame(boxes, "x0 bigint, y0 bigint, x1 bigint, y1 bigint")

    def units(found):
        out = set()
        for i, ax, ay, bx, by in found:
            n = max(abs(bx - ax), abs(by - ay))
            dx, dy = (bx - ax) // n, (by - ay) // n
            new = {(i, ax + k * dx, ay + k * dy, dx, dy) for k in range(n)}
            assert not out & new
            out |= new
        return out

    flat = [w for w in wires if w[0] != 99]
    lies = lambda x, y, dx, dy: any(min(2 * x, 2 * x + 2 * dx) >= 2 * b[0] and max(2 * x, 2 * x + 2 * dx) <= 2 * b[2] and min(y, y + dy) >= b[1] and max(y, y + dy) <= b[3] for b in boxes)
    parts = {k: [tuple(x) for x in edges.covered(e, r, k, tile=8).collect()] for k in (True, False)}
    assert all((99, 0, 0, 7, 9) in p for p in parts.values())
    for k, p in parts.items():
        assert units(x for x in p if x[0] != 99) == {u for u in units(flat) if lies(*u[1:]) == k}
    none = r.limit(0)
    assert edges.covered(e, none, True).count() == 0 and edges.covered(e, none, False).count() == len(wires)
    assert {x.id for x in edges.interacting(e, e.filter("id = 1")).collect()} >= {1} if any(w[0] == 1 for w in wires) else True


def test_net_annotation_counts(spark):
    e = spark.createDataFrame([(0, "a", "b", "net", 1.0), (1, "b", "c", "cell", 2.0), (2, "c", "d", "net", 3.0)], "edge_idx bigint, src string, dst string, kind string, delay double")
    nets = spark.createDataFrame([(0, "n0", 2.0, 3.0, ["a", "b", "b"]), (1, "n1", 1.0, 1.0, ["b", "c"]), (2, "n2", 5.0, 1.0, ["a", "b"])], "seq bigint, net string, r double, c double, pins array<string>")
    out, counts = timing.net_annotated(e, nets)
    assert {r.edge_idx: r.delay for r in out.collect()} == {0: 5.0, 1: 2.0, 2: 3.0}
    assert tuple(counts.first()) == (2, 1)
    last = timing.annotated(e, spark.createDataFrame([(1, "a", "b", 7.0), (0, "a", "b", 9.0)], "seq int, src string, dst string, delay double"))
    assert {r.edge_idx: (r.delay, r.updated) for r in last.collect()} == {0: (7.0, True), 1: (2.0, False), 2: (3.0, False)}
