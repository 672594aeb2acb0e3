"""The layout queries against DuckDB on the smallest tables, and laws of the geometry functions."""

import decimal
import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from maskloom import queries as Q
from maskloom.functions import geometry as G
from maskloom.operators import connect, kernels, place, region, spatial, timing
from maskloom.plans import graph

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([[plain(r[c]) for c in cols] for r in df.collect()], key=str)
    if name in Q.oracle_sql():
        rel = duck.sql(Q.oracle_sql()[name])
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert got == sorted([[plain(r[i]) for i in at] for r in rel.fetchall()], key=str)
    else:
        assert got


def boxes(spark, n, seed, span=300, size=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.randint(-span, span), rng.randint(-span, span)
        rows.append((i, x, y, x + rng.randint(1, size), y + rng.randint(1, size)))
    rows.append((n, -900, 5, 900, 6))  # one that spans many tiles
    return spark.createDataFrame(rows, "id bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint"), rows


@pytest.mark.parametrize("tile,coarse", [(7, 4), (64, 1), (1000, 32)])
@pytest.mark.parametrize("distance", [0, 13])
def test_pairs_match_nested_loops(spark, tile, coarse, distance):
    a, ra = boxes(spark, 60, 1)
    b, rb = boxes(spark, 60, 2)
    got = [(r.a_id, r.b_id) for r in spatial.pairs(a, b, distance, tile, coarse=coarse).collect()]
    d = distance
    expect = {(p[0], q[0]) for p in ra for q in rb if p[1] - d <= q[3] and q[1] <= p[3] + d and p[2] - d <= q[4] and q[2] <= p[4] + d}
    assert len(got) == len(set(got)) and set(got) == expect


@pytest.mark.parametrize("keep,test", [(region.UNION, lambda a, b: a or b), (region.INTERSECTION, lambda a, b: a and b), (region.DIFFERENCE, lambda a, b: a and not b), (region.XOR, lambda a, b: a != b)])
def test_boolean_covers_exactly(spark, keep, test):
    a, ra = boxes(spark, 12, 3, 20, 15)
    b, rb = boxes(spark, 12, 4, 20, 15)
    out = region.boolean(a.filter("id < 12"), b.filter("id < 12"), keep, tile=16).collect()
    cover = {}
    for r in out:
        for x in range(r.x0, r.x1):
            for y in range(r.y0, r.y1):
                cover[x, y] = cover.get((x, y), 0) + 1
    assert set(cover.values()) <= {1}
    inside = lambda rows, x, y: any(r[1] <= x < r[3] and r[2] <= y < r[4] for r in rows[:12])
    assert set(cover) == {(x, y) for x in range(-25, 40) for y in range(-25, 40) if test(inside(ra, x, y), inside(rb, x, y))}


@pytest.mark.parametrize("corners", [True, False])
def test_links_connect_what_touches(spark, corners):
    """Links of crowded boxes, some without area, are no more than boxes in tiles, and connect what pairs of touching boxes do."""
    rng = random.Random(8)
    rows = [(i, i % 2, x, y, x + rng.choice((0, 1, 3, 9)), y + rng.choice((0, 1, 2, 7))) for i, (x, y) in enumerate((rng.randrange(-30, 60), rng.randrange(-30, 60)) for _ in range(400))]
    rows += [(1000 + i, 5, i % 4, i % 3, 20 + i % 4, 20) for i in range(200)]
    r = spark.createDataFrame(rows, "id bigint, layer int, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    root = {p[0]: p[0] for p in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for p in rows:
        for q in rows:
            x, y = min(p[4], q[4]) - max(p[2], q[2]), min(p[5], q[5]) - max(p[3], q[3])
            if p[1] == q[1] and p[0] < q[0] and x >= 0 and y >= 0 and (corners or x > 0 or y > 0):
                a, b = sorted((find(p[0]), find(q[0])))
                root[b] = a
    made = spatial.links(r, ["layer"], corners, 16)
    assert made.filter("a >= 1000").count() <= 200 * 4
    got = {x.node: x.comp for x in graph.components(made).collect()}
    assert {p[0]: got.get(p[0], p[0]) for p in rows} == {p[0]: find(p[0]) for p in rows}


def test_coupling_is_not_dealt_again(spark):
    """Pairs are summed where they meet; rectangles that share an id are summed together."""
    rows = [(1, 0, 0, 0, 10, 10), (2, 0, 15, 0, 20, 10), (3, 0, 0, 14, 10, 20)]
    r = lambda more: spark.createDataFrame(rows + more, "id bigint, layer int, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    got = lambda df: {(x.a_id, x.b_id): x.coupling for x in df.collect()}
    once = connect.coupling(r([]), 8)
    assert "Aggregate" not in once._jdf.queryExecution().executedPlan().toString()
    assert got(once) == {(1, 2): 2000, (1, 3): 2500}
    assert got(connect.coupling(r([(2, 0, -8, 0, -4, 10)]), 8)) == {(1, 2): 4500, (1, 3): 2500}


def test_crowded_tiles_stay_small(spark):
    """Many rectangles over each other make rows by the area of a tile, not by the square of their number; a tile's rows may come in many batches."""
    rng = random.Random(6)
    rows = [(f"r{i % 2}" if i % 50 else None, x, y, x + rng.randint(1, 9), y + rng.randint(1, 9)) for i, (x, y) in enumerate((rng.randrange(-20, 40), rng.randrange(-20, 40)) for _ in range(3000))]
    a = spark.createDataFrame(rows, "rule string, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    out = region.merged(a, ["rule"], 64).collect()
    want = {(r[0], x, y) for r in rows if r[0] for x in range(r[1], r[3]) for y in range(r[2], r[4])}
    got = [(r.rule, x, y) for r in out for x in range(r.x0, r.x1) for y in range(r.y0, r.y1)]
    assert len(got) == len(set(got)) and set(got) == want and len(out) < 1000
    held = region._sweep(region.UNION, [], region.to_arrow_schema(a.select("x0", "y0", "x1", "y1").schema), 8)
    at = lambda r: {"tx": [0], "ty": [0], "side": [0], **{c: [v] for c, v in zip(("x0", "y0", "x1", "y1"), r, strict=True)}}
    boxes_ = [(i, 0, i + 2, 5) for i in range(40)]
    made = [b.to_pylist() for b in held(region.pa.RecordBatch.from_pydict(at(r)) for r in boxes_)]
    assert made == [[{"x0": 0, "y0": 0, "x1": 41, "y1": 5}]]


def test_grow_then_shrink_gives_a_box_back(spark):
    a = spark.createDataFrame([(0, 0, 10, 7), (30, 3, 50, 9)], "x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    back = region.shrunk(region.sized(a, 4, tile=8), 4, tile=8)
    assert region.area(back).first().area == 70 + 120


def test_components_and_levels(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (8, 8)], "a bigint, b bigint")
    assert {r.node: r.comp for r in graph.components(e).collect()} == {1: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    dag = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src bigint, dst bigint")
    assert {r.node: r.value for r in graph.levels(dag).collect()} == {1: 0, 2: 1, 3: 2}
    with pytest.raises(ValueError):
        graph.levels(spark.createDataFrame([(1, 2), (2, 1)], "src bigint, dst bigint"))


def test_ring_functions(spark):
    ring = [(0, 0), (10, 0), (10, 10), (5, 10), (5, 5), (0, 5)]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in ring],)], "p array<struct<x:bigint,y:bigint>>")
    r = df.select(G.double_area(F.col("p")).alias("a"), G.perimeter(F.col("p")).alias("l"), G.canonical(F.col("p")).alias("c"), G.point_in_ring(F.col("p"), F.lit(2), F.lit(8)).alias("out"), G.point_in_ring(F.col("p"), F.lit(5), F.lit(7)).alias("on"), G.point_in_ring(F.col("p"), F.lit(7), F.lit(7)).alias("in")).first()
    assert (int(r.a), r.l, r.out, r.on, r["in"]) == (150, 40, False, True, True)
    assert [(p.x, p.y) for p in r.c] == [(0, 0), (0, 5), (5, 5), (5, 10), (10, 10), (10, 0)]


def test_worst_path_adds_up(spark):
    e = Q._edges(spark, SF)
    a = timing.arrivals(e)
    end = a.orderBy(F.desc("value"), "node").first()
    path = [r.node for r in timing.worst_path(e, a, end.node).orderBy("step").collect()]
    delay = {(r.src, r.dst): r.delay for r in e.collect()}
    assert sum(delay[p] for p in zip(path[:-1], path[1:], strict=True)) == end.value


def test_placement_settles(spark):
    rng = random.Random(4)
    pins = spark.createDataFrame([(i % 7, i, rng.randint(0, 5000), rng.randint(0, 5000)) for i in range(60)], "net bigint, pin bigint, x bigint, y bigint")
    out = place.global_placed(pins)
    assert sorted(r.pin for r in out.collect()) == list(range(60))
    wire = lambda df: place.half_perimeters(df).agg(F.sum("hpwl")).first()[0]
    assert wire(out) < 7 * 4 < wire(pins)
    with pytest.raises(RuntimeError):
        place.global_placed(pins, 3)


def test_deep_hierarchies_are_whole_or_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1, 0, False, 1, 0) for i in range(4)], "parent bigint, child bigint, rot int, mirror boolean, dx bigint, dy bigint")
    assert sorted(r.depth for r in graph.flatten(chain, 0, 4).collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        graph.flatten(chain, 0, 3)


def test_routes_get_all_rounds(spark):
    for n, seed in ((18, 4), (18, 8)):  # these need more than 6 and more than 20 rounds
        rng = random.Random(seed)
        rows = [(0, i, *[rng.randrange(6) for _ in range(4)]) for i in range(n)]
        got = kernels.region_routes(spark.createDataFrame(rows, "region bigint, net bigint, sx bigint, sy bigint, tx bigint, ty bigint"), 6, 4).first()
        assert got.nets == n and got.overflow == 0


def test_regions_are_routed_apart_and_as_by_the_kernel(spark):
    rng = random.Random(2)
    rows = [(r, i, *[rng.randrange(7) for _ in range(4)]) for r in range(8) for i in range(0 if r == 5 else 15 * r + 1)]
    rows += [(9, 0, 2, 2, 2, 2), (9, 1, 6, 0, 0, 6)]
    pins = spark.createDataFrame(rows[::-1], "region bigint, net bigint, sx bigint, sy bigint, tx bigint, ty bigint")
    out = kernels.region_routes(pins, 7, 3)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "Pandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in got}) > 2  # few rows, but much work
    for r in got:
        routes, over = kernels.negotiated(7, 7, [((a, b), (c, d)) for k, _, a, b, c, d in rows if k == r.region], 3)
        assert (r.nets, r.length, r.overflow) == (len(routes), sum(len(p) - 1 for p in routes), over)
    assert sorted(r.region for r in got) == [0, 1, 2, 3, 4, 6, 7, 9] and max(r.overflow for r in got) > 0
    for bad in (7, -1, None):
        with pytest.raises(Exception, match="outside the grid"):
            kernels.region_routes(spark.createDataFrame([(0, 0, 1, 1, 2, bad)], pins.schema), 7, 3).collect()


def test_table_text_is_read_once(spark):
    df = spark.createDataFrame([('index_1 ("1, 3"); index_2 ("2, 4"); values ("1, 2", "3, 4");', 2.0, 3.0), (None, 2.0, 3.0)], "t string, s double, l double")
    out = df.select(G.table_at(F.col("t"), F.col("s"), F.col("l")).alias("v"))
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") <= 12
    assert [r.v for r in out.collect()] == [2.5, None]
