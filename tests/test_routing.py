"""Routed nets, edits, table texts and orders of nets on small cases with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from maskloom.functions import geometry as G
from maskloom.operators import connect, place, routing
from maskloom.sources import netlists

SEGMENTS = "net string, pos int, layer int, to_layer int, length bigint"


def test_vias_up_shield_what_follows(spark):
    rows = [("a", 0, 0, None, 100), ("a", 1, 0, 1, 0), ("a", 2, 0, None, 9000), ("a", 3, 1, None, 50), ("a", 4, 1, 0, 0), ("a", 5, 1, None, 50), ("b", 0, 0, None, 10)]
    rules = spark.createDataFrame([(0, 2, 10.0), (1, 1, 20.0)], "layer int, width int, limit double")
    gates = spark.createDataFrame([("a", "g", 0, 4), ("a", "high", 1, 4), ("a", "none", 0, 0), ("a", "wide", 0, 20), ("b", "h", 0, 2)], "net string, gate string, layer int, area int")
    got = {tuple(r) for r in routing.gate_antennas(spark.createDataFrame(rows, SEGMENTS), gates, rules).collect()}
    # the wire behind the via up doesn't count, those before and after a via down do; a ratio at its limit is none beyond it
    assert got == {("a", "g", 0, 200.0, 4.0, 50.0), ("a", "g", 1, 100.0, 4.0, 25.0), ("a", "high", 1, 100.0, 4.0, 25.0)}
    assert routing.gate_antennas(spark.createDataFrame([], SEGMENTS), gates, rules).isEmpty()


def test_tracks(spark):
    at = lambda *p: [{"x": x, "y": y} for x, y in p]
    w = spark.createDataFrame([(1, 0, at((4, 5), (6, 5), (24, 5))), (2, 0, at((1, 1), (2, 2))), (3, 0, at((-5, 0), (-15, 0))), (4, 9, at((1, 1), (1, 1), (3, 1))), (5, 0, None), (6, 0, [])], "id int, layer int, points array<struct<x: bigint, y: bigint>>")
    grids = spark.createDataFrame([(0, 0, 10, 0, 1)], "layer int, x_origin bigint, x_pitch bigint, y_origin bigint, y_pitch bigint")
    got = {r.id: [(p.x, p.y) for p in r.points] for r in routing.on_tracks(w, grids).collect()}
    assert got == {1: [(0, 5), (10, 5), (20, 5)], 2: [(0, 1), (0, 2)], 3: [(-10, 0), (-20, 0)], 4: [(1, 1), (3, 1)]}


def test_jogs_of_a_stair(spark):
    ring = [{"x": x, "y": y} for x, y in ((0, 0), (0, 40), (50, 40), (50, 36), (90, 36), (90, 0))]
    p = spark.createDataFrame([(ring,)], "points array<struct<x: bigint, y: bigint>>")
    got = [tuple(r) for r in routing.small_jogs(p, 6).collect()]
    assert got == [(47, 35, 53, 41)]
    assert routing.small_jogs(p, 4).isEmpty()
    with pytest.raises(ValueError):
        routing.small_jogs(p, 0)


def test_clips(spark):
    rows = [("box", 0, 0, 10, 10), ("box", 10, 5, 20, 9), ("box", 11, 0, 20, 9), ("polygon", -5, -5, 3, 3), ("text", 10, 10, 10, 10), ("text", 11, 2, 11, 2)]
    s = spark.createDataFrame(rows, "kind string, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    got = {tuple(r) for r in routing.clipped_shapes(s, (2, 2, 10, 10)).collect()}
    assert got == {("box", 2, 2, 10, 10), ("box", 10, 5, 10, 9), ("polygon", -5, -5, 3, 3), ("text", 10, 10, 10, 10)}
    i = spark.createDataFrame([(1, 5, 5), (2, 6, 20), (None, 2, 2)], "child bigint, dx bigint, dy bigint")
    kept = routing.clipped_instances(i, (2, 2, 10, 10))
    assert {tuple(r) for r in routing.replaced_instances(kept, F.col("child") == 1, 9).collect()} == {(9, 5, 5), (None, 2, 2)}


def test_table_texts(spark):
    texts = ['(t) { index_1 ("1, 3"); index_2 ("0,2"); values ("0, 2", \\\n "4, 6"); }', "{ index_1 (1, 3); index_2 (0, 2); values (0, 2, 4, 6) }", '{ index_1 ("1,3"); values ("0,2,4,6"); }', "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: r.v for r in df.select("id", G.table_at(F.col("t"), F.lit(2.0), F.lit(1.0)).alias("v")).collect()}
    assert got == {0: 3.0, 1: 3.0, 2: 0.0, 3: 0.0, 4: None}
    twice = df.limit(1).select(G.lookup_table(F.lit('index_1 ("9"); index_1 ("1.5, 2e-1")')).alias("t")).first().t
    assert (twice.index_1, twice.index_2, twice["values"]) == ([1.5, 0.2], [], [])


def test_points_widen_boxes(spark):
    df = spark.createDataFrame([(0, 0, 5, 5, 9, -2), (None, None, None, None, 3, 4)], "x0 bigint, y0 bigint, x1 bigint, y1 bigint, x bigint, y bigint")
    box = G.expanded(tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), F.col("x"), F.col("y"))
    assert [tuple(r) for r in df.select(*box).collect()] == [(0, -2, 9, 5), (3, 4, 3, 4)]


@pytest.mark.parametrize("descending", [False, True])
def test_places_are_those_of_a_sort(spark, descending):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, *range(9), 4, 4, 4])) for i in range(400)]
    df = spark.createDataFrame(rows, "net int, hpwl int")
    low = (lambda v: (v is not None, v or 0)) if not descending else (lambda v: (v is None, -(v or 0)))
    want = {n: k for k, (n, _) in enumerate(sorted(rows, key=lambda r: (low(r[1]), r[0])))}
    assert {r.net: r.place for r in place.ranked(df, "hpwl", descending).collect()} == want
    assert place.ranked(df.limit(0), "hpwl", descending).isEmpty()


def test_layer_map_comes_back(spark):
    rows = [(1, "METAL1", "drawing", 10, 0), (2, "V", "pin", 6800, 20)]
    df = spark.createDataFrame(rows, "line int, name string, purpose string, layer int, datatype int")
    lines = [r.value for r in netlists.write_layermap(df).collect()]
    assert lines == ["# name  purpose  layer  datatype", "METAL1 drawing  10   0", "V      pin     6800  20"]
    back = netlists.read_layermap(spark.createDataFrame([("f", "\n".join(lines))], "path string, value string"))
    assert [tuple(r) for r in back.orderBy("line").select("line", "name", "purpose", "layer", "datatype").collect()] == rows
    assert [r.value for r in netlists.write_layermap(df.limit(0)).collect()] == lines[:1]


def test_shields_lie_between(spark):
    rows = [(1, 1, 0, "h", 0, -101, 101), (2, 2, 0, "h", 3, -50, 2000), (2, 3, 0, "h", 30, -50, 2000), (1, 4, 0, "v", 10, 0, 90), (3, 5, 0, "v", 15, 10, 95), (3, 6, 1, "h", 3, 0, 900), (1, 7, 0, "h", 4, 0, 900)]
    s = spark.createDataFrame(rows, "net int, seq int, layer int, axis string, at bigint, lo bigint, hi bigint")
    for tile in (16, 5000):
        got = {tuple(r) for r in connect.shields(connect.parallel_wires(s, 5, tile), 60).collect()}
        assert got == {(0, 1, 2, -50, 100, 1), (0, 4, 5, -28, 52, 50), (0, 7, 2, 0, 900, 3)}
    assert connect.shields(connect.parallel_wires(s, 5), 900).isEmpty()
