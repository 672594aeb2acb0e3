"""Crosstalk in groups of nets, and annotation of nets by pairs of pins, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from maskloom.operators import connect, timing


@pytest.mark.parametrize("groups,tile", [(1, 64), (3, 16), (7, 5000)])
def test_crosstalk_by_groups(spark, groups, tile):
    rng = random.Random(groups)
    rows = []
    for i in range(300):
        lo = rng.randrange(-400, 400)
        rows.append((rng.randrange(40), rng.randrange(2), rng.choice("hv"), rng.randrange(-30, 60), lo, lo + rng.choice((0, 7, 60, 300)), i))
    rows += [(i % 3, 5, "h", i % 4, 0, 90, 1000 + i) for i in range(60)] + [(None, 0, "h", 0, 0, 90, 2000)]
    s = spark.createDataFrame(rows, "net bigint, layer int, axis string, at bigint, lo bigint, hi bigint, seq bigint")
    want = {}
    for a in rows[:-1]:
        for b in rows[:-1]:
            n = min(a[5], b[5]) - max(a[4], b[4])
            if a[0] < b[0] and a[1:3] == b[1:3] and 0 < abs(a[3] - b[3]) <= 4 and n > 0:
                want[a[1], a[0], b[0]] = want.get((a[1], a[0], b[0]), 0) + n
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        found = connect.crosstalk(s, 4, 50, tile, groups)
        got = [tuple(r) for r in found.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found.schema["layer"].dataType == s.schema["layer"].dataType
    assert sorted(got) == sorted((*k, v) for k, v in want.items() if v > 50)


def test_crosstalk_deals_wires_and_not_pairs(spark):
    """Pairs of wires are summed where they meet: nothing is dealt after them."""
    s = spark.range(10).select(F.col("id").alias("net"), F.lit(0).alias("layer"), F.lit("h").alias("axis"), F.col("id").alias("at"), F.lit(0).alias("lo"), F.lit(9).alias("hi"))
    plan = connect.crosstalk(s, 4, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange") and "Join" not in plan


@pytest.mark.parametrize("most", [1, 3, 64])
def test_net_annotation_of_small_and_large_nets(spark, most):
    rng = random.Random(6)
    edges = [(i, rng.randrange(12), rng.randrange(12), rng.choice(("net", "cell")), 1.0) for i in range(60)]
    nets = [(i, f"n{i}", float(rng.randrange(9)), 2.0, [rng.randrange(12) for _ in range(rng.randrange(7))]) for i in range(30)]
    e = spark.createDataFrame(edges, "edge_idx bigint, src bigint, dst bigint, kind string, delay double")
    out, counts = timing.net_annotated(e, spark.createDataFrame(nets, "seq bigint, net string, r double, c double, pins array<bigint>"), most)
    hits = [(i, s, r * c) for i, a, b, k, _ in edges if k == "net" and a != b for s, _, r, c, pins in nets if a in pins and b in pins]
    last = {}
    for i, s, v in sorted(hits, key=lambda h: h[1]):
        last[i] = v
    assert {r.edge_idx: r.delay for r in out.collect()} == {i: last.get(i, d) for i, *_, d in edges}
    assert tuple(counts.first()) == (len(hits), len(nets) - len({s for _, s, _ in hits}))
