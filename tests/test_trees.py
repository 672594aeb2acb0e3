"""Trees of many nets at once against the searches net by net."""

import numpy as np
import pytest

from maskloom.operators import kernels as K
from maskloom.operators import trees as T


def nets(n, span, seed):
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < 9:
        p = np.unique(rng.integers(0, span, (5 * n, 2)), axis=0)
        if len(p) >= n:
            out.append(p[np.sort(rng.choice(len(p), n, replace=False))])
    a = np.stack(out)
    return out, a[:, :, 0].astype(np.int64), a[:, :, 1].astype(np.int64)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 15])
@pytest.mark.parametrize("span", [7, 20000, 1 << 30])
def test_trees_of_many_nets(n, span):
    p, x, y = nets(n, span, n)
    first, least = T.steiner(x, y)
    assert first.tolist() == [K.spanning_tree(q)[0] for q in p] == T.spanning(x, y)[0].tolist()
    assert least.tolist() == [K.steiner_length(q) for q in p]
    sinks = [[(f"{i:02}", int(a), int(b)) for i, (a, b) in enumerate(q)] for q in p]
    delay, wire = T.zero_skews(x, y)
    assert [(a, b) for a, b in zip(delay.tolist(), wire.tolist(), strict=True)] == [K.zero_skew(s)[:2] for s in sinks]
    for s, q in zip(sinks, p, strict=True):
        tree = K.bisected((0, 0), s, 3)
        depth = {0: 0}
        for b in tree[1:]:
            up = tree[b["parent"]]
            depth[b["id"]] = depth[up["id"]] + abs(b["x"] - up["x"]) + abs(b["y"] - up["y"])
        ends = [depth[b["id"]] for b in tree if b["sink"] is not None]
        assert T.bisected_measures(*q.T.tolist(), 3) == (len(tree) - 1 - n, max(ends) - min(ends))


def test_nets_of_all_sizes_meet_whole(spark, monkeypatch):
    """Nets that go on over batches, with equal pins and a null name, and sizes beyond the bounds."""
    rng = np.random.default_rng(4)
    rows = [(None if net == 3 else net, i, int(a), int(b)) for net, n in enumerate((1, 2, 5, 4, 70, 12, 12)) for i, (a, b) in enumerate(rng.integers(0, 30, (n, 2)))]
    df = spark.createDataFrame(rows, "net bigint, pin bigint, x bigint, y bigint")
    monkeypatch.setattr(T, "CLOCK_PINS", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        steiner, clock, span = ({r.net: r for r in f(df).collect()} for f in (T.steiner_lengths, T.clock_trees, T.spanning_lengths))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    of = {net: [(str(r[1]), r[2], r[3]) for r in rows if r[0] == net] for net in {r[0] for r in rows}}
    assert set(steiner) == set(clock) == set(span) == set(of)
    for net, sinks in of.items():
        p = np.unique(np.array([s[1:] for s in sinks]), axis=0)
        assert (steiner[net].spanning, steiner[net].steiner) == (K.spanning_tree(p)[0], K.steiner_length(p))
        assert (span[net].pins, span[net].length) == (len(p), steiner[net].spanning)
        assert (clock[net].delay_zero_skew, clock[net].wire_zero_skew) == K.zero_skew(sinks)[:2] and clock[net].sinks == len(sinks)


def test_a_task_takes_many_nets(spark):
    """20,000 nets of 5 pins, each of which was a pandas group of milliseconds before."""
    import time

    from pyspark.sql import functions as F

    df = spark.range(100_000).select((F.col("id") % 20_000).alias("net"), F.col("id").alias("pin"), (F.col("id") * 7919 % 20011).alias("x"), (F.col("id") * F.col("id") % 20021).alias("y"))
    T.steiner_lengths(df.limit(100)).count()
    began = time.perf_counter()
    assert T.steiner_lengths(df).count() == 20_000 and T.clock_trees(df).count() == 20_000
    assert time.perf_counter() - began < 30
