"""Spanning, Steiner and clock trees of nets, many nets at once: those of one number of pins go through the same whole-array steps in Arrow workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.operators import kernels
from maskloom.plans.groups import by_key, whole_groups

_FAR = 1 << 62
#: Nets of more pins go one by one through `kernels`, whose memory grows less.
STEINER_PINS, CLOCK_PINS = 64, 2048


def spanning(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths and links (upper ends, lower ends; a row a step) of the trees that kernels.spanning_tree finds, one for each row of pins."""
    m, n = x.shape
    rows, at = np.arange(m), np.zeros(m, np.int64)
    far, near, open_ = np.full((m, n), _FAR), np.zeros((m, n), np.int64), x.astype(np.int64)  # open_: reached points are moved out of the way
    total, up, low = np.zeros(m, np.int64), np.empty((n - 1, m), np.int64), np.empty((n - 1, m), np.int64)
    for i in range(n - 1):
        open_[rows, at] = _FAR >> 1
        far[rows, at] = _FAR
        d = np.abs(open_ - x[rows, at, None]) + np.abs(y - y[rows, at, None])
        near = np.where(d < far, at[:, None], near)
        np.minimum(far, d, out=far)
        at = far.argmin(1)
        total += far[rows, at]
        up[i], low[i] = near[rows, at], at
    return total, up, low


def _with_each(x, y, up, low, gx, gy) -> np.ndarray:
    """As kernels._with_each, for the grid points in each row of gx and gy."""
    way = np.abs(x.T[:, :, None] - gx) + np.abs(y.T[:, :, None] - gy)
    rows, total = np.arange(len(x)), np.zeros(gx.shape, x.dtype)
    for a, b in zip(up[::-1], low[::-1], strict=True):
        link = (np.abs(x[rows, a] - x[rows, b]) + np.abs(y[rows, a] - y[rows, b]))[:, None]
        below, above = way[b, rows], way[a, rows]
        total += np.minimum(below, link)
        way[a, rows] = np.minimum(above, np.maximum(below, link))
    return total + way[0]


def _leaves(x, y, up, low, pins: int) -> np.ndarray:
    """Length of the links to added points that end as leaves."""
    m, n = x.shape
    rows, out, ends = np.arange(m), np.zeros(m, np.int64), np.zeros((m, n), np.int64)
    for v in (*up, *low):
        ends[rows, v] += 1
    for a, b in zip(up[::-1], low[::-1], strict=True):
        gone = (b >= pins) & (ends[rows, b] == 1)
        out += np.where(gone, np.abs(x[rows, a] - x[rows, b]) + np.abs(y[rows, a] - y[rows, b]), 0)
        ends[rows, a] -= gone
    return out


def steiner(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the spanning and of the Steiner trees, as kernels.steiner_length, one for each row of distinct pins in order."""
    m, pins = x.shape
    x, y = x - x.min(1, keepdims=True), y - y.min(1, keepdims=True)
    best, up, low = spanning(x, y)
    first = best
    if pins < 3:
        return first, first
    if int(max(x.max(), y.max())) * 8 * pins < 1 << 31:  # all lengths are below it
        x, y = x.astype(np.int32), y.astype(np.int32)
    gx, gy = np.repeat(np.sort(x, 1), pins, axis=1), np.tile(np.sort(y, 1), (1, pins))
    out, active = np.empty(m, np.int64), np.arange(m)
    while len(active):
        lengths = _with_each(x, y, up, low, gx, gy)
        at = lengths.argmin(1)
        go = lengths[np.arange(len(at)), at] < best
        out[active[~go]] = best[~go] - _leaves(x[~go], y[~go], up[:, ~go], low[:, ~go], pins)
        active, gx, gy, at = active[go], gx[go], gy[go], at[go]
        rows = np.arange(len(at))
        x, y = np.concatenate([x[go], gx[rows, at, None]], 1), np.concatenate([y[go], gy[rows, at, None]], 1)
        if len(active):
            best, up, low = spanning(x, y)
    return first, out


def zero_skews(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(delay, wire) as kernels.zero_skew, for each row of sinks in the order of their names."""
    m, n = x.shape
    rows, wire, none = np.arange(m), np.zeros(m, np.int64), _FAR
    u, v = 2 * (x + y), 2 * (x - y)
    t = [u, u, v, v, np.zeros((m, n), np.int64)]  # bounds of u, bounds of v, depth
    gap = lambda a, b: np.maximum(np.maximum(np.maximum(b[0] - a[1], a[0] - b[1]), np.maximum(b[2] - a[3], a[2] - b[3])), 0)
    d = gap([c[:, :, None] for c in t], [c[:, None, :] for c in t])
    d[:, np.tri(n, dtype=bool)] = none
    while n > 1:
        i, j = np.divmod(d.reshape(m, -1).argmin(1), n)
        near = d[rows, i, j]
        a, b = [c[rows, i] for c in t], [c[rows, j] for c in t]
        up = (near + b[4] - a[4]) // 2
        ea = np.where(up < 0, 0, np.where(up <= near, up, b[4] - a[4]))
        eb = np.where(up < 0, a[4] - b[4], np.where(up <= near, near - up, 0))
        wire += ea + eb
        new = [np.maximum(a[0] - ea, b[0] - eb), np.minimum(a[1] + ea, b[1] + eb), np.maximum(a[2] - ea, b[2] - eb), np.minimum(a[3] + ea, b[3] + eb), a[4] + ea]
        left = np.ones((m, n), bool)
        left[rows, i] = left[rows, j] = False
        t = [c[left].reshape(m, n - 2) for c in t]
        old, d = d[left[:, :, None] & left[:, None, :]].reshape(m, n - 2, n - 2), np.full((m, n - 1, n - 1), none)
        d[:, :-1, :-1] = old
        d[:, :-1, -1] = gap(t, [c[:, None] for c in new])
        t = [np.concatenate([c, e[:, None]], 1) for c, e in zip(t, new, strict=True)]
        n -= 1
    return t[4][:, 0] // 2, wire // 2


def bisected_measures(xs: list[int], ys: list[int], fanout: int) -> tuple[int, int]:
    """(buffers, skew) of the tree of kernels.bisected from the origin, without its branches."""
    buffers, least, most = 0, None, None
    stack = [(0, 0, 0, list(zip(xs, ys, strict=True)))]
    while stack:
        px, py, depth, group = stack.pop()
        gx, gy = [p[0] for p in group], [p[1] for p in group]
        x0, x1, y0, y1 = min(gx), max(gx), min(gy), max(gy)
        x, y = (x0 + x1) // 2, (y0 + y1) // 2
        depth += abs(x - px) + abs(y - py)
        buffers += 1
        if len(group) <= fanout:
            ends = [abs(a - x) + abs(b - y) + depth for a, b in group]
            least = min(ends) if least is None else min(least, *ends)
            most = max(ends) if most is None else max(most, *ends)
            continue
        axis, cut = (0, x) if x1 - x0 >= y1 - y0 else (1, y)
        low, high = [p for p in group if p[axis] <= cut], [p for p in group if p[axis] > cut]
        if not high:  # all at one place
            low, high = group[: len(group) // 2], group[len(group) // 2 :]
        stack += [(x, y, depth, high), (x, y, depth, low)]
    return buffers, most - least


def _by_pins(pins: DataFrame, run: Callable, names: list[str], distinct: bool, size: Callable[[int], int], order: list[Column]) -> DataFrame:
    """(net, names): what `run` finds for arrays (x, y) of a row for each of several nets of one number of pins, at most `size` of that number at once."""
    schema = pa.schema([("net", pa.int64()), *[(c, pa.int64()) for c in names]])
    rows = pins.select(F.col("net").cast("bigint").alias("net"), F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), *[c.alias(f"o{i}") for i, c in enumerate(order)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for net, starts, (x, y) in whole_groups(batches, "net", "x", "y"):
            if distinct:  # they come in the order of x and y
                keep = np.ones(len(x), bool)
                keep[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
                keep[starts] = True
                starts, x, y = (np.cumsum(keep) - 1)[starts], x[keep], y[keep]
            counts, made, at = np.diff([*starts, len(x)]), [[] for _ in names], []
            for n in np.unique(counts):
                which = np.flatnonzero(counts == n)
                for a in range(0, len(which), size(int(n))):
                    part = which[a : a + size(int(n))]
                    here = starts[part, None] + np.arange(n)
                    at.append(part)
                    for out, v in zip(made, run(x[here], y[here]), strict=True):
                        out.append(v)
            yield pa.RecordBatch.from_arrays([net.take(pa.array(np.concatenate(at))), *[pa.array(np.concatenate(v), pa.int64()) for v in made]], schema=schema)

    return by_key(rows, "net", order=tuple(f"o{i}" for i in range(len(order)))).mapInArrow(work, ", ".join(f"{c} bigint" for c in schema.names))


def _size(most: int, n: int) -> int:
    return max(1, most // n)


def spanning_lengths(pins: DataFrame) -> DataFrame:
    """(net, pins, length): Manhattan minimum spanning tree of each net's distinct pins. A net must fit in a worker."""
    run = lambda x, y: (np.full(len(x), x.shape[1]), spanning(x, y)[0])
    return _by_pins(pins, run, ["pins", "length"], True, lambda n: _size(1 << 17, n), [F.col("x"), F.col("y")])


def steiner_lengths(pins: DataFrame) -> DataFrame:
    """(net, spanning, steiner): lengths of each net's spanning tree and Steiner tree, over all of its distinct pins."""

    def run(x, y):
        if x.shape[1] <= STEINER_PINS:
            return steiner(x, y)
        return spanning(x, y)[0], np.array([kernels.steiner_length(np.stack(p, 1)) for p in zip(x, y, strict=True)])

    return _by_pins(pins, run, ["spanning", "steiner"], True, lambda n: _size(1 << 19, n**3), [F.col("x"), F.col("y")])


def clock_trees(sinks: DataFrame, fanout: int = 8) -> DataFrame:
    """(net, sinks, buffers, skew_bisected, wire_zero_skew, delay_zero_skew) of each clock net (net, pin, x, y); sinks are in the order of their pins as text."""

    def run(x, y):
        if x.shape[1] <= CLOCK_PINS:
            delay, wire = zero_skews(x, y)
        else:
            found = [kernels.zero_skew([(f"{i:020}", int(a), int(b)) for i, (a, b) in enumerate(zip(*p, strict=True))]) for p in zip(x, y, strict=True)]
            delay, wire = np.array([f[0] for f in found]), np.array([f[1] for f in found])
        halved = [bisected_measures(a, b, fanout) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        return np.full(len(x), x.shape[1]), np.array([h[0] for h in halved]), np.array([h[1] for h in halved]), wire, delay

    names = ["sinks", "buffers", "skew_bisected", "wire_zero_skew", "delay_zero_skew"]
    return _by_pins(sinks, run, names, False, lambda n: _size(1 << 19, n * n), [F.col("pin").cast("string"), F.col("x"), F.col("y")])
