"""Connectivity and what follows from it: nets, parasitics, crosstalk, electromigration, antennas and netlist comparison."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.operators.spatial import BOX, links, pairs
from maskloom.plans.graph import components
from maskloom.plans.groups import Rows, numbers, pieces


def nets(rects: DataFrame, tile: int = 256) -> DataFrame:
    """(id, net): rectangles of one layer that touch, directly or through others, are one net, named by its least id."""
    comp = components(links(rects, ["layer"], True, tile)).withColumnRenamed("node", "id")
    return rects.select("id").join(comp, "id", "left").select("id", F.coalesce("comp", "id").alias("net"))


def via_stacks(rects: DataFrame, vias: DataFrame, tile: int = 256) -> DataFrame:
    """(id, net): nets over layers, where a via (layer_lo, layer_hi, box) joins the rectangles of both layers that overlap it."""
    flat = nets(rects)
    hits = pairs(rects.select("id", "layer", *BOX), vias.select(F.monotonically_increasing_id().alias("via"), "layer_lo", "layer_hi", *BOX), 0, tile)
    hits = hits.filter((F.col("a_layer") == F.col("b_layer_lo")) | (F.col("a_layer") == F.col("b_layer_hi"))).select(F.col("a_id").alias("id"), "b_via").join(flat, "id")
    joined = hits.groupBy("b_via").agg(F.min("net").alias("a")).join(hits, "b_via").select("a", F.col("net").alias("b"))
    comp = components(joined).withColumnRenamed("node", "net")
    return flat.join(comp, "net", "left").select("id", F.coalesce("comp", "net").alias("net"))


def ground_parasitics(rects: DataFrame, sheet: int, area_cap: int, edge_cap: int) -> DataFrame:
    """(id, resistance, ground_cap): sheet * long / short side; area and perimeter capacitance, in whole units of the coefficients."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return rects.select("id", (F.lit(float(sheet)) * F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1))).alias("resistance"), (w * h * area_cap + 2 * (w + h) * edge_cap).alias("ground_cap"))


def coupling(rects: DataFrame, reach: int, tile: int = 256) -> DataFrame:
    """(layer, a_id, b_id, coupling): for facing edges nearer than `reach`, common length over distance, summed, in thousandths.

    All directions of a pair are in one row of the join, so that pairs are not dealt again to be summed; only where an id names several rectangles they are.
    """
    from maskloom.operators.drc import _directions, _faces, near

    found = _directions(reach)
    own = lambda v: F.floor(F.when(v["axis"] == "h", v["y1"] - v["y0"]).otherwise(v["x1"] - v["x0"]) * 1000 / v["dist"])
    total = sum((F.coalesce(own(v), F.lit(0)) for v in found[1:]), F.coalesce(own(found[0]), F.lit(0)))
    met = near(rects, reach, tile).filter(_faces(reach)).select("layer", "a_id", "b_id", total.alias("coupling"))
    if rects.groupBy("layer", "id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return met
    return met.groupBy("layer", "a_id", "b_id").agg(F.sum("coupling").alias("coupling"))


def parallel_wires(segments: DataFrame, reach: int, tile: int = 1024) -> DataFrame:
    """(layer, axis, a_net, b_net, a_seq, b_seq, lo, hi, a_at, b_at): wires of two nets on one layer and axis with 0 < distance <= reach, and where they run along.

    All pairs of segments count. Wires are dealt by (layer, axis, track strip and tile along it); the tile where the common part begins owns a pair.
    """
    strip = reach + 1
    a = segments.withColumn("k", F.explode(F.array(*[F.floor(F.col("at") / strip) + d for d in (-1, 0, 1)])))
    a = a.withColumn("t", F.explode(F.sequence(F.floor(F.col("lo") / tile), F.floor(F.col("hi") / tile))))
    b = segments.withColumn("k", F.floor(F.col("at") / strip)).withColumn("t", F.explode(F.sequence(F.floor(F.col("lo") / tile), F.floor(F.col("hi") / tile))))
    x, y = a.alias("x"), b.alias("y")
    gap = F.abs(F.col("x.at") - F.col("y.at"))
    low, high = F.greatest("x.lo", "y.lo"), F.least("x.hi", "y.hi")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("layer", "axis", "k", "t")]
    met = x.join(y, on, "inner").filter((F.col("x.net") < F.col("y.net")) & (gap > 0) & (gap <= reach) & (high > low) & (F.floor(low / tile) == F.col("x.t")))
    ends = [F.col(f"{s}.{c}").alias(f"{n}_{c}") for c in ("net", "seq", "at") for s, n in (("x", "a"), ("y", "b"))]
    return met.select(F.col("x.layer").alias("layer"), F.col("x.axis").alias("axis"), *ends, low.alias("lo"), high.alias("hi"))


def crosstalk(segments: DataFrame, reach: int, most: int, tile: int = 1024, groups: int = 15) -> DataFrame:
    """(layer, a_net, b_net, parallel): common lengths of wires of two nets within reach, summed, where over `most`.

    All pairs of segments count; they are summed where they meet and not dealt. Nets are dealt to an odd number of groups; a group's wires stay in a worker's
    memory, and those of itself and of the half of the groups behind it stream by, net by net. What is dealt is (groups + 1) / 2 copies
    of the wires whatever their number; what is met grows with the pairs. Axes are h and v; nets and coordinates are whole numbers.
    """
    if groups % 2 == 0:
        raise ValueError("the number of groups must be odd")
    kind = segments.schema["layer"].dataType
    whole = [F.col(c).cast("bigint").alias(c) for c in ("layer", "net", "at", "lo", "hi")]
    s = segments.select(*whole, (F.col("axis") == "h").cast("bigint").alias("axis")).dropna().filter("hi > lo")
    s = s.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(groups // 2)))).withColumn("g", F.pmod(F.xxhash64("net") + F.col("d"), F.lit(groups))).withColumn("d", F.least("d", F.lit(1)).cast("bigint"))
    n = max(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * groups)
    dealt = s.repartition(n, "layer", "g").sortWithinPartitions("layer", "g", "d", "net")
    schema = pa.schema([(c, pa.int64()) for c in ("layer", "a_net", "b_net", "parallel")])

    def run(batches):
        out, at, own, index, late, size = Rows(schema, ["layer"], 200_000), None, [], None, [], 0
        for key, rows in pieces(batches, ["layer", "g", "d"]):
            if key != at:
                if late:
                    yield from _met(out, at[0], index, late, reach, most)
                    late, size = [], 0
                if key[2] == 0:
                    if own and index is None:
                        yield from _met(out, at[0], _Wires(own, tile), own, reach, most, True)
                    own, index = [], None
                elif index is None or at[:2] != key[:2]:
                    index = _Wires(own if at is not None and at[:2] == key[:2] else [], tile)
                    yield from _met(out, key[0], index, own, reach, most, True)
                at = key
            wires = np.stack(numbers(rows, "net", "axis", "at", "lo", "hi"))
            if key[2] == 0:
                own.append(wires)
                continue
            # whole nets, some at a time: what comes after the last change of the net waits
            last = int(np.flatnonzero(np.diff(wires[0], prepend=late[-1][0, -1] if late else wires[0, 0]))[-1:].sum()) if size >= 20_000 else 0
            if size >= 20_000 and wires[0, last] != (wires[0, last - 1] if last else late[-1][0, -1]):
                yield from _met(out, key[0], index, [*late, wires[:, :last]], reach, most)
                late, size, wires = [], 0, wires[:, last:]
            late.append(wires)
            size += wires.shape[1]
        if late:
            yield from _met(out, at[0], index, late, reach, most)
        elif own and index is None:
            yield from _met(out, at[0], _Wires(own, tile), own, reach, most, True)
        yield from out.rest()

    found = dealt.mapInArrow(run, ", ".join(f"{c} bigint" for c in schema.names))
    return found.withColumn("layer", F.col("layer").cast(kind))


class _Wires:
    """Wires (net, axis, at, lo, hi), copied for each tile along them, in the order of axis, tile and place."""

    def __init__(self, parts: list[np.ndarray], tile: int):
        w = np.concatenate(parts, 1) if parts else np.zeros((5, 0), np.int64)
        self.tile, self.size = tile, w.shape[1]
        if not self.size:
            return
        self.nets, self.net = np.unique(w[0], return_inverse=True)
        self.at0, self.wide = w[2].min(), int(np.ptp(w[2])) + 1
        self.t0, self.t1 = int((w[3] // tile).min()), int((w[4] // tile).max())
        i, t = self._tiles(w)
        key = self._code(w[1, i], t) * self.wide + (w[2, i] - self.at0)
        order = key.argsort(kind="stable")
        self.key, i = key[order], i[order]
        self.net, self.at, self.lo, self.hi = self.net[i], w[2, i], w[3, i], w[4, i]

    def _tiles(self, w):
        low, high = np.maximum(w[3] // self.tile, self.t0), np.minimum(w[4] // self.tile, self.t1)
        n = np.maximum(high - low + 1, 0)
        i = np.repeat(np.arange(len(n)), n)
        return i, low[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)

    def _code(self, axis, t):
        return axis * (self.t1 - self.t0 + 1) + (t - self.t0)

    def near(self, w, reach):
        """(wire, tile, first, end): where the copies within reach of a wire begin and end, for each tile of the wire."""
        i, t = self._tiles(w)
        base, at = self._code(w[1, i], t) * self.wide, w[2, i] - self.at0
        first = np.searchsorted(self.key, base + np.clip(at - reach, 0, self.wide), "left")
        return i, t, first, np.searchsorted(self.key, base + np.clip(at + reach, -1, self.wide - 1), "right")


def _met(out: Rows, layer: int, index: _Wires, parts: list[np.ndarray], reach: int, most: int, same: bool = False, size: int = 1 << 20):
    """Sums of common lengths of the index's wires and of wires in the order of their nets, whole nets of about `size` pairs at a time. same: both are one set."""
    if not index.size or not parts:
        return
    w = np.concatenate(parts, 1)
    i, t, first, end = index.near(w, reach)
    done = np.cumsum(end - first)
    nets = np.append(np.flatnonzero(np.diff(w[0, i], prepend=w[0, i[0]] - 1)), len(i)) if len(i) else np.zeros(1, np.int64)
    before, a = 0, 0
    while a < len(nets) - 1:
        b = min(max(int(np.searchsorted(done[nets[1:] - 1], before + size, "right")), a + 1), len(nets) - 1)
        rows = slice(nets[a], nets[b])
        count = (end - first)[rows]
        k = np.repeat(np.arange(len(count)), count)
        x = np.arange(len(k)) + np.repeat(first[rows] - (np.cumsum(count) - count), count)
        y = i[rows][k]
        low, high = np.maximum(index.lo[x], w[3, y]), np.minimum(index.hi[x], w[4, y])
        keep = (high > low) & (index.at[x] != w[2, y]) & (low // index.tile == t[rows][k])
        if same:
            keep &= index.nets[index.net[x]] < w[0, y]
        x, y, long = index.net[x[keep]], y[keep], (high - low)[keep]
        if len(x):
            at = np.cumsum(np.diff(w[0, i[rows]], prepend=w[0, i[rows][0]]) != 0)
            pair = at[k[keep]] * len(index.nets) + x
            order = pair.argsort()
            pair = pair[order]
            new = np.flatnonzero(np.diff(pair, prepend=-1))
            total = np.add.reduceat(long[order], new)
            big = total > most
            mine, other = index.nets[x[order[new[big]]]], w[0, y[order[new[big]]]]
            yield from out.add((layer,), a_net=np.minimum(mine, other), b_net=np.maximum(mine, other), parallel=total[big])
        before, a = int(done[nets[b] - 1]), b


def shields(pairs: DataFrame, most: int) -> DataFrame:
    """(layer, a_seq, b_seq, x0, x1, y): a level wire as long as the common part about the middle between two wires that run along for more than `most`.

    It is level for upright wires too: a mark of where a shield belongs. Halves go towards zero.
    """
    half = lambda v: (F.signum(v) * F.floor(F.abs(v) / F.lit(2))).cast("bigint")
    level = F.col("axis") == "h"
    along, across, n = half(F.col("lo") + F.col("hi")), half(F.col("a_at") + F.col("b_at")), half(F.col("hi") - F.col("lo"))
    x, y = F.when(level, along).otherwise(across), F.when(level, across).otherwise(along)
    return pairs.filter(F.col("hi") - F.col("lo") > most).select("layer", "a_seq", "b_seq", (x - n).alias("x0"), (x + n).alias("x1"), y.alias("y"))


def electromigration(segments: DataFrame, currents: DataFrame, limits: DataFrame) -> DataFrame:
    """(net, seq, layer, density): wires whose current over width and thickness exceeds their layer's limit; (net, current), (layer, thickness, limit)."""
    j = segments.join(currents, "net").join(limits, "layer")
    density = F.col("current") / (F.col("width") * F.col("thickness"))
    return j.withColumn("density", density).filter(F.col("density") > F.col("limit")).select("net", "seq", "layer", "density")


def antenna(metal: DataFrame, gates: DataFrame, most: float) -> DataFrame:
    """(net, ratio): nets whose metal area over gate area exceeds a ratio; (net, area) each, summed; nets without gates don't count."""
    m = metal.groupBy("net").agg(F.sum("area").alias("metal"))
    g = gates.groupBy("net").agg(F.sum("area").alias("gate")).filter("gate > 0")
    return m.join(g, "net").withColumn("ratio", F.col("metal") / F.col("gate")).filter(F.col("ratio") > most).select("net", "ratio")


def terminals(devices: DataFrame) -> DataFrame:
    return devices.select(F.explode(F.array("g", "d", "s")).alias("net")).distinct()


def compare_nets(layout: DataFrame, schematic: DataFrame) -> DataFrame:
    """(net, state): names of both netlists: matched, or only in the layout or the schematic."""
    a, b = terminals(layout).withColumn("l", F.lit(True)), terminals(schematic).withColumn("r", F.lit(True))
    state = F.when(F.col("l") & F.col("r"), "matched").when(F.col("l"), "layout_only").otherwise("schematic_only")
    return a.join(b, "net", "full").select("net", state.alias("state"))


def compare_devices(layout: DataFrame, schematic: DataFrame) -> DataFrame:
    """(layout_name, schematic_name, how, same_width): devices matched by name, the rest by kind and sorted terminal nets, in name order.

    Devices left over on either side have how = unmatched. same_width: widths within 1 per cent.
    """
    sig = lambda df: df.withColumn("sig", F.concat_ws("/", "kind", F.array_join(F.array_sort(F.array("g", "d", "s")), ",")))
    a, b = sig(layout), sig(schematic)
    on = lambda how, j: j.select(F.col("a.name").alias("layout_name"), F.col("b.name").alias("schematic_name"), how.alias("how"), (F.abs(F.col("a.w") - F.col("b.w")) * 100 <= F.greatest("a.w", "b.w")).alias("same_width"))
    named = on(F.lit("name"), a.alias("a").join(b.alias("b"), "name"))
    rest = Window.partitionBy("sig").orderBy("name")
    left = a.join(b.select("name"), "name", "left_anti").withColumn("r", F.row_number().over(rest))
    right = b.join(a.select("name"), "name", "left_anti").withColumn("r", F.row_number().over(rest))
    how = F.when(F.col("a.name").isNotNull() & F.col("b.name").isNotNull(), "structure").otherwise("unmatched")
    other = on(how, left.alias("a").join(right.alias("b"), ["sig", "r"], "full"))
    return named.unionAll(other)
