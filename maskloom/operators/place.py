"""Placement and routing measures: wire length, rows, gaps, grids, congestion and Pareto fronts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.plans.tables import materialize


def half_perimeters(pins: DataFrame) -> DataFrame:
    """(net, hpwl): half the perimeter of each net's pins; nets of one pin don't count."""
    span = F.max("x") - F.min("x") + F.max("y") - F.min("y")
    return pins.groupBy("net").agg(F.count("*").alias("pins"), span.alias("hpwl")).filter("pins >= 2")


def ranked(nets: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Nets with their place (from 0) in the order of a measure, ties by net; null measures come first, or last if descending.

    Rows are dealt by ranges of the measure and net; the counts of the ranges, one row a partition, give each range its first place.
    """
    order = [F.desc(by) if descending else F.col(by), F.col("net")]
    n = int(nets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(nets.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    first = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__first"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.join(F.broadcast(first), "__part").withColumn("place", F.col("__first") + own).drop("__part", "__first")  # first: at most n rows


def wire_metrics(segments: DataFrame) -> DataFrame:
    """(net, layer, wires, length): by net, by layer and in all, null where it is summed over."""
    return segments.groupingSets([[F.col("net")], [F.col("layer")], []], "net", "layer").agg(F.count("*").alias("wires"), F.sum(F.col("hi") - F.col("lo")).alias("length"))


def legalized(cells: DataFrame) -> DataFrame:
    """(cell, site_row, x, legal_x): cells of a row pushed right, in the order of x and cell, until none overlaps the one before.

    A cell's place is the greatest of x less the widths before it, plus these widths: one window.
    """
    w = Window.partitionBy("site_row").orderBy("x", "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("w").over(w) - F.col("w")
    placed = cells.withColumn("before", before)
    return placed.withColumn("legal_x", F.max(F.col("x") - F.col("before")).over(w) + F.col("before")).select("cell", "site_row", "x", "w", "legal_x")


def gaps(cells: DataFrame, x: str = "x") -> DataFrame:
    """(site_row, start, length): free room between the cells of each row."""
    w = Window.partitionBy("site_row").orderBy(x, "cell")
    far = F.max(F.col(x) + F.col("w")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return cells.withColumn("start", far).filter(F.col("start") < F.col(x)).select("site_row", "start", (F.col(x) - F.col("start")).alias("length"))


def filled(room: DataFrame, widths: list[int]) -> DataFrame:
    """(site_row, width, n): fill cells that gaps take, the widest first."""
    left = F.col("length")
    counts = []
    for w in sorted(widths, reverse=True):
        counts.append(F.struct(F.lit(w).cast("bigint").alias("width"), F.floor(left / w).alias("n")))
        left = F.pmod(left, F.lit(w))
    return room.select("site_row", F.explode(F.array(*counts)).alias("c")).groupBy("site_row", "c.width").agg(F.sum("c.n").alias("n"))


def taps(rows: DataFrame, pitch: int) -> DataFrame:
    """(site_row, x): one tap for each pitch of each row (site_row, lo, hi)."""
    return rows.filter("hi >= lo").select("site_row", F.explode(F.sequence("lo", "hi", F.lit(pitch).cast("bigint"))).alias("x"))


def congestion(segments: DataFrame, cell: int, capacity: int) -> DataFrame:
    """(layer, edges, used, saturated, overflow, mean_percent): use of grid cells that wires cross."""
    used = segments.withColumn("c", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell)))).groupBy("layer", "axis", F.floor(F.col("at") / cell).alias("k"), "c").agg(F.count("*").alias("used"))
    full = F.col("used") >= capacity
    return used.groupBy("layer").agg(F.count("*").alias("edges"), F.sum("used").alias("used"), F.sum(full.cast("bigint")).alias("saturated"), F.max(F.greatest(F.col("used") - capacity, F.lit(0))).alias("overflow"), F.floor(F.sum("used") * 100 / (F.count("*") * capacity)).alias("mean_percent"))


def pareto(options: DataFrame, group: str, load: str, delay: str) -> DataFrame:
    """Options that no other of their group beats: in the order of load, those with less delay than all before."""
    w = Window.partitionBy(group).orderBy(load, delay).rowsBetween(Window.unboundedPreceding, -1)
    return options.withColumn("best", F.min(delay).over(w)).filter(F.col("best").isNull() | (F.col(delay) < F.col("best"))).drop("best")


def stripes(x0: int, y0: int, x1: int, y1: int, pitch: int, spark) -> DataFrame:
    """(i, net, x): alternating supply stripes over a core, by whole pitches."""
    n = (x1 - x0) // pitch + 1
    return spark.range(n).select(F.col("id").alias("i"), F.when(F.col("id") % 2 == 0, "VDD").otherwise("VSS").alias("net"), (F.lit(x0) + F.col("id") * pitch).alias("x"))


def global_placed(pins: DataFrame, most: int = 200) -> DataFrame:
    """(pin, x, y) after rounds of moving every pin half way to the mean of its net, in whole units, until the sum of half perimeters changes by less than 1."""
    wire = lambda at: half_perimeters(at).agg(F.coalesce(F.sum("hpwl"), F.lit(0))).first()[0]
    half = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2)
    at, before = pins, wire(pins)
    for _ in range(most):
        mean = at.groupBy("net").agg(F.round(F.avg("x")).cast("bigint").alias("mx"), F.round(F.avg("y")).cast("bigint").alias("my"))
        at = materialize(at.join(mean, "net").select("net", "pin", half("x", "mx").alias("x"), half("y", "my").alias("y")), "placement")
        now = wire(at)
        if abs(before - now) < 1:
            return at
        before = now
    raise RuntimeError("the placement did not settle")
