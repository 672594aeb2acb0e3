"""Static timing on a graph of edges (edge_idx, src, dst, kind, delay): arrivals, required times, slacks, corners, derates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.plans.graph import propagate
from maskloom.plans.tables import materialize


def sources(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def sinks(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def arrivals(edges: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """(node, value): latest arrival; sources start at 0 or at their row of inputs (node, value). Nodes not reached have no row."""
    start = sources(edges).withColumn("value", F.lit(0).cast("bigint")) if inputs is None else inputs
    return propagate(edges, start, F.col("value") + F.col("delay"))


def required(edges: DataFrame, period: int) -> DataFrame:
    """(node, value): the latest arrival that keeps every sink below it within the period."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "delay")
    return propagate(back, sinks(edges).withColumn("value", F.lit(period).cast("bigint")), F.col("value") - F.col("delay"), F.min)


def slacks(edges: DataFrame, period: int) -> DataFrame:
    a, r = arrivals(edges).withColumnRenamed("value", "arrival"), required(edges, period).withColumnRenamed("value", "required")
    return a.join(r, "node").withColumn("slack", F.col("required") - F.col("arrival"))


def hold_slacks(edges: DataFrame, hold: int) -> DataFrame:
    """(node, arrival, slack): earliest arrival less the hold time, where it is negative."""
    early = propagate(edges, sources(edges).withColumn("value", F.lit(0).cast("bigint")), F.col("value") + F.col("delay"), F.min)
    return early.select("node", F.col("value").alias("arrival"), (F.col("value") - hold).alias("slack")).filter("slack < 0")


def cell_depths(edges: DataFrame) -> DataFrame:
    """(node, value): the greatest number of cell edges on a path to each node."""
    return propagate(edges, sources(edges).withColumn("value", F.lit(0).cast("bigint")), F.col("value") + F.when(F.col("kind") == "cell", 1).otherwise(0))


def derated(edges: DataFrame, table: list[tuple[int, float]]) -> DataFrame:
    """Edges with delay times the factor at the destination's depth: linear between the table's depths, clamped at its ends."""
    depth = cell_depths(edges).select(F.col("node").alias("dst"), F.col("value").alias("depth"))
    points = sorted(table)
    d = F.col("depth").cast("double")
    factor = F.lit(1.0) if not points else F.when(d >= points[-1][0], F.lit(points[-1][1]))
    for (a, fa), (b, fb) in reversed(list(zip(points[:-1], points[1:], strict=True))):
        factor = factor.when((d >= a) & (d < b), F.lit(fa) + (d - a) * ((fb - fa) / (b - a)))
    if points:
        factor = factor.otherwise(F.lit(points[0][1]))
    return edges.join(depth, "dst").withColumn("factor", factor).withColumn("derated", F.col("delay") * F.col("factor"))


def statistical(edges: DataFrame, sigma: int) -> DataFrame:
    """(node, mean, variance): along the path of the greatest mean, of each edge's variance sigma squared; ties to the greater variance."""
    start = sources(edges).withColumn("value", F.struct(F.lit(0).cast("bigint").alias("mean"), F.lit(0).cast("bigint").alias("variance")))
    step = F.struct((F.col("value.mean") + F.col("delay")).alias("mean"), (F.col("value.variance") + sigma * sigma).alias("variance"))
    return propagate(edges, start, step).select("node", "value.mean", "value.variance")


def corners(edges: DataFrame, factors: dict[str, int], period: int) -> DataFrame:
    """(corner, worst_arrival, worst_slack) over the sinks: delays times whole-number factors, all corners in one propagation."""
    table = F.array(*[F.struct(F.lit(k).alias("corner"), F.lit(v).cast("bigint").alias("factor")) for k, v in factors.items()])
    scaled = edges.withColumn("c", F.explode(table)).select("*", "c.*").select(F.struct("corner", F.col("src").alias("n")).alias("src"), F.struct("corner", F.col("dst").alias("n")).alias("dst"), "kind", (F.col("delay") * F.col("factor")).alias("delay"))
    ends = sinks(scaled)
    return arrivals(scaled).join(ends, "node").groupBy("node.corner").agg(F.max("value").alias("worst_arrival"), F.min(F.lit(period) - F.col("value")).alias("worst_slack"))


def at_corner(edges: DataFrame, factor: float, derate: float) -> DataFrame:
    """Edges at a corner: delays times its factor and its late or early derate."""
    return edges.withColumn("delay", F.col("delay") * F.lit(float(factor) * float(derate)))


def crossings(edges: DataFrame, domains: DataFrame) -> DataFrame:
    """(edge_idx, src, dst, src_domain, dst_domain): edges between two clock domains (node, domain); empty domains don't count."""
    known = domains.filter("domain is not null and domain <> ''")
    a = known.select(F.col("node").alias("src"), F.col("domain").alias("src_domain"))
    b = known.select(F.col("node").alias("dst"), F.col("domain").alias("dst_domain"))
    return edges.join(a, "src").join(b, "dst").filter("src_domain <> dst_domain").select("edge_idx", "src", "dst", "src_domain", "dst_domain")


def worst(slack: DataFrame, n: int) -> DataFrame:
    return slack.orderBy("slack", "node").limit(n)


def worst_path(edges: DataFrame, arrival: DataFrame, endpoint: int, most: int = 10_000) -> DataFrame:
    """(step, node): back from an endpoint along predecessors whose arrival and delay make its arrival; ties to the later, then smaller, node."""
    spark = edges.sparkSession
    a = arrival.select(F.col("node").alias("src"), F.col("value").alias("at"))
    b = arrival.select(F.col("node").alias("dst"), F.col("value").alias("to"))
    tight = edges.join(a, "src").join(b, "dst").filter(F.col("at") + F.col("delay") == F.col("to"))
    first = Window.partitionBy("dst").orderBy(F.desc("at"), "src")
    before = tight.withColumn("r", F.row_number().over(first)).filter("r = 1").select("src", "dst")
    before, path, node = materialize(before, "before"), [endpoint], endpoint
    for _ in range(most):
        row = before.filter(F.col("dst") == node).first()
        if row is None:
            return spark.createDataFrame([(i, n) for i, n in enumerate(reversed(path))], "step int, node bigint")
        node = row.src
        path.append(node)
    raise ValueError("the graph has a cycle")


def annotated(edges: DataFrame, delays: DataFrame) -> DataFrame:
    """Edges with the delay of a (seq, src, dst, delay) table where it has one, the last by seq if it has several; also whether it had."""
    new = delays.groupBy("src", "dst").agg(F.max_by("delay", "seq").alias("new"))
    return edges.join(new, ["src", "dst"], "left").withColumn("updated", F.col("new").isNotNull()).withColumn("delay", F.coalesce("new", "delay")).drop("new")


def excepted(slack: DataFrame, exceptions: DataFrame, period: int) -> DataFrame:
    """(node, slack, rule): slack under path exceptions (seq, node, rule, value), the last that names an endpoint holding.

    false: no limit (null); multicycle: value periods; max_delay: value. Other endpoints keep their slack.
    """
    last = exceptions.groupBy("node").agg(F.max_by(F.struct("rule", "value"), "seq").alias("e")).select("node", "e.rule", "e.value")
    limit = F.when(F.col("rule") == "multicycle", F.col("value") * period - F.col("arrival")).when(F.col("rule") == "max_delay", F.col("value") - F.col("arrival"))
    return slack.join(last, "node", "left").select("node", F.when(F.col("rule").isNull(), F.col("slack")).otherwise(limit).alias("slack"), "rule")


def common_clock(edges: DataFrame, root: int, pairs: DataFrame) -> DataFrame:
    """(launch, capture, common): the latest clock arrival among the nodes from which both ends can be reached; 0 if there is none.

    Ancestors of all ends are found together, one join for each level, among the nodes below the root.
    """
    spark = edges.sparkSession
    clock = materialize(arrivals(edges, spark.createDataFrame([(root, 0)], "node bigint, value bigint")), "clock")
    ends = pairs.select(F.col("launch").alias("n")).union(pairs.select("capture")).distinct()
    back = edges.select(F.col("dst").alias("p"), F.col("src").alias("q"))
    front = materialize(ends.select("n", F.col("n").alias("up")), "ancestors")
    known = front
    while not front.isEmpty():
        step = front.join(back, F.col("up") == F.col("p")).select("n", F.col("q").alias("up")).distinct()
        front = materialize(step.join(known, ["n", "up"], "left_anti"), "ancestors")
        known = materialize(known.unionAll(front), "ancestors")
    up = known.join(clock.select(F.col("node").alias("up"), F.col("value").alias("at")), "up")
    a, b = up.select(F.col("n").alias("launch"), "up", "at"), up.select(F.col("n").alias("capture"), "up")
    best = pairs.join(a, "launch").join(b, ["capture", "up"]).groupBy("launch", "capture").agg(F.max("at").alias("common"))
    return pairs.join(best, ["launch", "capture"], "left").select("launch", "capture", F.coalesce("common", F.lit(0)).alias("common"))


def half_crossing(currents: DataFrame, cap: float, vdd: float) -> DataFrame:
    """(key, delay): when the integral of current over time, by trapezoids and over the load, first reaches half of vdd; 0 if never."""
    w = Window.partitionBy("key").orderBy("t")
    step = F.coalesce((F.col("i") + F.lag("i").over(w)) / 2 * (F.col("t") - F.lag("t").over(w)), F.lit(0.0))
    v = currents.withColumn("dv", step).withColumn("v", F.sum("dv").over(w) / cap)
    v = v.withColumn("pv", F.lag("v").over(w)).withColumn("pt", F.lag("t").over(w))
    cross = F.when((F.col("pv") < vdd / 2) & (F.col("v") >= vdd / 2), F.col("pt") + (vdd / 2 - F.col("pv")) / (F.col("v") - F.col("pv")) * (F.col("t") - F.col("pt")))
    return v.groupBy("key").agg(F.coalesce(F.min(cross), F.lit(0.0)).alias("delay"))


def net_annotated(edges: DataFrame, nets: DataFrame, most: int = 64) -> tuple[DataFrame, DataFrame]:
    """Net edges get resistance times capacitance of the net (seq, net, r, c, pins) that has both their ends among its pins; the last net holds.

    Also (edges_updated, nets_skipped): how many pairs of pins met an edge, and how many nets met none. Pins of a net of at most `most` are paired, those where
    an edge begins with the others; each pin of a larger net meets edges by an equal key, so that its pins are not paired with each other.
    Nodes are named (src and dst are pins' names).
    """
    held = materialize(nets.select("seq", (F.col("r") * F.col("c")).alias("rc"), F.array_distinct("pins").alias("pins")), "nets")
    links = edges.filter("kind = 'net' and src <> dst").select("edge_idx", "src", "dst")
    few = held.filter(F.size("pins") <= most).select("seq", "rc", "pins", F.explode("pins").alias("src")).join(links.select("src").distinct(), "src", "left_semi")
    few = few.select("seq", "rc", "src", F.explode("pins").alias("dst")).join(links, ["src", "dst"]).select("edge_idx", "seq", "rc")
    pin = held.filter(F.size("pins") > most).select("seq", "rc", F.explode("pins").alias("pin"))
    many = links.join(pin.withColumnRenamed("pin", "src"), "src").join(pin.select("seq", F.col("pin").alias("dst")), ["dst", "seq"]).select("edge_idx", "seq", "rc")
    hit = few.unionByName(many)
    new = hit.groupBy("edge_idx").agg(F.max_by("rc", "seq").alias("new"))
    out = edges.join(new, "edge_idx", "left").withColumn("delay", F.coalesce("new", F.col("delay").cast("double"))).select(*edges.columns)
    met = hit.agg(F.count("*").alias("edges_updated"), F.count_distinct("seq").alias("met"))
    whole = held.agg(F.count("*").alias("nets"))
    counts = met.withColumn("k", F.lit(0)).join(whole.withColumn("k", F.lit(0)), "k").select("edges_updated", (F.col("nets") - F.col("met")).alias("nets_skipped"))
    return out, counts


def clock_credit(edges: DataFrame, root: int, pairs: DataFrame, late: float, early: float) -> DataFrame:
    """(launch, capture, common, credit): the clock path that both ends share counts once, not late and early: common * (late - early)."""
    return common_clock(edges, root, pairs).withColumn("credit", F.greatest("common", F.lit(0)) * F.lit(late - early))


def arrivals_with_slew(edges: DataFrame, delay, slew, inputs: DataFrame | None = None) -> DataFrame:
    """(node, arrival, slew): latest arrivals where an edge's delay and the slew behind it follow from the slew before it.

    delay, slew: functions of three columns, the slew at the edge's start, the load of its end (the sum of `delay` of the net edges that leave it), and
    the edge's own delay. A node keeps the slew of the edge that arrives last, of equal ones the first by edge_idx. Levels
    are found once; each level meets only its own edges. inputs: (node, arrival, slew) of sources that don't start at 0.
    """
    start = sources(edges).withColumns({"arrival": F.lit(0.0), "slew": F.lit(0.0)})
    if inputs is not None:
        start = start.select("node").join(inputs.select("node", F.col("arrival").cast("double").alias("arrival"), F.col("slew").cast("double").alias("slew")), "node", "left").fillna(0.0, ["arrival", "slew"])
    load = edges.filter("kind = 'net'").groupBy(F.col("src").alias("dst")).agg(F.sum(F.col("delay").cast("double")).alias("load"))
    from maskloom.plans.graph import levels

    level = materialize(levels(edges), "levels")
    work = edges.join(load, "dst", "left").join(level.select(F.col("node").alias("dst"), F.col("value").alias("level")), "dst")
    work = materialize(work.select("edge_idx", "src", "dst", F.col("delay").cast("double").alias("own"), F.coalesce("load", F.lit(0.0)).alias("load"), "level"), "leveled")
    known = materialize(start.select("node", "arrival", "slew"), "arrivals")
    for n in range(1, (level.agg(F.max("value")).first()[0] or 0) + 1):
        met = work.filter(F.col("level") == n).join(known.withColumnRenamed("node", "src"), "src")
        made = met.select("dst", F.struct((F.col("arrival") + delay(F.col("slew"), F.col("load"), F.col("own"))).alias("arrival"), (-F.col("edge_idx")).alias("first"), slew(F.col("slew"), F.col("load"), F.col("own")).alias("slew")).alias("x"))
        known = known.unionAll(materialize(made.groupBy(F.col("dst").alias("node")).agg(F.max("x").alias("x")).select("node", "x.arrival", "x.slew"), "arrivals"))
    return known


def scenarios(edges: DataFrame, factors: dict[str, tuple[int, int]], exceptions: DataFrame) -> DataFrame:
    """(scenario, worst_slack, worst_endpoint) and, under a null scenario, the worst of all: factors are (delay factor, period) of each scenario.

    exceptions: (scenario, seq, node, rule, value) as excepted() reads them. All scenarios go through one propagation; sinks without a finite slack don't count.
    """
    table = F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(f).cast("bigint").alias("factor"), F.lit(p).cast("bigint").alias("period")) for k, (f, p) in factors.items()])
    named = lambda c: F.struct("scenario", F.col(c).alias("n")).alias(c)
    scaled = materialize(edges.withColumn("x", F.explode(table)).select("*", "x.*").select(named("src"), named("dst"), "kind", (F.col("delay") * F.col("factor")).alias("delay")), "scenarios")
    ends = arrivals(scaled).join(sinks(scaled), "node").select("node.scenario", F.col("node.n").alias("node"), F.col("value").alias("arrival"))
    period = F.create_map(*[x for k, (_, p) in factors.items() for x in (F.lit(k), F.lit(p).cast("bigint"))])
    last = exceptions.groupBy("scenario", "node").agg(F.max_by(F.struct("rule", "value"), "seq").alias("e")).select("scenario", "node", "e.*")
    limit = F.when(F.col("rule") == "multicycle", F.col("value") * F.col("period")).when(F.col("rule") == "max_delay", F.col("value")).when(F.col("rule").isNull(), F.col("period"))
    slack = ends.join(last, ["scenario", "node"], "left").withColumn("period", F.try_element_at(period, F.col("scenario"))).withColumn("slack", limit - F.col("arrival")).filter("slack is not null")
    worst_ = F.min(F.struct("slack", "node"))
    return slack.groupingSets([[F.col("scenario")], []], "scenario").agg(worst_.alias("w")).select("scenario", F.col("w.slack").alias("worst_slack"), F.col("w.node").alias("worst_endpoint"))


def path_report(path: DataFrame, arrival: DataFrame, required_: DataFrame) -> DataFrame:
    """(line, text): a path (step, node) as text, with arrival, required time and slack of its end and the steps' times."""
    p = path.join(arrival.select("node", F.col("value").cast("double").alias("at")), "node").join(required_.select("node", F.col("value").cast("double").alias("need")), "node", "left")
    w = Window.orderBy("step")  # one path
    p = p.withColumn("delta", F.col("at") - F.coalesce(F.lag("at").over(w), F.col("at")))
    ends = p.agg(F.min_by("node", "step").alias("first"), F.max_by("node", "step").alias("last"), F.max_by("at", "step").alias("at"), F.max_by("need", "step").alias("need"))
    head = F.array(
        F.format_string("Path: %s → %s", F.col("first").cast("string"), F.col("last").cast("string")), F.format_string("  arrival = %.4f", "at"), F.format_string("  required = %.4f", "need"),
        F.format_string("  slack = %.4f", F.col("need") - F.col("at")), F.lit(""), F.lit("  step  cumul    delta   pin"),
    )
    top = ends.filter("first is not null").select(F.posexplode(head).alias("line", "text"))
    return top.unionAll(p.select((F.col("step") + 6).alias("line"), F.format_string("  %4d  %7.4f  %+7.4f  %s", "step", "at", "delta", F.col("node").cast("string")).alias("text")))
