"""Queries over merged polygons, edges, scenarios and path reports, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.functions import geometry as G
from maskloom.operators import edges, polygons, timing
from maskloom.plans.tables import materialize
from maskloom.plans.views import view, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


#: Edges of merged shapes, as in operators.polygons but without tiles: slabs between all x of a layer.
_EDGES = """WITH r AS (SELECT layer AS g, x0, y0, x1, y1 FROM rects), c AS (SELECT g, x, lead(x) OVER (PARTITION BY g ORDER BY x) AS nx FROM (SELECT DISTINCT g, unnest([x0, x1]) AS x FROM r)),
s AS (SELECT r.g, c.x, c.nx, y0, y1 FROM c JOIN r ON r.g = c.g AND r.x0 <= c.x AND r.x1 >= c.nx WHERE c.nx IS NOT NULL),
e AS (SELECT g, x, nx, y, sum(d) AS d FROM (SELECT g, x, nx, y0 AS y, 1 AS d FROM s UNION ALL SELECT g, x, nx, y1, -1 FROM s) GROUP BY ALL),
w AS (SELECT *, lead(y) OVER o AS ny, sum(d) OVER o AS a FROM e WINDOW o AS (PARTITION BY g, x ORDER BY y)), b AS (SELECT g, x, nx, y, ny FROM w WHERE ny IS NOT NULL AND a > 0),
t AS (SELECT g, 'v' AS axis, x AS pos, y AS lo, ny AS hi, 1 AS d FROM b UNION ALL SELECT g, 'v', nx, y, ny, -1 FROM b UNION ALL SELECT g, 'h', y, x, nx, 1 FROM b UNION ALL SELECT g, 'h', ny, x, nx, -1 FROM b),
u AS (SELECT g, axis, pos, p, sum(d) AS d FROM (SELECT g, axis, pos, lo AS p, d FROM t UNION ALL SELECT g, axis, pos, hi, -d FROM t) GROUP BY ALL HAVING sum(d) <> 0),
ed AS (SELECT * FROM (SELECT g AS layer, axis, pos, p AS lo, lead(p) OVER o AS hi, CAST(sum(d) OVER o AS INTEGER) AS side FROM u WINDOW o AS (PARTITION BY g, axis, pos ORDER BY p)) WHERE side <> 0)"""
_NEAR = "a.axis = b.axis AND b.pos > a.pos AND b.pos - a.pos < {least} AND a.lo < b.hi AND b.lo < a.hi"


@query(f"{_EDGES} SELECT layer, axis, pos AS \"at\", lo, hi, side FROM ed", "rects")
def merged_edges(spark, sf_dir):
    return polygons.edges(view(spark, sf_dir, "rects"), ["layer"]).withColumnRenamed("inner", "side")


def _two(spark, sf_dir):
    r = view(spark, sf_dir, "rects")
    return r.filter("layer in (0, 2)"), r.filter("layer in (1, 3)")


_TWO = _EDGES.replace("SELECT layer AS g", "SELECT layer % 2 AS g")


@query(
    _TWO + " " + " UNION ALL ".join(f"SELECT a.axis, a.pos AS \"at\", a.lo, a.hi, b.pos AS \"to\", b.lo AS to_lo, b.hi AS to_hi, b.pos - a.pos AS dist FROM ed a JOIN ed b ON {_NEAR.format(least=30)} AND a.side < 0 AND b.side > 0 AND a.layer = {x} AND b.layer = {1 - x}" for x in (0, 1)),
    "rects",
)
def merged_separation(spark, sf_dir):
    return polygons.separation(*_two(spark, sf_dir), 30)


def _enclosing(sign: int, out: str, own: str) -> str:
    far = "CAST(round(sqrt(400 - (b.pos - a.pos) * (b.pos - a.pos))) AS BIGINT)"
    return f"SELECT a.axis, {own}.pos AS \"at\", {own}.lo, {own}.hi, {out}.pos AS \"to\", greatest({own}.lo - {far}, {out}.lo) AS to_lo, least({own}.hi + {far}, {out}.hi) AS to_hi, b.pos - a.pos AS dist FROM ed a JOIN ed b ON {_NEAR.format(least=20)} AND a.side = {sign} AND b.side = {sign} AND {out}.layer = 0 AND {own}.layer = 1"


@query(f"{_TWO} {_enclosing(1, 'a', 'b')} UNION ALL {_enclosing(-1, 'b', 'a')}", "rects")
def merged_enclosing(spark, sf_dir):
    return polygons.enclosing(*_two(spark, sf_dir), 20)


@query()
def merged_space(spark, sf_dir):
    return polygons.space(view(spark, sf_dir, "rects"), 30, ["layer"])


@query()
def merged_width(spark, sf_dir):
    return polygons.width(view(spark, sf_dir, "rects"), 30, ["layer"])


@query()
def merged_overlap(spark, sf_dir):
    return polygons.overlap(*_two(spark, sf_dir), 20)


_AREA = _EDGES.replace("SELECT layer AS g", "SELECT 0 AS g")


@query(
    _AREA.split(",\nt AS (")[0]
    + """, f AS (SELECT min(x0) - 200 AS x0, min(y0) - 200 AS y0, max(x1) + 200 AS x1, max(y1) + 200 AS y1 FROM r), n AS (SELECT *, CAST(ceil((x1 - x0) / 600.0::DOUBLE - 1e-10) AS BIGINT) AS nx, CAST(ceil((y1 - y0) / 600.0::DOUBLE - 1e-10) AS BIGINT) AS ny FROM f),
    p AS (SELECT nx, ny, CAST(floor(0.5 + (x0 + x1) * 0.5 - nx * 300 + 1e-10) AS BIGINT) AS sx, CAST(floor(0.5 + (y0 + y1) * 0.5 - ny * 300 + 1e-10) AS BIGINT) AS sy FROM n),
    t AS (SELECT ix, iy, sx + ix * 600 - 200 AS x0, sy + iy * 600 - 200 AS y0, sx + ix * 600 + 800 AS x1, sy + iy * 600 + 800 AS y1 FROM (SELECT *, unnest(range(ny)) AS iy FROM (SELECT *, unnest(range(nx)) AS ix FROM p))),
    z AS (SELECT t.*, coalesce((SELECT sum((least(b.nx, t.x1) - greatest(b.x, t.x0)) * (least(b.ny, t.y1) - greatest(b.y, t.y0))) FROM b WHERE b.x < t.x1 AND b.nx > t.x0 AND b.y < t.y1 AND b.ny > t.y0), 0) AS area FROM t)
    SELECT ix, iy, x0, y0, x1, y1, CAST(floor(area / 1000000.0::DOUBLE * 1000000) AS BIGINT) AS millionths FROM z WHERE NOT (area / 1000000.0::DOUBLE > 0.1 - 1e-10 AND area / 1000000.0::DOUBLE < 0.4 + 1e-10)""",
    "rects",
)
def density_tiles(spark, sf_dir):
    """Windows of 1000 every 600 units, also those without shapes; the shapes of all layers merged."""
    out = polygons.density_tiles(view(spark, sf_dir, "rects"), (1000, 1000), (600, 600), 0.1, 0.4)
    return out.withColumn("millionths", F.floor(F.col("density") * 1000000).cast("bigint")).drop("density")


_SPOKES = "SELECT seq AS id, lo AS ax, segments.at AS ay, CASE WHEN layer = 0 THEN hi ELSE lo END AS bx, CASE WHEN layer = 0 THEN segments.at ELSE segments.at + (hi - lo) * (1 + layer) END AS by_ FROM segments"


def _spokes(spark, sf_dir):
    s = view(spark, sf_dir, "segments")
    flat = F.col("layer") == 0
    return s.select(F.col("seq").alias("id"), F.col("lo").alias("ax"), F.col("at").alias("ay"), F.when(flat, F.col("hi")).otherwise(F.col("lo")).alias("bx"), F.when(flat, F.col("at")).otherwise(F.col("at") + (F.col("hi") - F.col("lo")) * (1 + F.col("layer"))).alias("by"))


@query(
    f"""WITH e AS ({_SPOKES}), m AS (SELECT *, ax = bx AND ay <> by_ AS upright, (ax + bx) // 2 AS mx, (ay + by_) // 2 AS my, abs(bx - ax) + abs(by_ - ay) AS n FROM e)
    SELECT id, upright, mx, my, n >= 400 AS long, CASE WHEN n <= 300 THEN ay WHEN upright THEN my - 150 ELSE my END AS cy, CASE WHEN upright THEN by_ + 7 ELSE by_ END AS far FROM m""",
    "segments",
)
def edge_measures(spark, sf_dir):
    """Direction, middle, length test, middle piece and extension of edges along an axis."""
    row = {c: F.col(c) for c in ("ax", "ay", "bx", "by")}
    x, y = G.midpoint(row)
    e = _spokes(spark, sf_dir)
    return e.select("id", G.has_angle(row, 90.0, 0.5).alias("upright"), x.alias("mx"), y.alias("my"), G.length_at_least(row, 400).alias("long"), G.edge_center(row, 300)["ay"].alias("cy"), G.edge_extended(row, 3, 7)["by"].alias("far"))


@query()
def edges_in_region(spark, sf_dir):
    """The parts of wires that lie over shapes."""
    return edges.covered(_spokes(spark, sf_dir), view(spark, sf_dir, "rects")).withColumnRenamed("by", "by_")


@query(
    """WITH p AS (SELECT l_orderkey AS seq, CAST(min(l_quantity) AS DOUBLE) AS r, CAST(max(l_linenumber) AS DOUBLE) AS c, list(DISTINCT l_linenumber * 1000 + l_suppkey % 50) || list(DISTINCT (l_linenumber + 1) * 1000 + l_partkey % 50) AS pins FROM lineitem GROUP BY 1),
    q AS (SELECT seq, r * c AS rc, unnest(list_distinct(pins)) AS pin FROM p), h AS (SELECT e.edge_idx, a.seq, a.rc FROM t_edges e JOIN q a ON a.pin = e.src JOIN q b ON b.pin = e.dst AND b.seq = a.seq WHERE e.kind = 'net' AND e.src <> e.dst)
    SELECT e.edge_idx, CAST(coalesce(n.rc, e.delay) AS DOUBLE) AS delay FROM t_edges e LEFT JOIN (SELECT edge_idx, max_by(rc, seq) AS rc FROM h GROUP BY 1) n USING (edge_idx)""",
    "t_edges",
)
def sta_net_annotation(spark, sf_dir):
    """Delays of net edges from resistance, capacitance and pins of nets: each order is a net of the pins that its lines name."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pins = F.array_union(F.collect_set(F.col("l_linenumber") * 1000 + F.col("l_suppkey") % 50), F.collect_set((F.col("l_linenumber") + 1) * 1000 + F.col("l_partkey") % 50))
    nets = lines.groupBy(F.col("l_orderkey").alias("seq")).agg(F.min("l_quantity").cast("double").alias("r"), F.max("l_linenumber").cast("double").alias("c"), pins.alias("pins"))
    out, _ = timing.net_annotated(materialize(view(spark, sf_dir, "t_edges"), "edges"), nets)
    return out.select("edge_idx", "delay")


def _longest(start: str, step: str, depth: int = 8) -> str:
    out = [f"l0 AS ({start})"]
    out += [f"l{i + 1} AS (SELECT e.dst AS node, max({step}) AS value FROM l{i} JOIN t_edges e ON e.src = l{i}.node GROUP BY e.dst)" for i in range(depth)]
    return ", ".join(out) + ", v AS (SELECT node, CAST(max(value) AS BIGINT) AS value FROM (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(depth + 1)) + ") GROUP BY node)"


_START = "SELECT DISTINCT src AS node, 0 AS value FROM t_edges WHERE src NOT IN (SELECT dst FROM t_edges)"


@query(
    f"""WITH {_longest(_START, "value + delay")}, s(scenario, factor, period) AS (VALUES ('fast', 8, 2000), ('slow', 12, 2500)),
    d AS (SELECT scenario, node, value * factor AS arrival, CASE WHEN node % 7 = 0 THEN NULL WHEN node % 7 = 1 THEN 2 * period WHEN node % 7 = 2 THEN 1500 ELSE period END AS need FROM v, s WHERE node NOT IN (SELECT src FROM t_edges)),
    k AS (SELECT scenario, node, need - arrival AS slack FROM d WHERE need IS NOT NULL)
    SELECT scenario, CAST(min(slack) AS BIGINT) AS worst_slack, arg_min(node, slack * 100000 + node) AS worst_endpoint FROM k GROUP BY GROUPING SETS ((scenario), ())""",
    "t_edges",
)
def sta_scenarios(spark, sf_dir):
    e = materialize(view(spark, sf_dir, "t_edges"), "edges")
    names = F.explode(F.array(F.lit("fast"), F.lit("slow")))
    rule = F.when(F.col("node") % 7 == 0, "false").when(F.col("node") % 7 == 1, "multicycle").otherwise("max_delay")
    exceptions = timing.sinks(e).filter("node % 7 < 3").select(names.alias("scenario"), F.lit(1).alias("seq"), "node", rule.alias("rule"), F.when(F.col("node") % 7 == 1, 2).otherwise(1500).alias("value"))
    return timing.scenarios(e, {"fast": (8, 2000), "slow": (12, 2500)}, exceptions)


@query(
    "WITH " + ", ".join([f"a{i} AS ({x})" for i, x in enumerate([_START.replace("0 AS value", "0.0::DOUBLE AS arrival, 1.0::DOUBLE AS slew")])])
    + """, ld AS (SELECT src AS node, sum(delay) AS load FROM t_edges WHERE kind = 'net' GROUP BY 1), g AS (SELECT e.*, CAST(coalesce(ld.load, 0) AS DOUBLE) AS load FROM t_edges e LEFT JOIN ld ON ld.node = e.dst)"""
    + "".join(
        f""", m{i} AS (SELECT dst AS node, max(struct_pack(arrival := a.arrival + g.delay + a.slew / 2, first := -g.edge_idx, slew := a.slew / 2 + g.load / 64)) AS x FROM g JOIN a{i} a ON a.node = g.src WHERE g.src // 1000 = {i + 1} GROUP BY 1),
        a{i + 1} AS (SELECT * FROM a{i} UNION ALL SELECT node, x.arrival, x.slew FROM m{i})"""
        for i in range(7)
    )
    + " SELECT node, CAST(round(arrival * 1024) AS BIGINT) AS arrival, CAST(round(slew * 1024) AS BIGINT) AS slew FROM a7",
    "t_edges",
)
def sta_slews(spark, sf_dir):
    """Arrivals and slews where half the slew adds to an edge's delay, and the load behind it to the slew."""
    e = materialize(view(spark, sf_dir, "t_edges"), "edges")
    start = timing.sources(e).select("node", F.lit(0.0).alias("arrival"), F.lit(1.0).alias("slew"))
    out = timing.arrivals_with_slew(e, lambda s, load, own: own + s / 2, lambda s, load, own: s / 2 + load / 64, start)
    return out.select("node", F.round(F.col("arrival") * 1024).cast("bigint").alias("arrival"), F.round(F.col("slew") * 1024).cast("bigint").alias("slew"))


_BACK = f"""WITH {_longest(_START, "value + delay")}, t AS (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY a.value DESC, src) AS r FROM t_edges e JOIN v a ON a.node = e.src JOIN v b ON b.node = e.dst WHERE a.value + delay = b.value),
p0 AS (SELECT node FROM v ORDER BY value DESC, node LIMIT 1), {", ".join(f"p{i + 1} AS (SELECT src AS node FROM t JOIN p{i} ON t.dst = p{i}.node WHERE r = 1)" for i in range(8))},
w AS ({" UNION ALL ".join(f"SELECT {i} AS back, node FROM p{i}" for i in range(9))}), s AS (SELECT (SELECT max(back) FROM w) - back AS step, node FROM w)"""


@query(
    f"""{_BACK}, o AS (SELECT step, s.node, CAST(v.value AS DOUBLE) AS arr, arr - coalesce(lag(arr) OVER (ORDER BY step), arr) AS delta FROM s JOIN v USING (node))
    SELECT step + 6 AS line, printf('  %4d  %7.4f  %+7.4f  %d', step, arr, delta, node) AS text FROM o UNION ALL
    SELECT unnest([0, 1, 2, 3, 4, 5]), unnest(['Path: ' || (SELECT node FROM o WHERE step = 0) || ' → ' || (SELECT arg_max(node, step) FROM o), printf('  arrival = %.4f', (SELECT max(arr) FROM o)), '  required = 300.0000', printf('  slack = %.4f', 300 - (SELECT max(arr) FROM o)), '', '  step  cumul    delta   pin'])""",
    "t_edges",
)
def path_report(spark, sf_dir):
    """The report of the path that arrives last."""
    e = materialize(view(spark, sf_dir, "t_edges"), "edges")
    a = materialize(timing.arrivals(e), "arrivals")
    end = a.orderBy(F.desc("value"), "node").first()
    return timing.path_report(timing.worst_path(e, a, end.node), a, timing.required(e, 300))


@query(
    """WITH p AS (SELECT id, 1 + id % 3 AS nr, id % 4 AS nc, layer, x1 - x0 AS w, y1 - y0 AS h FROM rects)
    SELECT id, CAST(nr * nc AS BIGINT) AS n, CASE WHEN nc > 0 THEN least(0, w * (nc - 1) - 5 * (nr - 1)) END AS bx0, CASE WHEN nc > 0 THEN greatest(0, 3 * (nc - 1) + h * (nr - 1)) END AS by1, CAST((CASE WHEN id % 2 = 0 THEN 4 - layer ELSE layer END + id) % 4 AS INTEGER) AS turn FROM p""",
    "rects",
)
def repetitions(spark, sf_dir):
    """Placements and extent of arrays of steps (-5, h) by rows and (w, 3) by columns, and a port's direction after a transform."""
    r = view(spark, sf_dir, "rects").withColumns({"nr": 1 + F.col("id") % 3, "nc": F.col("id") % 4, "w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0")})
    box = G.repeat_box((F.lit(-5), F.col("h")), (F.col("w"), F.lit(3)), F.col("nr"), F.col("nc"))
    turn = G.turned(F.col("layer"), F.col("id"), F.col("id") % 2 == 0).cast("int")
    return r.select("id", G.repeats(F.col("nr"), F.col("nc"), F.lit(None).cast("array<int>")).alias("n"), box[0].alias("bx0"), box[3].alias("by1"), turn.alias("turn"))


@query(f"{_BACK} SELECT CAST(step AS INTEGER) AS step, node FROM s", "t_edges")
def worst_path(spark, sf_dir):
    e = materialize(view(spark, sf_dir, "t_edges"), "edges")
    a = materialize(timing.arrivals(e), "arrivals")
    end = a.orderBy(F.desc("value"), "node").first()
    return timing.worst_path(e, a, end.node)

