"""Queries over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom import queries_io, queries_polygons, queries_routing
from maskloom.functions import geometry as G
from maskloom.operators import connect, correct, drc, kernels, place, region, spatial, timing, trees
from maskloom.plans import graph
from maskloom.plans.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "drc_space"
BOX = spatial.BOX


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _layer(spark, sf_dir, n: int) -> DataFrame:
    return view(spark, sf_dir, "rects").filter(F.col("layer") == n)


_TOUCH = "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"
_OPEN = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
_IN = "a.x0 >= b.x0 AND a.x1 <= b.x1 AND a.y0 >= b.y0 AND a.y1 <= b.y1"


# --- scalar geometry -----------------------------------------------------------------------------


@query(
    """WITH t AS (SELECT *, id % 4 AS rot, id % 3 = 0 AS mirror, id % 17 AS dx, id % 23 AS dy FROM rects),
    m AS (SELECT *, CASE WHEN mirror THEN -y1 ELSE y0 END AS my0, CASE WHEN mirror THEN -y0 ELSE y1 END AS my1 FROM t)
    SELECT id, CASE rot WHEN 0 THEN x0 WHEN 1 THEN -my1 WHEN 2 THEN -x1 ELSE my0 END + dx AS x0, CASE rot WHEN 0 THEN my0 WHEN 1 THEN x0 WHEN 2 THEN -my1 ELSE -x1 END + dy AS y0,
    CASE rot WHEN 0 THEN x1 WHEN 1 THEN -my0 WHEN 2 THEN -x0 ELSE my1 END + dx AS x1, CASE rot WHEN 0 THEN my1 WHEN 1 THEN x1 WHEN 2 THEN -my0 ELSE -x0 END + dy AS y1 FROM m""",
    "rects",
)
def bbox_transform(spark, sf_dir):
    r = view(spark, sf_dir, "rects")
    box = G.apply_box(F.col("id") % 4, F.col("id") % 3 == 0, F.col("id") % 17, F.col("id") % 23, [F.col(c) for c in BOX])
    return r.select("id", *[b.alias(c) for b, c in zip(box, BOX, strict=True)])


@query("SELECT id, id % 4 AS rot, id % 3 = 0 AS mirror, id % 1000 AS dx, id % 777 AS dy, x0, y0 FROM rects", "rects")
def transform_inverse(spark, sf_dir):
    """A transform, composed with its inverse and itself again, gives itself and moves points there and back."""
    r = view(spark, sf_dir, "rects")
    t = (F.col("id") % 4, F.col("id") % 3 == 0, F.col("id") % 1000, F.col("id") % 777)
    again = G.compose(G.compose(t, G.inverse(t)), t)
    x, y = G.apply(*G.inverse(t), *G.apply(*t, F.col("x0"), F.col("y0")))
    return r.select("id", again[0].alias("rot"), again[1].alias("mirror"), again[2].alias("dx"), again[3].alias("dy"), x.alias("x0"), y.alias("y0"))


@query(
    f"""SELECT a.id, CASE WHEN {_TOUCH} THEN greatest(a.x0, b.x0) END AS ix0, CASE WHEN {_TOUCH} THEN least(a.y1, b.y1) END AS iy1, least(a.x0, b.x0) AS ux0, greatest(a.y1, b.y1) AS uy1,
    {_TOUCH} AS touch, {_OPEN} AS open, {_IN} AS inside FROM rects a JOIN rects b ON b.id = a.id + 1""",
    "rects",
)
def bbox_algebra(spark, sf_dir):
    r = view(spark, sf_dir, "rects")
    j = r.alias("a").join(r.withColumn("id", F.col("id") - 1).alias("b"), "id")
    a, b = [F.col(f"a.{c}") for c in BOX], [F.col(f"b.{c}") for c in BOX]
    i, u = G.intersection(a, b), G.union(a, b)
    return j.select("id", i[0].alias("ix0"), i[3].alias("iy1"), u[0].alias("ux0"), u[3].alias("uy1"), G.touches(a, b).alias("touch"), G.overlaps(a, b).alias("open"), G.within(a, b).alias("inside"))


@query("SELECT id, CAST((x1 - x0) * (y1 - y0) AS BIGINT) AS area, 2 * (x1 - x0 + y1 - y0) AS perimeter, x0 AS first_x, y0 AS first_y FROM rects", "rects")
def shape_area_perimeter(spark, sf_dir):
    """Polygon area, perimeter and canonical first point, of boxes given counter-clockwise from another corner."""
    r = view(spark, sf_dir, "rects")
    ring = F.reverse(G.canonical(G.box_polygon(*[F.col(c) for c in BOX])))
    p = r.withColumn("ring", ring)
    first = G.canonical(F.col("ring"))[0]
    return p.select("id", (F.abs(G.double_area(F.col("ring"))) / 2).cast("bigint").alias("area"), G.perimeter(F.col("ring")).alias("perimeter"), first["x"].alias("first_x"), first["y"].alias("first_y"))


@query("SELECT id, layer FROM rects WHERE (x1 - x0) * (y1 - y0) BETWEEN 5000 AND 9000", "rects")
def select_by_area(spark, sf_dir):
    ring = G.box_polygon(*[F.col(c) for c in BOX])
    return view(spark, sf_dir, "rects").filter(F.abs(G.double_area(ring)).between(10000, 18000)).select("id", "layer")


@query("SELECT id, layer FROM rects WHERE 2 * (x1 - x0 + y1 - y0) BETWEEN 300 AND 500", "rects")
def select_by_perimeter(spark, sf_dir):
    return view(spark, sf_dir, "rects").filter(G.perimeter(G.box_polygon(*[F.col(c) for c in BOX])).between(300, 500)).select("id", "layer")


@query("SELECT id FROM rects WHERE greatest(x1 - x0, y1 - y0) / greatest(least(x1 - x0, y1 - y0), 1) BETWEEN 2.0 AND 4.0", "rects")
def select_by_aspect(spark, sf_dir):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return view(spark, sf_dir, "rects").filter((F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1))).between(2.0, 4.0)).select("id")


@query(
    """SELECT id, unnest([x0, x0, x1, x1]) AS ax, unnest([y0, y1, y1, y0]) AS ay, unnest([x0, x1, x1, x0]) AS bx, unnest([y1, y1, y0, y0]) AS by_, unnest([y1 - y0, x1 - x0, y1 - y0, x1 - x0]) AS length,
    unnest([90.0, 0.0, 90.0, 0.0]::DOUBLE[]) AS angle FROM rects""",
    "rects",
)
def edges_of_polygons(spark, sf_dir):
    r = view(spark, sf_dir, "rects").withColumn("e", F.explode(G.edges_of(G.box_polygon(*[F.col(c) for c in BOX]))))
    e = F.col("e")
    return r.select("id", "e.ax", "e.ay", "e.bx", F.col("e.by").alias("by_"), F.sqrt(G.length_squared(e).cast("double")).cast("bigint").alias("length"), G.angle(e).alias("angle"))


@query(
    """SELECT p_partkey, 'D' || p_partkey || '[' || p_size % 8 || ':0]' AS bus, 'D' || p_partkey || '[' || unnest(range(p_size % 8, -1, -1)) || ']' AS bit FROM part"""
)
def bus_expand(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat(F.lit("D"), F.col("p_partkey"), F.lit("["), F.col("p_size") % 8, F.lit(":0]")).alias("bus"))
    return p.withColumn("bit", F.explode(G.bus_names(G.bus_parts(F.col("bus")))))


_A1, _A2 = [0.0, 10.0, 20.0, 40.0], [1.0, 2.0, 4.0]
_V = [float((i * 7 + j * 3) % 11) for i in range(4) for j in range(3)]


@query(
    f"""WITH q AS (SELECT l_quantity AS s, l_tax * 50 AS l, {_A1}::DOUBLE[] AS a, {_A2}::DOUBLE[] AS b, {_V}::DOUBLE[] AS v FROM (SELECT DISTINCT l_quantity, l_tax FROM lineitem)),
    r AS (SELECT *, greatest(least(len(list_filter(a, lambda x: x <= s)), 3), 1) AS i, greatest(least(len(list_filter(b, lambda x: x <= l)), 2), 1) AS j FROM q),
    f AS (SELECT *, greatest(least((s - a[i]) / (a[i + 1] - a[i]), 1.0::DOUBLE), 0.0::DOUBLE) AS f, greatest(least((l - b[j]) / (b[j + 1] - b[j]), 1.0::DOUBLE), 0.0::DOUBLE) AS g FROM r)
    SELECT s AS slew, l AS load, CAST(round(1000 * ((v[(i - 1) * 3 + j] * (1 - g) + v[(i - 1) * 3 + j + 1] * g) * (1 - f) + (v[i * 3 + j] * (1 - g) + v[i * 3 + j + 1] * g) * f)) AS BIGINT) AS delay FROM f"""
)
def nldm_lookup(spark, sf_dir):
    q = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_quantity").alias("slew"), (F.col("l_tax") * 50).alias("load"), "l_tax").dropDuplicates(["slew", "l_tax"]).drop("l_tax")
    arr = lambda v: F.array(*[F.lit(x) for x in v])
    return q.withColumn("delay", F.round(1000 * G.bilinear(arr(_A1), arr(_A2), arr(_V), F.col("slew"), F.col("load"))).cast("bigint"))


@query("SELECT pin, CAST(round((x - 5) / 16) * 16 + 5 AS BIGINT) AS sx, CAST(round((y - 3) / 20) * 20 + 3 AS BIGINT) AS sy, least(x // 500, 39) AS gx, least(y // 500, 39) AS gy FROM net_pins", "net_pins")
def track_snap(spark, sf_dir):
    p = view(spark, sf_dir, "net_pins")
    cell = lambda c: F.least(F.floor(F.col(c) / 500), F.lit(39))
    return p.select("pin", G.snap(F.col("x"), 5, 16).alias("sx"), G.snap(F.col("y"), 3, 20).alias("sy"), cell("x").alias("gx"), cell("y").alias("gy"))


# --- selections and rules ------------------------------------------------------------------------

_AB = "WITH a AS (SELECT * FROM rects WHERE layer = 0), b AS (SELECT * FROM rects WHERE layer = 1) "


def _ab(spark, sf_dir):
    return _layer(spark, sf_dir, 0), _layer(spark, sf_dir, 1)


@query(f"{_AB} SELECT id, layer FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {_TOUCH})", "rects")
def interacting(spark, sf_dir):
    return spatial.interacting(*_ab(spark, sf_dir)).select("id", "layer")


@query(f"{_AB} SELECT id, layer FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_TOUCH})", "rects")
def not_interacting(spark, sf_dir):
    return spatial.not_interacting(*_ab(spark, sf_dir)).select("id", "layer")


@query(f"{_AB} SELECT id, layer FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {_OPEN})", "rects")
def overlapping(spark, sf_dir):
    return spatial.overlapping(*_ab(spark, sf_dir)).select("id", "layer")


@query(f"{_AB} SELECT id, layer FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_OPEN})", "rects")
def not_overlapping(spark, sf_dir):
    return spatial.not_overlapping(*_ab(spark, sf_dir)).select("id", "layer")


@query(f"{_AB} SELECT id, layer FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {_IN})", "rects")
def inside(spark, sf_dir):
    return spatial.inside(*_ab(spark, sf_dir)).select("id", "layer")


@query("SELECT id FROM rects r WHERE EXISTS (SELECT 1 FROM texts t WHERE t.label = 'Brand#11' AND t.x BETWEEN r.x0 AND r.x1 AND t.y BETWEEN r.y0 AND r.y1)", "rects", "texts")
def with_text(spark, sf_dir):
    return spatial.with_text(view(spark, sf_dir, "rects"), view(spark, sf_dir, "texts"), "Brand#11").select("id")


@query("SELECT id, x0 >= 5000 AND x1 <= 9000 AND y0 >= 5000 AND y1 <= 9000 AS whole FROM rects WHERE x0 <= 9000 AND x1 >= 5000 AND y0 <= 9000 AND y1 >= 5000", "rects")
def window_query(spark, sf_dir):
    r = spatial.query_window(view(spark, sf_dir, "rects"), 5000, 5000, 9000, 9000)
    return r.select("id", G.within([F.col(c) for c in BOX], [F.lit(v) for v in (5000, 5000, 9000, 9000)]).alias("whole"))


def _facing_sql(source: str, keys: str) -> str:
    one = lambda axis, x, y, p, q: f"""SELECT {keys}, '{axis}' AS axis, {q}.{x}0 - {p}.{x}1 AS dist, {f"{p}.x1" if x == "x" else "greatest(a.x0, b.x0)"} AS x0, {f"{p}.y1" if x == "y" else "greatest(a.y0, b.y0)"} AS y0,
        {f"{q}.x0" if x == "x" else "least(a.x1, b.x1)"} AS x1, {f"{q}.y0" if x == "y" else "least(a.y1, b.y1)"} AS y1 FROM {source} AND {q}.{x}0 > {p}.{x}1 AND {q}.{x}0 - {p}.{x}1 < 50 AND a.{y}0 < b.{y}1 AND b.{y}0 < a.{y}1"""  # noqa: E731
    return " UNION ALL ".join([one("h", "x", "y", "a", "b"), one("h", "x", "y", "b", "a"), one("v", "y", "x", "a", "b"), one("v", "y", "x", "b", "a")])


@query(_facing_sql("rects a JOIN rects b ON a.layer = b.layer AND a.id < b.id", "a.layer, a.id AS a_id, b.id AS b_id"), "rects")
def drc_space(spark, sf_dir):
    return drc.space(view(spark, sf_dir, "rects"), 50)


@query(_AB + _facing_sql("a JOIN b ON true", "a.id AS a_id, b.id AS b_id"), "rects")
def drc_separation(spark, sf_dir):
    return drc.separation(*_ab(spark, sf_dir), 50)


@query("SELECT id, 'h' AS axis, x1 - x0 AS dist FROM rects WHERE x1 - x0 BETWEEN 1 AND 39 UNION ALL SELECT id, 'v', y1 - y0 FROM rects WHERE y1 - y0 BETWEEN 1 AND 39", "rects")
def drc_width(spark, sf_dir):
    return drc.width(view(spark, sf_dir, "rects"), 40)


@query(
    _AB + " UNION ALL ".join(f"SELECT a.id AS a_id, b.id AS b_id, '{side}' AS side, {d} AS dist FROM a JOIN b ON {_OPEN} AND {d} > 0 AND {d} < 30" for side, d in (("left", "b.x0 - a.x0"), ("right", "a.x1 - b.x1"), ("bottom", "b.y0 - a.y0"), ("top", "a.y1 - b.y1"))),
    "rects",
)
def drc_enclosing(spark, sf_dir):
    return drc.enclosing(*_ab(spark, sf_dir), 30)


@query(
    _AB + " UNION ALL ".join(f"SELECT a.id AS a_id, b.id AS b_id, '{side}' AS side, least(a.{d}1, b.{d}1) - greatest(a.{d}0, b.{d}0) AS dist FROM a JOIN b ON {_OPEN} AND least(a.{d}1, b.{d}1) - greatest(a.{d}0, b.{d}0) < 20" for side, d in (("h", "x"), ("v", "y"))),
    "rects",
)
def drc_overlap(spark, sf_dir):
    return drc.overlap(*_ab(spark, sf_dir), 20)


@query("SELECT id FROM rects WHERE (x1 - x0) * (y1 - y0) < 2000", "rects")
def drc_area(spark, sf_dir):
    return drc.area_below(view(spark, sf_dir, "rects"), 2000).select("id")


@query(
    """WITH w AS (SELECT layer, x0, y0, x1, y1, unnest(range(x0 // 1000, (x1 - 1) // 1000 + 1)) AS wx FROM rects), v AS (SELECT *, unnest(range(y0 // 1000, (y1 - 1) // 1000 + 1)) AS wy FROM w),
    s AS (SELECT layer, wx, wy, CAST(sum((least(x1, (wx + 1) * 1000) - greatest(x0, wx * 1000)) * (least(y1, (wy + 1) * 1000) - greatest(y0, wy * 1000))) AS BIGINT) AS area FROM v GROUP BY ALL)
    SELECT *, area / 1000000.0::DOUBLE AS density FROM s WHERE area / 1000000.0::DOUBLE < 0.02 - 1e-10 OR area / 1000000.0::DOUBLE > 0.25 + 1e-10""",
    "rects",
)
def drc_density_window(spark, sf_dir):
    return drc.density_windows(view(spark, sf_dir, "rects"), 1000, 0.02, 0.25)


@query(
    "SELECT 'area' AS rule, count(*) AS violations FROM rects WHERE (x1 - x0) * (y1 - y0) < 2000 UNION ALL SELECT 'clean', 0 UNION ALL SELECT 'width', count(*) FILTER (x1 - x0 < 40) + count(*) FILTER (y1 - y0 < 40) FROM rects",
    "rects",
)
def drc_report(spark, sf_dir):
    r = view(spark, sf_dir, "rects")
    return drc.report({"area": drc.area_below(r, 2000), "width": drc.width(r, 40), "clean": drc.width(r, 0)})


# --- region algebra ------------------------------------------------------------------------------


def _area_sql(keep: str) -> str:
    """Area by layer group over unit slabs: x cuts, then covered y length by a window, without tiles."""
    return f"""WITH r AS (SELECT CAST(layer // 2 AS BIGINT) AS g, layer % 2 AS side, x0, y0, x1, y1 FROM rects),
    c AS (SELECT g, x, lead(x) OVER (PARTITION BY g ORDER BY x) AS nx FROM (SELECT DISTINCT g, unnest([x0, x1]) AS x FROM r)),
    s AS (SELECT r.g, c.x, c.nx, side, y0, y1 FROM c JOIN r ON r.g = c.g AND r.x0 <= c.x AND r.x1 >= c.nx WHERE c.nx IS NOT NULL),
    e AS (SELECT g, x, nx, y, sum(d) FILTER (side = 0) AS da, sum(d) FILTER (side = 1) AS db FROM (SELECT g, x, nx, side, y0 AS y, 1 AS d FROM s UNION ALL SELECT g, x, nx, side, y1, -1 FROM s) GROUP BY g, x, nx, y),
    w AS (SELECT *, lead(y) OVER o AS ny, coalesce(sum(da) OVER o, 0) AS a, coalesce(sum(db) OVER o, 0) AS b FROM e WINDOW o AS (PARTITION BY g, x ORDER BY y))
    SELECT CAST(g AS INTEGER) AS g, CAST(sum((nx - x) * (ny - y)) AS BIGINT) AS area FROM w WHERE ny IS NOT NULL AND ({keep}) GROUP BY g"""


def _two(spark, sf_dir):
    r = view(spark, sf_dir, "rects").withColumn("g", F.expr("cast(layer div 2 as int)"))
    return r.filter("layer % 2 = 0"), r.filter("layer % 2 = 1")


def _boolean(name: str, keep, sql: str):
    def run(spark, sf_dir):
        return region.area(region.boolean(*_two(spark, sf_dir), keep, ["g"]), ["g"])

    run.__name__ = name
    query(_area_sql(sql), "rects")(run)


_boolean("region_union", region.UNION, "a > 0 OR b > 0")
_boolean("region_intersection", region.INTERSECTION, "a > 0 AND b > 0")
_boolean("region_difference", region.DIFFERENCE, "a > 0 AND b <= 0")
_boolean("region_xor", region.XOR, "(a > 0) <> (b > 0)")


@query(_area_sql("a > 0").replace("SELECT CAST(layer // 2 AS BIGINT) AS g, layer % 2 AS side, x0, y0, x1, y1", "SELECT CAST(layer AS BIGINT) AS g, 0 AS side, x0 - 5 AS x0, y0 - 5 AS y0, x1 + 5 AS x1, y1 + 5 AS y1"), "rects")
def region_size(spark, sf_dir):
    r = view(spark, sf_dir, "rects").withColumn("g", F.col("layer"))
    return region.area(region.sized(r, 5, ["g"]), ["g"])


@query(
    _area_sql("a > 0 AND b <= 0").replace("x1, y1 FROM rects)", "x1, y1 FROM rects WHERE layer % 2 = 0 OR id % 3 = 0)").replace("SELECT CAST(g AS INTEGER) AS g,", "SELECT 'rule' || g AS rule,"),
    "rects",
)
def waivers(spark, sf_dir):
    a, b = (df.withColumn("rule", F.concat(F.lit("rule"), F.col("g").cast("string"))) for df in _two(spark, sf_dir))
    return region.area(region.waived(a, b.filter("id % 3 = 0")), ["rule"])


# --- connectivity --------------------------------------------------------------------------------


@query(
    f"""WITH RECURSIVE p AS (SELECT * FROM rects), l AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.layer = b.layer AND a.id <> b.id AND {_TOUCH}),
    r AS (SELECT id, id AS c FROM p UNION SELECT r.id, l.b FROM r JOIN l ON r.c = l.a) SELECT id, min(c) AS net FROM r GROUP BY id""",
    "rects",
)
def net_components(spark, sf_dir):
    return connect.nets(view(spark, sf_dir, "rects"))


@query("SELECT id, CAST(7 AS DOUBLE) * greatest(x1 - x0, y1 - y0) / greatest(least(x1 - x0, y1 - y0), 1) AS resistance, (x1 - x0) * (y1 - y0) * 3 + 2 * (x1 - x0 + y1 - y0) * 5 AS ground_cap FROM rects", "rects")
def pex_ground(spark, sf_dir):
    return connect.ground_parasitics(view(spark, sf_dir, "rects"), 7, 3, 5)


@query(
    f"SELECT layer, a_id, b_id, CAST(sum(CAST(floor((CASE axis WHEN 'h' THEN y1 - y0 ELSE x1 - x0 END) * 1000 / dist) AS BIGINT)) AS BIGINT) AS coupling FROM ({_facing_sql('rects a JOIN rects b ON a.layer = b.layer AND a.id < b.id', 'a.layer, a.id AS a_id, b.id AS b_id')}) GROUP BY ALL",
    "rects",
)
def pex_coupling(spark, sf_dir):
    return connect.coupling(view(spark, sf_dir, "rects"), 50)


@query(
    """SELECT a.layer, a.net AS a_net, b.net AS b_net, CAST(sum(least(a.hi, b.hi) - greatest(a.lo, b.lo)) AS BIGINT) AS parallel FROM segments a JOIN segments b
    ON a.layer = b.layer AND a.axis = b.axis AND a.net < b.net AND abs(a.at - b.at) BETWEEN 1 AND 20 AND least(a.hi, b.hi) > greatest(a.lo, b.lo) GROUP BY ALL HAVING sum(least(a.hi, b.hi) - greatest(a.lo, b.lo)) > 200""",
    "segments",
)
def crosstalk(spark, sf_dir):
    return connect.crosstalk(view(spark, sf_dir, "segments"), 20, 200)


@query(
    """SELECT net, seq, s.layer, current / (width * thickness) AS density FROM segments s JOIN (SELECT c_custkey AS net, CAST(c_custkey % 100 AS DOUBLE) AS current FROM customer) USING (net)
    JOIN (VALUES (0, 2.0::DOUBLE, 2.5::DOUBLE), (1, 3.0, 2.0), (2, 4.0, 1.5)) m(layer, thickness, lim) ON m.layer = s.layer WHERE current / (width * thickness) > lim""",
    "segments",
)
def em_check(spark, sf_dir):
    currents = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("net"), (F.col("c_custkey") % 100).cast("double").alias("current"))
    limits = spark.createDataFrame([(0, 2.0, 2.5), (1, 3.0, 2.0), (2, 4.0, 1.5)], "layer int, thickness double, limit double")
    return connect.electromigration(view(spark, sf_dir, "segments"), currents, limits)


@query(
    """WITH m AS (SELECT net, sum((hi - lo) * width) AS metal FROM segments GROUP BY net), g AS (SELECT c_custkey AS net, sum(c_custkey % 40) AS gate FROM customer GROUP BY c_custkey)
    SELECT net, CAST(metal AS DOUBLE) / CAST(gate AS DOUBLE) AS ratio FROM m JOIN g USING (net) WHERE gate > 0 AND CAST(metal AS DOUBLE) / CAST(gate AS DOUBLE) > 4000""",
    "segments",
)
def antenna_check(spark, sf_dir):
    metal = view(spark, sf_dir, "segments").select("net", ((F.col("hi") - F.col("lo")) * F.col("width")).alias("area"))
    gates = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("net"), (F.col("c_custkey") % 40).alias("area"))
    return connect.antenna(metal, gates, 4000.0)


@query(
    """WITH a AS (SELECT DISTINCT unnest([g, d, s]) AS net FROM layout_devices), b AS (SELECT DISTINCT unnest([g, d, s]) AS net FROM schematic_devices)
    SELECT coalesce(a.net, b.net) AS net, CASE WHEN a.net IS NOT NULL AND b.net IS NOT NULL THEN 'matched' WHEN a.net IS NOT NULL THEN 'layout_only' ELSE 'schematic_only' END AS state FROM a FULL JOIN b ON a.net = b.net""",
    "layout_devices",
    "schematic_devices",
)
def lvs_net_names(spark, sf_dir):
    return connect.compare_nets(view(spark, sf_dir, "layout_devices"), view(spark, sf_dir, "schematic_devices"))


@query(
    """WITH a AS (SELECT *, concat_ws('/', kind, array_to_string(list_sort([g, d, s]), ',')) AS sig FROM layout_devices), b AS (SELECT *, concat_ws('/', kind, array_to_string(list_sort([g, d, s]), ',')) AS sig FROM schematic_devices),
    l AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY name) AS r FROM a WHERE name NOT IN (SELECT name FROM b)), r AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY name) AS r FROM b WHERE name NOT IN (SELECT name FROM a))
    SELECT a.name AS layout_name, b.name AS schematic_name, 'name' AS how, abs(a.w - b.w) * 100 <= greatest(a.w, b.w) AS same_width FROM a JOIN b ON a.name = b.name
    UNION ALL SELECT l.name, r.name, CASE WHEN l.name IS NOT NULL AND r.name IS NOT NULL THEN 'structure' ELSE 'unmatched' END, abs(l.w - r.w) * 100 <= greatest(l.w, r.w) FROM l FULL JOIN r ON l.sig = r.sig AND l.r = r.r""",
    "layout_devices",
    "schematic_devices",
)
def lvs_device_match(spark, sf_dir):
    return connect.compare_devices(view(spark, sf_dir, "layout_devices"), view(spark, sf_dir, "schematic_devices"))


# --- hierarchy -----------------------------------------------------------------------------------


@query(
    """WITH RECURSIVE t AS (SELECT CAST(0 AS BIGINT) AS cell, 0 AS depth, 0 AS rot, false AS mirror, CAST(0 AS BIGINT) AS dx, CAST(0 AS BIGINT) AS dy UNION ALL
    SELECT child, depth + 1, (t.rot + CASE WHEN t.mirror THEN -i.rot ELSE i.rot END + 8) % 4, t.mirror <> i.mirror,
    t.dx + CASE t.rot WHEN 0 THEN i.dx WHEN 1 THEN -CASE WHEN t.mirror THEN -i.dy ELSE i.dy END WHEN 2 THEN -i.dx ELSE CASE WHEN t.mirror THEN -i.dy ELSE i.dy END END,
    t.dy + CASE t.rot WHEN 0 THEN CASE WHEN t.mirror THEN -i.dy ELSE i.dy END WHEN 1 THEN i.dx WHEN 2 THEN -CASE WHEN t.mirror THEN -i.dy ELSE i.dy END ELSE -i.dx END
    FROM t JOIN instances i ON i.parent = t.cell) SELECT * FROM t""",
    "instances",
)
def flatten_hierarchy(spark, sf_dir):
    return graph.flatten(view(spark, sf_dir, "instances"), 0)


@query("SELECT DISTINCT parent AS cell FROM instances WHERE parent NOT IN (SELECT child FROM instances)", "instances")
def top_cells(spark, sf_dir):
    i = view(spark, sf_dir, "instances")
    return i.select(F.col("parent").alias("cell")).distinct().join(i.select(F.col("child").alias("cell")), "cell", "left_anti")


@query("SELECT p_size AS size, p_brand AS brand, min(p_partkey) AS cell, count(*) AS copies FROM part GROUP BY ALL")
def cell_dedup(spark, sf_dir):
    """Cells of equal content are one, the first; the hash of the content is the key, its name is not part of it."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("hash", F.sha2(F.concat_ws("|", "p_size", "p_brand"), 256))
    return p.groupBy("hash").agg(F.first("p_size").alias("size"), F.first("p_brand").alias("brand"), F.min("p_partkey").alias("cell"), F.count("*").alias("copies")).drop("hash")


@query("SELECT layer AS old, CASE layer WHEN 1 THEN 10 WHEN 3 THEN 30 ELSE layer END AS layer, count(*) AS n FROM rects GROUP BY ALL", "rects")
def layer_map(spark, sf_dir):
    table = spark.createDataFrame([(1, 10), (3, 30)], "old int, new int")
    r = view(spark, sf_dir, "rects").withColumnRenamed("layer", "old").join(table, "old", "left")
    return r.groupBy("old", F.coalesce("new", "old").alias("layer")).agg(F.count("*").alias("n"))


# --- timing --------------------------------------------------------------------------------------


def _levels(start: str, step: str, combine: str = "max", back: bool = False, depth: int = 8) -> str:
    s, d = ("dst", "src") if back else ("src", "dst")
    out = [f"l0 AS ({start})"]
    out += [f"l{i + 1} AS (SELECT e.{d} AS node, {combine}({step}) AS value FROM l{i} JOIN t_edges e ON e.{s} = l{i}.node GROUP BY e.{d})" for i in range(depth)]
    return ", ".join(out) + f", v AS (SELECT node, CAST({combine}(value) AS BIGINT) AS value FROM ({' UNION ALL '.join(f'SELECT node, value FROM l{i}' for i in range(depth + 1))}) GROUP BY node)"


_SRC = "SELECT DISTINCT src AS node, 0 AS value FROM t_edges WHERE src NOT IN (SELECT dst FROM t_edges)"
_SNK = "SELECT DISTINCT dst AS node, 300 AS value FROM t_edges WHERE dst NOT IN (SELECT src FROM t_edges)"


def _edges(spark, sf_dir):
    from maskloom.plans.tables import materialize

    return materialize(view(spark, sf_dir, "t_edges"), "edges")


@query(f"WITH {_levels(_SRC, 'value + delay')} SELECT node, value FROM v", "t_edges")
def sta_arrival(spark, sf_dir):
    return timing.arrivals(_edges(spark, sf_dir))


@query(f"WITH {_levels(_SNK, 'value - delay', 'min', True)} SELECT node, value FROM v", "t_edges")
def sta_required(spark, sf_dir):
    return timing.required(_edges(spark, sf_dir), 300)


_SLACK = f"WITH a AS (WITH {_levels(_SRC, 'value + delay')} SELECT * FROM v), r AS (WITH {_levels(_SNK, 'value - delay', 'min', True)} SELECT * FROM v), s AS (SELECT node, a.value AS arrival, r.value AS required, r.value - a.value AS slack FROM a JOIN r USING (node))"


@query(f"{_SLACK} SELECT * FROM s", "t_edges")
def sta_slack(spark, sf_dir):
    return timing.slacks(_edges(spark, sf_dir), 300)


@query(f"{_SLACK} SELECT * FROM s ORDER BY slack, node LIMIT 20", "t_edges")
def worst_n(spark, sf_dir):
    return timing.worst(timing.slacks(_edges(spark, sf_dir), 300), 20)


@query(f"WITH {_levels(_SRC, 'value + delay', 'min')} SELECT node, value AS arrival, value - 40 AS slack FROM v WHERE value < 40", "t_edges")
def sta_hold(spark, sf_dir):
    return timing.hold_slacks(_edges(spark, sf_dir), 40)


@query(f"WITH {_levels(_SRC, chr(118) + 'alue + CASE WHEN kind = ' + chr(39) + 'cell' + chr(39) + ' THEN 1 ELSE 0 END')} SELECT e.edge_idx, CAST(v.value AS BIGINT) AS depth, CAST(round(delay * (CASE WHEN v.value >= 4 THEN 1.0 WHEN v.value >= 2 THEN 1.1 - (v.value - 2) * 0.05 WHEN v.value >= 1 THEN 1.2 - (v.value - 1) * 0.1 ELSE 1.2 END) * 1000) AS BIGINT) AS derated FROM t_edges e JOIN v ON v.node = e.dst", "t_edges")
def sta_aocv(spark, sf_dir):
    d = timing.derated(_edges(spark, sf_dir), [(1, 1.2), (2, 1.1), (4, 1.0)])
    return d.select("edge_idx", "depth", F.round(F.col("derated") * 1000).cast("bigint").alias("derated"))


@query(f"WITH {_levels(_SRC.replace('0 AS value', '{mean: 0::BIGINT, variance: 0::BIGINT} AS value'), '{mean: value.mean + delay, variance: value.variance + 9}').replace('CAST(max(value) AS BIGINT)', 'max(value)')} SELECT node, value.mean AS mean, value.variance AS variance FROM v", "t_edges")
def sta_pocv(spark, sf_dir):
    return timing.statistical(_edges(spark, sf_dir), 3)


@query(
    f"WITH {_levels(_SRC, 'value + delay')}, c(corner, factor) AS (VALUES ('fast', 8), ('slow', 12), ('typ', 10)) SELECT corner, CAST(max(value * factor) AS BIGINT) AS worst_arrival, CAST(min(3000 - value * factor) AS BIGINT) AS worst_slack FROM c, v WHERE node IN (SELECT node FROM ({_SNK})) GROUP BY corner",
    "t_edges",
)
def sta_corners(spark, sf_dir):
    return timing.corners(_edges(spark, sf_dir), {"typ": 10, "slow": 12, "fast": 8}, 3000)


@query("SELECT edge_idx, src, dst, 'd' || src % 3 AS src_domain, 'd' || dst % 3 AS dst_domain FROM t_edges WHERE src % 3 <> dst % 3", "t_edges")
def cdc(spark, sf_dir):
    e = view(spark, sf_dir, "t_edges")
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return timing.crossings(e, nodes.withColumn("domain", F.concat(F.lit("d"), (F.col("node") % 3).cast("string"))))


# --- placement and routing -----------------------------------------------------------------------


@query("SELECT net, count(*) AS pins, max(x) - min(x) + max(y) - min(y) AS hpwl FROM net_pins GROUP BY net HAVING count(*) >= 2", "net_pins")
def hpwl(spark, sf_dir):
    return place.half_perimeters(view(spark, sf_dir, "net_pins"))


@query("WITH h AS (SELECT net, count(*) AS pins, max(x) - min(x) + max(y) - min(y) AS hpwl FROM net_pins GROUP BY net HAVING count(*) >= 2) SELECT *, CAST(row_number() OVER (ORDER BY hpwl DESC, net) - 1 AS INTEGER) AS place FROM h", "net_pins")
def net_order(spark, sf_dir):
    return place.ranked(place.half_perimeters(view(spark, sf_dir, "net_pins")), "hpwl", True).withColumn("place", F.col("place").cast("int"))


@query("SELECT net, layer, count(*) AS wires, CAST(sum(hi - lo) AS BIGINT) AS length FROM segments GROUP BY GROUPING SETS ((net), (layer), ())", "segments")
def wire_metrics(spark, sf_dir):
    return place.wire_metrics(view(spark, sf_dir, "segments"))


@query(
    """WITH o AS (SELECT *, sum(w) OVER q - w AS before FROM placed WINDOW q AS (PARTITION BY site_row ORDER BY x, cell ROWS UNBOUNDED PRECEDING))
    SELECT cell, site_row, x, w, CAST(max(x - before) OVER (PARTITION BY site_row ORDER BY x, cell ROWS UNBOUNDED PRECEDING) + before AS BIGINT) AS legal_x FROM o""",
    "placed",
)
def legalize_rows(spark, sf_dir):
    return place.legalized(view(spark, sf_dir, "placed"))


_GAPS = "g AS (SELECT site_row, start, x - start AS length FROM (SELECT *, max(x + w) OVER (PARTITION BY site_row ORDER BY x, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start FROM placed) WHERE start < x)"


@query(f"WITH {_GAPS} SELECT * FROM g", "placed")
def row_gaps(spark, sf_dir):
    return place.gaps(view(spark, sf_dir, "placed"))


@query(f"WITH {_GAPS}, f AS (SELECT site_row, length // 8 AS n8, length % 8 // 3 AS n3, length % 8 % 3 AS n1 FROM g) SELECT site_row, CAST(unnest([8, 3, 1]) AS BIGINT) AS width, CAST(unnest([sum(n8), sum(n3), sum(n1)]) AS BIGINT) AS n FROM f GROUP BY site_row", "placed")
def gap_fill(spark, sf_dir):
    return place.filled(place.gaps(view(spark, sf_dir, "placed")), [1, 3, 8])


@query("WITH r AS (SELECT site_row, min(x) AS lo, max(x + w) AS hi FROM placed GROUP BY site_row) SELECT site_row, unnest(range(lo, hi + 1, 500)) AS x FROM r", "placed")
def tap_cells(spark, sf_dir):
    rows = view(spark, sf_dir, "placed").groupBy("site_row").agg(F.min("x").alias("lo"), F.max(F.col("x") + F.col("w")).alias("hi"))
    return place.taps(rows, 500)


@query(
    """WITH c AS (SELECT layer, axis, segments.at // 500 AS k, unnest(range(lo // 500, hi // 500 + 1)) AS c FROM segments), u AS (SELECT layer, axis, k, c, count(*) AS used FROM c GROUP BY ALL)
    SELECT layer, count(*) AS edges, CAST(sum(used) AS BIGINT) AS used, count(*) FILTER (used >= 4) AS saturated, max(greatest(used - 4, 0)) AS overflow, CAST(floor(sum(used) * 100 / (count(*) * 4)) AS BIGINT) AS mean_percent FROM u GROUP BY layer""",
    "segments",
)
def congestion_summary(spark, sf_dir):
    return place.congestion(view(spark, sf_dir, "segments"), 500, 4)


@query(
    """SELECT l_suppkey, l_quantity, l_extendedprice FROM (SELECT *, min(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
    FROM (SELECT DISTINCT l_suppkey, l_quantity, l_extendedprice FROM lineitem)) WHERE best IS NULL OR l_extendedprice < best"""
)
def pareto_prune(spark, sf_dir):
    return place.pareto(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_quantity", "l_extendedprice").distinct(), "l_suppkey", "l_quantity", "l_extendedprice")


@query("SELECT i, CASE WHEN i % 2 = 0 THEN 'VDD' ELSE 'VSS' END AS net, 100 + i * 250 AS x FROM range(40) t(i)")
def power_stripes(spark, sf_dir):
    return place.stripes(100, 0, 9999, 9999, 250, spark)


@query()
def spanning_trees(spark, sf_dir):
    return trees.spanning_lengths(view(spark, sf_dir, "net_pins"))


@query()
def global_placement(spark, sf_dir):
    return place.global_placed(view(spark, sf_dir, "net_pins"))


# --- corrections, fill, exceptions and kernels ---------------------------------------------------


@query(
    " UNION ALL ".join(f"SELECT id, '{s}' AS side, {x} - 6 AS x0, {y} - 6 AS y0, {x} + 6 AS x1, {y} + 6 AS y1 FROM rects" for s, x, y in (("ll", "x0", "y0"), ("lr", "x1", "y0"), ("ul", "x0", "y1"), ("ur", "x1", "y1"))),
    "rects",
)
def opc_serifs(spark, sf_dir):
    return correct.serifs(view(spark, sf_dir, "rects"), 12)


@query(
    "SELECT id, 'left' AS side, x0 - 8 AS x0, y0 - 8 AS y0, x0 AS x1, y1 + 8 AS y1 FROM rects WHERE (y1 - y0) * 2 <= 120 UNION ALL SELECT id, 'right', x1, y0 - 8, x1 + 8, y1 + 8 FROM rects WHERE (y1 - y0) * 2 <= 120 "
    "UNION ALL SELECT id, 'bottom', x0 - 8, y0 - 8, x1 + 8, y0 FROM rects WHERE (x1 - x0) * 2 <= 120 UNION ALL SELECT id, 'top', x0 - 8, y1, x1 + 8, y1 + 8 FROM rects WHERE (x1 - x0) * 2 <= 120",
    "rects",
)
def opc_hammerheads(spark, sf_dir):
    return correct.hammerheads(view(spark, sf_dir, "rects"), 40, 8)


@query(
    "SELECT id, 'left' AS side, x0 - 30 AS x0, y0, x0 - 20 AS x1, y1 FROM rects WHERE y1 - y0 >= 150 UNION ALL SELECT id, 'right', x1 + 20, y0, x1 + 30, y1 FROM rects WHERE y1 - y0 >= 150 "
    "UNION ALL SELECT id, 'bottom', x0, y0 - 30, x1, y0 - 20 FROM rects WHERE x1 - x0 >= 150 UNION ALL SELECT id, 'top', x0, y1 + 20, x1, y1 + 30 FROM rects WHERE x1 - x0 >= 150",
    "rects",
)
def opc_assist_bars(spark, sf_dir):
    return correct.assist_bars(view(spark, sf_dir, "rects"), 150, 20, 10)


_CORNERS = "c AS (SELECT id, layer, unnest([0, 1, 2, 3]) AS k, unnest([x0, x0, x1, x1]) AS x, unnest([y0, y1, y1, y0]) AS y FROM rects)"


@query(f"WITH {_CORNERS} SELECT a.id AS a_id, b.id AS b_id, a.k AS a_k, b.k AS b_k, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS squared FROM c a JOIN c b ON a.layer = b.layer AND a.id < b.id AND abs(a.x - b.x) < 60 AND abs(a.y - b.y) < 60 WHERE squared > 0 AND squared < 3600", "rects")
def lfd_near_corners(spark, sf_dir):
    return correct.near_corners(view(spark, sf_dir, "rects"), 60, ["layer"])


@query(
    """WITH f AS (SELECT min(x0) AS ox, min(y0) AS oy, (max(x1) - min(x0) - 60) // 100 + 1 AS nx, (max(y1) - min(y0) - 60) // 100 + 1 AS ny FROM rects),
    g AS (SELECT ox, oy, i, unnest(range(ny)) AS j FROM (SELECT *, unnest(range(nx)) AS i FROM f)), b AS (SELECT r.*, f.*, CAST(floor((x0 - 70 - ox) / 100.0) AS BIGINT) + 1 AS i0, CAST(ceil((x1 + 10 - ox) / 100.0) AS BIGINT) AS i1, CAST(floor((y0 - 70 - oy) / 100.0) AS BIGINT) + 1 AS j0, CAST(ceil((y1 + 10 - oy) / 100.0) AS BIGINT) AS j1 FROM rects r, f),
    k AS (SELECT DISTINCT i, j FROM (SELECT i, unnest(range(j0, j1)) AS j FROM (SELECT *, unnest(range(i0, i1)) AS i FROM b)))
    SELECT i, j, ox + i * 100 AS x0, oy + j * 100 AS y0, ox + i * 100 + 60 AS x1, oy + j * 100 + 60 AS y1 FROM g ANTI JOIN k USING (i, j)""",
    "rects",
)
def density_fill(spark, sf_dir):
    """The fill of the whole box of all shapes."""
    r = view(spark, sf_dir, "rects")
    return correct.fill(r, tuple(spatial.bounds(r).select(*BOX).first()), 60, 100, 10)


@query(
    "WITH v AS (SELECT id, x0 AS x, y0 AS y, 1 + id % 3 AS n FROM rects), a AS (SELECT *, unnest(range(n)) AS i FROM v), b AS (SELECT *, unnest(range(n)) AS j, ((n - 1) * 14 + 8) // 2 AS h FROM a) SELECT id, i, j, x - h + i * 14 AS x0, y - h + j * 14 AS y0, x - h + i * 14 + 8 AS x1, y - h + j * 14 + 8 AS y1 FROM b",
    "rects",
)
def via_arrays(spark, sf_dir):
    v = view(spark, sf_dir, "rects").select("id", F.col("x0").alias("x"), F.col("y0").alias("y"), (1 + F.col("id") % 3).alias("n"))
    return correct.via_cuts(v, 8, 14)


_EXC = "SELECT node, CASE WHEN node % 5 = 0 THEN 'false' WHEN node % 5 = 1 THEN 'multicycle' ELSE 'max_delay' END AS rule, CASE WHEN node % 5 = 1 THEN 2 ELSE 250 END AS value"


@query(f"{_SLACK}, x AS ({_EXC} FROM s WHERE node % 5 <= 2) SELECT s.node, CASE WHEN x.rule IS NULL THEN s.slack WHEN x.rule = 'multicycle' THEN x.value * 300 - arrival WHEN x.rule = 'max_delay' THEN x.value - arrival END AS slack, x.rule FROM s LEFT JOIN x USING (node)", "t_edges")
def sta_exceptions(spark, sf_dir):
    s = timing.slacks(_edges(spark, sf_dir), 300)
    first = s.filter("node % 5 <= 2").select(F.lit(1).alias("seq"), "node", F.lit("max_delay").alias("rule"), F.lit(1).alias("value"))
    second = s.filter("node % 5 <= 2").selectExpr("2 as seq", "node", "case when node % 5 = 0 then 'false' when node % 5 = 1 then 'multicycle' else 'max_delay' end as rule", "case when node % 5 = 1 then 2 else 250 end as value")
    return timing.excepted(s, first.unionAll(second), 300)


@query(
    f"""WITH {_levels("SELECT src AS node, 0 AS value FROM t_edges WHERE src = 1007", "value + delay")}, RECURSIVEMARK p AS (SELECT DISTINCT src AS launch, dst AS capture FROM t_edges),
    e AS (SELECT launch AS n FROM p UNION SELECT capture FROM p), u0 AS (SELECT n, n AS up FROM e), {", ".join(f"u{i + 1} AS (SELECT DISTINCT n, src AS up FROM u{i} JOIN t_edges ON dst = up)" for i in range(8))},
    u AS (SELECT DISTINCT n, up, value FROM ({" UNION ALL ".join(f"SELECT * FROM u{i}" for i in range(9))}) JOIN v ON node = up)
    SELECT p.launch, p.capture, CAST(coalesce(max(a.value) FILTER (b.up IS NOT NULL), 0) AS BIGINT) AS common FROM p LEFT JOIN u a ON a.n = p.launch LEFT JOIN u b ON b.n = p.capture AND b.up = a.up GROUP BY ALL""".replace("RECURSIVEMARK ", ""),
    "t_edges",
)
def sta_common_clock(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return timing.common_clock(e, 1007, e.select(F.col("src").alias("launch"), F.col("dst").alias("capture")).distinct())


@query(
    """WITH s AS (SELECT CAST(user_id AS BIGINT) AS key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS t, abs(value) AS i FROM events WHERE value IS NOT NULL),
    d AS (SELECT *, coalesce((i + lag(i) OVER w) / 2 * (t - lag(t) OVER w), 0) AS dv FROM s WINDOW w AS (PARTITION BY key ORDER BY t)), v AS (SELECT *, sum(dv) OVER (PARTITION BY key ORDER BY t) / 4.0 AS v FROM d),
    c AS (SELECT *, lag(v) OVER w AS pv, lag(t) OVER w AS pt FROM v WINDOW w AS (PARTITION BY key ORDER BY t))
    SELECT key, CAST(round(1000 * coalesce(min(CASE WHEN pv < 20.0 AND v >= 20.0 THEN pt + (20.0 - pv) / (v - pv) * (t - pt) END), 0)) AS BIGINT) AS delay FROM c GROUP BY key"""
)
def ccs_delay(spark, sf_dir):
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("value is not null")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("double")
    waves = e.select(F.col("user_id").cast("bigint").alias("key"), t.alias("t"), F.abs("value").alias("i"))
    return timing.half_crossing(waves, 4.0, 40.0).withColumn("delay", F.round(F.col("delay") * 1000).cast("bigint"))


@query()
def steiner_trees(spark, sf_dir):
    return trees.steiner_lengths(view(spark, sf_dir, "net_pins"))


@query()
def clock_trees(spark, sf_dir):
    return trees.clock_trees(view(spark, sf_dir, "net_pins"))


@query()
def negotiated_routes(spark, sf_dir):
    p = view(spark, sf_dir, "net_pins").select((F.col("net") % 64).alias("region"), F.col("pin").alias("net"), (F.col("x") % 24).alias("sx"), (F.col("y") % 24).alias("sy"), (F.col("pin") * 7 % 24).alias("tx"), (F.col("pin") * 11 % 24).alias("ty"))
    return kernels.region_routes(p, 24, 12)


for part in (queries_io, queries_polygons, queries_routing):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
