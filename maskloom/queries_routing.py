"""Queries over routed nets, cell edits, table texts and layer maps, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.functions import geometry as G
from maskloom.operators import connect, place, polygons, routing, timing
from maskloom.plans.views import view, with_views
from maskloom.queries_polygons import _EDGES
from maskloom.sources import netlists

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


@query(
    """WITH s AS (SELECT net, seq AS pos, layer, CASE WHEN seq % 8 = 0 THEN layer + 1 WHEN seq % 8 = 4 THEN layer - 1 END AS to_layer, hi - lo AS length FROM segments),
    u AS (SELECT net, layer, min(pos) AS shield FROM s WHERE to_layer > layer GROUP BY ALL), r(layer, width, lim) AS (VALUES (0, 2, 400.0::DOUBLE), (1, 3, 600.0), (2, 4, 800.0)),
    m AS (SELECT s.net, s.layer, CAST(sum(length) * any_value(width) AS DOUBLE) AS area, any_value(lim) AS lim FROM s JOIN r USING (layer) LEFT JOIN u ON u.net = s.net AND u.layer = s.layer WHERE to_layer IS NULL AND (shield IS NULL OR pos < shield) GROUP BY ALL),
    g AS (SELECT net, pin AS gate, pin % 3 AS own, CAST(pin % 7 AS DOUBLE) AS gate_area FROM net_pins)
    SELECT m.net, gate, CAST(m.layer AS INTEGER) AS layer, m.area, gate_area, CAST(floor(m.area / gate_area * 1000) AS BIGINT) AS thousandths FROM m JOIN g USING (net) WHERE m.layer >= own AND gate_area > 0 AND m.area / gate_area > lim""",
    "segments", "net_pins",
)
def gate_antennas(spark, sf_dir):
    """Antenna ratios by gate and layer, where a via up shields the wires behind it."""
    via = F.when(F.col("seq") % 8 == 0, F.col("layer") + 1).when(F.col("seq") % 8 == 4, F.col("layer") - 1)
    s = view(spark, sf_dir, "segments").select("net", F.col("seq").alias("pos"), "layer", via.alias("to_layer"), (F.col("hi") - F.col("lo")).alias("length"))
    g = view(spark, sf_dir, "net_pins").select("net", F.col("pin").alias("gate"), (F.col("pin") % 3).alias("layer"), (F.col("pin") % 7).alias("area"))
    rules = spark.createDataFrame([(0, 2, 400.0), (1, 3, 600.0), (2, 4, 800.0)], "layer int, width int, limit double")
    out = routing.gate_antennas(s, g, rules)
    return out.withColumn("thousandths", F.floor(F.col("ratio") * 1000).cast("bigint")).drop("ratio")


_GRID = "CASE WHEN {v} >= {o} THEN {o} + ({v} - {o} + {p} // 2) // {p} * {p} ELSE {o} - ({o} - {v} + {p} // 2) // {p} * {p} END"


@query(
    "WITH g(layer, xo, xp, yo, yp) AS (VALUES (0, 15, 700, 3, 20), (1, 10000, 301, 0, 1)), w AS (SELECT seq, s.layer, lo, hi, s.at, xo, xp, yo, yp FROM segments s LEFT JOIN g ON g.layer = s.layer), "
    f"t AS (SELECT seq, layer, coalesce({_GRID.format(v='lo', o='xo', p='xp')}, lo) AS ax, coalesce({_GRID.format(v='hi', o='xo', p='xp')}, hi) AS bx, coalesce({_GRID.format(v='w.at', o='yo', p='yp')}, w.at) AS y FROM w) "
    "SELECT seq, layer, CAST(ax AS BIGINT) AS ax, CAST(bx AS BIGINT) AS bx, CAST(y AS BIGINT) AS y FROM t WHERE ax <> bx",
    "segments",
)
def wires_on_tracks(spark, sf_dir):
    """Wires on the tracks of their layer, one layer without tracks; wires shorter than a track go."""
    at = lambda c: F.struct(F.col(c).alias("x"), F.col("at").alias("y"))
    w = view(spark, sf_dir, "segments").select("seq", "layer", F.array(at("lo"), at("hi")).alias("points"))
    grids = spark.createDataFrame([(0, 15, 700, 3, 20), (1, 10000, 301, 0, 1)], "layer int, x_origin bigint, x_pitch bigint, y_origin bigint, y_pitch bigint")
    p = F.col("points")
    return routing.on_tracks(w, grids).select("seq", "layer", p[0]["x"].alias("ax"), p[1]["x"].alias("bx"), p[0]["y"].alias("y"))


_JOGS = """m AS (SELECT layer, unnest([(x0 + x1) // 2, (x0 + x1) // 2, x0, x1]) AS x, unnest([y0, y1, (y0 + y1) // 2, (y0 + y1) // 2]) AS y, unnest([x1 - x0, x1 - x0, y1 - y0, y1 - y0]) AS n FROM rects),
q AS (SELECT layer AS g, x - 15 AS x0, y - 15 AS y0, x + 15 AS x1, y + 15 AS y1 FROM m WHERE n < 31)"""


@query(f"{_EDGES.replace('WITH r AS (SELECT layer AS g, x0, y0, x1, y1 FROM rects)', f'WITH {_JOGS}, r AS (SELECT * FROM q)')} SELECT layer, axis, pos AS \"at\", lo, hi, side FROM ed", "rects")
def small_jogs(spark, sf_dir):
    """The borders of the merged marks at edges shorter than 31, by layer."""
    r = view(spark, sf_dir, "rects")
    jogs = routing.small_jogs(r.select("layer", G.box_polygon(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("points")), 31, ["layer"])
    return polygons.edges(jogs, ["layer"]).withColumnRenamed("inner", "side")


@query(
    """WITH s AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'box' WHEN id % 3 = 1 THEN 'polygon' ELSE 'text' END AS kind FROM rects)
    SELECT id, kind, CASE WHEN kind = 'box' THEN greatest(x0, 3000) ELSE x0 END AS x0, CASE WHEN kind = 'box' THEN greatest(y0, 2000) ELSE y0 END AS y0, CASE WHEN kind = 'box' THEN least(x1, 15000) ELSE x1 END AS x1, CASE WHEN kind = 'box' THEN least(y1, 16000) ELSE y1 END AS y1
    FROM s WHERE CASE WHEN kind = 'text' THEN x0 BETWEEN 3000 AND 15000 AND y0 BETWEEN 2000 AND 16000 ELSE x0 <= 15000 AND x1 >= 3000 AND y0 <= 16000 AND y1 >= 2000 END""",
    "rects",
)
def clip_shapes(spark, sf_dir):
    kind = F.when(F.col("id") % 3 == 0, "box").when(F.col("id") % 3 == 1, "polygon").otherwise("text")
    return routing.clipped_shapes(view(spark, sf_dir, "rects").withColumn("kind", kind), (3000, 2000, 15000, 16000)).drop("layer")


@query("SELECT parent, CASE WHEN child % 5 = 0 THEN 7 ELSE child END AS child, rot, dx, dy FROM instances WHERE dx BETWEEN 100 AND 800 AND dy BETWEEN 50 AND 900", "instances")
def clip_and_replace_instances(spark, sf_dir):
    i = routing.clipped_instances(view(spark, sf_dir, "instances"), (100, 50, 800, 900))
    return routing.replaced_instances(i, F.col("child") % 5 == 0, 7).drop("mirror")


@query("SELECT id, CASE id % 6 WHEN 0 THEN '' WHEN 1 THEN 'wrong_winding' WHEN 2 THEN 'duplicate_vertex' WHEN 3 THEN 'zero_area' WHEN 4 THEN 'self_intersecting,wrong_winding' ELSE 'zero_area' END AS issues FROM rects", "rects")
def polygon_issues(spark, sf_dir):
    """Faults of rings: turned the wrong way, with a repeated vertex, flat, crossing itself, and of two points."""
    ring = lambda *at: F.array(*[F.struct((F.col("x0") + x).alias("x"), (F.col("y0") + y).alias("y")) for x, y in at])
    rings = [((0, 0), (0, 9), (9, 9), (9, 0)), ((0, 0), (9, 0), (9, 9), (0, 9)), ((0, 0), (0, 9), (0, 9), (9, 9), (9, 0)), ((0, 0), (9, 9), (4, 4)), ((0, 0), (10, 0), (10, 10), (5, 10), (5, -5), (0, -5)), ((0, 0), (9, 9))]
    points = F.coalesce(*[F.when(F.col("id") % 6 == k, ring(*at)) for k, at in enumerate(rings)])
    return view(spark, sf_dir, "rects").select("id", F.array_join(G.polygon_issues(points), ",").alias("issues"))


@query(
    """WITH q AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS n, CAST(p_partkey % 90 AS DOUBLE) AS slew, CAST(p_partkey % 17 AS DOUBLE) AS load FROM part),
    f AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (slew - 1) / n)) AS f, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (load - 2.5) / 7.5)) AS g FROM q)
    SELECT id, CAST(round(1000 * ((0.5 * (1 - g) + 1.25 * g) * (1 - f) + ((n + 1) * (1 - g) + 300.0 * g) * f)) AS BIGINT) AS delay FROM f"""
)
def liberty_tables(spark, sf_dir):
    """Delays from the texts of timing tables, one each part, at its slew and load."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a small file is one task, its texts are much work
    text = F.format_string('{ index_1 ("1, %d");\n index_2 ("2.5, 10"); values ( "0.5, 1.25", \\\n "%d, 3.0e2" ); }', (F.col("p_size") + 1).cast("bigint"), (F.col("p_size") + 1).cast("bigint"))
    at = G.table_at(text, (F.col("p_partkey") % 90).cast("double"), (F.col("p_partkey") % 17).cast("double"))
    return p.select(F.col("p_partkey").alias("id"), F.round(at * 1000).cast("bigint").alias("delay"))


_NETS = "h AS (SELECT net, count(*) AS pins, max(x) - min(x) + max(y) - min(y) AS hpwl FROM net_pins GROUP BY net HAVING count(*) >= 2)"


@query(f"WITH {_NETS} SELECT net, pins, row_number() OVER (ORDER BY pins DESC, net) - 1 AS place FROM h", "net_pins")
def net_order_fanout(spark, sf_dir):
    return place.ranked(place.half_perimeters(view(spark, sf_dir, "net_pins")).select("net", "pins"), "pins", True)


@query(f"WITH {_NETS} SELECT net, CASE WHEN net % 3 = 0 THEN CAST(net % 11 AS DOUBLE) ELSE 0.0::DOUBLE END AS weight, row_number() OVER (ORDER BY weight DESC, net) - 1 AS place FROM h", "net_pins")
def net_order_criticality(spark, sf_dir):
    """Nets in the order of given weights; those without one weigh nothing."""
    nets = place.half_perimeters(view(spark, sf_dir, "net_pins")).select("net")
    weights = nets.filter("net % 3 = 0").select("net", (F.col("net") % 11).cast("double").alias("weight"))
    return place.ranked(nets.join(weights, "net", "left").fillna(0.0, ["weight"]), "weight", True)


@query("SELECT edge_idx, CAST(delay AS DOUBLE) * 0.75 AS delay FROM t_edges", "t_edges")
def sta_early_corner(spark, sf_dir):
    return timing.at_corner(view(spark, sf_dir, "t_edges"), 1.5, 0.5).select("edge_idx", "delay")


@query(
    """WITH e AS (SELECT row_number() OVER (ORDER BY p_brand) AS line, p_brand AS name, 'drawing' AS purpose, row_number() OVER (ORDER BY p_brand) * 7 AS layer, 0 AS datatype FROM (SELECT DISTINCT p_brand FROM part)), w AS (SELECT CAST(greatest(max(length(name)), 4) AS INTEGER) AS w FROM e)
    SELECT rpad(name, w, ' ') || ' ' || purpose || ' ' || lpad(CAST(layer AS VARCHAR), CAST(greatest(length(CAST(layer AS VARCHAR)), 3) AS INTEGER), ' ') || '   0' AS value FROM e, w UNION ALL SELECT '# name  purpose  layer  datatype'"""
)
def layer_map_lines(spark, sf_dir):
    """The lines of a layer map of all brands."""
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("net")).distinct()
    e = place.ranked(brands.withColumn("k", F.lit(0)), "k").select((F.col("place") + 1).alias("line"), F.col("net").alias("name"), F.lit("drawing").alias("purpose"), ((F.col("place") + 1) * 7).alias("layer"), F.lit(0).alias("datatype"))
    return netlists.write_layermap(e)


@query(
    """WITH p AS (SELECT a.layer, a.axis, a.seq AS a_seq, b.seq AS b_seq, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi, (a.at + b.at) // 2 AS m FROM segments a JOIN segments b
    ON a.layer = b.layer AND a.axis = b.axis AND a.net < b.net AND abs(a.at - b.at) BETWEEN 1 AND 20 AND least(a.hi, b.hi) - greatest(a.lo, b.lo) > 200), q AS (SELECT *, (lo + hi) // 2 AS c, (hi - lo) // 2 AS n FROM p)
    SELECT layer, a_seq, b_seq, CASE WHEN axis = 'h' THEN c ELSE m END - n AS x0, CASE WHEN axis = 'h' THEN c ELSE m END + n AS x1, CASE WHEN axis = 'h' THEN m ELSE c END AS y FROM q""",
    "segments",
)
def shields(spark, sf_dir):
    """Shield marks between wires that run along each other for more than 200."""
    return connect.shields(connect.parallel_wires(view(spark, sf_dir, "segments"), 20), 200)
