"""Round trips through the file formats: tables are written as a format's bytes or text and read back by its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.plans.tables import materialize
from maskloom.plans.views import view, with_views
from maskloom.sources import layout, markup, netlists

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def _elements(rects, scale: int = 1):
    point = lambda x, y: F.struct((F.col(x) * scale).alias("x"), (F.col(y) * scale).alias("y"))
    null = lambda *names: [F.lit(None).cast("bigint").alias(n) for n in names]
    return rects.select(
        F.concat(F.lit("C"), F.col("id") % 16).alias("cell"), F.col("id").alias("seq"), F.lit("box").alias("kind"), "layer", F.lit(0).alias("datatype"), F.array(point("x0", "y0"), point("x1", "y1")).alias("points"),
        F.concat(F.lit("metal"), F.col("layer")).alias("text"), F.lit(None).cast("string").alias("child"), F.lit(False).alias("mirror"), *null("width", "rot", "cols", "rows", "col_x", "col_y", "row_x", "row_y"),
    )


_BOXES = "SELECT concat('C', id % 16) AS cell, layer, x0, y0, x1, y1 FROM rects"


def _back(files, fmt: str, scale: int = 1):
    s = layout.shapes(layout.parse(files, fmt))
    return s.select("cell", "layer", *[(F.col(c) / scale).cast("bigint").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(_BOXES, "rects")
def gds_round_trip(spark, sf_dir):
    return _back(layout.cell_files(_elements(view(spark, sf_dir, "rects")), "gds"), "gds")


@query(_BOXES, "rects")
def oasis_round_trip(spark, sf_dir):
    return _back(layout.cell_files(_elements(view(spark, sf_dir, "rects")), "oas"), "oas")


@query(_BOXES, "rects")
def cif_round_trip(spark, sf_dir):
    return _back(layout.cell_files(_elements(view(spark, sf_dir, "rects"), 20), "cif"), "cif", 20)


@query("SELECT concat('C', id % 16) AS cell, concat('metal', layer) AS text, x0, y0, x1, y1 FROM rects", "rects")
def mag_round_trip(spark, sf_dir):
    s = layout.shapes(layout.parse(layout.cell_files(_elements(view(spark, sf_dir, "rects"), 1000), "mag"), "mag"))
    return s.select("cell", "text", *[(F.col(c) / 1000).cast("bigint").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("SELECT concat('n', net) AS net, CAST(count(*) AS DOUBLE) AS total_cap, CAST(net % 7 AS DOUBLE) AS resistance, count(*) AS pins, min('P' || pin || ':A') AS first_pin FROM net_pins GROUP BY net", "net_pins")
def spef_round_trip(spark, sf_dir):
    nets = view(spark, sf_dir, "net_pins").groupBy("net").agg(F.count("*").cast("double").alias("total_cap"), F.collect_list(F.concat(F.lit("P"), F.col("pin"), F.lit(":A"))).alias("connections"))
    nets = nets.select(F.concat(F.lit("n"), F.col("net")).alias("net"), "total_cap", (F.col("net") % 7).cast("double").alias("resistance"), "connections", (F.col("net") % 8).alias("part"))
    back = netlists.read_spef(materialize(netlists.write_spef(nets, "top", "part"), "files"))
    return back.select("net", "total_cap", "resistance", F.size("connections").cast("bigint").alias("pins"), F.array_min("connections").alias("first_pin"))


@query("SELECT concat('U', cell) AS name, concat('W', w) AS master, x, CAST(site_row * 1400 AS BIGINT) AS y, CASE WHEN site_row % 2 = 0 THEN 'N' ELSE 'FS' END AS orient FROM placed", "placed")
def def_round_trip(spark, sf_dir):
    p = view(spark, sf_dir, "placed")
    parts = p.select(F.concat(F.lit("U"), F.col("cell")).alias("name"), F.concat(F.lit("W"), F.col("w")).alias("master"), "x", (F.col("site_row") * 1400).cast("bigint").alias("y"), F.when(F.col("site_row") % 2 == 0, "N").otherwise("FS").alias("orient"))
    return netlists.read_def(netlists.write_def(parts, "top")).filter("kind = 'component'").select("name", "master", "x", "y", "orient")


@query("SELECT concat('rule', layer) AS rule, concat('  <item>\n   <tags></tags>\n   <category>rule', layer, '</category>\n   <cell>top</cell>\n   <visited>false</visited>\n   <multiplicity>1</multiplicity>\n   <values>\n    <value>polygon: (', x0, ',', y0, ';', x0, ',', y1, ';', x1, ',', y1, ';', x1, ',', y0, ')</value>\n   </values>\n  </item>\n') AS value FROM rects", "rects")
def report_items(spark, sf_dir):
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    r = view(spark, sf_dir, "rects").select(F.concat(F.lit("rule"), "layer").alias("rule"), F.array(point("x0", "y0"), point("x0", "y1"), point("x1", "y1"), point("x1", "y0")).alias("points"))
    return markup.report_items(r, "top")


@query("SELECT p_brand AS path, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INT) AS seq, p_name AS name, concat(p_partkey % 256, '/', p_size, '@1') AS source, CAST(p_size AS INT) AS width, p_size % 2 = 0 AS visible FROM part")
def layer_properties_round_trip(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    given = {"path": F.col("p_brand"), "seq": F.col("p_partkey"), "name": F.col("p_name"), "source": F.concat(F.col("p_partkey") % 256, F.lit("/"), "p_size", F.lit("@1")), "width": F.col("p_size"), "visible": F.col("p_size") % 2 == 0}
    layers = part.select(*[given.get(c, F.lit(markup.TAGS.get(t))).alias(c) for t, c in {"path": "path", "seq": "seq", **markup.COLUMNS}.items()])
    return markup.read_layer_properties(markup.write_layer_properties(layers)).select("path", "seq", "name", "source", "width", "visible")


@query("SELECT concat('*  ', CASE WHEN net < 3 THEN 'pin' ELSE 'net' END, ' n', net, ': bbox=[', min(x), ',', min(y), ' ', max(x), ',', max(y), '], ', count(*), ' shapes') AS value FROM net_pins GROUP BY net UNION ALL SELECT unnest(['* CDL netlist', '.SUBCKT top n0 n1 n2', '* devices: (none)', '.ENDS top'])", "net_pins")
def cdl_lines(spark, sf_dir):
    nets = view(spark, sf_dir, "net_pins").groupBy("net").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("shapes"))
    return netlists.write_cdl(nets.withColumn("net", F.concat(F.lit("n"), "net")), "top", ["n0", "n1", "n2"])
