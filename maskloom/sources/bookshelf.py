"""Bookshelf placements: the files of an .aux manifest as tables of cells, pins and rows. Spark expressions only.

Files of nets and rows are split at their own record words, so that a large file is read by many tasks.
Numbers must be whole; anything else fails the query with Spark's cast error.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ENDINGS = ("nodes", "nets", "pl", "scl")


def _words(df: DataFrame, column: str = "value") -> DataFrame:
    """Lines without comments, as words `w`; empty lines and the banner go."""
    line = F.trim(F.regexp_replace(F.regexp_replace(column, "#.*", ""), r"\s+", " "))
    return df.withColumn("line", line).filter((F.col("line") != "") & ~F.upper("line").startswith("UCLA")).withColumn("w", F.split("line", " ")).drop(column)


def _whole(i: int, name: str):
    return F.coalesce(F.get("w", F.lit(i)).cast("bigint"), F.lit(0)).alias(name)


def read_aux(spark: SparkSession, path: str) -> dict[str, str]:
    """The paths of a manifest's files by ending; the manifest is a line or two."""
    listed = _words(spark.read.text(path)).select(F.explode(F.split(F.element_at(F.split("line", ":"), -1), " ")).alias("f"))
    found = {}
    for row in listed.filter(F.col("f").rlike(rf"\.({'|'.join(_ENDINGS)})$")).collect():
        found[row.f.rsplit(".", 1)[1]] = posixpath.join(posixpath.dirname(path), row.f)
    return found


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(name, width, height, fixed); terminals are fixed. Lines with a colon are counts."""
    lines = _words(spark.read.text(path)).filter(~F.col("line").contains(":"))
    return lines.select(F.col("w")[0].alias("name"), _whole(1, "width"), _whole(2, "height"), F.exists("w", lambda v: F.lower(v).isin("terminal", "fixed")).alias("fixed"))


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """(name, x, y, fixed, seq); seq orders the lines as in the file."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("seq"))
    return _words(lines).select("seq", F.col("w")[0].alias("name"), _whole(1, "x"), _whole(2, "y"), F.exists("w", lambda v: F.lower(v).isin("/fixed", "fixed")).alias("fixed"))


def read_nets(spark: SparkSession, path: str) -> DataFrame:
    """(net, seq, cell): the pins of nets as listed. A net without a name is net_<its number in the file, from 0>.

    Numbers come from each block's count of nets, a table of one row for each split of the file.
    """
    records = spark.read.text(path, lineSep="NetDegree").select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = records.groupBy("block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("block", (before - F.col("first") - 1).alias("shift"))
    nets = records.join(F.broadcast(blocks), "block").withColumn("number", F.col("id") + F.col("shift")).filter("number >= 0")
    head = F.split(F.trim(F.regexp_replace(F.substring_index("value", "\n", 1), "#.*", "")), r"\s+")
    nets = nets.select(F.coalesce(F.get(head, F.lit(2)), F.concat(F.lit("net_"), "number")).alias("net"), F.posexplode(F.slice(F.split("value", "\n"), 2, 1 << 30)).alias("seq", "value"))
    return _words(nets).select("net", "seq", F.col("w")[0].alias("cell"))


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, site_width, num_sites, height) of core rows that have all five."""
    text = F.regexp_replace(F.split("value", r"(?im)^\s*end")[0], "#[^\n]*", "")
    keys = {"x": "SubrowOrigin", "y": "Coordinate", "site_width": "Sitewidth", "num_sites": "NumSites", "height": "Height"}
    rows = spark.read.text(path, lineSep="CoreRow").select(*[F.regexp_extract(text, rf"(?i)\b{word}\s*:?\s*(-?[0-9]+)", 1).alias(name) for name, word in keys.items()])
    return rows.filter(F.forall(F.array(*keys), lambda v: v != "")).select(*[F.col(name).cast("bigint") for name in keys])


def read_bookshelf(spark: SparkSession, aux: str) -> dict[str, DataFrame]:
    """cells (name, width, height, x, y, fixed), pins (net, seq, cell) and rows of a design; files that the manifest lacks
    give no table. Cells without a place are at the origin, those with several at the last. A net keeps each of its known cells once, and needs two."""
    files, out = read_aux(spark, aux), {}
    if "scl" in files:
        out["rows"] = read_rows(spark, files["scl"])
    if "nodes" in files:
        cells = read_nodes(spark, files["nodes"])
        if "pl" in files:
            places = read_places(spark, files["pl"]).groupBy("name").agg(F.max_by(F.struct("x", "y"), "seq").alias("at"), F.max("fixed").alias("held"))
            cells = cells.join(places, "name", "left").select("name", "width", "height", F.coalesce("at.x", F.lit(0)).alias("x"), F.coalesce("at.y", F.lit(0)).alias("y"), (F.col("fixed") | F.coalesce("held", F.lit(False))).alias("fixed"))
        else:
            cells = cells.select("name", "width", "height", F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), "fixed")
        out["cells"] = cells
        if "nets" in files:
            pins = read_nets(spark, files["nets"]).join(cells.select(F.col("name").alias("cell")), "cell", "left_semi").groupBy("net", "cell").agg(F.min("seq").alias("seq"))
            out["pins"] = pins.withColumn("n", F.count("*").over(Window.partitionBy("net"))).filter("n > 1").select("net", "seq", "cell")
    return out
