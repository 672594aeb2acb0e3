"""Markup files: layer properties, technologies and reports of violations, as tables and back."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.sources.netlists import _rows

# Tags of a layer's properties, in the order in which they are written, with the value where one is missing.
TAGS = {
    "frame-color": "", "fill-color": "", "frame-brightness": 0, "fill-brightness": 0, "dither-pattern": 0, "line-style": 0, "valid": True, "visible": True,
    "transparent": False, "width": 1, "marked": False, "xfill": False, "animation": 0, "name": "", "source": "",
}
_TYPES = {str: "string", int: "int", bool: "boolean"}
COLUMNS = {t: t.replace("-", "_") for t in TAGS}
LAYERS = "path string, seq int, " + ", ".join(f"{COLUMNS[t]} {_TYPES[type(v)]}" for t, v in TAGS.items())
TECHNOLOGY = "path string, name string, description string, dbu double, default_grids string"


def _root(text: str) -> ET.Element:
    try:
        return ET.fromstring(text)
    except ET.ParseError as e:
        raise ValueError(str(e)) from e


def _value(text: str | None, missing):
    """A text, number or flag; what is no number or flag counts as missing."""
    text = (text or "").strip()
    if isinstance(missing, bool):
        return {"true": True, "false": False}.get(text.lower(), missing)
    if isinstance(missing, int):
        try:
            return int(text)
        except ValueError:
            return missing
    return text or missing


def parse_layer_properties(text: str) -> Iterator[dict]:
    for seq, layer in enumerate(_root(text).iter("properties")):
        yield {"seq": seq} | {COLUMNS[t]: _value(layer.findtext(t), missing) for t, missing in TAGS.items()}


def parse_technology(text: str) -> Iterator[dict]:
    root = _root(text)
    dbu = root.findtext("dbu")
    try:
        dbu = float(dbu)
    except (TypeError, ValueError):
        dbu = 0.001
    yield {"name": (root.findtext("name") or "").strip(), "description": (root.findtext("description") or "").strip(), "dbu": dbu, "default_grids": (root.findtext("default-grids") or "").strip()}


def read_layer_properties(source: DataFrame) -> DataFrame:
    """Layers in the order of their file; of technology files those of the embedded table."""
    return _rows(source, parse_layer_properties, LAYERS)


def read_technology(source: DataFrame) -> DataFrame:
    return _rows(source, parse_technology, TECHNOLOGY)


def escaped(value: Column) -> Column:
    for sign, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
        value = F.replace(value, F.lit(sign), F.lit(f"&{name};"))
    return value


def _tag(name: str, value: Column, indent: int) -> Column:
    return F.concat(F.lit(" " * indent + f"<{name}>"), escaped(F.coalesce(value.cast("string"), F.lit(""))), F.lit(f"</{name}>\n"))


def _layer_tables(layers: DataFrame) -> DataFrame:
    block = F.concat(F.lit(" <properties>\n"), *[_tag(t, F.col(c), 2) for t, c in COLUMNS.items()], F.lit(" </properties>\n"))
    rows = layers.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", block.alias("block")))).alias("s"))
    return rows.select("path", F.concat(F.lit("<layer-properties>\n"), F.array_join("s.block", ""), F.lit("</layer-properties>\n")).alias("body"))


_HEAD = '<?xml version="1.0" encoding="utf-8"?>\n'


def write_layer_properties(layers: DataFrame) -> DataFrame:
    """(path, value): a file for each path of the layers; a table of layers is small."""
    return _layer_tables(layers).select("path", F.concat(F.lit(_HEAD), "body").alias("value"))


def write_technology(technology: DataFrame, layers: DataFrame) -> DataFrame:
    """(path, value): technologies, each with its path's layers."""
    head = F.concat(F.lit(_HEAD + "<technology>\n"), *[_tag(t, F.col(t.replace("-", "_")), 1) for t in ("name", "description", "dbu", "default-grids")])
    body = F.coalesce("body", F.lit("<layer-properties>\n</layer-properties>\n"))
    return technology.join(_layer_tables(layers), "path", "left").select("path", F.concat(head, body, F.lit("</technology>\n")).alias("value"))


def ring(points: str) -> Column:
    """A ring of points as x,y;x,y"""
    return F.array_join(F.transform(points, lambda p: F.concat(p["x"].cast("string"), F.lit(","), p["y"].cast("string"))), ";")


def report_items(violations: DataFrame, cell: str) -> DataFrame:
    """(rule, value): the report's text of every violation (rule, points)."""
    head = F.concat(F.lit("  <item>\n   <tags></tags>\n"), _tag("category", F.col("rule"), 3), _tag("cell", F.lit(cell), 3))
    rest = F.concat(F.lit("   <visited>false</visited>\n   <multiplicity>1</multiplicity>\n   <values>\n    <value>polygon: ("), ring("points"), F.lit(")</value>\n   </values>\n  </item>\n"))
    return violations.select("rule", F.concat(head, rest).alias("value"))


def write_report(rules: DataFrame, violations: DataFrame, cell: str) -> DataFrame:
    """(value): pieces of a report database in their order: all rules (seq, rule), also those without violations, then every violation.

    `.write.text` gives files that are one report when joined by name; only a sort moves the rows.
    """
    known = rules.select(F.lit(1).alias("part"), F.col("seq").cast("bigint").alias("at"), F.concat(F.lit("  <category>\n"), _tag("name", F.col("rule"), 3), F.lit("   <description></description>\n  </category>\n")).alias("value"))
    found = report_items(violations, cell).join(F.broadcast(rules.select("seq", "rule")), "rule").select(F.lit(3).alias("part"), F.col("seq").cast("bigint").alias("at"), "value")
    name = cell.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    fixed = [
        (0, 0, f"{_HEAD}<report-database>\n <description></description>\n <original-file></original-file>\n <generator>maskloom</generator>\n <top-cell>{name}</top-cell>\n <tags></tags>\n <categories>\n"),
        (2, 0, f" </categories>\n <cells>\n  <cell>\n   <name>{name}</name>\n   <variant>0</variant>\n  </cell>\n </cells>\n <items>\n"),
        (4, 0, " </items>\n</report-database>\n"),
    ]
    frame = rules.sparkSession.createDataFrame(fixed, "part int, at bigint, value string")
    return frame.unionByName(known).unionByName(found).orderBy("part", "at", "value").select(F.rtrim("value", F.lit("\n")).alias("value"))
