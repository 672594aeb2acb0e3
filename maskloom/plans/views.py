"""Layout and timing tables derived from the star schema by whole-number arithmetic, the same in both SQL dialects.

Each view is one SQL text; {a // b} stands for whole-number division, which Spark writes `div`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_X = "(o_orderkey * 7919 + (o_orderkey % 97) * (o_orderkey % 89) * 13) % 20011"
_Y = "(o_orderkey * o_orderkey) % 20021"
_BOX = f"{_X} AS x0, {_Y} AS y0, {_X} + 20 + o_orderkey % 180 AS x1, {_Y} + 20 + {{o_orderkey // 180}} % 180 AS y1"

#: name: (table it reads, SQL)
VIEWS = {
    "rects": ("orders", f"SELECT o_orderkey AS id, CAST(o_orderkey % 4 AS INT) AS layer, {_BOX} FROM orders"),
    "net_pins": ("orders", f"SELECT o_custkey AS net, o_orderkey AS pin, {_X} AS x, {_Y} AS y FROM orders"),
    "texts": ("part", "SELECT p_partkey AS id, p_brand AS label, (p_partkey * 7907) % 20011 AS x, (p_partkey * p_partkey * 3) % 20021 AS y FROM part"),
    "placed": ("orders", "SELECT o_orderkey AS cell, CAST(o_orderkey % 64 AS INT) AS site_row, (o_orderkey * 31) % 9001 AS x, 4 + o_orderkey % 13 AS w FROM orders"),
    "segments": (
        "orders",
        f"SELECT o_custkey AS net, o_orderkey AS seq, CAST(o_orderkey % 3 AS INT) AS layer, CASE WHEN o_orderkey % 2 = 0 THEN 'h' ELSE 'v' END AS axis, "
        f"CASE WHEN o_orderkey % 2 = 0 THEN {_Y} ELSE {_X} END AS at, CASE WHEN o_orderkey % 2 = 0 THEN {_X} ELSE {_Y} END AS lo, "
        f"CASE WHEN o_orderkey % 2 = 0 THEN {_X} ELSE {_Y} END + 100 + o_orderkey % 900 AS hi, 10 + o_orderkey % 7 AS width FROM orders",
    ),
    "t_edges": (
        "lineitem",
        "SELECT CAST(src * 10000 + dst AS BIGINT) AS edge_idx, src, dst, CASE WHEN {src // 1000} % 2 = 1 THEN 'cell' ELSE 'net' END AS kind, delay FROM "
        "(SELECT l_linenumber * 1000 + l_suppkey % 50 AS src, (l_linenumber + 1) * 1000 + l_partkey % 50 AS dst, CAST(min(l_quantity) AS BIGINT) AS delay FROM lineitem GROUP BY 1, 2) e",
    ),
    "instances": ("part", "SELECT {(p_partkey - 1) // 4} AS parent, p_partkey AS child, CAST(p_partkey % 4 AS INT) AS rot, p_partkey % 3 = 0 AS mirror, (p_partkey * 17) % 1000 AS dx, (p_partkey * 29) % 1000 AS dy FROM part WHERE p_partkey > 0"),
    "layout_devices": ("supplier", "SELECT concat('M', s_suppkey) AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'nmos' ELSE 'pmos' END AS kind, concat('n', s_nationkey) AS g, concat('n', (s_suppkey * 7) % 25) AS d, concat('n', s_suppkey % 5) AS s, 1 + s_suppkey % 9 AS w FROM supplier"),
    "schematic_devices": (
        "supplier",
        "SELECT concat('M', s_suppkey + CASE WHEN s_suppkey % 10 = 3 THEN 1000000 ELSE 0 END) AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'nmos' ELSE 'pmos' END AS kind, "
        "concat('n', CASE WHEN s_suppkey % 25 = 7 THEN 99 ELSE s_nationkey END) AS g, concat('n', (s_suppkey * 7) % 25) AS d, concat('n', s_suppkey % 5) AS s, 1 + s_suppkey % 9 + CASE WHEN s_suppkey % 50 = 11 THEN 1 ELSE 0 END AS w FROM supplier",
    ),
}
_DIV = re.compile(r"\{([^{}]*) // ([^{}]*)\}")


def spark_sql(name: str) -> str:
    return _DIV.sub(r"((\1) div (\2))", VIEWS[name][1])


def duck_sql(name: str) -> str:
    return _DIV.sub(r"((\1) // (\2))", VIEWS[name][1])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived view over the Parquet table of a data folder."""
    table, _ = VIEWS[name]
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(re.sub(rf"\bFROM {table}\b", "FROM {source}", spark_sql(name)), source=source)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views as common table expressions before it."""
    tables = ", ".join(f"{n} AS ({duck_sql(n)})" for n in names)
    rest = sql.strip()
    if rest.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {tables}, {rest[15:]}"
    if rest.upper().startswith("WITH "):
        return f"WITH {tables}, {rest[5:]}"
    return f"WITH {tables} {rest}"
