"""Timing and netlist text files as DataFrames: SPEF, SDF, Liberty, LEF, DEF and layer maps, a row for each file on the way in."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class TextFormatError(ValueError):
    """The file does not follow its format."""


def _rows(files: DataFrame, parse: Callable[[str], Iterator[dict]], schema: str, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    names = [f.strip().split(" ")[0] for f in re.split(r",(?![^<]*>)", schema)]

    def frame(rows):
        return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    def run(batches):
        for pdf in batches:
            for *key, text in zip(*[pdf[k] for k in keys], pdf["value"], strict=True):
                rows, path = [], key[0]
                try:
                    for r in parse(text):
                        rows.append({**dict(zip(keys, key, strict=True)), **r})
                        if len(rows) == 5000:
                            yield frame(rows)
                            rows = []
                except (ValueError, IndexError, StopIteration) as e:
                    raise TextFormatError(f"{path}: {e}") from e
                if rows:
                    yield frame(rows)

    return files.select(*keys, "value").mapInPandas(run, schema)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _lines(text: str) -> Iterator[str]:
    """The stripped lines of a text one after the other, without a list of them all."""
    return (m[0].strip() for m in re.finditer(r"[^\n\r\v\f\x1c-\x1e\x85\u2028\u2029]+", text))


# --- SPEF ---

SPEF = "path string, design string, net string, total_cap double, resistance double, connections array<string>, coupling array<struct<net:string,cap:double>>"


def parse_spef(text: str, whole: bool = True) -> Iterator[dict]:
    """Nets with their lumped values. Of capacitor rows only those with a ground node first and another net second count, as coupling;
    other rows of four fields add to the resistance. Of a piece of a file nets keep the numbers that stand for names."""
    names: dict[str, str] = {}
    design, net, mapped = "", None, False
    real = lambda v: lookup(v.split(":")[0])
    lookup = lambda v: names.get(v, f"net_{v[1:]}") if whole and v.startswith("*") else v
    for line in _lines(text):
        word = line.split()
        if not word:
            continue
        if word[0] == "*DESIGN":
            design = line[7:].strip().strip('"')
        elif word[0] == "*NAME_MAP":
            mapped = True
        elif word[0] == "*D_NET":
            if net:
                yield net
            mapped = False
            net = {"design": design, "net": lookup(word[1]), "total_cap": float(word[2]), "resistance": 0.0, "connections": [], "coupling": []}
        elif word[0] == "*END":
            if net:
                yield net
            net = None
        elif mapped and line[0] == "*" and len(word) > 1:
            names[word[0]] = word[1]
        elif net and word[0] == "*I" and len(word) > 1:
            net["connections"].append(word[1])
        elif net and word[0][0].isdigit() and len(word) == 4:
            if ":GROUND" in word[1]:
                net["coupling"].append({"net": real(word[2]), "cap": float(word[3])})
            else:
                net["resistance"] += float(word[3])
    if net:
        yield net


def _spef_names(text: str) -> Iterator[dict]:
    mapped = False
    for n, line in enumerate(_lines(text)):
        word = line.split()
        if word and word[0] in ("*NAME_MAP", "*D_NET"):
            mapped = word[0] == "*NAME_MAP"
        elif mapped and line[:1] == "*" and len(word) > 1 and word[0] not in ("*DESIGN", "*END"):
            yield {"at": n, "id": word[0], "name": word[1]}


def _spef_nets(text: str) -> Iterator[dict]:
    for n, r in enumerate(parse_spef(text, False)):
        yield {"at": n, **r}


def read_spef(source: DataFrame) -> DataFrame:
    """Nets of SPEF files (path, value), or of files that come in pieces (path, part, value), which end between two lines and outside of nets.

    Names of a file's map, which is in other pieces than the nets, meet them by a join; a net is named after its place in the file or not at all,
    so the map must come first.
    """
    if "part" not in source.columns:
        return _rows(source, parse_spef, SPEF)
    words = F.regexp_extract_all("value", F.lit(r"(?m)^\s*\*(NAME_MAP|D_NET)\b"), F.lit(1))
    ends = source.select("path", F.col("part").cast("bigint").alias("part"), F.try_element_at(words, F.lit(-1)).alias("last"), F.regexp_extract("value", r'(?m)^\s*\*DESIGN([^\n]*)', 1).alias("design"))
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    state = ends.select("path", "part", F.last("last", True).over(before).alias("open"), F.last(F.when(F.col("design") != "", F.col("design")), True).over(before).alias("named"))
    # a piece is read as a file of its own, with the head that its place calls for
    head = F.concat(F.coalesce(F.concat(F.lit("*DESIGN"), "named", F.lit("\n")), F.lit("")), F.when(F.col("open") == "NAME_MAP", "*NAME_MAP\n").otherwise(""))
    held = source.withColumn("part", F.col("part").cast("bigint")).join(state, ["path", "part"]).select("path", "part", F.concat(head, "value").alias("value"))
    names = _rows(held, _spef_names, "path string, part bigint, at bigint, id string, name string", ("path", "part"))
    names = names.groupBy("path", "id").agg(F.max_by("name", F.struct("part", "at")).alias("name"))
    nets = _rows(held, _spef_nets, SPEF.replace("path string", "path string, part bigint, at bigint"), ("path", "part"))
    named = lambda c: F.coalesce("name", F.when(F.col(c).startswith("*"), F.concat(F.lit("net_"), F.substr(c, F.lit(2)))).otherwise(F.col(c)))
    pairs = nets.filter(F.size("coupling") > 0).select("path", "part", "at", F.posexplode("coupling").alias("i", "c")).select("path", "part", "at", "i", F.col("c.net").alias("id"), "c.cap")
    pairs = pairs.join(names, ["path", "id"], "left").groupBy("path", "part", "at").agg(F.array_sort(F.collect_list(F.struct("i", named("id").alias("net"), "cap"))).alias("met"))
    out = nets.withColumnRenamed("net", "id").join(names, ["path", "id"], "left").withColumn("net", named("id")).join(pairs, ["path", "part", "at"], "left")
    met = F.transform("met", lambda m: F.struct(m["net"].alias("net"), m["cap"].alias("cap")))
    return out.withColumn("coupling", F.coalesce(met, F.col("coupling"))).select("path", "design", "net", "total_cap", "resistance", "connections", "coupling")


def write_spef(nets: DataFrame, design: str, group: str | None = None, most: int = 2000) -> DataFrame:
    """(path, part, value): SPEF text of nets (net, total_cap, resistance, connections), one file for each group, whose pieces in the order of part are the file; ids
    follow the order of names.

    A piece has at most `most` nets, so that no row holds the whole file.
    """
    key = F.col(group).cast("string") if group else F.lit("all")
    df = nets.withColumn("k", key).withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("net")).cast("bigint"))
    pins = F.array_join(F.transform("connections", lambda c: F.concat(F.lit("*I "), c, F.lit(" I\n"))), "")
    block = F.concat(F.lit("\n*D_NET *"), F.col("i"), F.lit(" "), F.col("total_cap"), F.lit("\n*CONN\n"), pins, F.lit("*RES\n1 *"), F.col("i"), F.lit(":1 *"), F.col("i"), F.lit(":2 "), F.col("resistance"), F.lit("\n*END\n"))
    df = df.select("k", "i", F.concat(F.lit("*"), F.col("i"), F.lit(" "), F.col("net"), F.lit("\n")).alias("name"), block.alias("block"))
    head = f'*SPEF "IEEE 1481-1998"\n*DESIGN "{design}"\n*DIVIDER /\n*DELIMITER :\n*T_UNIT 1 NS\n*C_UNIT 1 FF\n*R_UNIT 1 OHM\n\n*NAME_MAP\n'

    def run(batches):  # a window gives its rows by group and in order
        for b in batches:
            keys, at = b.column("k").to_pylist(), 0
            while at < len(keys):
                size = next((n for n in range(1, min(most, len(keys) - at)) if keys[at + n] != keys[at]), min(most, len(keys) - at))
                i, names, blocks = (b.column(c).slice(at, size).to_pylist() for c in ("i", "name", "block"))
                first = [(0, head)] if i[0] == 1 else []
                made = [*first, (i[0], "".join(v for v in names if v is not None)), ((1 << 61) + i[0], "".join(v for v in blocks if v is not None))]
                yield pa.RecordBatch.from_pydict({"path": pa.array([keys[at]] * len(made), pa.string()), "part": pa.array([p for p, _ in made], pa.int64()), "value": [v for _, v in made]})
                at += size

    return df.mapInArrow(run, "path string, part bigint, value string")


# --- Liberty ---

LIBERTY = "path string, cell string, area double, pin string, direction string, cap double, function string, related_pin string, timing_type string, timing_sense string"
_TOKEN = re.compile(r'"(?:[^"\\]|\\.|\\\n)*"|[A-Za-z0-9_.+\-*/!\'^&|]+(?:\[[^\]]*\])?|[(){};:,]')


def _group(tokens: list[str], at: int) -> tuple[dict, int]:
    """Attributes and child groups up to the closing brace."""
    out: dict = {"attrs": {}, "groups": []}
    while at < len(tokens) and tokens[at] != "}":
        name = tokens[at]
        if name in ";,":
            at += 1
        elif at + 1 < len(tokens) and tokens[at + 1] == ":":
            end = at + 2
            while end < len(tokens) and tokens[end] not in (";", "}"):
                end += 1
            out["attrs"][name] = " ".join(tokens[at + 2 : end]).strip('"')
            at = end
        elif at + 1 < len(tokens) and tokens[at + 1] == "(":
            end = tokens.index(")", at)
            args = [t.strip('"') for t in tokens[at + 2 : end] if t != ","]
            if end + 1 < len(tokens) and tokens[end + 1] == "{":
                child, at = _group(tokens, end + 2)
                out["groups"].append((name, args, child))
                at += 1
            else:
                out["attrs"][name] = ",".join(args)
                at = end + 1
        else:
            at += 1
    return out, at


def parse_liberty(text: str) -> Iterator[dict]:
    """A row for each pin, or for each timing arc of a pin that has some."""
    text = re.sub(r"/\*.*?\*/", " ", text, flags=re.DOTALL).replace("\\\n", " ")
    top, _ = _group(_TOKEN.findall(text), 0)
    for kind, _, lib in top["groups"]:
        if kind != "library":
            continue
        for k, args, cell in lib["groups"]:
            if k != "cell":
                continue
            base = {"cell": args[0], "area": float(cell["attrs"].get("area", 0))}
            for p, pins, pin in cell["groups"]:
                if p != "pin":
                    continue
                a = pin["attrs"]
                for name in pins:
                    row = base | {"pin": name, "direction": a.get("direction"), "cap": float(a.get("capacitance", 0)), "function": a.get("function")}
                    arcs = [g["attrs"] for t, _, g in pin["groups"] if t == "timing"]
                    for arc in arcs or [{}]:
                        yield row | {"related_pin": arc.get("related_pin"), "timing_type": arc.get("timing_type"), "timing_sense": arc.get("timing_sense")}


def read_liberty(source: DataFrame) -> DataFrame:
    return _rows(source, parse_liberty, LIBERTY)


# --- LEF and DEF ---

LEF = "path string, macro string, width bigint, height bigint, pin string, direction string, use string, layer string, x0 bigint, y0 bigint, x1 bigint, y1 bigint"


def parse_lef(text: str, per_micron: int = 1000) -> Iterator[dict]:
    """A row for each rectangle of each macro's pins, lengths in database units."""
    dbu = lambda v: round(float(v) * per_micron)
    word = re.sub(r"#[^\n]*", "", text).replace(";", " ; ").split()
    macro = pin = None
    size, layer, at, held = (0, 0), None, 0, {}
    while at < len(word):
        w = word[at]
        if w == "MACRO":
            macro, size = word[at + 1], (0, 0)
            at += 1
        elif macro and w == "SIZE":
            size = dbu(word[at + 1]), dbu(word[at + 3])
        elif macro and w == "PIN":
            pin, held = word[at + 1], {}
            at += 1
        elif pin and w in ("DIRECTION", "USE"):
            held[w.lower()] = word[at + 1]
        elif pin and w == "LAYER":
            layer = word[at + 1]
        elif pin and w == "RECT":
            v = word[at + 1 : at + 5]
            yield {"macro": macro, "width": size[0], "height": size[1], "pin": pin, "layer": layer, **held, **dict(zip(("x0", "y0", "x1", "y1"), map(dbu, v), strict=True))}
            at += 4
        elif w == "END" and at + 1 < len(word):
            if pin and word[at + 1] == pin:
                pin, at = None, at + 1
            elif macro and not pin and word[at + 1] == macro:
                macro, at = None, at + 1
        at += 1


def read_lef(source: DataFrame) -> DataFrame:
    return _rows(source, parse_lef, LEF)


DEF = "path string, design string, kind string, name string, master string, x bigint, y bigint, orient string, pins array<string>"


def parse_def(text: str) -> Iterator[dict]:
    """Rows of kind die (corner points in name order), component (master and place) and net (its instance:pin names)."""
    design = re.search(r"\bDESIGN\s+(\S+)\s*;", text)
    design = design[1] if design else ""
    die = re.search(r"\bDIEAREA\s+((?:\(\s*-?\d+\s+-?\d+\s*\)\s*)+);", text)
    for i, (x, y) in enumerate(re.findall(r"\(\s*(-?\d+)\s+(-?\d+)\s*\)", die[1]) if die else []):
        yield {"design": design, "kind": "die", "name": str(i), "x": int(x), "y": int(y)}
    for section, kind in (("COMPONENTS", "component"), ("NETS", "net")):
        found = re.search(rf"(?<!SPECIAL)\b{section}\s+\d+\s*;(.*?)\bEND\s+{section}\b", text, re.DOTALL)
        for item in re.finditer(r"-\s+(\S+)\s+([^;]*);", found[1]) if found else ():
            name, rest = item.groups()
            if kind == "component":
                place = re.search(r"\+\s*(?:PLACED|FIXED)\s*\(\s*(-?\d+)\s+(-?\d+)\s*\)\s*(\S+)", rest)
                yield {"design": design, "kind": kind, "name": name, "master": rest.split()[0], "x": int(place[1]) if place else None, "y": int(place[2]) if place else None, "orient": place[3] if place else None}
            else:
                head = rest.split("+")[0]
                yield {"design": design, "kind": kind, "name": name, "pins": [f"{a}:{b}" for a, b in re.findall(r"\(\s*(\S+)\s+(\S+)\s*\)", head)]}


_NAMES = "(?:COMPONENTS|NETS|SPECIALNETS|PINS|VIAS|BLOCKAGES)"
_SECTION = rf"(?:^|\s)(END\s+{_NAMES}\b|{_NAMES}(?=\s+\d+\s*;))"


def read_def(source: DataFrame) -> DataFrame:
    """Rows of DEF files (path, value), or of files that come in pieces (path, part, value), which end between two statements.

    Of pieces only the section that each ends in is looked at across a file; its design is named in its first piece.
    """
    if "part" not in source.columns:
        return _rows(source, parse_def, DEF)
    words = F.regexp_extract_all("value", F.lit(_SECTION), F.lit(1))
    ends = source.select("path", "part", F.try_element_at(words, F.lit(-1)).alias("last"), F.regexp_extract("value", r"\bDESIGN\s+(\S+)\s*;", 1).alias("design"))
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    state = ends.select("path", "part", F.last("last", True).over(before).alias("open"), F.first(F.when(F.col("design") != "", F.col("design")), True).over(before).alias("named"))
    held = source.join(state, ["path", "part"])
    # a piece is read as a file of its own, with the head that its place calls for
    name = F.when(F.col("open").rlike("^(COMPONENTS|NETS)$"), F.col("open"))
    head = F.concat(F.coalesce(F.concat(F.lit("DESIGN "), "named", F.lit(" ;\n")), F.lit("")), F.coalesce(F.concat(name, F.lit(" 0 ;\n")), F.lit("")))
    inside = F.coalesce(F.try_element_at(words, F.lit(-1)), "open")
    tail = F.when(inside.rlike("^(COMPONENTS|NETS)$"), F.concat(F.lit("\nEND "), inside, F.lit("\n"))).otherwise(F.lit(""))
    return _rows(held.select("path", F.concat(head, "value", tail).alias("value")), parse_def, DEF)


def write_def(components: DataFrame, design: str) -> DataFrame:
    """(path, part, value): DEF text of components (name, master, x, y, orient), in the order of names; its pieces in the order of part are the file.

    Names are dealt by ranges, and each batch of rows is a piece, so that no row holds the whole file.
    """
    line = F.concat(F.lit("- "), F.col("name"), F.lit(" "), F.col("master"), F.lit(" + PLACED ( "), F.col("x"), F.lit(" "), F.col("y"), F.lit(" ) "), F.col("orient"), F.lit(" ;"))
    n = int(components.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = components.select("name", line.alias("line")).repartitionByRange(n, "name").sortWithinPartitions("name", "line").withColumn("p", F.spark_partition_id())

    def run(batches):
        for i, b in enumerate(batches):
            text = [t for t in b.column("line").to_pylist() if t is not None]
            if text:
                yield pa.RecordBatch.from_pydict({"part": pa.array([((b.column("p")[0].as_py() + 1) << 32) + i], pa.int64()), "value": ["\n".join([*text, ""])]})

    body = lines.mapInArrow(run, "part bigint, value string")
    head = F.concat(F.lit(f"VERSION 5.7 ;\nDESIGN {design} ;\nUNITS DISTANCE MICRONS 1000 ;\n\nCOMPONENTS "), F.count("*"), F.lit(" ;\n"))
    first = components.agg(head.alias("value")).select(F.lit(0).cast("bigint").alias("part"), "value")
    last = components.sparkSession.createDataFrame([((1 << 62), "END COMPONENTS\n\nEND DESIGN\n")], "part bigint, value string")
    return first.unionByName(body).unionByName(last).select(F.lit(design).alias("path"), "part", "value")


# --- SDF and layer maps ---

SDF = "path string, cell_type string, instance string, from_pin string, to_pin string, rise array<double>, fall array<double>"


def parse_sdf(text: str) -> Iterator[dict]:
    """Delays of IOPATH entries; a single value stands for minimum, typical and maximum."""
    for cell in re.split(r"\(\s*CELL\s*(?=\()", text)[1:]:
        kind, inst = re.search(r'CELLTYPE\s+"([^"]*)"', cell), re.search(r"INSTANCE\s+([^\s()]+)\s*\)", cell)
        for a, b, rise, fall in re.findall(r"IOPATH\s+(\S+)\s+(\S+)\s*\(([^()]*)\)\s*(?:\(([^()]*)\))?", cell):
            v = [[float(x) for x in p.split(":") if x] for p in (rise, fall or rise)]
            v = [x * 3 if len(x) == 1 else x for x in v]
            yield {"cell_type": kind[1] if kind else None, "instance": inst[1] if inst else "", "from_pin": a, "to_pin": b, "rise": v[0], "fall": v[1]}


def read_sdf(source: DataFrame) -> DataFrame:
    return _rows(source, parse_sdf, SDF)


def read_layermap(source: DataFrame) -> DataFrame:
    """(name, purpose, layer, datatype) from lines of these four; # and // begin comments. Spark expressions only."""
    line = source.select("path", F.posexplode(F.split("value", "\n")).alias("line", "v")).withColumn("w", F.split(F.trim(F.regexp_replace("v", r"(#|//).*$", "")), r"\s+"))
    return line.filter(F.size("w") >= 4).select("path", "line", F.col("w")[0].alias("name"), F.col("w")[1].alias("purpose"), F.col("w")[2].cast("int").alias("layer"), F.col("w")[3].cast("int").alias("datatype"))


def write_layermap(entries: DataFrame) -> DataFrame:
    """(value): lines of a layer map in the order of `line`, from (line, name, purpose, layer, datatype), in columns as wide as their longest."""
    wide = entries.agg(*[F.greatest(F.coalesce(F.max(F.length(c)), F.lit(0)), F.lit(least)).alias(f"{c}_w") for c, least in (("name", 4), ("purpose", 7))])
    num = lambda c: F.lpad(F.col(c).cast("string"), F.greatest(F.length(F.col(c).cast("string")), F.lit(3)), F.lit(" "))
    text = F.concat_ws(" ", F.rpad("name", F.col("name_w"), F.lit(" ")), F.rpad("purpose", F.col("purpose_w"), F.lit(" ")), num("layer"), num("datatype"))
    lines = entries.withColumn("k", F.lit(0)).join(wide.withColumn("k", F.lit(0)), "k").select(F.col("line").cast("bigint").alias("at"), text.alias("value"))
    head = entries.sparkSession.createDataFrame([(None, "# name  purpose  layer  datatype")], "at bigint, value string")
    return head.unionAll(lines).orderBy(F.asc_nulls_first("at")).select("value")


# --- CDL ---


def write_cdl(nets: DataFrame, subcircuit: str, pins: list[str]) -> DataFrame:
    """(value): lines of a subcircuit in order, its nets (net, x0, y0, x1, y1, shapes) as comments, those of `pins` marked."""
    whole = lambda c: F.col(c).cast("string")
    kind = F.when(F.col("net").isin(pins), "pin").otherwise("net") if pins else F.lit("net")
    text = F.concat(F.lit("*  "), kind, F.lit(" "), F.col("net"), F.lit(": bbox=["), whole("x0"), F.lit(","), whole("y0"), F.lit(" "), whole("x1"), F.lit(","), whole("y1"), F.lit("], "), whole("shapes"), F.lit(" shapes"))
    lines = nets.select(F.lit(1).alias("part"), F.col("net").alias("at"), text.alias("value"))
    fixed = [(0, "0", "* CDL netlist"), (0, "1", " ".join([".SUBCKT", subcircuit, *pins])), (2, "0", "* devices: (none)"), (2, "1", f".ENDS {subcircuit}")]
    return nets.sparkSession.createDataFrame(fixed, "part int, at string, value string").unionByName(lines).orderBy("part", "at").select("value")
