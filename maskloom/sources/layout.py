"""Layout files as DataFrames: GDSII stream, OASIS, CIF, MAG and DXF, read in parallel by file, and written by cell.

Every reader gives the same element rows, so that shapes and instances are filters on them:
kind is box, polygon, path, text or ref; points are whole database units; a ref places `child` by rot, mirror, dx, dy
in an array of cols by rows steps.
"""

from __future__ import annotations

import itertools
import math
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskloom.plans.tables import materialize
from maskloom.sources.elements import LayoutError, element, shape
from maskloom.sources.oasis import oasis_elements, oasis_head, oasis_open, oasis_tail, parse_oasis

ELEMENT = "path string, cell string, seq bigint, kind string, layer int, datatype int, points array<struct<x:bigint,y:bigint>>, width bigint, text string, child string, rot int, mirror boolean, cols int, rows int, col_x bigint, col_y bigint, row_x bigint, row_y bigint"


# --- GDSII stream --------------------------------------------------------------------------------

# Record types and data types of the stream format.
_R = {"HEADER": 0x0002, "BGNLIB": 0x0102, "LIBNAME": 0x0206, "UNITS": 0x0305, "ENDLIB": 0x0400, "BGNSTR": 0x0502, "STRNAME": 0x0606, "ENDSTR": 0x0700, "BOUNDARY": 0x0800, "PATH": 0x0900, "SREF": 0x0A00, "AREF": 0x0B00, "TEXT": 0x0C00, "LAYER": 0x0D02, "DATATYPE": 0x0E02, "WIDTH": 0x0F03, "XY": 0x1003, "ENDEL": 0x1100, "SNAME": 0x1206, "COLROW": 0x1302, "TEXTTYPE": 0x1602, "STRING": 0x1906, "STRANS": 0x1A01, "ANGLE": 0x1C05, "BOX": 0x2D00, "BOXTYPE": 0x2E02}
_NAMES = {v >> 8: k for k, v in _R.items()}


def real8(value: float) -> bytes:
    """An excess-64 base-16 real."""
    if value == 0:
        return bytes(8)
    sign, value, exponent = (0x80 if value < 0 else 0), abs(value), 64
    while value >= 1:
        value, exponent = value / 16, exponent + 1
    while value < 1 / 16:
        value, exponent = value * 16, exponent - 1
    return bytes([sign | exponent]) + round(value * (1 << 56)).to_bytes(7, "big")


def from_real8(raw: bytes) -> float:
    value = int.from_bytes(raw[1:8], "big") / (1 << 56) * 16.0 ** ((raw[0] & 0x7F) - 64)
    return -value if raw[0] & 0x80 else value


_HEAD = struct.Struct(">HB")


def records(data: bytes, whole: bool = True) -> Iterator[tuple[str, bytes]]:
    at = 0
    while at + 4 <= len(data):
        n, kind = _HEAD.unpack_from(data, at)
        if n < 4 or at + n > len(data):
            raise LayoutError("a record runs past the end")
        name = _NAMES.get(kind, f"#{kind}")
        yield name, data[at + 4 : at + n]
        at += n
        if name == "ENDLIB":
            return
    if whole or at < len(data):
        raise LayoutError("no end of library")


def parse_gds(data: bytes, cell: str | None = None, whole: bool = True) -> Iterator[dict]:
    """Elements of a file, or of a piece of one that begins in a cell; returns the cell in which it ends."""
    now = None
    for name, body in records(data, whole):
        if name == "STRNAME":
            cell = body.rstrip(b"\0").decode()
        elif name in ("BOUNDARY", "PATH", "SREF", "AREF", "TEXT", "BOX"):
            now = {"what": name, "rot": 0, "mirror": False, "type": 0, "layer": 0, "width": 0, "text": None, "child": None, "n": (1, 1)}
        elif now is None:
            continue
        elif name == "LAYER":
            now["layer"] = struct.unpack(">h", body)[0]
        elif name in ("DATATYPE", "TEXTTYPE", "BOXTYPE"):
            now["type"] = struct.unpack(">h", body)[0]
        elif name == "WIDTH":
            now["width"] = struct.unpack(">i", body)[0]
        elif name == "SNAME":
            now["child"] = body.rstrip(b"\0").decode()
        elif name == "STRING":
            now["text"] = body.rstrip(b"\0").decode("utf-8", "replace")
        elif name == "COLROW":
            now["n"] = struct.unpack(">hh", body)
        elif name == "STRANS":
            now["mirror"] = bool(body[0] & 0x80)
        elif name == "ANGLE":
            turns = from_real8(body) / 90
            if abs(turns - round(turns)) > 1e-9:
                raise LayoutError("a rotation by no quarter turns")
            now["rot"] = round(turns) % 4
        elif name == "XY":
            v = struct.unpack(f">{len(body) // 4}i", body)
            now["xy"] = list(zip(v[::2], v[1::2], strict=True))
        elif name == "ENDEL":
            xy = now.get("xy") or []
            if not xy or cell is None:
                raise LayoutError("an element without place")
            if now["what"] in ("BOUNDARY", "BOX"):
                yield shape(cell, xy, now["layer"], now["type"])
            elif now["what"] == "PATH":
                yield element(cell, "path", xy, now["layer"], now["type"], width=now["width"])
            elif now["what"] == "TEXT":
                yield element(cell, "text", xy[:1], now["layer"], now["type"], text=now["text"])
            else:
                (x, y), (cols, rows) = xy[0], now["n"]
                step = [(p[0] - x, p[1] - y) for p in xy[1:3]] or [(0, 0), (0, 0)]
                more = {"col_x": step[0][0] // cols, "col_y": step[0][1] // cols, "row_x": step[1][0] // rows, "row_y": step[1][1] // rows}
                yield element(cell, "ref", xy[:1], child=now["child"], rot=now["rot"], mirror=now["mirror"], cols=cols, rows=rows, **more)
            now = None
    if now is not None and not whole:
        raise LayoutError("a piece ends inside an element")
    return cell


def _record(name: str, body: bytes = b"") -> bytes:
    body += b"\0" * (len(body) % 2)
    return struct.pack(">HH", len(body) + 4, _R[name]) + body


def gds_open(name: str) -> bytes:
    return _record("BGNSTR", bytes(24)) + _record("STRNAME", name.encode())


def gds_cell(name: str, elements: list[dict]) -> bytes:
    """One structure; dates are zero, so that equal cells have equal bytes."""
    return gds_open(name) + gds_elements(elements) + _record("ENDSTR")


def gds_elements(elements: list[dict]) -> bytes:
    xy = lambda points: _record("XY", struct.pack(f">{2 * len(points)}i", *[v for p in points for v in p]))
    out = []
    for e in elements:
        kind, points = e["kind"], [tuple(p) for p in e["points"]]
        short = lambda k, v: _record(k, struct.pack(">h", v))
        if kind in ("box", "polygon"):
            if kind == "box":
                (x0, y0), (x1, y1) = points
                points = [(x0, y0), (x0, y1), (x1, y1), (x1, y0)]
            out += [_record("BOUNDARY"), short("LAYER", e["layer"]), short("DATATYPE", e["datatype"]), xy([*points, points[0]])]
        elif kind == "path":
            out += [_record("PATH"), short("LAYER", e["layer"]), short("DATATYPE", e["datatype"]), _record("WIDTH", struct.pack(">i", e["width"])), xy(points)]
        elif kind == "text":
            out += [_record("TEXT"), short("LAYER", e["layer"]), short("TEXTTYPE", e["datatype"]), xy(points), _record("STRING", e["text"].encode())]
        else:
            many = e["cols"] * e["rows"] > 1
            out += [_record("AREF" if many else "SREF"), _record("SNAME", e["child"].encode())]
            if e["mirror"] or e["rot"]:
                out += [_record("STRANS", b"\x80\0" if e["mirror"] else b"\0\0"), _record("ANGLE", real8(90.0 * e["rot"]))]
            if many:
                (x, y), c, r = points[0], e["cols"], e["rows"]
                out += [_record("COLROW", struct.pack(">hh", c, r))]
                points = [(x, y), (x + c * e["col_x"], y + c * e["col_y"]), (x + r * e["row_x"], y + r * e["row_y"])]
            out.append(xy(points))
        out.append(_record("ENDEL"))
    return b"".join(out)


def gds_head(library: str = "LIB", per_micron: int = 1000) -> bytes:
    return _record("HEADER", struct.pack(">h", 600)) + _record("BGNLIB", bytes(24)) + _record("LIBNAME", library.encode()) + _record("UNITS", real8(1 / per_micron) + real8(1e-6 / per_micron))


def gds_tail() -> bytes:
    return _record("ENDLIB")


# --- text formats --------------------------------------------------------------------------------


def _unit_turn(x: int, y: int) -> int:
    try:
        return {(1, 0): 0, (0, 1): 1, (-1, 0): 2, (0, -1): 3}[(x > 0) - (x < 0), (y > 0) - (y < 0)]
    except KeyError:
        raise LayoutError("a rotation by no quarter turns") from None


def parse_cif(data: bytes, cell: str | None = None) -> Iterator[dict]:
    """Caltech form: boxes, polygons, and calls; one unit is ten database units. A layer L<n> is n / 0, others have no number.

    A piece of a file begins in a cell; returns the one in which it ends.
    """
    text, depth = [], 0
    for c in data.decode("utf-8", "replace"):
        depth += (c == "(") - (c == ")")
        if depth == 0 and c != ")":
            text.append(c)
    layer, number = None, lambda v: int(v) * 10
    for part in "".join(text).split(";"):
        word = part.replace(",", " ").split()
        if not word or word[0] == "E":
            continue
        if word[0] == "DS":
            cell = f"C{word[1]}"
        elif word[0] == "DF":
            cell = None
        elif word[0] == "L":
            layer = int(word[1][1:]) if word[1][:1] == "L" and word[1][1:].isdigit() else None
        elif word[0] == "B":
            w, h, x, y = (int(v) for v in word[1:5])
            yield element(cell or "TOP", "box", [(5 * (2 * x - w), 5 * (2 * y - h)), (5 * (2 * x + w), 5 * (2 * y + h))], layer, 0)
        elif word[0] == "P":
            v = [number(x) for x in word[1:]]
            yield shape(cell or "TOP", list(zip(v[::2], v[1::2], strict=True)), layer, 0)
        elif word[0] == "C":
            if cell is None:
                continue  # the call of the top cell
            rot, mirror, dx, dy, at = 0, False, 0, 0, 2
            while at < len(word):  # each step acts on what the ones before gave
                step = word[at]
                if step == "T":
                    dx, dy, at = dx + number(word[at + 1]), dy + number(word[at + 2]), at + 3
                elif step == "R":
                    turn = _unit_turn(int(word[at + 1]), int(word[at + 2]))
                    dx, dy = ((dx, dy), (-dy, dx), (-dx, -dy), (dy, -dx))[turn]
                    rot, at = (rot + turn) % 4, at + 3
                else:
                    across = step == "MX" or word[at : at + 2] == ["M", "X"]  # x changes its sign
                    dx, dy = (-dx, dy) if across else (dx, -dy)
                    rot, mirror, at = ((2 if across else 0) - rot) % 4, not mirror, at + (1 if step in ("MX", "MY") else 2)
            yield element(cell, "ref", [(dx, dy)], child=f"C{word[1]}", rot=rot, mirror=mirror, cols=1, rows=1, col_x=0, col_y=0, row_x=0, row_y=0)
    return cell


def cif_lines(elements: list[dict]) -> str:
    """Lines of a cell's definition. Boxes and polygons need whole tens of database units; refs name cells C<n>."""
    lines, layer = [], object()
    for e in elements:
        if e["kind"] in ("box", "polygon") and e["layer"] != layer:
            layer = e["layer"]
            lines.append(f"L L{layer};")
        if e["kind"] == "box":
            (x0, y0), (x1, y1) = e["points"]
            lines.append(f"B {(x1 - x0) // 10} {(y1 - y0) // 10} {(x0 + x1) // 20} {(y0 + y1) // 20};")
        elif e["kind"] == "polygon":
            lines.append("P " + " ".join(f"{x // 10} {y // 10}" for x, y in e["points"]) + ";")
        elif e["kind"] == "ref":
            turn = ("", "R 0 1 ", "R -1 0 ", "R 0 -1 ")[e["rot"]]
            (x, y) = e["points"][0]
            lines.append(f"C {e['child'][1:]} {'MY ' if e['mirror'] else ''}{turn}T {x // 10} {y // 10};")
    return "".join(f"{line}\n" for line in lines)


def parse_mag(data: bytes, name: str = "TOP", unit: int = 1000) -> Iterator[dict]:
    """Magic cells: rectangles of named layers (the name is the text), uses with their transform."""
    layer, use = None, None
    for line in data.decode("utf-8", "replace").splitlines():
        word = line.split()
        if line.startswith("<<"):
            layer = line.strip("<> ")
        elif not word:
            continue
        elif word[0] == "rect" and layer not in (None, "end", "labels", "checkpaint"):
            x0, y0, x1, y1 = (int(v) * unit for v in word[1:5])
            yield element(name, "box", [(x0, y0), (x1, y1)], text=layer)
        elif word[0] == "use":
            use = word[1]
        elif word[0] == "transform" and use is not None:
            a, b, c, d, e, f = (int(v) for v in word[1:7])
            mirror = a * e - b * d < 0
            yield element(name, "ref", [(c * unit, f * unit)], child=use, rot=_unit_turn(a, d), mirror=mirror, cols=1, rows=1, col_x=0, col_y=0, row_x=0, row_y=0)
            use = None
    return name


def mag_lines(elements: list[dict], unit: int = 1000) -> str:
    lines, by = [], {}
    for e in elements:
        if e["kind"] == "box":
            by.setdefault(e["text"], []).append("rect " + " ".join(str(v // unit) for p in e["points"] for v in p))
    for layer in sorted(by):
        lines += [f"<< {layer} >>", *by[layer]]
    return "".join(f"{line}\n" for line in lines)


def parse_dxf(data: bytes, unit: int = 1000) -> Iterator[dict]:
    """Entities LINE, LWPOLYLINE, CIRCLE (64 corners), TEXT and INSERT, and blocks as cells; one drawing unit is 1000 database units."""
    lines = data.decode("utf-8", "replace").splitlines()
    pairs = [(int(lines[i].strip()), lines[i + 1].strip()) for i in range(0, len(lines) - 1, 2)]
    cell, entity, waiting = "TOP", None, None

    def number(code: int, many: bool = False):
        v = [round(float(x) * unit) for c, x in entity if c == code]
        return v if many else (v[0] if v else 0)

    def done():
        if entity is None:
            return
        kind, name = entity[0][1], next((x for c, x in entity if c == 8), "0")
        layer = int(name) if name.isdigit() else None
        xs, ys = number(10, True), number(20, True)
        if kind == "LINE":
            yield element(cell, "path", [(xs[0], ys[0]), (number(11), number(21))], layer, 0, width=0)
        elif kind == "LWPOLYLINE" and len(xs) > 2 and any(c == 70 and int(x) & 1 for c, x in entity):
            yield shape(cell, list(zip(xs, ys, strict=True)), layer, 0)
        elif kind == "LWPOLYLINE" and len(xs) > 1:
            yield element(cell, "path", list(zip(xs, ys, strict=True)), layer, 0, width=number(43))
        elif kind == "CIRCLE":
            r = number(40)
            yield element(cell, "polygon", [(round(xs[0] + r * math.cos(2 * math.pi * i / 64)), round(ys[0] + r * math.sin(2 * math.pi * i / 64))) for i in range(64)], layer, 0)
        elif kind == "TEXT":
            yield element(cell, "text", [(xs[0], ys[0])], layer, 0, text=next((x for c, x in entity if c == 1), ""))
        elif kind == "INSERT":
            turn = next((float(x) for c, x in entity if c == 50), 0.0) / 90
            if abs(turn - round(turn)) > 1e-9:
                raise LayoutError("a rotation by no quarter turns")
            mirror = next((float(x) for c, x in entity if c == 42), 1.0) < 0
            yield element(cell, "ref", [(xs[0], ys[0])], child=next(x for c, x in entity if c == 2), rot=round(turn) % 4, mirror=mirror, cols=1, rows=1, col_x=0, col_y=0, row_x=0, row_y=0)

    for code, value in pairs:
        if code == 0:
            yield from done()
            entity = [(code, value)] if value in ("LINE", "LWPOLYLINE", "CIRCLE", "TEXT", "INSERT") else None
            if value == "BLOCK":
                waiting = True
            elif value == "ENDBLK":
                cell = "TOP"
        elif entity is not None:
            entity.append((code, value))
        elif waiting and code == 2:
            cell, waiting = value, None
    yield from done()


FORMATS: dict[str, Callable[[bytes], Iterator[dict]]] = {"gds": parse_gds, "cif": parse_cif, "mag": parse_mag, "dxf": parse_dxf, "oas": parse_oasis}


#: Readers of a piece of a file, which ends between two elements and begins in a cell (data, name of the file, cell).
_PIECES = {"gds": lambda d, _, c: parse_gds(d, c, False), "cif": lambda d, _, c: parse_cif(d, c), "mag": lambda d, n, _: parse_mag(d, n), "oas": lambda d, _, c: parse_oasis(d, c, False)}
_UNKNOWN = "\0"


def _cell_name(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _end(it: Iterator[dict], begin: str) -> tuple[str | None, int]:
    """The cell that a piece ends in, and how many of its elements the piece has."""
    n, now = 0, begin
    try:
        while True:
            e = next(it)
            now, n = e["cell"], n + 1 if e["cell"] == now else 1
    except StopIteration as end:
        return end.value, n if end.value == now else 0


def _gds_end(data: bytes, begin: str) -> tuple[str | None, int]:
    """As _end, by the kinds of records alone."""
    at, n, cell = 0, 0, begin
    while at + 4 <= len(data):
        size, kind = _HEAD.unpack_from(data, at)
        if size < 4:
            raise LayoutError("a record runs past the end")
        if kind == 0x11:
            n += 1
        elif kind == 0x06:
            cell, n = data[at + 4 : at + size].rstrip(b"\0").decode(), 0
        elif kind == 0x04:
            break
        at += size
    return cell, n


def _piece_starts(pieces: DataFrame, fmt: str) -> DataFrame:
    """(path, part, open, first): the cell that each piece begins in, and how many elements it has before; a row a piece."""
    reader = _PIECES[fmt]

    def run(batches):
        for b in batches:
            made = {"path": [], "part": [], "last": [], "n": []}
            for i in range(b.num_rows):
                path, part, content = (b.column(c)[i].as_py() for c in ("path", "part", "content"))
                begin = _cell_name(path) if fmt == "mag" else _UNKNOWN
                try:
                    last, n = _gds_end(content, begin) if fmt == "gds" else _end(reader(content, begin, begin), begin)
                except (LayoutError, ValueError, IndexError, struct.error) as x:
                    raise LayoutError(f"{path}: {x}") from x
                for c, v in zip(made, (path, part, None if last == begin else last or "", n), strict=True):
                    made[c].append(v)
            yield pa.RecordBatch.from_pydict(made, pa.schema([("path", pa.string()), ("part", pa.int64()), ("last", pa.string()), ("n", pa.int64())]))

    ends = pieces.select("path", F.col("part").cast("bigint").alias("part"), "content").mapInArrow(run, "path string, part bigint, last string, n bigint")
    here = Window.partitionBy("path").orderBy("part")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("base", F.when(F.col("last").isNotNull(), F.sum("n").over(here) - F.col("n")))
    first = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.coalesce(F.last("base", True).over(before), F.lit(0))
    return ends.select("path", "part", F.last("last", True).over(before).alias("open"), first.alias("first"))


def parse(files: DataFrame, fmt: str) -> DataFrame:
    """Element rows of files (path, content), or of files that come in pieces (path, part, content); an unreadable file raises LayoutError with its path.

    Pieces end between two elements, and need nothing of the ones before but the cell they are in. They are read twice, so they should be kept, not made anew.
    """
    reader = FORMATS[fmt]
    if "part" in files.columns:
        source = files.join(F.broadcast(_piece_starts(files, fmt)), ["path", "part"])  # a row a piece
    else:
        source = files.withColumns({"open": F.lit(None).cast("string"), "first": F.lit(None).cast("bigint")})
    pieces = _PIECES.get(fmt) if "part" in files.columns else None

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                path, content, begin, first = (b.column(c)[i].as_py() for c in ("path", "content", "open", "first"))
                name, begin = _cell_name(path), begin or None
                rows, seq = [], {name if fmt == "mag" else begin: first or 0}
                try:
                    for e in pieces(content, name, begin) if pieces else reader(content, name) if fmt == "mag" else reader(content):
                        e["path"], e["seq"] = path, seq.get(e["cell"], 0)
                        seq[e["cell"]] = e["seq"] + 1
                        rows.append(e)
                        if len(rows) == 5000:
                            yield _batch(rows)
                            rows = []
                except (LayoutError, ValueError, IndexError, struct.error) as x:
                    raise LayoutError(f"{path}: {x}") from x
                if rows:
                    yield _batch(rows)

    return source.select("path", "content", "open", "first").mapInArrow(run, ELEMENT)


_POINTS = pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())]))
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(f, _TYPES.get(f_type, _POINTS)) for f, f_type in (f.split(" ", 1) for f in ELEMENT.split(", "))])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    ends = pa.array(list(itertools.accumulate((len(r["points"]) for r in rows), initial=0)), pa.int32())
    flat = [pa.array([p[i] for r in rows for p in r["points"]], pa.int64()) for i in (0, 1)]
    points = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(flat, fields=list(_POINTS.value_type)), type=_POINTS)
    return pa.RecordBatch.from_arrays([points if f.name == "points" else pa.array([r.get(f.name) for r in rows], f.type) for f in _SCHEMA], schema=_SCHEMA)


def read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Element rows of the files of one format under a path, a task for each file or several."""
    return parse(spark.read.format("binaryFile").load(path).select("path", F.col("content")), fmt)


def shapes(elements: DataFrame) -> DataFrame:
    """Shapes with their bounds; a path's by half its width."""
    half = F.when(F.col("kind") == "path", F.floor(F.coalesce("width", F.lit(0)) / 2)).otherwise(F.lit(0))
    x, y = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    return elements.filter("kind <> 'ref'").select("path", "cell", "seq", "kind", "layer", "datatype", "points", "width", "text", (F.array_min(x) - half).alias("x0"), (F.array_min(y) - half).alias("y0"), (F.array_max(x) + half).alias("x1"), (F.array_max(y) + half).alias("y1"))


def instances(elements: DataFrame) -> DataFrame:
    """Placements, arrays expanded."""
    e = elements.filter("kind = 'ref'").withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cols") - 1))).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    at = F.element_at("points", 1)
    return e.select("path", F.col("cell").alias("parent"), "child", "rot", "mirror", (at["x"] + F.col("c") * F.col("col_x") + F.col("r") * F.col("row_x")).alias("dx"), (at["y"] + F.col("c") * F.col("col_y") + F.col("r") * F.col("row_y")).alias("dy"))


_LAST = 1 << 62
#: Beginning of a cell, its elements, and its end, as bytes.
_CELLS = {
    "gds": (gds_open, gds_elements, _record("ENDSTR")),
    "oas": (oasis_open, oasis_elements, b""),
    "cif": (lambda name: f"DS {int(name[1:])} 1 1;\n".encode(), lambda e: cif_lines(e).encode(), b"DF;"),
    "mag": (lambda _: b"magic\ntech scmos\ntimestamp 0\n", lambda e: mag_lines(e).encode(), b"<< end >>\n"),
}
_WHOLE = ("layer", "datatype", "width", "rot", "cols", "rows", "col_x", "col_y", "row_x", "row_y")


def _dicts(b: pa.RecordBatch) -> list[dict]:
    """Elements of a batch, column by column, as values of nested rows one by one are slow."""
    lists = b.column("points")
    flat, size = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
    xy = list(zip(flat.field("x").to_numpy(zero_copy_only=False).tolist(), flat.field("y").to_numpy(zero_copy_only=False).tolist(), strict=True))
    ends = list(itertools.accumulate(size, initial=0))
    columns = {"points": [xy[a:z] for a, z in itertools.pairwise(ends)]}
    for f in ("kind", "text", "child", "mirror", *(f for f in _WHOLE if f in b.schema.names)):
        v = b.column(f)
        columns[f] = [0] * len(v) if f in _WHOLE and v.null_count == len(v) else (pc.fill_null(v, 0) if f in _WHOLE else v).to_pylist()
    return [dict(zip(columns, r, strict=True)) for r in zip(*columns.values(), strict=True)]


def encode_pieces(elements: DataFrame, fmt: str = "gds", most: int = 2000) -> DataFrame:
    """(cell, part, content): every cell's stream in pieces of at most `most` elements, which in the order of part are the cell.

    Elements are dealt by ranges of cell and seq, so that neither a row nor a task holds a whole cell.
    """
    begin, body, end = _CELLS[fmt]
    schema = pa.schema([("cell", pa.string()), ("part", pa.int64()), ("content", pa.binary())])
    ddl = "cell string, part bigint, content binary"

    def frames(batches):
        for b in batches:
            for name in b.column("cell").to_pylist():
                yield pa.RecordBatch.from_pydict({"cell": [name] * 2, "part": [0, _LAST], "content": [begin(name), end]}, schema)

    def run(batches):
        n = 0
        for b in batches:
            names = b.column("cell").to_pylist()
            at = 0
            while at < len(names):
                size = next((k for k in range(1, min(most, len(names) - at)) if names[at + k] != names[at]), min(most, len(names) - at))
                n += 1
                part = ((b.column("__p")[at].as_py() + 1) << 32) + n
                yield pa.RecordBatch.from_pydict({"cell": [names[at]], "part": [part], "content": [body(_dicts(b.slice(at, size)))]}, schema)
                at += size

    order = ["cell", "text", "seq"] if fmt == "mag" else ["cell", "seq"]  # MAG has a section a layer
    n = int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = elements.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    return elements.select("cell").distinct().mapInArrow(frames, ddl).unionByName(dealt.mapInArrow(run, ddl))


def cell_files(elements: DataFrame, fmt: str) -> DataFrame:
    """(path, part, content): a written file for each cell, in pieces."""
    pieces = encode_pieces(elements, fmt)
    if fmt in _STREAMS:
        head, tail = _STREAMS[fmt]
        content = F.when(F.col("part") == 0, F.concat(F.lit(head()), "content")).when(F.col("part") == _LAST, F.concat("content", F.lit(tail()))).otherwise(F.col("content"))
        pieces = pieces.withColumn("content", content)
    return materialize(pieces.select(F.col("cell").alias("path"), "part", "content"), "files")


#: Formats of which a file is a head, the cells one after the other, and a tail.
_STREAMS = {"gds": (gds_head, gds_tail), "oas": (oasis_head, oasis_tail)}


def save(elements: DataFrame, path: str, fmt: str) -> None:
    """One library file of all cells, by name; their pieces stream through the driver one partition at a time."""
    head, tail = _STREAMS[fmt]
    with open(path, "wb") as out:
        out.write(head())
        for row in encode_pieces(elements, fmt).orderBy("cell", "part").toLocalIterator():
            out.write(row.content)
        out.write(tail())


def save_gds(elements: DataFrame, path: str) -> None:
    save(elements, path, "gds")
