"""OASIS stream files: a reader of every record of the standard, and a writer by cell with compressed blocks.

A file is read twice, as its name tables may follow their use. Properties and extension records are skipped.
A circle has 64 corners; a path's extensions beyond its ends are not kept; a magnification other than 1 or an angle of no
quarter turns raises LayoutError, as do files that end early and repetitions of over MOST_COPIES.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

from maskloom.sources.elements import LayoutError, element, shape

MAGIC = b"%SEMI-OASIS\r\n"
MOST_COPIES = 1 << 26

# The standard's directions (east, north, west, south, north-east, north-west, south-west, south-east).
_COMPASS = ((1, 0), (0, 1), (-1, 0), (0, -1), (1, 1), (-1, 1), (-1, -1), (1, -1))
# The corners of the standard's compact trapezoids, types 0 to 25, in width w and height h.
_COMPACT = (
    "0,0 0,h w-h,h w,0", "0,0 0,h w,h w-h,0", "0,0 h,h w,h w,0", "h,0 0,h w,h w,0", "0,0 h,h w-h,h w,0", "h,0 0,h w,h w-h,0", "0,0 h,h w,h w-h,0", "h,0 0,h w-h,h w,0",
    "0,0 0,h w,h-w w,0", "0,0 0,h-w w,h w,0", "0,0 0,h w,h w,w", "0,w 0,h w,h w,0", "0,0 0,h w,h-w w,w", "0,w 0,h-w w,h w,0", "0,0 0,h-w w,h w,w", "0,w 0,h w,h-w w,0",
    "0,0 0,w w,0", "0,0 0,w w,w", "0,0 w,w w,0", "0,w w,w w,0", "0,0 h,h 2h,0", "0,h 2h,h h,0", "0,0 0,2w w,w", "0,w w,2w w,0", "0,0 0,h w,h w,0", "0,0 0,w w,w w,0",
)


class _Source:
    """Bytes with a place in them; compressed blocks are entered, and left when they end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.outer = data, 0, []

    def take(self, n: int) -> bytes:
        if n > len(self.data) - self.at:
            raise LayoutError("the file ends inside a record")
        self.at += n
        return self.data[self.at - n : self.at]

    def unsigned(self) -> int:
        value = shift = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7
            if shift > 63:
                raise LayoutError("an integer of over 64 bits")

    def signed(self) -> int:
        v = self.unsigned()
        return -(v >> 1) if v & 1 else v >> 1

    def real(self, kind: int | None = None) -> float:
        kind = self.unsigned() if kind is None else kind
        if kind > 7:
            raise LayoutError("a real of no known type")
        if kind > 5:
            return struct.unpack("<f" if kind == 6 else "<d", self.take(4 if kind == 6 else 8))[0]
        top = self.unsigned()
        over = self.unsigned() if kind > 3 else 1
        if over == 0 or (kind in (2, 3) and top == 0):
            raise LayoutError("a division by zero")
        value = 1 / top if kind in (2, 3) else top / over
        return -value if kind % 2 else value

    def string(self) -> str:
        return self.take(self.unsigned()).decode("utf-8", "replace")

    def compass(self, bits: int) -> tuple[int, int]:
        v = self.unsigned()
        x, y = _COMPASS[v & ((1 << bits) - 1)]
        return x * (v >> bits), y * (v >> bits)

    def delta(self) -> tuple[int, int]:
        v = self.unsigned()
        if v & 1:
            return (-(v >> 2) if v & 2 else v >> 2), self.signed()
        x, y = _COMPASS[(v >> 1) & 7]
        return x * (v >> 4), y * (v >> 4)

    def record(self) -> int:
        while self.outer and self.at == len(self.data):
            self.data, self.at = self.outer.pop()
        return self.unsigned()

    def done(self) -> bool:
        while self.outer and self.at == len(self.data):
            self.data, self.at = self.outer.pop()
        return self.at == len(self.data)

    def enter_block(self) -> None:
        method, plain, packed = self.unsigned(), self.unsigned(), self.unsigned()
        if method:
            raise LayoutError("a compression of no known kind")
        try:
            body = zlib.decompressobj(-15).decompress(self.take(packed), max(1, plain))
        except zlib.error as e:
            raise LayoutError(str(e)) from e
        if len(body) != plain:
            raise LayoutError("a compressed block of another length than it says")
        self.outer.append((self.data, self.at))
        self.data, self.at = body, 0

    def points(self, closed: bool) -> list[tuple[int, int]]:
        """A point list from the origin; lists of alternate directions leave out a polygon's last corner."""
        kind, n = self.unsigned(), self.unsigned()
        if kind > 5:
            raise LayoutError("a point list of no known type")
        out, step = [(0, 0)], (0, 0)
        for i in range(n):
            x, y = out[-1]
            if kind < 2:
                dx, dy = (self.signed(), 0) if (i + kind) % 2 == 0 else (0, self.signed())
            else:
                dx, dy = self.compass(kind) if kind < 4 else self.delta()
            if kind == 5:
                dx, dy = step = (step[0] + dx, step[1] + dy)
            out.append((x + dx, y + dy))
        if closed and kind < 2:
            x, y = out[-1]
            out.append((0, y) if (n + kind) % 2 == 0 else (x, 0))
        return out

    def repetition(self, kind: int) -> tuple | list:
        """A grid (columns, rows, column step, row step), or a list of places."""
        if kind in (1, 2, 3, 8, 9):
            n = self.unsigned() + 2
            m = self.unsigned() + 2 if kind in (1, 8) else 1
            if n * m > MOST_COPIES:
                raise LayoutError("a repetition of too many copies")
            if kind in (8, 9):
                return n, m, self.delta(), self.delta() if kind == 8 else (0, 0)
            if kind == 3:
                return n, 1, (0, self.unsigned()), (0, 0)
            return n, m, (self.unsigned(), 0), (0, self.unsigned()) if kind == 1 else (0, 0)
        if not 4 <= kind <= 11:
            raise LayoutError("a repetition of no known type")
        n = self.unsigned() + 1
        grid = self.unsigned() if kind in (5, 7, 11) else 1
        out = [(0, 0)]
        for _ in range(n):
            dx, dy = self.delta() if kind > 9 else ((self.unsigned(), 0) if kind < 6 else (0, self.unsigned()))
            out.append((out[-1][0] + dx * grid, out[-1][1] + dy * grid))
        return out


class _Reader:
    """The records of a file in order; names and modal values are kept as the standard says."""

    def __init__(self, data: bytes, cell: str | None = None, whole: bool = True):
        self.src, self.modal, self.info, self.cell, self.whole = _Source(data), {}, 0, cell, whole

    def field(self, bit: int, name: str, read):
        if self.info & bit:
            self.modal[name] = read()
        elif name not in self.modal:
            raise LayoutError(f"{name} is used before it is given")
        return self.modal[name]

    def where(self, kind: str, x_bit: int, y_bit: int, again: int):
        """Place and repetition of an element."""
        m, src = self.modal, self.src
        for axis, bit in (("x", x_bit), ("y", y_bit)):
            if self.info & bit:
                m[kind, axis] = src.signed() + (m.get((kind, axis), 0) if m.get("relative") else 0)
        rep = None
        if self.info & again:
            how = src.unsigned()
            rep = self.field(again, "repetition", lambda: src.repetition(how)) if how else self.field(0, "repetition", None)
        return m.get((kind, "x"), 0), m.get((kind, "y"), 0), rep

    def name(self, explicit: int, by_number: int, kind: str):
        src = self.src
        return self.field(explicit, kind, lambda: src.unsigned() if self.info & by_number else src.string())

    def items(self) -> Iterator[tuple]:
        """('cell' or 'text', number, name) of the name tables, and ('element', cell, build, x, y, repetition)."""
        src = self.src
        if self.whole or src.data.startswith(MAGIC):
            if src.take(len(MAGIC)) != MAGIC or src.record() != 1:
                raise LayoutError("no start of an OASIS file")
            src.string(), src.real()
            if src.unsigned() == 0:
                for _ in range(12):
                    src.unsigned()
        numbers = {"cell": 0, "text": 0}
        while (self.whole or not src.done()) and (kind := src.record()) != 2:
            if kind in (3, 4, 5, 6):
                table, value = "cell" if kind < 5 else "text", src.string()
                number = numbers[table] if kind % 2 else src.unsigned()
                numbers[table] += kind % 2
                yield table, number, value
            elif kind in (13, 14):
                self.cell, self.modal = src.unsigned() if kind == 13 else src.string(), {}
            elif kind in (15, 16):
                self.modal["relative"] = kind == 16
            elif 17 <= kind <= 27:
                if self.cell is None:
                    raise LayoutError("an element outside cells")
                self.info = src.take(1)[0]
                yield ("element", self.cell, *(self.ref(kind) if kind < 19 else (self.text() if kind == 19 else self.geometry(kind))))
            elif kind == 34:
                src.enter_block()
            elif kind:
                self.skip(kind)

    def ref(self, kind: int):
        src = self.src
        child = self.name(0x80, 0x40, "child")
        turns = (self.info >> 1) & 3
        if kind == 18:
            size = src.real() if self.info & 4 else 1.0
            angle = (src.real() if self.info & 2 else 0.0) / 90
            if abs(size - 1) > 1e-9 or abs(angle - round(angle)) > 1e-9:
                raise LayoutError("a placement of another size or by no quarter turns")
            turns = round(angle) % 4
        flip = bool(self.info & 1)
        return ((child, turns, flip), *self.where("ref", 0x20, 0x10, 8))

    def text(self):
        value = self.name(0x40, 0x20, "text")
        layer, kind = self.field(1, "textlayer", self.src.unsigned), self.field(2, "texttype", self.src.unsigned)
        return ((value, layer, kind), *self.where("text", 0x10, 8, 4))

    def geometry(self, kind: int):
        src, f = self.src, self.field
        layer, datatype = f(1, "layer", src.unsigned), f(2, "datatype", src.unsigned)
        width = None
        if kind == 20:
            w = f(0x40, "w", src.unsigned)
            if self.info & 0x80:  # a square
                self.modal["h"] = w
            h = f(0x20, "h", src.unsigned)
            points = [(0, 0), (0, h), (w, h), (w, 0)]
        elif kind == 21:
            points = f(0x20, "outline", lambda: src.points(True))
        elif kind == 22:
            width = 2 * f(0x40, "half width", src.unsigned)
            if self.info & 0x80:
                ends = src.unsigned()
                for bits in (ends >> 2 & 3, ends & 3):
                    if bits == 3:
                        src.signed()
            points = f(0x20, "line", lambda: src.points(False))
        elif kind < 26:
            w, h = f(0x40, "w", src.unsigned), f(0x20, "h", src.unsigned)
            a = src.signed() if kind != 25 else 0
            b = src.signed() if kind != 24 else 0
            if self.info & 0x80:
                points = [(0, max(a, 0)), (0, h + min(b, 0)), (w, h - max(b, 0)), (w, -min(a, 0))]
            else:
                points = [(max(a, 0), h), (w + min(b, 0), h), (w - max(b, 0), 0), (-min(a, 0), 0)]
        elif kind == 26:
            which = f(0x80, "compact type", src.unsigned)
            if which >= len(_COMPACT):
                raise LayoutError("a compact trapezoid of no known type")
            used = _COMPACT[which]
            w = f(0x40, "w", src.unsigned) if "w" in used or self.info & 0x40 else 0
            h = f(0x20, "h", src.unsigned) if "h" in used or self.info & 0x20 else 0
            size = {"0": 0, "w": w, "h": h, "w-h": w - h, "h-w": h - w, "2w": 2 * w, "2h": 2 * h}
            points = [tuple(size[v] for v in p.split(",")) for p in used.split()]
        else:
            r = f(0x20, "radius", src.unsigned)
            points = [(round(r * math.cos(math.pi * i / 32)), round(r * math.sin(math.pi * i / 32))) for i in range(64)]
        return ((points, layer, datatype, width), *self.where("geometry", 0x10, 8, 4))

    def skip(self, kind: int) -> None:
        """Names of properties and layers, properties, and extensions."""
        src = self.src
        if 7 <= kind <= 10:
            src.string()
            if kind % 2 == 0:
                src.unsigned()
        elif kind in (11, 12):
            src.string()
            for _ in range(2):
                for _ in range((0, 1, 1, 1, 2)[min(src.unsigned(), 4)]):
                    src.unsigned()
        elif kind == 28:
            info = src.take(1)[0]
            if info & 4:
                src.unsigned() if info & 2 else src.string()
            if not info & 8:
                for _ in range(src.unsigned() if info >> 4 == 15 else info >> 4):
                    value = src.unsigned()
                    if value < 8:
                        src.real(value)
                    elif value < 10 or value > 12:
                        src.unsigned()
                    else:
                        src.string()
        elif kind in (30, 31, 32):
            src.unsigned(), src.string()
            if kind == 31:
                src.unsigned()
        elif kind == 33:
            self.info = src.take(1)[0]
            src.unsigned()
            self.field(1, "layer", src.unsigned), self.field(2, "datatype", src.unsigned)
            src.string()
            self.where("geometry", 0x10, 8, 4)
        elif kind != 29:
            raise LayoutError(f"a record of no known type, {kind}")


def _places(rep) -> Iterator[tuple[int, int]]:
    if rep is None:
        yield 0, 0
    elif isinstance(rep, list):
        yield from rep
    else:
        cols, rows, (cx, cy), (rx, ry) = rep
        yield from ((c * cx + r * rx, c * cy + r * ry) for r in range(rows) for c in range(cols))


def parse_oasis(data: bytes, start: str | None = None, whole: bool = True) -> Iterator[dict]:
    """Elements of a file, or of a piece of one that begins in a cell and uses no values or numbered names of others; returns the cell in which it ends."""
    names = {"cell": {}, "text": {}}
    reader = _Reader(data, start, whole)
    items = reader.items() if whole else list(reader.items())  # a piece is small
    for item in items:
        if item[0] != "element":
            names[item[0]][item[1]] = item[2]

    def named(table: str, key):
        if isinstance(key, str):
            return key
        if key not in names[table]:
            raise LayoutError(f"no name of number {key}")
        return names[table][key]

    for item in _Reader(data).items() if whole else items:
        if item[0] != "element":
            continue
        _, cell, what, x, y, rep = item
        cell = named("cell", cell)
        if len(what) == 3 and isinstance(what[2], bool):
            child, rot, flip = what
            grid = rep if isinstance(rep, tuple) else (1, 1, (0, 0), (0, 0))
            cols, rows, (cx, cy), (rx, ry) = grid
            for dx, dy in _places(rep if isinstance(rep, list) else None):
                yield element(cell, "ref", [(x + dx, y + dy)], child=named("cell", child), rot=rot, mirror=flip, cols=cols, rows=rows, col_x=cx, col_y=cy, row_x=rx, row_y=ry)
            continue
        for dx, dy in _places(rep):
            if len(what) == 3:
                yield element(cell, "text", [(x + dx, y + dy)], what[1], what[2], text=named("text", what[0]))
            else:
                points, layer, datatype, width = what
                points = [(px + x + dx, py + y + dy) for px, py in points]
                yield shape(cell, points, layer, datatype) if width is None else element(cell, "path", points, layer, datatype, width=width)
    return None if reader.cell is None else named("cell", reader.cell)


# --- writer --------------------------------------------------------------------------------------


def unsigned(v: int) -> bytes:
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes([*out, v])


def signed(v: int) -> bytes:
    return unsigned(abs(v) << 1 | (v < 0))


def _delta(x: int, y: int) -> bytes:
    return unsigned(abs(x) << 2 | (x < 0) << 1 | 1) + signed(y)


def _string(s: str) -> bytes:
    raw = s.encode()
    return unsigned(len(raw)) + raw


def oasis_head(per_micron: int = 1000) -> bytes:
    return MAGIC + b"\x01" + _string("1.0") + b"\x00" + unsigned(per_micron) + bytes(13)


def oasis_tail() -> bytes:
    """The end record has 256 bytes; no checksum."""
    return b"\x02" + unsigned(252) + bytes(252) + b"\x00"


def oasis_open(name: str) -> bytes:
    return b"\x0e" + _string(name)


def oasis_cell(name: str, elements: list[dict], threshold: int = 256) -> bytes:
    """One cell; its elements are compressed where they take `threshold` bytes or more."""
    return oasis_open(name) + oasis_elements(elements, threshold)


def oasis_elements(elements: list[dict], threshold: int = 256) -> bytes:
    """Elements that give all their values, so that none rests on those before it."""
    out = []
    for e in elements:
        kind, points = e["kind"], [tuple(p) for p in e["points"]]
        (x, y), rest = points[0], points[1:]
        place = signed(x) + signed(y)
        steps = b"".join(_delta(b[0] - a[0], b[1] - a[1]) for a, b in zip(points, rest, strict=False))
        steps = b"\x04" + unsigned(len(rest)) + steps
        if kind == "ref":
            cols, rows, again = e["cols"], e["rows"], b""
            if cols > 1 and rows > 1:
                again = b"\x08" + unsigned(cols - 2) + unsigned(rows - 2) + _delta(e["col_x"], e["col_y"]) + _delta(e["row_x"], e["row_y"])
            elif cols > 1 or rows > 1:
                step = (e["col_x"], e["col_y"]) if cols > 1 else (e["row_x"], e["row_y"])
                again = b"\x09" + unsigned(max(cols, rows) - 2) + _delta(*step)
            out.append(bytes([17, 0xB0 | (8 if again else 0) | e["rot"] << 1 | bool(e["mirror"])]) + _string(e["child"]) + place + again)
            continue
        layer = unsigned(e["layer"]) + unsigned(e["datatype"])
        if kind == "box":
            (x1, y1) = points[1]
            out.append(bytes([20, 0x7B]) + layer + unsigned(x1 - x) + unsigned(y1 - y) + place)
        elif kind == "polygon":
            out.append(bytes([21, 0x3B]) + layer + steps + place)
        elif kind == "path":
            if e["width"] % 2:
                raise LayoutError("a path of odd width has no form in OASIS")
            out.append(bytes([22, 0xFB]) + layer + unsigned(e["width"] // 2) + b"\x05" + steps + place)
        else:
            out.append(bytes([19, 0x5B]) + _string(e["text"]) + layer + place)
    body = b"".join(out)
    if len(body) >= threshold:
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = packer.compress(body) + packer.flush()
        body = b"\x22\x00" + unsigned(len(body)) + unsigned(len(packed)) + packed
    return body
