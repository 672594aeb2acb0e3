"""Element rows shared by the readers of layout files."""

from __future__ import annotations


class LayoutError(ValueError):
    """The file does not follow its format."""


def element(cell: str, kind: str, points, layer=None, datatype=None, **more) -> dict:
    return {"cell": cell, "kind": kind, "layer": layer, "datatype": datatype, "points": [(int(x), int(y)) for x, y in points], **more}


def shape(cell: str, points: list, layer, datatype) -> dict:
    """A polygon, or a box where four points make an upright rectangle."""
    if len(points) > 1 and points[0] == points[-1]:
        points = points[:-1]
    if len(points) < 3:
        raise LayoutError("a polygon of fewer than three points")
    xs, ys = {p[0] for p in points}, {p[1] for p in points}
    if len(points) == 4 and len(xs) == len(ys) == 2 and all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(points, points[1:] + points[:1], strict=True)):
        return element(cell, "box", [(min(xs), min(ys)), (max(xs), max(ys))], layer, datatype)
    return element(cell, "polygon", points, layer, datatype)
