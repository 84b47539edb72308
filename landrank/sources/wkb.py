"""Well-known binary geometry to points, lines and polygons, and back; plain Python for the file readers."""

from __future__ import annotations

import struct

# Geometry codes.
POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = 1, 2, 3, 4, 5, 6, 7


class _Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.order = data, at, "<"

    def number(self, kind: str):
        value = struct.unpack_from(self.order + kind, self.data, self.at)[0]
        self.at += struct.calcsize(kind)
        return value

    def point(self, dims: int):
        values = struct.unpack_from(f"{self.order}{dims}d", self.data, self.at)
        self.at += 8 * dims
        return values[:2]

    def points(self, dims: int):
        return [self.point(dims) for _ in range(self.number("I"))]

    def geometry(self) -> tuple[int, list]:
        """(code, coordinates); heights and measures are left out."""
        self.order = "<" if self.data[self.at] else ">"
        self.at += 1
        code = self.number("I")
        extra = (code & 0x80000000 != 0) + (code & 0x40000000 != 0)
        if code & 0x20000000:
            self.number("I")
        code &= 0x1FFFFFFF
        extra += {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
        code, dims = code % 1000, 2 + extra
        if code == POINT:
            return code, self.point(dims)
        if code == LINE:
            return code, self.points(dims)
        if code == POLYGON:
            return code, [self.points(dims) for _ in range(self.number("I"))]
        if MULTIPOINT <= code <= COLLECTION:
            return code, [self.geometry() for _ in range(self.number("I"))]
        raise ValueError(f"geometry code {code}")


def _parts(code: int, value, kind: int) -> list:
    """Coordinates of all parts of one kind, through multi-geometries and collections."""
    if code == kind:
        return [value]
    return [x for c, v in value for x in _parts(c, v, kind)] if code >= MULTIPOINT else []


def read(data: bytes) -> dict:
    """parts (lines), geom (polygons of rings) and x, y (a single point); null for other kinds."""
    code, value = _Reader(data).geometry()
    dots = lambda ring: [{"x": float(x), "y": float(y)} for x, y in ring]
    lines, polygons, points = (_parts(code, value, k) for k in (LINE, POLYGON, POINT))
    point = points[0] if points else (None, None)
    return {
        "parts": [dots(p) for p in lines] or None,
        "geom": [[dots(r) for r in p] for p in polygons] or None,
        "x": point[0],
        "y": point[1],
    }


def polygon(rings: list[list[tuple[float, float]]]) -> bytes:
    out = struct.pack("<BII", 1, POLYGON, len(rings))
    for ring in rings:
        out += struct.pack("<I", len(ring)) + b"".join(struct.pack("<2d", *p) for p in ring)
    return out


def polygons(parts: list[list[list[tuple[float, float]]]]) -> bytes:
    """A multipolygon: polygons of rings."""
    return struct.pack("<BII", 1, MULTIPOLYGON, len(parts)) + b"".join(map(polygon, parts))


def line(points: list[tuple[float, float]]) -> bytes:
    return struct.pack("<BII", 1, LINE, len(points)) + b"".join(struct.pack("<2d", *p) for p in points)


def point(x: float, y: float) -> bytes:
    return struct.pack("<BI2d", 1, POINT, x, y)
