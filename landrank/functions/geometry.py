"""Plane geometry as Column expressions.

Rectangles are four doubles, segments four, points two.  A polygon is ``edges``, an array of structs (x1, y1, x2, y2) over
all its rings, with the bounding box beside it; a line is an array of parts, each an array of structs (x, y).  Distances
use sqrt of sums of squares, so that SQL written the same way gives the same doubles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
PARTS = f"array<array<{POINT}>>"
POLYGONS = f"array<array<array<{POINT}>>>"
EDGES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def length(dx, dy) -> Column:
    return F.sqrt(c(dx) * c(dx) + c(dy) * c(dy))


def along(px, py, x1, y1, x2, y2) -> Column:
    """Where on the segment, 0 to 1, lies the point nearest to (px, py)."""
    px, py, x1, y1, x2, y2 = map(c, (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = ((px - x1) * dx + (py - y1) * dy) / F.when(square > 0, square)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(0.0))


def point_segment(px, py, x1, y1, x2, y2) -> Column:
    """Distance of a point from a closed segment."""
    t = along(px, py, x1, y1, x2, y2)
    x1, y1 = c(x1), c(y1)
    return length(c(px) - x1 - t * (c(x2) - x1), c(py) - y1 - t * (c(y2) - y1))


def point_rectangle(px, py, xmin, ymin, xmax, ymax) -> Column:
    px, py, zero = c(px), c(py), F.lit(0.0)
    return length(F.greatest(c(xmin) - px, zero, px - c(xmax)), F.greatest(c(ymin) - py, zero, py - c(ymax)))


def clip_range(x1, y1, x2, y2, xmin, ymin, xmax, ymax) -> tuple[Column, Column, Column]:
    """The part of a segment in a closed rectangle: first and last parameter, and whether there is one."""
    x1, y1, x2, y2, xmin, ymin, xmax, ymax = map(c, (x1, y1, x2, y2, xmin, ymin, xmax, ymax))
    dx, dy = x2 - x1, y2 - y1
    first, last, inside = F.lit(0.0), F.lit(1.0), F.lit(True)
    for step, room in ((-dx, x1 - xmin), (dx, xmax - x1), (-dy, y1 - ymin), (dy, ymax - y1)):
        at = room / F.when(step != 0, step)
        first = F.greatest(first, F.when(step < 0, at))
        last = F.least(last, F.when(step > 0, at))
        inside = inside & ((step != 0) | (room >= 0))
    return first, last, inside & (first <= last)


def segment_meets_rectangle(x1, y1, x2, y2, xmin, ymin, xmax, ymax) -> Column:
    return clip_range(x1, y1, x2, y2, xmin, ymin, xmax, ymax)[2]


def segment_rectangle(x1, y1, x2, y2, xmin, ymin, xmax, ymax) -> Column:
    """Distance of a segment from a closed rectangle."""
    corners = [(xmin, ymin), (xmin, ymax), (xmax, ymin), (xmax, ymax)]
    apart = F.least(
        *(point_segment(x, y, x1, y1, x2, y2) for x, y in corners),
        point_rectangle(x1, y1, xmin, ymin, xmax, ymax),
        point_rectangle(x2, y2, xmin, ymin, xmax, ymax),
    )
    return F.when(segment_meets_rectangle(x1, y1, x2, y2, xmin, ymin, xmax, ymax), F.lit(0.0)).otherwise(apart)


def rectangle_overlap(a: tuple, b: tuple) -> Column:
    """Area that two rectangles (xmin, ymin, xmax, ymax) share."""
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = (tuple(map(c, r)) for r in (a, b))
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(zero, F.least(ay1, by1) - F.greatest(ay0, by0))


def rings_to_edges(rings: Column) -> Column:
    """Edges of an array of rings; rings may or may not repeat their first point."""
    def of(ring):
        return F.transform(
            ring,
            lambda p, i: F.struct(
                p["x"].alias("x1"),
                p["y"].alias("y1"),
                F.element_at(ring, (i + 1) % F.size(ring) + 1)["x"].alias("x2"),
                F.element_at(ring, (i + 1) % F.size(ring) + 1)["y"].alias("y2"),
            ),
        )

    return F.flatten(F.transform(rings, of))


def polygon_edges(geom: Column) -> Column:
    """Edges of a (multi)polygon given as polygons of rings of points."""
    return rings_to_edges(F.flatten(geom))


def rectangle_edges(xmin, ymin, xmax, ymax) -> Column:
    xmin, ymin, xmax, ymax = map(c, (xmin, ymin, xmax, ymax))
    turn = [(xmin, ymin, xmax, ymin), (xmax, ymin, xmax, ymax), (xmax, ymax, xmin, ymax), (xmin, ymax, xmin, ymin)]
    return F.array(*(F.struct(a.alias("x1"), b.alias("y1"), d.alias("x2"), e.alias("y2")) for a, b, d, e in turn))


def _side(e, px, py) -> Column:
    return (e["x2"] - e["x1"]) * (py - e["y1"]) - (px - e["x1"]) * (e["y2"] - e["y1"])


def on_boundary(px, py, edges: Column) -> Column:
    px, py = c(px), c(py)
    return F.exists(
        edges,
        lambda e: (_side(e, px, py) == 0)
        & px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])),
    )


def crossings_odd(px, py, edges: Column) -> Column:
    """Even-odd rule: whether a ray to the right crosses an odd number of edges; holes need no special care."""
    px, py = c(px), c(py)
    met = F.filter(edges, lambda e: ((e["y1"] > py) != (e["y2"] > py)) & ((_side(e, px, py) > 0) == (e["y2"] > e["y1"])))
    return F.size(met) % 2 == 1


def point_within(px, py, edges: Column) -> Column:
    """Strictly inside: the boundary is outside."""
    return crossings_odd(px, py, edges) & ~on_boundary(px, py, edges)


def point_touches(px, py, edges: Column) -> Column:
    """Inside or on the boundary."""
    return crossings_odd(px, py, edges) | on_boundary(px, py, edges)


def edges_area(edges: Column) -> Column:
    """Shoelace sum; rings of holes run the other way round than outer rings."""
    return F.abs(F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["x1"] * e["y2"] - e["x2"] * e["y1"]))) / 2


def edges_bounds(edges: Column) -> list[Column]:
    """xmin, ymin, xmax, ymax."""
    return [
        F.array_min(F.transform(edges, lambda e: e["x1"])),
        F.array_min(F.transform(edges, lambda e: e["y1"])),
        F.array_max(F.transform(edges, lambda e: e["x1"])),
        F.array_max(F.transform(edges, lambda e: e["y1"])),
    ]


def edges_centroid(edges: Column) -> tuple[Column, Column]:
    """Centroid of the area."""
    def moment(k: str) -> Column:
        return F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e[f"{k}1"] + e[f"{k}2"]) * (e["x1"] * e["y2"] - e["x2"] * e["y1"]))

    twice = F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["x1"] * e["y2"] - e["x2"] * e["y1"]))
    return moment("x") / (3 * F.nullif(twice, F.lit(0.0))), moment("y") / (3 * F.nullif(twice, F.lit(0.0)))


def every(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)
