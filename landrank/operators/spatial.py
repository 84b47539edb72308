"""Spatial joins as equi-joins on buckets with an exact residual predicate.

Catalyst turns a bare inequality join into a nested loop, so both sides get the buckets of a square lattice that they can
meet in, and are joined on the bucket: a hash join, which Spark broadcasts or shuffles by size and splits where a bucket is
hot.  A feature that spans buckets has a row in each; where a sum follows, pairs are made distinct first.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g

BUCKET = 500.0
DOT = pa.struct([("x", pa.float64()), ("y", pa.float64())])


def _floor(x: Column, size: float) -> Column:
    return F.floor(x / float(size)).cast("long")


def spread(df: DataFrame, xmin, ymin, xmax, ymax, size: float = BUCKET, reach: float = 0.0) -> DataFrame:
    """A row for each bucket (__bx, __by) that the box, widened by ``reach``, touches."""
    lo_x, lo_y = _floor(g.c(xmin) - reach, size), _floor(g.c(ymin) - reach, size)
    hi_x, hi_y = _floor(g.c(xmax) + reach, size), _floor(g.c(ymax) + reach, size)
    return df.withColumn("__bx", F.explode(F.sequence(lo_x, hi_x))).withColumn("__by", F.explode(F.sequence(lo_y, hi_y)))


def points_in_polygons(points: DataFrame, polygons: DataFrame, x: str, y: str, closed: bool = False, how: str = "inner", size: float = BUCKET, few: bool | None = None) -> DataFrame:
    """Points with the polygons that hold them: the point's columns, then the polygon's.

    ``polygons`` has edges and xmin, ymin, xmax, ymax.  A point lies in one bucket, so each pair comes once.  Catalyst's
    size of the polygons leaves out the buckets that they are spread over, so that many of them can look few.  ``few``
    says whether the points are few, and keeps polygons from being broadcast: few points are, else both are shuffled.
    """
    left = points.withColumns({"__bx": _floor(F.col(x), size), "__by": _floor(F.col(y), size)})
    right = spread(polygons, "xmin", "ymin", "xmax", "ymax", size)
    names = {n: f"__p_{n}" for n in right.columns if n in left.columns}
    right = right.withColumnsRenamed(names)
    px, py = F.col(x), F.col(y)

    def r(n: str) -> Column:
        return F.col(names.get(n, n))

    box = (px >= r("xmin")) & (px <= r("xmax")) & (py >= r("ymin")) & (py <= r("ymax"))
    exact = g.point_touches(px, py, r("edges")) if closed else g.point_within(px, py, r("edges"))
    same = (F.col("__bx") == F.col("__p___bx")) & (F.col("__by") == F.col("__p___by"))
    if few is not None:
        left, right = (F.broadcast(left), right) if few else (left, right.hint("merge"))
    out = left.join(right, same & box & exact, how).drop("__bx", "__by", "__p___bx", "__p___by")
    kept = [n for k, n in names.items() if not k.startswith("__b")]
    return out.drop(*[n for n in kept if n in ("__p_xmin", "__p_ymin", "__p_xmax", "__p_ymax")])


def rectangle_overlaps(cells: DataFrame, rectangles: DataFrame, size: float = BUCKET) -> DataFrame:
    """cell_id, feature_id, share: area that a cell and a rectangle share, over the cell's; pairs that share any, each once."""
    left = spread(cells.select("cell_id", "xmin", "ymin", "xmax", "ymax"), "xmin", "ymin", "xmax", "ymax", size)
    right = spread(rectangles.select("feature_id", *(F.col(n).alias(f"f_{n}") for n in ("xmin", "ymin", "xmax", "ymax"))), "f_xmin", "f_ymin", "f_xmax", "f_ymax", size)
    area = g.rectangle_overlap(("xmin", "ymin", "xmax", "ymax"), ("f_xmin", "f_ymin", "f_xmax", "f_ymax"))
    whole = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    pairs = left.join(right, ["__bx", "__by"]).where(_first_bucket(size) & (area > 0) & (whole > 0))
    return pairs.select("cell_id", "feature_id", (area / whole).alias("share"))


def _first_bucket(size: float) -> Column:
    """Of the buckets that a pair meets in, the one with the lower left corner of the boxes' common part: no pair twice."""
    return (F.col("__bx") == _floor(F.greatest("xmin", "f_xmin"), size)) & (F.col("__by") == _floor(F.greatest("ymin", "f_ymin"), size))


def polygon_overlaps(cells: DataFrame, polygons: DataFrame, size: float = BUCKET) -> DataFrame:
    """The same for polygons of any shape, given as ``geom``: rings are clipped to the cell, holes taken off."""
    left = spread(cells.select("cell_id", "xmin", "ymin", "xmax", "ymax"), "xmin", "ymin", "xmax", "ymax", size)
    right = spread(polygons.select("feature_id", "geom", *(F.col(n).alias(f"f_{n}") for n in ("xmin", "ymin", "xmax", "ymax"))), "f_xmin", "f_ymin", "f_xmax", "f_ymax", size)
    near = (F.col("f_xmin") < F.col("xmax")) & (F.col("f_xmax") > F.col("xmin")) & (F.col("f_ymin") < F.col("ymax")) & (F.col("f_ymax") > F.col("ymin"))
    pairs = left.join(right, ["__bx", "__by"]).where(near & _first_bucket(size))
    whole = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    share = clipped_area("geom", "xmin", "ymin", "xmax", "ymax") / whole
    return pairs.where(whole > 0).select("cell_id", "feature_id", share.alias("share")).where("share > 0")


def clip_ring(ring: list[tuple[float, float]], box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """A ring cut to a rectangle, side by side; parts may be joined along the rectangle's sides, which have no area."""
    for axis, bound, keep_above in ((0, box[0], True), (1, box[1], True), (0, box[2], False), (1, box[3], False)):
        out = []
        for (a, b) in zip(ring, ring[1:] + ring[:1], strict=True):
            a_in, b_in = (p[axis] >= bound if keep_above else p[axis] <= bound for p in (a, b))
            if a_in:
                out.append(a)
            if a_in != b_in:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                cut = [a[k] + t * (b[k] - a[k]) for k in (0, 1)]
                cut[axis] = bound
                out.append(tuple(cut))
        ring = out
        if not ring:
            return []
    return ring


def ring_area(ring: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2 if ring else 0.0


def _points(ring) -> list[tuple[float, float]]:
    out = [(p["x"], p["y"]) for p in ring]
    return out[:-1] if len(out) > 1 and out[0] == out[-1] else out


def clipped_area(geom, xmin, ymin, xmax, ymax) -> Column:
    """Area of (multi)polygons within rectangles."""

    def area(polygons, box):
        rings = [[ring_area(clip_ring(_points(ring), box)) for ring in polygon] for polygon in polygons]
        return sum(r[0] - sum(r[1:]) for r in rings if r)

    def run(geom: pa.Array, xmin: pa.Array, ymin: pa.Array, xmax: pa.Array, ymax: pa.Array) -> pa.Array:
        columns = (c.to_pylist() for c in (geom, xmin, ymin, xmax, ymax))
        return pa.array([area(p, box) for p, *box in zip(*columns, strict=True)], pa.float64())

    return F.arrow_udf(run, "double")(*map(g.c, (geom, xmin, ymin, xmax, ymax)))


def clipped_polygons(geom, xmin, ymin, xmax, ymax) -> Column:
    """(Multi)polygons cut to rectangles; polygons without a part inside go."""

    def cut(polygons, box):
        out = []
        for polygon in polygons:
            rings = [r for r in (clip_ring(_points(ring), box) for ring in polygon) if len(r) > 2]
            if rings:
                out.append([[{"x": x, "y": y} for x, y in [*r, r[0]]] for r in rings])
        return out

    def run(geom: pa.Array, xmin: pa.Array, ymin: pa.Array, xmax: pa.Array, ymax: pa.Array) -> pa.Array:
        columns = (c.to_pylist() for c in (geom, xmin, ymin, xmax, ymax))
        return pa.array([cut(p, box) for p, *box in zip(*columns, strict=True)], pa.list_(pa.list_(pa.list_(DOT))))

    return F.arrow_udf(run, g.POLYGONS)(*map(g.c, (geom, xmin, ymin, xmax, ymax)))


def segments(lines: DataFrame, key: str = "line_id", parts: str = "parts") -> DataFrame:
    """Lines as segments: key, part, seg, x1, y1, x2, y2, len, before (length of the line up to the segment, parts in order)."""
    part = lines.select(key, F.posexplode(parts).alias("part", "points"))
    points = F.col("points")
    cut = F.transform(
        F.sequence(F.lit(1), F.size(points) - 1),
        lambda i: F.struct(
            (i - 1).alias("seg"), F.element_at(points, i)["x"].alias("x1"), F.element_at(points, i)["y"].alias("y1"),
            F.element_at(points, i + 1)["x"].alias("x2"), F.element_at(points, i + 1)["y"].alias("y2"),
        ),
    )
    rows = part.where(F.size(points) > 1).select(key, "part", F.inline(cut))
    return with_lengths(rows, key)


def with_lengths(rows: DataFrame, key: str = "line_id") -> DataFrame:
    from pyspark.sql import Window

    rows = rows.withColumn("len", g.length(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    order = Window.partitionBy(key).orderBy("part", "seg")
    return rows.withColumns(
        {
            "before": F.coalesce(F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "length": F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )


def clip_segments(rows: DataFrame, bbox) -> DataFrame:
    """Segments cut to a box; those outside go. Lengths are to be taken anew after it."""
    xmin, ymin, xmax, ymax = map(float, bbox)
    first, last, meets = g.clip_range("x1", "y1", "x2", "y2", F.lit(xmin), F.lit(ymin), F.lit(xmax), F.lit(ymax))
    at = {"__t0": first, "__t1": last}
    x, y = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    cut = {
        "__x1": F.col("x1") + F.col("__t0") * x, "__y1": F.col("y1") + F.col("__t0") * y,
        "__x2": F.col("x1") + F.col("__t1") * x, "__y2": F.col("y1") + F.col("__t1") * y,
    }
    ends = ["x1", "y1", "x2", "y2"]
    done = rows.where(meets).withColumns(at).withColumns(cut).drop(*ends, "__t0", "__t1")
    return done.withColumnsRenamed({f"__{n}": n for n in ends})


def in_box(df: DataFrame, bbox) -> DataFrame:
    """Rows whose bounding box meets the box: plain comparisons on stored columns, which parquet prunes by."""
    xmin, ymin, xmax, ymax = map(float, bbox)
    return df.where((F.col("xmax") >= xmin) & (F.col("xmin") <= xmax) & (F.col("ymax") >= ymin) & (F.col("ymin") <= ymax))


def polygons_in_box(df: DataFrame, bbox) -> DataFrame:
    """Polygons that meet the box: bounding boxes first, then an edge or corner that does."""
    xmin, ymin, xmax, ymax = map(float, bbox)
    box = tuple(F.lit(v) for v in (xmin, ymin, xmax, ymax))
    edge = F.exists("edges", lambda e: g.segment_meets_rectangle(e["x1"], e["y1"], e["x2"], e["y2"], *box))
    return in_box(df, bbox).where(edge | g.point_within(F.lit(xmin), F.lit(ymin), F.col("edges")))


def nearest_within(cells: DataFrame, features: DataFrame, reach: float) -> DataFrame:
    """cell_id, distance: 0 if a segment meets the cell, else the least distance of its centre from one, up to ``reach``.

    ``features``: segments x1, y1, x2, y2 (points as segments without length).  Cells go to the buckets around their centre,
    segments to those of their box, and the minimum needs no distinct pairs; cells without a segment in reach have no row.
    """
    box = [F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2")]
    right = spread(features.select("x1", "y1", "x2", "y2"), *box, size=reach)
    reached = [F.least(F.col("xmin"), F.col("cx") - reach), F.least(F.col("ymin"), F.col("cy") - reach), F.greatest(F.col("xmax"), F.col("cx") + reach), F.greatest(F.col("ymax"), F.col("cy") + reach)]
    left = spread(cells.select("cell_id", "xmin", "ymin", "xmax", "ymax", "cx", "cy"), *reached, size=reach)
    # boxes first: most pairs of a bucket are out of reach
    near = (F.least("x1", "x2") <= F.greatest(F.col("xmax"), F.col("cx") + reach)) & (F.greatest("x1", "x2") >= F.least(F.col("xmin"), F.col("cx") - reach))
    near = near & (F.least("y1", "y2") <= F.greatest(F.col("ymax"), F.col("cy") + reach)) & (F.greatest("y1", "y2") >= F.least(F.col("ymin"), F.col("cy") - reach))
    pairs = left.join(right, ["__bx", "__by"]).where(near)
    meets = g.segment_meets_rectangle("x1", "y1", "x2", "y2", "xmin", "ymin", "xmax", "ymax")
    apart = g.point_segment("cx", "cy", "x1", "y1", "x2", "y2")
    distance = F.when(meets, F.lit(0.0)).when(apart <= reach, apart)
    return pairs.select("cell_id", distance.alias("distance")).where("distance is not null").groupBy("cell_id").agg(F.min("distance").alias("distance"))


def lines_near_cells(cells: DataFrame, rows: DataFrame, reach: float, key: str = "line_id", size: float = 250.0) -> DataFrame:
    """cell_id, key of the lines that come within ``reach`` of a cell, each pair once."""
    box = [F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2")]
    right = spread(rows.select(key, "x1", "y1", "x2", "y2"), *box, size=size)
    left = spread(cells.select("cell_id", "xmin", "ymin", "xmax", "ymax"), "xmin", "ymin", "xmax", "ymax", size=size, reach=reach)
    near = g.segment_rectangle("x1", "y1", "x2", "y2", "xmin", "ymin", "xmax", "ymax") <= reach
    return left.join(right, ["__bx", "__by"]).where(near).select("cell_id", key).distinct()


def simplified_points(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas-Peucker without recursion: points farther than the tolerance from their chord stay."""
    if len(points) < 3:
        return points
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        (x1, y1), (x2, y2) = points[a], points[b]
        dx, dy = x2 - x1, y2 - y1
        square = dx * dx + dy * dy
        far, at = -1.0, -1
        for i in range(a + 1, b):
            px, py = points[i]
            t = max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / square)) if square else 0.0
            d = (px - x1 - t * dx) ** 2 + (py - y1 - t * dy) ** 2
            if d > far:
                far, at = d, i
        if far > tolerance * tolerance:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [points[i] for i in sorted(keep)]


def simplify(parts: Column, tolerance: float) -> Column:
    """Each part of a line, or ring of a polygon, with fewer points."""

    def run(values: pa.Array) -> pa.Array:
        def one(part):
            return [{"x": x, "y": y} for x, y in simplified_points([(p["x"], p["y"]) for p in part], tolerance)]

        return pa.array([None if v is None else [one(p) for p in v] for v in values.to_pylist()], pa.list_(pa.list_(DOT)))

    return F.arrow_udf(run, g.PARTS)(parts)
