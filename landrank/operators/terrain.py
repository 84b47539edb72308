"""Terrain from a pixel table (row, col, x, y, z): slope, aspect, classes, buildable ground, resampling, sampling.

``slope_aspect`` takes differences along rows and columns with two windows; it suits rasters of any width whose rows and
columns fit a task.  ``tiled_slope_aspect`` does the same over tiles with a margin of one pixel and one shuffle, for large
rasters.  Both have one rule: a difference is taken over the neighbours that there are, both, one, or none (then it is 0),
at the rim of the raster as beside missing pixels; a missing height that is kept as a number takes part as that number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored
from ..functions.thresholds import BUILDABLE_SLOPE

FLAT = 1e-10
TILE = 256


def slope_of(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))


def aspect_of(dx: Column, dy: Column) -> Column:
    """Azimuth of the way down, clockwise from north; -1 on flat ground. dy is along rows, which run south."""
    turned = F.degrees(F.atan2(-dx, dy))
    return F.when((F.abs(dx) < FLAT) & (F.abs(dy) < FLAT), F.lit(-1.0)).when(turned < 0, turned + 360.0).otherwise(turned)


def _difference(along: str, across: str, resolution: float) -> Column:
    """Central difference where both neighbours are there, one-sided where one is."""
    order = Window.partitionBy(across).orderBy(along)
    before = F.when(F.lag(along).over(order) == F.col(along) - 1, F.lag("z").over(order))
    after = F.when(F.lead(along).over(order) == F.col(along) + 1, F.lead("z").over(order))
    steps = F.when(before.isNotNull(), 1).otherwise(0) + F.when(after.isNotNull(), 1).otherwise(0)
    rise = F.coalesce(after, F.col("z")) - F.coalesce(before, F.col("z"))
    return F.when(steps > 0, rise / (steps * float(resolution))).otherwise(F.lit(0.0))


def slope_aspect(pixels: DataFrame, resolution: float) -> DataFrame:
    """Adds slope and aspect in degrees."""
    both = pixels.withColumn("__dx", _difference("col", "row", resolution)).withColumn("__dy", _difference("row", "col", resolution))
    return both.withColumns({"slope": slope_of(F.col("__dx"), F.col("__dy")), "aspect": aspect_of(F.col("__dx"), F.col("__dy"))}).drop("__dx", "__dy")


def differences(z: np.ndarray, resolution: float, axis: int) -> np.ndarray:
    """The same difference over an array; NaN: no pixel."""
    z = np.moveaxis(z, axis, 0)
    gap = np.full((1, *z.shape[1:]), np.nan)
    before, after = np.concatenate([gap, z[:-1]]), np.concatenate([z[1:], gap])
    steps = np.isfinite(before).astype(float) + np.isfinite(after)
    rise = np.where(np.isfinite(after), after, z) - np.where(np.isfinite(before), before, z)
    return np.moveaxis(np.where(steps > 0, rise / np.maximum(steps * resolution, 1e-300), 0.0), 0, axis)


def tiled_slope_aspect(pixels: DataFrame, resolution: float, tile: int = TILE) -> DataFrame:
    """The same by tiles: pixels next to a tile's border go to both tiles, then each tile is one array."""
    near = lambda k: F.array_distinct(F.array(*(F.expr(f"({k} + {d}) div {tile}") for d in (-1, 0, 1))))
    kept = ["row", "col", *(n for n in ("x", "y") if n in pixels.columns), "z"]
    rows = pixels.select(*kept).withColumn("__tr", F.explode(near("row"))).withColumn("__tc", F.explode(near("col")))

    def one(key, part):
        r0, c0 = int(part["row"].min()), int(part["col"].min())
        z = np.full((int(part["row"].max()) - r0 + 1, int(part["col"].max()) - c0 + 1), np.nan)
        z[part["row"] - r0, part["col"] - c0] = part["z"]
        dy, dx = (differences(z, resolution, axis) for axis in (0, 1))
        slope = np.degrees(np.arctan(np.sqrt(dx * dx + dy * dy)))
        aspect = np.degrees(np.arctan2(-dx, dy))
        aspect = np.where(aspect < 0, aspect + 360, aspect)
        aspect[(np.abs(dx) < FLAT) & (np.abs(dy) < FLAT)] = -1
        own = part[(part["row"] // tile == key[0]) & (part["col"] // tile == key[1])]
        at = (own["row"] - r0, own["col"] - c0)
        return own[kept].assign(slope=slope[at], aspect=aspect[at])

    kinds = ", ".join(f"{n} {'long' if n in ('row', 'col') else 'double'}" for n in kept)
    return rows.groupBy("__tr", "__tc").applyInPandas(one, f"{kinds}, slope double, aspect double")


def solar_class(slope: Column, aspect: Column) -> Column:
    """2 for flat ground and gentle slopes to the south, 1 for acceptable ones, else 0; bounds are inclusive."""
    return (
        F.when(slope < 5, 2)
        .when(aspect.between(135, 225) & slope.between(5, 35), 2)
        .when(aspect.between(90, 270) & slope.between(5, 45), 1)
        .otherwise(0)
    )


def buildable(slope: Column) -> Column:
    return (slope <= BUILDABLE_SLOPE).cast("int")


def sample(points: DataFrame, pixels: DataFrame, x: Column, y: Column, origin: tuple[float, float], resolution: float, nodata: float | None) -> DataFrame:
    """Adds ``elevation``, the height of the pixel that holds the point; null outside the raster and for missing heights."""
    at = points.withColumns(
        {"__col": F.floor((x - origin[0]) / float(resolution)), "__row": F.floor((F.lit(float(origin[1])) - y) / float(resolution))}
    )
    heights = pixels.select(F.col("row").cast("long").alias("__row"), F.col("col").cast("long").alias("__col"), F.col("z").alias("elevation"))
    if nodata is not None:
        heights = heights.where(F.col("elevation") != float(nodata))
    return at.join(heights, ["__row", "__col"], "left").drop("__row", "__col")


def resample(pixels: DataFrame, grid: DataFrame, origin: tuple[float, float], resolution: float) -> DataFrame:
    """Bilinear heights at the points of ``grid`` (row, col, x, y): four neighbours by equi-join, one weighted sum.

    Neighbours that are missing leave their weight to the others, as long as any is there.
    """
    u = (F.col("x") - float(origin[0])) / float(resolution) - 0.5
    v = (F.lit(float(origin[1])) - F.col("y")) / float(resolution) - 0.5
    near = grid.withColumns({"__u": u, "__v": v})
    corners = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))).alias("k")
    near = near.select("*", corners).withColumns({"__row": F.floor("__v") + F.col("k.i"), "__col": F.floor("__u") + F.col("k.j")})
    weight = (1 - F.abs(F.col("__u") - F.col("__col"))) * (1 - F.abs(F.col("__v") - F.col("__row")))
    heights = pixels.select(F.col("row").cast("long").alias("__row"), F.col("col").cast("long").alias("__col"), F.col("z").alias("__z"))
    hit = near.withColumn("__w", weight).join(heights, ["__row", "__col"])
    total = F.sum("__w")
    return hit.groupBy("row", "col", "x", "y").agg((F.sum(F.col("__w") * F.col("__z")) / F.when(total > 0, total)).alias("z")).where("z is not null")


def crop(pixels: DataFrame, bbox) -> DataFrame:
    xmin, ymin, xmax, ymax = map(float, bbox)
    return pixels.where(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax))


def contour_segments(pixels: DataFrame, interval: float = 50.0, nodata: float | None = None) -> DataFrame:
    """elevation, major, x1, y1, x2, y2: where levels cross the quads of four neighbouring pixels (marching squares).

    Two crossed sides give a segment; in a saddle, four sides give two, paired by the mean of the corners.  Quads with a
    missing corner have none; levels at or below 0 are left out.  A quad is put together by one aggregation, no window.
    """
    solid = pixels.where(F.col("z") != float(nodata)) if nodata is not None else pixels
    corner = [(0, 0), (0, 1), (1, 1), (1, 0)]
    each = F.explode(F.array(*(F.struct((F.col("row") - i).alias("r"), (F.col("col") - j).alias("q"), F.lit(k).alias("k")) for k, (i, j) in enumerate(corner))))
    rows = solid.select("x", "y", "z", each.alias("e")).select("x", "y", "z", "e.*")
    picked = [F.max(F.when(F.col("k") == k, F.col(n))).alias(f"{n}{k}") for k in range(4) for n in ("x", "y", "z")]
    quads = rows.groupBy("r", "q").agg(*picked, F.count("*").alias("n")).where("n = 4")
    low, high = F.least("z0", "z1", "z2", "z3"), F.greatest("z0", "z1", "z2", "z3")
    first, last = F.floor(low / interval).cast("int") + 1, F.floor(high / interval).cast("int")
    first = F.greatest(first, F.lit(1))
    levels = quads.where(first <= last).withColumn("step", F.explode(F.sequence(first, last))).withColumn("elevation", F.col("step") * float(interval))
    sides = [(0, 1), (1, 2), (3, 2), (0, 3)]
    points = []
    for a, b in sides:
        za, zb = F.col(f"z{a}"), F.col(f"z{b}")
        crossed = (za >= F.col("elevation")) != (zb >= F.col("elevation"))
        t = (F.col("elevation") - za) / F.when(za != zb, zb - za)
        points.append(
            F.when(crossed, F.struct((F.col(f"x{a}") + t * (F.col(f"x{b}") - F.col(f"x{a}"))).alias("x"), (F.col(f"y{a}") + t * (F.col(f"y{b}") - F.col(f"y{a}"))).alias("y")))
        )
    top, right, bottom, left = points
    hits = F.filter(F.array(*points), lambda p: p.isNotNull())
    saddle = F.size(hits) == 4
    mean_in = (F.col("z0") + F.col("z1") + F.col("z2") + F.col("z3")) / 4 >= F.col("elevation")
    joined_corner = mean_in == (F.col("z0") >= F.col("elevation"))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    two = F.when(joined_corner, F.array(pair(top, right), pair(bottom, left))).otherwise(F.array(pair(top, left), pair(right, bottom)))
    found = F.when(saddle, two).when(F.size(hits) == 2, F.array(pair(F.element_at(hits, 1), F.element_at(hits, 2))))
    out = levels.select("elevation", F.explode(found).alias("s"))
    return out.select("elevation", (F.col("elevation") % 100 == 0).alias("major"), F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def joined_lines(lines: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Lines joined where their ends meet, two by two; rings end where they begin."""
    ends: dict[tuple[float, float], list[int]] = {}
    for i, line in enumerate(lines):
        for end in (line[0], line[-1]):
            ends.setdefault(end, []).append(i)
    used, out = [False] * len(lines), []

    def grown(line: list[tuple[float, float]]) -> list[tuple[float, float]]:
        """The line with all that can be joined to its last point."""
        while line[0] != line[-1]:
            other = next((j for j in ends[line[-1]] if not used[j]), None)
            if other is None:
                break
            used[other] = True
            more = lines[other]
            line += more[1:] if more[0] == line[-1] else more[-2::-1]
        return line

    for i, line in enumerate(lines):
        if not used[i]:
            used[i] = True
            out.append(grown(grown(list(line))[::-1]))
    return out


def contour_lines(pixels: DataFrame, interval: float = 50.0, nodata: float | None = None, least: int = 5, tile: float = 5000.0) -> DataFrame:
    """elevation, major, parts: contour segments joined to lines of ``least`` points or more.

    Segments are joined tile by tile.  An end well within its tile, with nothing to be joined to, is dead: it lies at the
    rim of the raster or beside a missing pixel.  Rings and lines with two dead ends are whole; the others are joined again
    by tiles of twice the side, until one holds all that are left.
    """
    segments = contour_segments(pixels, interval, nodata).where("x1 <> x2 or y1 <> y2")
    ends = [F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (1, 2)]
    lines = segments.select("elevation", F.array(*ends).alias("points"), F.array(F.lit(False), F.lit(False)).alias("dead"), F.lit(False).alias("whole"))
    bounds = [f(n).alias(f"{f.__name__}_{n}") for n in ("x", "y", "col") for f in (F.min, F.max)]
    box = pixels.agg(*bounds).first()
    x0, y0, side = box["min_x"], box["min_y"], None if box["min_x"] is None else max(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"])
    pixel = (box["max_x"] - x0) / (box["max_col"] - box["min_col"]) if side and box["max_col"] > box["min_col"] else 1.0
    kinds = "elevation double, points array<struct<x:double,y:double>>, dead array<boolean>, whole boolean"

    def joiner(size: float, first: bool, last: bool):
        def one(key, part):
            import pandas as pd

            left, low, edge = (x0 or 0.0) + key[1] * size, (y0 or 0.0) + key[2] * size, 2 * pixel
            told = [[(p["x"], p["y"]) for p in points] for points in part["points"]]
            dead = {line[k] for line, flags in zip(told, part["dead"], strict=True) for k in (0, -1) if flags[k]}

            def ended(p) -> bool:
                return p in dead or first and left + edge < p[0] < left + size - edge and low + edge < p[1] < low + size - edge

            rows = []
            for line in joined_lines(told):
                flags = [ended(line[0]), ended(line[-1])]
                rows.append((key[0], [{"x": x, "y": y} for x, y in line], flags, last or line[0] == line[-1] or all(flags)))
            return pd.DataFrame(rows, columns=["elevation", "points", "dead", "whole"])

        return one

    first = True
    while True:
        last = not side or tile > side
        middle = F.expr("cast(size(points) div 2 as int)")  # a line goes to the tile of its middle segment
        x, y = ((F.element_at("points", middle)[n] + F.element_at("points", middle + 1)[n]) / 2 for n in ("x", "y"))
        at = [F.floor((v - (o or 0.0)) / F.lit(float(tile))).alias(n) for v, o, n in ((x, x0, "tx"), (y, y0, "ty"))]
        key = [F.lit(0).cast("long").alias("tx"), F.lit(0).cast("long").alias("ty")] if last else at
        lines = stored(lines, "contours")
        open_ = lines.where("not whole").select("elevation", "points", "dead", *key)
        lines = lines.where("whole").unionByName(open_.groupBy("elevation", "tx", "ty").applyInPandas(joiner(tile, first, last), kinds))
        if last:
            major = (F.col("elevation") % 100 == 0).alias("major")
            return lines.where(F.size("points") >= least).select("elevation", major, F.array("points").alias("parts"))
        tile, first = 2 * tile, False
