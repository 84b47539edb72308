"""Layers made of the test tables' keys, by fixed arithmetic: 40 x 40 cells of 250 m over 10 km x 10 km.

The same arithmetic stands in ``oracle`` as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import exclusions, grid, spatial, terrain
from ..operators.scorers import Context

BBOX, SIZE = (0.0, 0.0, 10000.0, 10000.0), 250.0
PIXELS, RESOLUTION, ORIGIN, NODATA = 200, 50.0, (0.0, 10000.0), -9999.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession) -> DataFrame:
    return grid.generate(spark, BBOX, SIZE)


def _d(expression: str, name: str):
    return F.expr(expression).cast("double").alias(name)


def civic(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("civic_id"))
    return k.select("civic_id", _d("(civic_id * 7919) % 10000", "x"), _d("(civic_id * 104729) % 10000", "y"))


HIGHWAYS = ["motorway", "primary", "residential", "track", "footway", "path", "cycleway"]


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("line_id"))
    rows = k.select("line_id", _d("(line_id * 1237) % 10000", "x1"), _d("(line_id * 3571) % 10000", "y1"))
    ends = {"x2": F.expr("x1 + (line_id % 7 - 3) * 150.0D"), "y2": F.expr("y1 + (line_id % 5 - 2) * 200.0D")}
    return rows.withColumns(ends).withColumn("highway", F.get(F.array(*map(F.lit, HIGHWAYS)), (F.col("line_id") % 8).cast("int")))


CODES = ["WARV50", "WARV59", "WACO25", "WALK40", "WATO30", "WARVIS", "WARV50", None, "WADM10", "WARV30"]


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of all orders, over 40 km x 40 km with the study area in the middle, as a province's layer would be."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("line_id"))
    rows = keys.withColumn("k", F.col("line_id"))
    rows = rows.withColumns({"x1": _d("(line_id * 811) % 40000 - 15000", "x1"), "y1": _d("(line_id * 3163) % 40000 - 15000", "y1")})
    rows = rows.withColumns({"x2": F.expr("x1 + (k % 9 - 4) * 120.0D"), "y2": F.expr("y1 + (k % 7 - 3) * 160.0D")})
    rows = rows.withColumns(
        {
            "FEAT_CODE": F.element_at(F.array(*map(F.lit, CODES)), (F.col("k") % 10 + 1).cast("int")),
            "LINE_CLASS": F.expr("if(k % 5 = 4, null, k % 4 + 1)").cast("int"),
            "MINZ": F.expr("if(k % 3 = 0, null, cast(k % 50 as double))"),
            "MAXZ": F.expr("if(k % 3 = 0, null, cast(k % 50 + k % 13 as double))"),
            "drainage_area_km2": F.expr("if(k % 6 = 0, (k % 400) / 4.0D, null)"),
            "part": F.lit(0),
            "seg": F.lit(0),
        }
    )
    return spatial.with_lengths(rows.drop("k"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    a, b, p, s = (F.col(n).cast("long").alias(n) for n in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    rows = rows.select(a, b, p, s, F.col("l_quantity").cast("double").alias("q"))
    return rows.select(
        _d("(l_orderkey * 7919 + l_linenumber * 977 + l_partkey * 31) % 10000 + 0.5D", "x"),
        _d("(l_orderkey * 104729 + l_linenumber * 3571 + l_suppkey * 17) % 10000 + 0.5D", "y"),
        F.expr("q * 6 - 10").alias("z"),
    )


def pixels(spark: SparkSession, side: int = PIXELS) -> DataFrame:
    """Smooth hills with steps, and a block of missing heights."""
    rows = spark.range(side * side).select(F.expr(f"id div {side}").alias("row"), F.expr(f"id % {side}").alias("col"))
    height = F.expr("cast((row * 7 + col * 3 + (row * col) % 17 + (row div 20) * (col div 25) * 9) % 150 + 2 as double)")
    hole = F.expr("row between 50 and 59 and col between 70 and 79")
    return rows.select(
        "row", "col", (F.col("col") * RESOLUTION + RESOLUTION / 2).alias("x"), (ORIGIN[1] - F.col("row") * RESOLUTION - RESOLUTION / 2).alias("y"),
        F.when(hole, F.lit(NODATA)).otherwise(height).alias("z"),
    )


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("parcel_id"))
    rows = keys.withColumn("k", F.col("parcel_id")).withColumns({"xmin": _d("(k * 433) % 9000", "xmin"), "ymin": _d("(k * 719) % 9000", "ymin")})
    rows = rows.withColumns({"xmax": F.expr("xmin + (k * 37) % 1301 + 20.0D"), "ymax": F.expr("ymin + (k * 53) % 1301 + 20.0D")})
    return grid.polygons_of_rectangles(rows.drop("k"))


def _zone(spark, sf_dir, name, key, formulas) -> DataFrame:
    rows = table(spark, sf_dir, name).select(F.col(key).cast("long").alias("feature_id"))
    x, y, w, h = formulas
    rows = rows.withColumns({"xmin": _d(x, "xmin"), "ymin": _d(y, "ymin")})
    return grid.polygons_of_rectangles(rows.withColumns({"xmax": F.col("xmin") + _d(w, "w"), "ymax": F.col("ymin") + _d(h, "h")}))


def protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zone(spark, sf_dir, "nation", "n_nationkey", ("(feature_id * 1723) % 9000 + 13", "(feature_id * 2917) % 9000 + 17", "300 + (feature_id % 6) * 150", "280 + (feature_id % 4) * 210"))


def flood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zone(spark, sf_dir, "region", "r_regionkey", ("(feature_id * 2311) % 9000 + 29", "(feature_id * 1259) % 9000 + 31", "700 + feature_id * 130", "640 + feature_id * 170"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exclusions.load(spark, protected(spark, sf_dir), flood(spark, sf_dir))


def _ring(*points) -> str:
    """A closed ring as SQL, of corners given as expressions."""
    return "array(" + ", ".join(f"struct(cast({x} as double) as x, cast({y} as double) as y)" for x, y in (*points, points[0])) + ")"


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle with a hole, and a right triangle beside it, as one feature, for every supplier."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("feature_id"))
    size = {"x": _d("(feature_id * 1723) % 8000 + 13", "x"), "y": _d("(feature_id * 2917) % 8000 + 17", "y"), "w": _d("300 + (feature_id % 6) * 152", "w"), "h": _d("280 + (feature_id % 4) * 212", "h")}
    box = _ring(("x", "y"), ("x + w", "y"), ("x + w", "y + h"), ("x", "y + h"))
    hole = _ring(("x + w / 4", "y + h / 4"), ("x + w / 4", "y + h / 2"), ("x + w / 2", "y + h / 2"), ("x + w / 2", "y + h / 4"))
    corner = _ring(("x + w + 50", "y"), ("x + w + 350", "y"), ("x + w + 50", "y + 400"))
    rows = rows.withColumns(size).select("feature_id", F.expr(f"array(array({box}, {hole}), array({corner}))").alias("geom"))
    rows = rows.withColumns({"edges": g.polygon_edges(F.col("geom")), "exclusion_reason": F.lit("protected_area")})
    return rows.withColumns(dict(zip(("xmin", "ymin", "xmax", "ymax"), g.edges_bounds(F.col("edges")), strict=True)))


KINDS = ["Urban area", "Forest", "Commercial", "Wetland", None, "RESIDENTIAL"]


def land_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _zone(spark, sf_dir, "supplier", "s_suppkey", ("(feature_id * 3643) % 9500 + 7", "(feature_id * 5231) % 9500 + 11", "200 + (feature_id % 5) * 90", "150 + (feature_id % 7) * 70"))
    return rows.withColumn("land_type", F.element_at(F.array(*map(F.lit, KINDS)), (F.col("feature_id") % 6 + 1).cast("int")))


def relief(spark: SparkSession) -> DataFrame:
    return terrain.slope_aspect(pixels(spark), RESOLUTION)


def context(spark: SparkSession, sf_dir: str) -> Context:
    return Context(
        bbox=BBOX, size=SIZE, pixels=pixels(spark), terrain=relief(spark), origin=ORIGIN, resolution=RESOLUTION, nodata=NODATA,
        streams=streams(spark, sf_dir), roads=roads(spark, sf_dir), civic=civic(spark, sf_dir),
    )
