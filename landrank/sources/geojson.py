"""GeoJSON: reading feature collections into layers, writing cells and layers as features."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import projection

DEEP = "array<array<array<array<double>>>>"


def read(spark: SparkSession, path: str, target: int = 2961, source: int = 4326) -> DataFrame:
    """A row for each feature: feature_id, kind, its properties, and the geometry by kind.

    Polygons have geom, edges and bounds; lines have parts; points x and y.  Geometry columns of other kinds are null.
    """
    raw = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    # geometries of several depths cannot share a type, so coordinates are read as text and parsed by kind
    text = spark.read.option("wholetext", True).text(path)
    shape = "struct<features:array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>>"
    rows = text.select(F.posexplode(F.from_json("value", shape)["features"]).alias("feature_id", "f"))
    names = []
    if "features" in raw.columns:
        inner = raw.schema["features"].dataType.elementType
        names = inner["properties"].dataType.names if "properties" in inner.names and hasattr(inner["properties"].dataType, "names") else []
    kind, coordinates = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    deep = F.when(kind == "MultiPolygon", coordinates).when(kind == "Polygon", F.concat(F.lit("["), coordinates, F.lit("]")))
    flat = F.when(kind == "MultiLineString", coordinates).when(kind == "LineString", F.concat(F.lit("["), coordinates, F.lit("]")))
    rows = rows.select(
        F.col("feature_id").cast("long").alias("feature_id"), kind.alias("kind"), *(F.col("f.properties")[n].alias(n) for n in names),
        F.from_json(deep, DEEP).alias("__deep"), F.from_json(flat, "array<array<array<double>>>").alias("__flat"),
        F.from_json(F.when(kind == "Point", coordinates), "array<double>").alias("__point"),
    )

    def moved(p: Column) -> Column:
        x, y = projection.transform(p[0], p[1], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    geom = F.transform("__deep", lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, moved)))
    parts = F.transform("__flat", lambda part: F.transform(part, moved))
    rows = rows.withColumns({"geom": geom, "parts": parts, "__at": F.when(F.col("__point").isNotNull(), moved(F.col("__point")))})
    rows = rows.withColumns({"edges": g.polygon_edges(F.col("geom")), "x": F.col("__at.x"), "y": F.col("__at.y")})
    bounds = dict(zip(("xmin", "ymin", "xmax", "ymax"), g.edges_bounds(F.col("edges")), strict=True))
    return rows.withColumns(bounds).drop("__deep", "__flat", "__point", "__at")


def rectangle_ring() -> Column:
    corners = [("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin")]
    return F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corners))


def features(rows: DataFrame, ring: Callable[[], Column], properties: list[str], source: int, digits: int | None = None) -> DataFrame:
    """cell_id and ``feature``, a GeoJSON text, of rows whose geometry is one ring; coordinates in degrees."""
    def turned(p: Column) -> Column:
        x, y = projection.transform(p["x"], p["y"], source, 4326)
        return F.array(F.round(x, digits), F.round(y, digits)) if digits is not None else F.array(x, y)

    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(ring(), turned)).alias("coordinates"))
    own = F.struct(*(F.col(n) for n in properties))
    text = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), own.alias("properties")), {"ignoreNullFields": "false"})
    return rows.select("cell_id", text.alias("feature"))


def write(found: DataFrame, path: str) -> None:
    """One FeatureCollection file, a line for each feature, streamed to the driver partition by partition."""
    with Path(path).open("w", encoding="utf-8") as out:
        out.write('{"type": "FeatureCollection", "features": [')
        for i, row in enumerate(found.orderBy("cell_id").toLocalIterator()):
            out.write((",\n" if i else "\n") + row["feature"])
        out.write("\n]}\n")


def collection(texts: list[str]) -> dict:
    return {"type": "FeatureCollection", "features": [json.loads(x) for x in texts]}
