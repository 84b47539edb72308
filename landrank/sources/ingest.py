"""Raw files to stored layers: read, turn to working coordinates, cut to the study area, write parquet.

A layer that is stored already is left alone.  Personal geodatabases and PBF extracts have no reader here: convert them to
GeoPackage or GeoJSON first; a GeoJSON road file counts as such an extract.
"""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import projection
from ..operators import spatial, terrain
from . import raster, vector
from .config import Config

log = logging.getLogger("landrank")

# Layer -> folder, kind, endings, required, description.
EXPECTED = {
    "dem": ("dem", "raster", [".tif", ".tiff"], True, "height model"),
    "streams": ("hydro", "vector", [".shp", ".gpkg", ".geojson"], True, "streams"),
    "land_cover": ("land-cover", "vector", [".shp", ".gpkg", ".geojson"], True, "land cover"),
    "roads": ("roads", "vector", [".shp", ".gpkg", ".geojson", ".pbf"], True, "roads"),
    "protected_areas": ("exclusions", "vector", [".shp", ".gpkg", ".geojson"], True, "protected ground"),
    "buildings": ("buildings", "vector", [".shp", ".gpkg", ".geojson"], False, "buildings"),
    "flood": ("exclusions", "vector", [".shp", ".gpkg", ".geojson"], False, "flood zones"),
    "parcels": ("parcels", "vector", [".shp", ".gpkg", ".gdb"], False, "parcels"),
    "civic": ("civic", "vector", [".shp", ".gpkg", ".geojson"], False, "addresses"),
}
METRES_PER_DEGREE = 111195.0


def stored_path(config: Config, layer: str) -> Path:
    return config.processed / f"{layer}.parquet"


def load(spark: SparkSession, config: Config, layer: str) -> DataFrame | None:
    """A stored layer; None where there is none."""
    path = stored_path(config, layer)
    return spark.read.parquet(str(path)) if path.exists() else None


def _keep(rows: DataFrame, config: Config, layer: str) -> Path:
    path = stored_path(config, layer)
    rows.write.mode("ignore").option("compression", "zstd").parquet(str(path))
    log.info("Stored %s", path)
    return path


def _found(folder: Path, *patterns: str, deep: bool = False) -> list[Path]:
    """Files by pattern, patterns in order of preference, names sorted within each."""
    return [p for pattern in patterns for p in sorted(folder.rglob(pattern) if deep else folder.glob(pattern))]


def dem(spark: SparkSession, config: Config) -> Path | None:
    """The finest height model there is, cut to the study area, with its header beside it."""
    path = stored_path(config, "dem")
    if path.exists():
        return path
    files = _found(config.raw / "hrdem", "*.tif") or _found(config.raw / "dem", "cdem_*.tif", "*.tif")
    if not files:
        log.warning("No DEM found under %s", config.raw)
        return None
    head, pixels = raster.read_header(spark, str(files[0])), raster.read(spark, str(files[0]))
    xmin, ymin, xmax, ymax = map(float, config.bbox)
    source = head.epsg or config.epsg
    origin, resolution = (head.left, head.top), head.resolution[0]
    if head.nodata is not None:
        pixels = pixels.where(F.col("z") != head.nodata)
    if source != config.epsg:  # bilinear, from a grid over the study area back to the source
        if source == 4326:
            resolution *= METRES_PER_DEGREE
        rows, columns = int(-(-(ymax - ymin) // resolution)), int(-(-(xmax - xmin) // resolution))
        cells = spark.range(rows * columns).select(F.expr(f"id div {columns}").alias("row"), F.expr(f"id % {columns}").alias("col"))
        x, y = xmin + (F.col("col") + 0.5) * resolution, ymax - (F.col("row") + 0.5) * resolution
        u, v = projection.transform(x, y, config.epsg, source)
        found = terrain.resample(pixels, cells.select("row", "col", u.alias("x"), v.alias("y")), origin, head.resolution[0])
        pixels, origin = found.select("row", "col", x.alias("x"), y.alias("y"), "z"), (xmin, ymax)
    pixels = terrain.crop(pixels, config.bbox)
    # rows and columns of the cut start at its corner
    first = (int((xmin - origin[0]) // resolution), int((origin[1] - ymax) // resolution))
    first = (max(first[0], 0), max(first[1], 0))
    pixels = pixels.withColumns({"row": F.col("row") - first[1], "col": F.col("col") - first[0]})
    kept = {"origin": [origin[0] + first[0] * resolution, origin[1] - first[1] * resolution], "resolution": resolution, "nodata": None}
    out = _keep(pixels, config, "dem")
    (config.processed / "dem.json").write_text(json.dumps(kept))
    return out


def dem_header(config: Config) -> dict | None:
    path = config.processed / "dem.json"
    return json.loads(path.read_text()) if path.exists() else None


def _lines(rows: DataFrame, config: Config, clip: bool) -> DataFrame:
    """Segments of lines that meet the study area, with the attributes of their line; cut to it where asked."""
    inside = spatial.in_box(rows, config.bbox).where("parts is not null").withColumnRenamed("feature_id", "line_id")
    cut = spatial.segments(inside)
    if clip:
        cut = spatial.with_lengths(spatial.clip_segments(cut.drop("len", "before", "length"), config.bbox))
        # numbers of parts and segments start at 0 again
        order = F.dense_rank().over(_by("line_id", "part", "seg")) - 1
        cut = cut.withColumn("seg", order).withColumn("part", F.lit(0))
    attributes = inside.drop("geom", "parts", "edges", "x", "y", "xmin", "ymin", "xmax", "ymax")
    return cut.join(attributes, "line_id")


def _by(key: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


def streams(spark: SparkSession, config: Config) -> Path | None:
    files = _found(config.raw / "hydro", "*.shp", "*.gpkg", "*.geojson")
    return _layer(spark, config, "streams", files, lambda rows: _lines(rows, config, True))


def roads(spark: SparkSession, config: Config) -> Path | None:
    """Extracts: rows with a highway class, cut to the study area. Other files: as they are, where they meet it."""
    extracts = _found(config.raw / "roads", "*.osm.pbf", "*.geojson")
    if extracts:
        return _layer(spark, config, "roads", extracts, lambda rows: _lines(rows.where(F.col("highway").isNotNull()), config, True))
    return _layer(spark, config, "roads", _found(config.raw / "roads", "*.gpkg", "*.shp"), lambda rows: _lines(rows, config, False))


def buildings(spark: SparkSession, config: Config) -> Path | None:
    files = _found(config.raw / "buildings", "*.gpkg", "*.shp", deep=True)
    return _layer(spark, config, "buildings", files, lambda rows: spatial.polygons_in_box(rows, config.bbox))


def land_cover(spark: SparkSession, config: Config) -> Path | None:
    files = _found(config.raw / "land-cover", "*POLY*.shp", "*.shp", "*.gpkg", deep=True)
    return _layer(spark, config, "land_cover", files, lambda rows: spatial.polygons_in_box(rows, config.bbox))


def crown_land(spark: SparkSession, config: Config) -> Path | None:
    files = _found(config.raw / "crown-land", "*.shp", "*.gpkg", deep=True)
    return _layer(spark, config, "crown_land", files, lambda rows: spatial.polygons_in_box(rows, config.bbox))


def protected_areas(spark: SparkSession, config: Config) -> Path | None:
    """The first file under exclusions; an empty cut is not stored."""
    files = _found(config.raw / "exclusions", "*.shp", deep=True)
    return _layer(spark, config, "protected_areas", files, lambda rows: spatial.polygons_in_box(rows, config.bbox), empty=False)


def _layer(spark, config: Config, name: str, files: list[Path], cut, empty: bool = True) -> Path | None:
    path = stored_path(config, name)
    if path.exists():
        return path
    if not files:
        log.warning("No files for %s under %s", name, config.raw)
        return None
    rows = cut(vector.read(spark, str(files[0]), config.epsg))
    if not empty and rows.isEmpty():
        log.warning("%s has nothing in the study area", name)
        return None
    return _keep(rows, config, name)


LAYERS = {"dem": dem, "streams": streams, "roads": roads, "buildings": buildings, "land_cover": land_cover, "crown_land": crown_land, "protected_areas": protected_areas}


def run(spark: SparkSession, config: Config) -> dict[str, Path | None]:
    config.processed.mkdir(parents=True, exist_ok=True)
    out = {name: read(spark, config) for name, read in LAYERS.items()}
    log.info("Ingested %d of %d layers", sum(p is not None for p in out.values()), len(out))
    return out


def check(spark: SparkSession, config: Config) -> dict[str, dict]:
    """For each expected raw layer: missing, readable with its facts, or the error on reading it."""
    out: dict[str, dict] = {}
    for name, (folder, kind, endings, required, text) in EXPECTED.items():
        files = [p for e in endings for p in sorted((config.raw / folder).glob(f"*{e}"))]
        if not files:
            out[name] = {"status": "MISSING (required)" if required else "MISSING (optional)", "description": text}
            continue
        facts: dict = {"path": str(files[0])}
        try:
            if kind == "raster":
                head = raster.read_header(spark, str(files[0]))
                right, bottom = head.left + head.width * head.resolution[0], head.top - head.height * head.resolution[1]
                facts |= {"crs": f"EPSG:{head.epsg}", "bounds": (head.left, bottom, right, head.top), "resolution": head.resolution, "shape": (head.height, head.width)}
            else:
                rows = vector.read(spark, str(files[0]), config.epsg)
                first = rows.limit(1).collect()
                shape = "unknown" if not first else "Polygon" if first[0]["geom"] else "LineString" if first[0]["parts"] else "Point"
                own = [c for c in rows.columns if c not in ("feature_id", "geom", "parts", "edges", "x", "y", "xmin", "ymin", "xmax", "ymax", "kind")]
                facts |= {"crs": f"EPSG:{vector.epsg_of(str(files[0]))}", "geometry_type": shape, "columns": [*own, "geometry"], "feature_count": rows.count()}
            facts["status"] = "ok"
        except Exception as e:  # noqa: BLE001  any failure to read is the finding
            facts |= {"status": "error", "error": str(e).splitlines()[0]}
            log.warning("Failed to read %s: %s", files[0], facts["error"])
        out[name] = facts | {"description": text}
    log.info("Data check complete: %d/%d layers found and readable", sum(r["status"] == "ok" for r in out.values()), len(out))
    return out
