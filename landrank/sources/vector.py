"""GeoPackage and shapefile as Spark data sources, and one entry for layers of any readable format.

Both formats are single files that do not split, so a file is one partition; a folder of files is read in parallel.  The
native store is parquet: read once, write parquet, and scans prune and split.
"""

from __future__ import annotations

import os
import sqlite3
import struct
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import geometry as g
from ..functions import projection
from ..functions.storage import importable
from . import wkb

SHAPE = f"geom {g.POLYGONS}, parts {g.PARTS}, x double, y double"
KINDS = {"INTEGER": "long", "INT": "long", "MEDIUMINT": "long", "SMALLINT": "long", "TINYINT": "long", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "BOOLEAN": "boolean"}


def _files(path: str, ending: str) -> list[str]:
    p = Path(path)
    return sorted(str(x) for x in p.rglob(f"*{ending}")) if p.is_dir() else [str(p)]


def _row(values: list, shape: dict) -> tuple:
    return (*values, shape["geom"], shape["parts"], shape["x"], shape["y"])


class File(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


#: Ids count within a file; the number of the file in its folder stands above these bits.
ID_BITS = 40


class _Reader(DataSourceReader):
    def __init__(self, files, rows, options):
        self.files, self.rows, self.options = files, rows, options

    def partitions(self):
        return [File(f, i) for i, f in enumerate(self.files)]

    def read(self, partition):
        first = partition.number << ID_BITS
        for i, *values in self.rows(partition.path, self.options):
            yield (first + i, *values)


class GeoPackage(DataSource):
    """format("geopackage"), option layer (default: the first feature table)."""

    @classmethod
    def name(cls):
        return "geopackage"

    def schema(self):
        _, _, columns, _ = gpkg_layer(_files(self.options["path"], ".gpkg")[0], self.options.get("layer"))
        return "feature_id long" + "".join(f", `{n}` {k}" for n, k in columns) + f", {SHAPE}"

    def reader(self, schema):
        return _Reader(_files(self.options["path"], ".gpkg"), gpkg_rows, dict(self.options))


def gpkg_layer(path: str, layer: str | None = None) -> tuple[str, str, list[tuple[str, str]], int]:
    """Table, geometry column, (name, type) of the other columns, EPSG code."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        found = db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns ORDER BY rowid").fetchall()
        picked = [f for f in found if layer is None or f[0] == layer]
        if not picked:
            raise ValueError(f"{path} has no layer {layer or 'with features'}")
        table, geometry, srs = picked[0]
        info = db.execute(f'PRAGMA table_info("{table}")').fetchall()
    columns = [(n, KINDS.get(kind.split("(")[0].upper(), "string")) for _, n, kind, _, _, key in info if n != geometry and not key]
    return table, geometry, columns, srs


def gpkg_geometry(blob: bytes | None) -> dict:
    """A GeoPackage geometry: header, optional envelope, WKB."""
    if blob is None or blob[3] & 16:
        return {"geom": None, "parts": None, "x": None, "y": None}
    return wkb.read(blob[8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] :])


def gpkg_rows(path: str, options: dict):
    table, geometry, columns, _ = gpkg_layer(path, options.get("layer"))
    names = "".join(f', "{n}"' for n, _ in columns)
    casts = [{"long": int, "double": float, "boolean": bool, "string": str}[k] for _, k in columns]
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        for i, (blob, *values) in enumerate(db.execute(f'SELECT "{geometry}"{names} FROM "{table}"')):
            yield _row([i, *(None if v is None else c(v) for v, c in zip(values, casts, strict=True))], gpkg_geometry(blob))


def rings_of(edges) -> list[list[tuple[float, float]]]:
    """Closed rings of edges that run ring by ring."""
    rings: list = []
    for e in edges:
        start, end = (e["x1"], e["y1"]), (e["x2"], e["y2"])
        if start == end:
            continue
        if not rings or len(rings[-1]) > 1 and rings[-1][0] == rings[-1][-1] or rings[-1][-1] != start:
            rings.append([start])
        rings[-1].append(end)
    return [r if r[0] == r[-1] else [*r, r[0]] for r in rings]


def _holds(ring: list[tuple[float, float]], x: float, y: float) -> bool:
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def polygons_of(rings: list[list[tuple[float, float]]]) -> list[list[list[tuple[float, float]]]]:
    """Rings as polygons: a ring that begins within the outer ring of one before is a hole of it."""
    out: list = []
    for ring in rings:
        home = next((p for p in out if _holds(p[0], *ring[0])), None)
        if home is None:
            out.append([ring])
        else:
            home.append(ring)
    return out


def write_gpkg(rows: DataFrame, path: str, layer: str, geometry: str = "edges", srs: int = 2961) -> None:
    """One GeoPackage file from rows with rings or rectangles; rows stream to the driver, which writes them."""
    columns = [(n, k) for n, k in rows.dtypes if k in ("bigint", "int", "double", "string", "boolean")]
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT", "boolean": "BOOLEAN"}
    Path(path).unlink(missing_ok=True)
    with sqlite3.connect(path) as db:
        db.execute("PRAGMA application_id = 1196444487")
        db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT)")
        db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', '')", (f"EPSG:{srs}", srs, srs))
        db.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, description TEXT, last_change TEXT, min_x REAL, min_y REAL, max_x REAL, max_y REAL, srs_id INTEGER)")
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (layer, layer, srs))
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER)")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geometry', 'MULTIPOLYGON', ?, 0, 0)", (layer, srs))
        db.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, geometry BLOB{"".join(f", {chr(34)}{n}{chr(34)} {kinds[k]}" for n, k in columns)})')
        head = b"GP\x00\x01" + struct.pack("<i", srs)
        for row in rows.toLocalIterator():
            if geometry in rows.columns:
                rings = rings_of(row[geometry] or [])
            else:
                left, low, right, top = (row[n] for n in ("xmin", "ymin", "xmax", "ymax"))
                rings = [[(left, low), (right, low), (right, top), (left, top), (left, low)]]
            blob = head + wkb.polygons(polygons_of(rings))
            db.execute(f'INSERT INTO "{layer}" VALUES (NULL{", ?" * (len(columns) + 1)})', (blob, *(row[n] for n, _ in columns)))


class Shapefile(DataSource):
    """format("shapefile"): .shp with its .dbf beside it."""

    @classmethod
    def name(cls):
        return "shapefile"

    def schema(self):
        fields = dbf_fields(_files(self.options["path"], ".shp")[0])
        return "feature_id long" + "".join(f", `{n}` {k}" for n, k, _, _ in fields) + f", {SHAPE}"

    def reader(self, schema):
        return _Reader(_files(self.options["path"], ".shp"), shp_rows, dict(self.options))


def _beside(path: str, ending: str) -> str | None:
    stem = os.path.splitext(path)[0]
    return next((stem + e for e in (ending, ending.upper()) if os.path.exists(stem + e)), None)


def dbf_fields(path: str) -> list[tuple[str, str, int, int]]:
    """(name, type, width, offset) of the attributes of a shapefile."""
    table = _beside(path, ".dbf")
    if table is None:
        return []
    with open(table, "rb") as f:
        head = f.read(struct.unpack("<H", f.read(10)[8:10])[0] - 10)
    out, offset = [], 1
    for at in range(22, len(head) - 1, 32):
        name, kind, width, places = head[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(head[at + 11]), head[at + 16], head[at + 17]
        if head[at] == 0x0D:
            break
        out.append((name, "double" if kind == "F" or kind == "N" and places else "long" if kind == "N" else "boolean" if kind == "L" else "string", width, offset))
        offset += width
    return out


def _dbf_value(raw: bytes, kind: str, encoding: str = "utf-8"):
    text = raw.decode(encoding, "replace").strip(" \0")
    if not text or text.startswith("*"):
        return None
    if kind == "boolean":
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    return int(float(text)) if kind == "long" else float(text) if kind == "double" else text


def _shape(data: bytes) -> dict:
    """One record: points, lines and polygons, with or without heights and measures."""
    out: dict = {"geom": None, "parts": None, "x": None, "y": None}
    kind = struct.unpack_from("<i", data)[0] % 10
    if kind == 1:
        out["x"], out["y"] = struct.unpack_from("<2d", data, 4)
    elif kind in (3, 5):
        count, total = struct.unpack_from("<2i", data, 36)
        starts = [*struct.unpack_from(f"<{count}i", data, 44), total]
        flat = struct.unpack_from(f"<{2 * total}d", data, 44 + 4 * count)
        rings = [[{"x": flat[2 * i], "y": flat[2 * i + 1]} for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
        if kind == 3:
            out["parts"] = rings
        else:  # rings that run clockwise are outer, the others holes of the outer one before
            polygons: list = []
            for ring in rings:
                turn = sum((b["x"] - a["x"]) * (b["y"] + a["y"]) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
                if turn >= 0 or not polygons:
                    polygons.append([ring])
                else:
                    polygons[-1].append(ring)
            out["geom"] = polygons
    return out


def shp_rows(path: str, options: dict):
    fields = dbf_fields(path)
    table = open(_beside(path, ".dbf"), "rb") if fields else None  # noqa: SIM115
    head, width = (0, 0) if table is None else struct.unpack("<2H", table.read(12)[8:12])
    with open(path, "rb") as f:
        f.seek(100)
        i = 0
        while len(record := f.read(8)) == 8:
            data = f.read(struct.unpack(">i", record[4:])[0] * 2)
            values = []
            if table is not None:
                table.seek(head + i * width)
                row = table.read(width)
                values = [_dbf_value(row[o : o + w], k) for _, k, w, o in fields]
            yield _row([i, *values], _shape(data))
            i += 1
    if table is not None:
        table.close()


def epsg_of(path: str) -> int:
    """EPSG code of a layer file: GeoPackage by its table, shapefile by its .prj; GeoJSON and OpenStreetMap are 4326. Unknown is an error."""
    if path.endswith(".gpkg"):
        return gpkg_layer(path)[3]
    if path.endswith(".shp"):
        prj = _beside(path, ".prj")
        text = Path(prj).read_text(errors="replace") if prj else ""
        for code, mark in ((2961, "UTM_zone_20N"), (2961, "UTM zone 20N"), (3857, "Mercator_Auxiliary_Sphere"), (3857, "Pseudo-Mercator")):
            if mark in text:
                return code
        if text.startswith("GEOGCS"):
            return 4326
        raise ValueError(f"{path} has no known coordinate system")
    return 4326


def read(spark: SparkSession, path: str, target: int = 2961, layer: str | None = None) -> DataFrame:
    """A layer in working coordinates, with edges and bounds for polygons and line_id for lines, from any readable format."""
    importable(spark)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".geojson", ".json")):
        from . import geojson

        return geojson.read(spark, path, target)
    kind = {".gpkg": GeoPackage, ".shp": Shapefile}.get(os.path.splitext(path)[1].lower())
    if path.endswith(".pbf"):
        from . import osm

        empty = {"geom": F.lit(None).cast(g.POLYGONS), "x": F.lit(None).cast("double"), "y": F.lit(None).cast("double")}
        rows = osm.lines(spark, path).withColumns(empty)
    elif kind is None:
        raise ValueError(f"{path}: read GeoPackage, shapefile, GeoJSON, OpenStreetMap extract or parquet; convert other formats first")
    else:
        spark.dataSource.register(kind)
        reader = spark.read.format(kind.name())
        rows = (reader.option("layer", layer) if layer else reader).load(path)
    source = epsg_of(path)

    def moved(p):
        x, y = projection.transform(p["x"], p["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    if source != target:
        rows = rows.withColumns(
            {
                "geom": F.transform("geom", lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, moved))),
                "parts": F.transform("parts", lambda part: F.transform(part, moved)),
                "__p": moved(F.struct("x", "y")),
            }
        ).withColumns({"x": F.col("__p.x"), "y": F.col("__p.y")}).drop("__p")
    return with_bounds(rows)


def with_bounds(rows: DataFrame) -> DataFrame:
    """Adds edges and the bounds of polygons, lines or points."""
    rows = rows.withColumn("edges", g.polygon_edges(F.col("geom")))
    points = F.coalesce(F.flatten("parts"), F.flatten(F.flatten("geom")), F.when(F.col("x").isNotNull(), F.array(F.struct("x", "y"))))
    rows = rows.withColumn("__all", points)
    xs, ys = F.transform("__all", lambda p: p["x"]), F.transform("__all", lambda p: p["y"])
    return rows.withColumns({"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}).drop("__all")
