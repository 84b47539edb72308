"""The map: layers are filtered, simplified and turned to GeoJSON by Spark, and put into one HTML page by the driver."""

from __future__ import annotations

import json
import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import projection, styles
from ..functions.thresholds import WEIGHTS
from ..operators import spatial, terrain
from ..sources import ingest
from ..sources.config import Config

log = logging.getLogger("landrank")
# Tolerances of simplification in degrees, digits of coordinates, base maps.
FINE, COARSE = 1e-4, 5e-4
TILES = {
    "Topographic": "https://server.arcgisonline.com/ArcGIS/rest/services/World_Topo_Map/MapServer/tile/{z}/{y}/{x}",
    "CartoDB Light": "https://{s}.basemaps.cartocdn.com/light_all/{z}/{x}/{y}{r}.png",
    "Satellite": "https://server.arcgisonline.com/ArcGIS/rest/services/World_Imagery/MapServer/tile/{z}/{y}/{x}",
    "CartoDB Dark": "https://{s}.basemaps.cartocdn.com/dark_all/{z}/{x}/{y}{r}.png",
}
CELL_COLUMNS = ["status", "score", "rank", "score_hydro", "score_solar", "score_elevation", "score_access", "score_buildable", "confidence", "confidence_band"]


def _degrees(p: Column, source: int) -> Column:
    x, y = projection.transform(p["x"], p["y"], source, 4326)
    return F.struct(x.alias("x"), y.alias("y"))


def _pairs(parts: Column, digits: int) -> Column:
    return F.transform(parts, lambda part: F.transform(part, lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits))))


def _feature(kind: str, coordinates: Column, properties: list[Column]) -> Column:
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    own = F.struct(*properties) if properties else F.struct(F.lit(None).cast("string").alias("none"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), own.alias("properties")), {"ignoreNullFields": "false"})


def cells(rows: DataFrame, source: int) -> DataFrame:
    """band, feature of scored cells, coloured by score."""
    corners = [("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin")]
    ring = F.array(*(_degrees(F.struct(F.col(x).alias("x"), F.col(y).alias("y")), source) for x, y in corners))
    s = F.col("score")
    own = [F.col(c) for c in CELL_COLUMNS if c in rows.columns] + [styles.colour(s).alias("colour"), styles.opacity(s).alias("opacity")]
    return rows.select(styles.band(s).alias("band"), _feature("Polygon", _pairs(F.array(ring), 5), own).alias("feature"))


def lines(segments: DataFrame, properties: list[Column], source: int) -> DataFrame:
    """feature of lines stored as segments: points in order, simplified."""
    names = [f"p{i}" for i in range(len(properties))]
    rows = segments.select("line_id", "part", "seg", "x1", "y1", "x2", "y2", *(p.alias(n) for p, n in zip(properties, names, strict=True)))
    listed = F.array_sort(F.collect_list(F.struct("seg", "x1", "y1", "x2", "y2")))
    parts = rows.groupBy("line_id", "part").agg(listed.alias("s"), *(F.first(n).alias(n) for n in names))
    first = F.transform("s", lambda e: F.struct(e["x1"].alias("x"), e["y1"].alias("y")))
    last = F.element_at("s", -1)
    points = F.concat(first, F.array(F.struct(last["x2"].alias("x"), last["y2"].alias("y"))))
    turned = parts.withColumn("points", F.array(F.transform(points, lambda p: _degrees(p, source))))
    done = turned.withColumn("points", spatial.simplify(F.col("points"), FINE))
    own = [F.col(n).alias(_name(p)) for n, p in zip(names, properties, strict=True)]
    return done.select(_feature("LineString", _pairs(F.col("points"), 5)[0], own).alias("feature"))


def _name(c: Column) -> str:
    return c._jc.toString().rpartition(" AS ")[2].strip("`") or c._jc.toString()


def polygons(rows: DataFrame, properties: list[str], source: int, tolerance: float) -> DataFrame:
    turned = rows.withColumn("__rings", F.transform(F.flatten("geom"), lambda ring: F.transform(ring, lambda p: _degrees(p, source))))
    done = turned.withColumn("__rings", spatial.simplify(F.col("__rings"), tolerance))
    own = [F.col(c) for c in properties if c in rows.columns]
    return done.select(_feature("Polygon", _pairs(F.col("__rings"), 5), own).alias("feature"))


def centres(rows: DataFrame, source: int) -> DataFrame:
    x, y = g.edges_centroid(F.col("edges"))
    at = rows.where("edges is not null").withColumn("__p", _degrees(F.struct(x.alias("x"), y.alias("y")), source))
    return at.select(_feature("Point", F.array(F.round("__p.x", 5), F.round("__p.y", 5)), []).alias("feature"))


def contours(pixels: DataFrame, source: int, nodata: float | None) -> DataFrame:
    rows = terrain.contour_lines(pixels, 50.0, nodata).select("elevation", "major", F.col("parts")[0].alias("points"))
    points = F.array(F.transform("points", lambda p: _degrees(p, source)))
    return rows.select(_feature("LineString", _pairs(points, 4)[0], [F.col("elevation"), F.col("major")]).alias("feature"))


def layers(spark: SparkSession, config: Config, scored: DataFrame) -> dict[str, DataFrame]:
    """Name -> features of every layer that there is, in drawing order."""
    out, epsg = {}, config.epsg
    shown = cells(scored, epsg)
    for name in [b[3] for b in styles.SCORE_BANDS] + [styles.LOWEST[2], styles.MISSING[2]]:
        out[name] = shown.where(F.col("band") == name).select("feature")
    streams, roads = ingest.load(spark, config, "streams"), ingest.load(spark, config, "roads")
    if streams is not None:
        kept, k = streams, F.lit(3)
        if "FEAT_CODE" in streams.columns:
            kept = kept.where(styles.flowing(F.col("FEAT_CODE")))
        if "LINE_CLASS" in streams.columns:
            k = F.col("LINE_CLASS").cast("int")
            kept = kept.where(F.coalesce(k, F.lit(3)) <= 4)
        own = [F.col(c) for c in ("RIVNAME_1", "LINE_CLASS") if c in kept.columns]
        style = [F.lit(styles.STREAM_COLOUR).alias("colour"), styles.stream_width(k).alias("width"), styles.stream_opacity(k).alias("opacity")]
        out["Streams & Rivers"] = lines(kept, own + style, epsg)
    if roads is not None:
        h = F.col("highway") if "highway" in roads.columns else F.lit(None).cast("string")
        kept = roads.where(styles.on_road_map(h)) if "highway" in roads.columns else roads
        own = [F.col(c) for c in ("name", "highway") if c in kept.columns]
        out["Roads"] = lines(kept, own + [styles.road_colour(h).alias("colour"), styles.road_width(h).alias("width")], epsg)
    for name, layer, columns, tolerance in (("Crown Land", "crown_land", ["Acres", "DNR_ID"], FINE), ("Protected Areas", "protected_areas", ["pro_name", "protect1"], COARSE)):
        rows = ingest.load(spark, config, layer)
        if rows is not None:
            out[name] = polygons(rows, columns, epsg, tolerance)
    buildings = ingest.load(spark, config, "buildings")
    if buildings is not None:
        out["Buildings"] = centres(buildings, epsg)
    dem, head = ingest.load(spark, config, "dem"), ingest.dem_header(config)
    if dem is not None and head is not None:
        out["Elevation Contours (50m)"] = contours(dem, epsg, head["nodata"])
    return out


PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>Land suitability</title>
<link rel="stylesheet" href="https://unpkg.com/leaflet@1.9.4/dist/leaflet.css"><script src="https://unpkg.com/leaflet@1.9.4/dist/leaflet.js"></script>
<style>html,body,#map{height:100%%;margin:0}.panel{position:fixed;background:#fff;border:2px solid #666;border-radius:6px;padding:12px;font:13px Arial;z-index:9999}
.panel i{width:16px;height:16px;display:inline-block;margin-right:6px;vertical-align:middle;border:1px solid #999}</style></head>
<body><div id="map"></div><div class="panel" style="bottom:30px;right:30px"><b>Suitability Score</b><br>%(legend)s</div>
<div class="panel" style="top:12px;left:55px"><b>Score formula</b><br>%(formula)s</div>
<script>
const layers = %(layers)s, tiles = %(tiles)s, bounds = %(bounds)s, area = %(area)s, first = %(first)s;
const map = L.map('map'), bases = {}, overlays = {};
Object.entries(tiles).forEach(([name, url], i) => { bases[name] = L.tileLayer(url); if (!i) bases[name].addTo(map); });
const style = f => { const p = f.properties; return {color: p.colour || '#6B4226', fillColor: p.colour || '#9467bd', weight: p.width || 0.5, opacity: p.width ? (p.opacity || 0.8) : 0.6, fillOpacity: p.width ? 0 : (p.opacity || 0.3)}; };
const told = (f, l) => l.bindTooltip(Object.entries(f.properties).filter(([k, v]) => v !== null && !['colour', 'opacity', 'width', 'none'].includes(k)).map(([k, v]) => k + ': ' + v).join('<br>'));
Object.entries(layers).forEach(([name, data]) => { overlays[name] = L.geoJSON(data, {style, onEachFeature: told, pointToLayer: (f, at) => L.circleMarker(at, {radius: 2, color: '#555'})}); if (name === first) overlays[name].addTo(map); });
overlays['Study Area'] = L.rectangle(area, {fill: false, dashArray: '6', color: '#333'}).addTo(map);
L.control.layers(bases, overlays, {collapsed: false}).addTo(map); map.fitBounds(bounds);
</script></body></html>
"""


def pieces(found, bounds, area, weights: dict[str, float]):
    """The page in pieces, feature by feature; ``found``: layers whose features are given as texts; empty layers are left out."""
    shades = [*((c, n) for _, c, _, n in styles.SCORE_BANDS), (styles.LOWEST[0], styles.LOWEST[2]), (styles.MISSING[0], styles.MISSING[2])]
    mark = "\0"
    before, after = (
        PAGE
        % {
            "legend": "".join(f'<i style="background:{c}"></i>{n}<br>' for c, n in shades),
            "formula": "".join(f"{n}: {w:g}%<br>" for n, w in weights.items()),
            "layers": mark,
            "tiles": json.dumps(TILES),
            "bounds": json.dumps(bounds),
            "area": json.dumps(area),
            "first": json.dumps(styles.SCORE_BANDS[0][3]),
        }
    ).split(mark)
    yield before + "{"
    some = False
    for name, features in found.items():
        own = False
        for feature in features:
            lead = ", " if own else f'{", " if some else ""}{json.dumps(name)}: {{"type": "FeatureCollection", "features": ['
            yield lead + feature.replace("</", "<\\/")
            own = True
        if own:
            yield "]}"
            some = True
    yield "}" + after


def page(found: dict[str, list[str]], bounds, area, weights: dict[str, float]) -> str:
    """The whole page."""
    return "".join(pieces(found, bounds, area, weights))


def run(spark: SparkSession, config: Config) -> str | None:
    """Writes map.html and returns its path; features pass the driver one by one, a partition of a layer at a time."""
    path = config.output / "scored_cells.parquet"
    if not path.exists():
        log.error("Scored cells not found at %s. Run 'score' first.", path)
        return None
    scored = spark.read.parquet(str(path))
    found = {name: (r["feature"] for r in rows.toLocalIterator()) for name, rows in layers(spark, config, scored).items()}
    corners = scored.agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()

    def degrees(x0, y0, x1, y1):
        frame = spark.createDataFrame([(float(x0), float(y0)), (float(x1), float(y1))], "x double, y double")
        x, y = projection.transform(F.col("x"), F.col("y"), config.epsg, 4326)
        return [[r["lat"], r["lon"]] for r in frame.select(y.alias("lat"), x.alias("lon")).collect()]

    bounds = degrees(*corners) if corners[0] is not None else degrees(*config.bbox)
    out = config.output / "map.html"
    with out.open("w", encoding="utf-8") as file:
        file.writelines(pieces(found, bounds, degrees(*config.bbox), config.scaled_weights() or WEIGHTS))
    return str(out)
