"""Queries over the views: one for each operator of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import projection, styles
from ..functions import thresholds as t
from ..operators import exclusions, flow, grid, hydro, ranking, scorers, spatial, statistics, terrain, zonal
from . import views as v

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


@query
def q_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.cells(spark)


@query
def q_rural_filter(spark, sf_dir):
    land = v.land_cover(spark, sf_dir)
    return grid.rural_cells(v.cells(spark), land, v.BBOX, grid.type_column(land)).select("cell_id")


@query
def q_mask_filter(spark, sf_dir):
    return grid.cells_within(v.cells(spark), v.protected(spark, sf_dir)).select("cell_id")


@query
def q_load_exclusions(spark, sf_dir):
    return v.zones(spark, sf_dir).select("feature_id", "exclusion_reason", "xmin", "ymin", "xmax", "ymax")


@query
def q_exclusion_centroid(spark, sf_dir):
    return exclusions.by_centre(v.cells(spark), v.zones(spark, sf_dir))


@query
def q_exclusion_overlap(spark, sf_dir):
    return exclusions.by_overlap(v.cells(spark), v.zones(spark, sf_dir))


@query
def q_shape_overlap(spark, sf_dir):
    """Shares of cells under polygons with holes and several parts: rectangles with a hole, of which SQL knows the area."""
    plain = v.shapes(spark, sf_dir).withColumn("geom", F.slice("geom", 1, 1))
    return spatial.polygon_overlaps(v.cells(spark), plain).select("cell_id", "feature_id", _r("share"))


@query
def q_shape_centres(spark, sf_dir):
    features = v.shapes(spark, sf_dir).select("feature_id", "xmin", "ymin", "xmax", "ymax", "edges")
    return spatial.points_in_polygons(v.cells(spark).select("cell_id", "cx", "cy"), features, "cx", "cy").select("cell_id", "feature_id")


@query
def q_shape_parcels(spark, sf_dir):
    """Sizes of parcels of any shape."""
    return ranking.parcel_size(v.shapes(spark, sf_dir).withColumnRenamed("feature_id", "parcel_id")).select("parcel_id", _r("area_acres"), "size_score")


def _open_cells(spark, sf_dir):
    return exclusions.apply(v.cells(spark), v.zones(spark, sf_dir))


@query
def q_exclusions(spark, sf_dir):
    return _open_cells(spark, sf_dir).select("cell_id", "status", "exclusion_reasons")


@query
def q_zonal_elevation(spark, sf_dir):
    means = zonal.heights(v.samples(spark, sf_dir), v.BBOX, v.SIZE)
    return means.select("cell_id", _r("mean"), "n", t.lookup(F.col("mean"), t.ELEVATION).alias("score"))


@query
def q_zonal_range(spark, sf_dir):
    found = zonal.heights(v.samples(spark, sf_dir), v.BBOX, v.SIZE)
    return found.select("cell_id", (F.col("most") - F.col("least")).alias("range"))


@query
def q_elevation_score(spark, sf_dir):
    return scorers.elevation(v.cells(spark), v.context(spark, sf_dir))


@query
def q_slope(spark, sf_dir):
    return v.relief(spark).select("row", "col", _r("slope"))


@query
def q_aspect(spark, sf_dir):
    return v.relief(spark).select("row", "col", _r("aspect"))


@query
def q_slope_tiled(spark, sf_dir):
    return terrain.tiled_slope_aspect(v.pixels(spark), v.RESOLUTION, 64).select("row", "col", _r("slope"), _r("aspect"))


@query
def q_slope_holes(spark, sf_dir):
    return terrain.tiled_slope_aspect(_small(spark), v.RESOLUTION, 64).select("row", "col", _r("slope"), _r("aspect"))


@query
def q_buildable_mask(spark, sf_dir):
    return v.relief(spark).select("row", "col", terrain.buildable(F.col("slope")).alias("buildable"))


@query
def q_solar_class(spark, sf_dir):
    return v.relief(spark).select("row", "col", terrain.solar_class(F.col("slope"), F.col("aspect")).alias("class"))


@query
def q_solar_score(spark, sf_dir):
    return scorers.solar(v.cells(spark), v.context(spark, sf_dir))


@query
def q_buildable_score(spark, sf_dir):
    return scorers.buildable(v.cells(spark), v.context(spark, sf_dir))


@query
def q_resample(spark, sf_dir):
    fine = spark.range(60 * 60).select(F.expr("id div 60").alias("row"), F.expr("id % 60").alias("col"))
    fine = fine.select("row", "col", (F.col("col") * 20 + 2010.0).alias("x"), (7990.0 - F.col("row") * 20).alias("y"))
    return terrain.resample(v.pixels(spark), fine, v.ORIGIN, v.RESOLUTION).select("row", "col", _r("z"))


@query
def q_access_roads(spark, sf_dir):
    features = scorers.access_features(v.roads(spark, sf_dir), None)
    return spatial.nearest_within(v.cells(spark), features, t.ACCESS_REACH).select("cell_id", _r("distance"))


@query
def q_access_civic(spark, sf_dir):
    features = scorers.access_features(None, v.civic(spark, sf_dir))
    return spatial.nearest_within(v.cells(spark), features, t.ACCESS_REACH).select("cell_id", _r("distance"))


@query
def q_access_score(spark, sf_dir):
    return scorers.access(v.cells(spark), v.context(spark, sf_dir))


@query
def q_vehicle_roads(spark, sf_dir):
    return v.roads(spark, sf_dir).where(styles.driven(F.col("highway"))).select("line_id", "highway")


@query
def q_flowing_water(spark, sf_dir):
    return v.streams(spark, sf_dir).where(styles.flowing(F.col("FEAT_CODE"))).select("line_id", F.col("FEAT_CODE").alias("feat_code"))


@query
def q_drainage_area(spark, sf_dir):
    rows = hydro.with_optional(v.streams(spark, sf_dir))
    area = hydro.drainage_area(F.col("length"))
    return rows.select("line_id", F.round(area, 6).alias("area"), F.round(hydro.flow(area), 9).alias("flow"), F.round(hydro.power(hydro.flow(area), F.lit(10.0)), 6).alias("power_at_10m"))


def _flowing(spark, sf_dir):
    return v.streams(spark, sf_dir).where(styles.flowing(F.col("FEAT_CODE")))


@query
def q_stream_cells(spark, sf_dir):
    return hydro.pairs(v.cells(spark), _flowing(spark, sf_dir), bbox=v.BBOX)


@query
def q_head(spark, sf_dir):
    cells, lines = v.cells(spark), _flowing(spark, sf_dir)
    found = hydro.stretches(hydro.pairs(cells, lines, bbox=v.BBOX), cells, lines)
    return hydro.heads(found, lines, v.pixels(spark), v.ORIGIN, v.RESOLUTION, v.NODATA).select("cell_id", "line_id", _r("head"))


@query
def q_hydro_power(spark, sf_dir):
    return hydro.best_power(v.cells(spark), v.context(spark, sf_dir)).select("cell_id", _r("power", 4))


@query
def q_hydro_score(spark, sf_dir):
    return scorers.hydro_power(v.cells(spark), v.context(spark, sf_dir))


@query
def q_dem_sample(spark, sf_dir):
    found = terrain.sample(v.civic(spark, sf_dir), v.pixels(spark), F.col("x"), F.col("y"), v.ORIGIN, v.RESOLUTION, v.NODATA)
    return found.select("civic_id", "elevation")


SCORES = [f"score_{n}" for n in t.WEIGHTS]


def _scored(spark, sf_dir, weights=None, enabled=None):
    return scorers.composite(_open_cells(spark, sf_dir), v.context(spark, sf_dir), weights or t.WEIGHTS, enabled or list(t.WEIGHTS), v.cells(spark), strict=True)


@query
def q_composite(spark, sf_dir):
    return _scored(spark, sf_dir).select("cell_id", "status", *SCORES, _r("score"))


@query
def q_disabled_criterion(spark, sf_dir):
    return _scored(spark, sf_dir, enabled=["elevation", "access"]).select("cell_id", "score_elevation", "score_access", _r("score"))


@query
def q_renormalised_weights(spark, sf_dir):
    scaled = t.scaled_weights(t.WEIGHTS, ["hydro", "solar", "access"])
    return spark.createDataFrame([(n, round(w, 6)) for n, w in scaled.items()], "criterion string, weight double")


DATA_FLAGS = {"no_flood_data": False, "hydro_drainage_proxy_only": True, "hydro_20m_dem": True}


def _sure(spark, sf_dir):
    return ranking.confidence(_scored(spark, sf_dir), DATA_FLAGS)


@query
def q_confidence(spark, sf_dir):
    return _sure(spark, sf_dir).select("cell_id", "confidence", "confidence_band")


@query
def q_flags(spark, sf_dir):
    return _sure(spark, sf_dir).select("cell_id", "flags")


@query
def q_band_counts(spark, sf_dir):
    return statistics.band_counts(_sure(spark, sf_dir)).select("band", "n", _r("percent"))


def _ranked(spark, sf_dir):
    return ranking.ranked(_sure(spark, sf_dir))


@query
def q_rank(spark, sf_dir):
    return _ranked(spark, sf_dir).select("cell_id", "status", _r("score"), "rank", "confidence", "confidence_band")


@query
def q_ranked_eligible(spark, sf_dir):
    return _ranked(spark, sf_dir).where("status <> 'excluded'").orderBy(F.col("rank").asc_nulls_last(), "cell_id").select("rank", "cell_id", _r("score"))


@query
def q_parcel_size(spark, sf_dir):
    return ranking.parcel_size(v.parcels(spark, sf_dir)).select("parcel_id", _r("area_acres"), "size_score")


@query
def q_parcel_scores(spark, sf_dir):
    return ranking.parcels(_scored(spark, sf_dir), v.parcels(spark, sf_dir)).select("parcel_id", _r("cell_score"), "size_score", _r("score"))


@query
def q_stats(spark, sf_dir):
    found = statistics.stats(_scored(spark, sf_dir), [*SCORES, "score"])
    return found.select(F.col("column"), "n", *(_r(n) for n in ("least", "most", "mean", "median", "p10", "p25", "p50", "p75", "p90")), "at_100", "at_0", _r("at_100_percent"), _r("at_0_percent"))


@query
def q_histogram(spark, sf_dir):
    return statistics.histogram(_scored(spark, sf_dir), [*SCORES, "score"])


EAST, NORTH = 380000.0, 4900000.0


@query
def q_export_csv_view(spark, sf_dir):
    lat, lon = projection.to_geographic(F.col("cx") + EAST, F.col("cy") + NORTH)
    return _ranked(spark, sf_dir).select("cell_id", "status", _r("score"), "rank", *SCORES, "confidence", "confidence_band", "flags", "exclusion_reasons", F.round(lat, 6).alias("latitude"), F.round(lon, 6).alias("longitude"))


@query
def q_projection_round_trip(spark, sf_dir):
    lat, lon = projection.to_geographic(F.col("x") * 20 + 300000.0, F.col("y") * 10 + 4850000.0)
    x, y = projection.from_geographic(lat, lon)
    rows = v.civic(spark, sf_dir)
    return rows.select("civic_id", F.round(x - (F.col("x") * 20 + 300000.0), 3).alias("dx"), F.round(y - (F.col("y") * 10 + 4850000.0), 3).alias("dy"))


@query
def q_export_geojson(spark, sf_dir):
    from ..sources import geojson

    shifted = _ranked(spark, sf_dir).withColumns({n: F.col(n) + EAST for n in ("xmin", "xmax")}).withColumns({n: F.col(n) + NORTH for n in ("ymin", "ymax")})
    return geojson.features(shifted, geojson.rectangle_ring, ["cell_id", "status", "score", "rank"], 2961, 6)


@query
def q_map_bands(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy(styles.band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


@query
def q_colors(spark, sf_dir):
    s = F.col("score")
    return _scored(spark, sf_dir).select("cell_id", styles.colour(s).alias("colour"), styles.opacity(s).alias("opacity"))


@query
def q_map_streams(spark, sf_dir):
    kept = v.streams(spark, sf_dir).where(styles.on_stream_map(F.col("FEAT_CODE"), F.col("LINE_CLASS")))
    k = F.col("LINE_CLASS")
    return kept.select("line_id", F.round(styles.stream_width(k), 6).alias("width"), F.round(styles.stream_opacity(k), 6).alias("opacity"))


@query
def q_map_roads(spark, sf_dir):
    h = F.col("highway")
    return v.roads(spark, sf_dir).where(styles.on_road_map(h)).select("line_id", styles.road_colour(h).alias("colour"), styles.road_width(h).alias("width"))


@query
def q_bbox_filter(spark, sf_dir):
    return spatial.polygons_in_box(v.land_cover(spark, sf_dir), (2000, 2000, 6000, 5000)).select("feature_id")


@query
def q_clip_roads(spark, sf_dir):
    kept = v.roads(spark, sf_dir).where(F.col("highway").isNotNull())
    return spatial.clip_segments(kept, (2000, 2000, 6000, 5000)).select("line_id", *(_r(n) for n in ("x1", "y1", "x2", "y2")))


@query
def q_linear_reference(spark, sf_dir):
    order = Window.partitionBy("g").orderBy("line_id")
    rows = v.roads(spark, sf_dir).withColumn("g", F.expr("line_id div 10"))
    rows = rows.select(F.col("g").alias("line_id"), F.lit(0).alias("part"), F.row_number().over(order).alias("seg"), "x1", "y1", "x2", "y2")
    return spatial.with_lengths(rows).select("line_id", "seg", _r("before"), _r("length"))


@query
def q_contour_segments(spark, sf_dir):
    found = terrain.contour_segments(v.pixels(spark), 50.0, v.NODATA)
    return found.select("elevation", "major", *(_r(n) for n in ("x1", "y1", "x2", "y2")))


def _small(spark):
    return v.pixels(spark).where(F.col("z") != v.NODATA)


@query
def q_d8_pointer(spark, sf_dir):
    return flow.pointers(_small(spark))


@query
def q_fill_depressions(spark, sf_dir):
    return flow.fill_depressions(_small(spark), 64).select("row", "col", "z")


@query
def q_flow_accumulation(spark, sf_dir):
    return flow.accumulation(flow.pointers(_small(spark)))


@query
def q_total_bounds(spark, sf_dir):
    return v.land_cover(spark, sf_dir).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


@query
def q_check_data(spark, sf_dir):
    from ..sources import catalog

    return catalog.checked_tables(spark, sf_dir, ["region", "nation", "supplier", "customer", "missing_layer"])
