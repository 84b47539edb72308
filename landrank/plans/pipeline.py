"""Prepare and score: the two long commands, each a chain of lazy tables with one write at the end of a layer."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import importable, tables_of
from ..operators import exclusions, flow, grid, ranking, scorers, terrain
from ..sources import ingest, raster
from ..sources.config import Config
from . import export

log = logging.getLogger("landrank")


def prepare(spark: SparkSession, config: Config, accumulate: bool = True) -> DataFrame:
    """Ingests raw layers, derives terrain, and stores the candidate grid."""
    importable(spark)
    ingest.run(spark, config)
    dem, head = ingest.load(spark, config, "dem"), ingest.dem_header(config)
    if dem is not None and head is not None:
        if not ingest.stored_path(config, "terrain").exists():
            terrain.tiled_slope_aspect(dem, head["resolution"]).write.parquet(str(ingest.stored_path(config, "terrain")))
        if accumulate and not ingest.stored_path(config, "flow_accumulation").exists():
            with tables_of(spark):
                flow.accumulation(flow.pointers(flow.fill_depressions(dem))).write.parquet(str(ingest.stored_path(config, "flow_accumulation")))
    else:
        log.warning("No DEM available; skipping derivatives")
    write_rasters(spark, config)
    land = ingest.load(spark, config, "land_cover")
    kind = grid.type_column(land) if land is not None else None
    cells = grid.rural_cells(grid.generate(spark, config.bbox, config.cell_size), land, config.bbox, kind)
    cells.write.mode("overwrite").parquet(str(ingest.stored_path(config, "candidate_grid")))
    return ingest.load(spark, config, "candidate_grid")


def write_rasters(spark: SparkSession, config: Config) -> list[str]:
    """The derived rasters as GeoTIFF files beside the stored tables: slope and aspect as numbers, buildable ground as 0 and 1."""
    found, head = ingest.load(spark, config, "terrain"), ingest.dem_header(config)
    if found is None or head is None:
        return []
    ends = found.agg(F.max("row").alias("row"), F.max("col").alias("col")).first()
    if ends["row"] is None:
        return []
    out, shape = [], (ends["row"] + 1, ends["col"] + 1)
    rows = found.withColumn("buildable", terrain.buildable(F.col("slope")))
    for column, kind, nodata in (("slope", "f4", -9999.0), ("aspect", "f4", -9999.0), ("buildable", "u1", 255)):
        path = str(config.processed / f"{column}.tif")
        raster.write(rows, column, path, shape, *head["origin"], head["resolution"], nodata, kind, config.epsg)
        out.append(path)
    return out


def data_flags(config: Config) -> dict[str, bool]:
    """What is known about the data as a whole: by which layers are stored, and by the raster's resolution."""
    head = ingest.dem_header(config)
    return {
        "no_flood_data": not ingest.stored_path(config, "flood").exists(),
        "hydro_drainage_proxy_only": not ingest.stored_path(config, "flow_accumulation").exists(),
        "hydro_20m_dem": head is not None and head["resolution"] >= 20,
    }


def context(spark: SparkSession, config: Config) -> scorers.Context:
    head = ingest.dem_header(config) or {"origin": (0.0, 0.0), "resolution": 20.0, "nodata": None}
    load = lambda name: ingest.load(spark, config, name)
    return scorers.Context(
        bbox=config.bbox, size=config.cell_size, pixels=load("dem"), terrain=load("terrain"), origin=tuple(head["origin"]), resolution=head["resolution"],
        nodata=head["nodata"], streams=load("streams"), roads=load("roads"), civic=load("civic"),
    )


def scored(spark: SparkSession, config: Config, cells: DataFrame) -> DataFrame:
    """Exclusions, scores, confidence, rank; what the log says of them is counted as the cells pass."""
    load = lambda name: ingest.load(spark, config, name)
    zones = exclusions.load(spark, load("protected_areas"), load("flood"), config.bbox)
    found = exclusions.apply(cells, zones, config.overlap_threshold)
    found = scorers.composite(found, context(spark, config), config.weights, config.enabled, cells)
    found, seen = scorers.observed(ranking.confidence(found, data_flags(config), config.deductions), config.enabled)
    out = ranking.ranked(found)  # stores the cells, so all are counted
    for line in scorers.told(seen.get):
        log.info(line)
    return out


def score(spark: SparkSession, config: Config) -> DataFrame | None:
    """Scores the stored grid, stores cells (and parcels, where there are any), and writes the result files."""
    importable(spark)
    config.output.mkdir(parents=True, exist_ok=True)
    cells = ingest.load(spark, config, "candidate_grid")
    if cells is None:
        log.error("Candidate grid not found at %s. Run 'prepare' first.", ingest.stored_path(config, "candidate_grid"))
        return None
    path = str(config.output / "scored_cells.parquet")
    with tables_of(spark):
        scored(spark, config, cells).write.mode("overwrite").parquet(path)
    found = spark.read.parquet(path)
    layer = ingest.load(spark, config, "parcels")
    if layer is not None:
        if "parcel_id" not in layer.columns:
            layer = layer.withColumn("parcel_id", F.col("feature_id"))
        with tables_of(spark):
            ranking.parcels(found, layer).write.mode("overwrite").parquet(str(config.output / "scored_parcels.parquet"))
    export.run(found, config.output, config.epsg)
    return found
