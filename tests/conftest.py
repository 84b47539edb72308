"""A local session, and the common frame: 1 km x 1 km, 16 cells, layers with known values."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

X0, Y0 = 380000.0, 4900000.0
BBOX = (X0, Y0, X0 + 1000, Y0 + 1000)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    found = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()


@pytest.fixture(scope="session")
def cells(spark):
    from landrank.operators import grid

    return grid.generate(spark, BBOX, 250)


@pytest.fixture(scope="session")
def rectangles(spark):
    """Rows of rectangles, given as offsets from the corner of the frame."""
    from landrank.operators import grid

    def made(rows, names=()):
        columns = ["feature_id", "xmin", "ymin", "xmax", "ymax", *names]
        moved = [(i, X0 + a, Y0 + b, X0 + c, Y0 + d, *more) for i, (a, b, c, d, *more) in enumerate(rows)]
        kinds = "feature_id long, xmin double, ymin double, xmax double, ymax double" + "".join(f", {n} string" for n in names)
        return grid.polygons_of_rectangles(spark.createDataFrame(moved, kinds).select(*columns))

    return made


@pytest.fixture(scope="session")
def frame(spark):
    """Layers of the common frame as a scoring context."""
    import numpy as np

    from landrank.operators import spatial, terrain
    from landrank.operators.scorers import Context

    z = np.linspace(50, 200, 100)
    rows = spark.range(10000).select(F.expr("id div 100").alias("row"), F.expr("id % 100").alias("col"))
    heights = spark.createDataFrame([(i, float(z[99 - i])) for i in range(100)], "row long, z double")
    pixels = rows.join(heights, "row").select("row", "col", (F.lit(X0) + F.col("col") * 10 + 5).alias("x"), (F.lit(Y0 + 1000) - F.col("row") * 10 - 5).alias("y"), "z")
    roads = spark.createDataFrame([(0, X0, Y0 + 500, X0 + 1000, Y0 + 500), (1, X0 + 500, Y0, X0 + 500, Y0 + 1000)], "line_id long, x1 double, y1 double, x2 double, y2 double")
    course = [(100, 900), (200, 700), (300, 400), (400, 100)]
    segments = [(0, 0, i, X0 + a, Y0 + b, X0 + c, Y0 + d, 2.5) for i, ((a, b), (c, d)) in enumerate(zip(course, course[1:], strict=False))]
    streams = spatial.with_lengths(spark.createDataFrame(segments, "line_id long, part int, seg int, x1 double, y1 double, x2 double, y2 double, drainage_area_km2 double"))
    civic = spark.createDataFrame([(0, X0 + 125, Y0 + 125), (1, X0 + 750, Y0 + 750)], "civic_id long, x double, y double")
    return Context(
        bbox=BBOX, size=250, pixels=pixels, terrain=terrain.slope_aspect(pixels, 10), buildable_mask=False, origin=(X0, Y0 + 1000), resolution=10,
        nodata=-9999.0, streams=streams, roads=roads, civic=civic,
    )


@pytest.fixture(scope="session")
def scored(spark, cells, frame, rectangles):
    """The common frame scored to the end."""
    from landrank.functions.thresholds import WEIGHTS
    from landrank.operators import exclusions, ranking, scorers

    zones = exclusions.load(spark, rectangles([(500, 500, 1000, 1000)]), None)
    found = scorers.composite(exclusions.apply(cells, zones), frame, WEIGHTS, list(WEIGHTS))
    flags = {"no_flood_data": True, "hydro_drainage_proxy_only": True, "hydro_20m_dem": False}
    return ranking.ranked(ranking.confidence(found, flags)).cache()
