"""Zonal statistics: one equi-join-free aggregate of the pixel table.

Cells form a regular grid, so a pixel's cell is arithmetic on its centre (half-open, lower bounds belong to the cell); the
pixel table is read once for heights, sun and buildable ground together, and partial sums are made before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import terrain


def cell_of(x: Column, y: Column, bbox, size: float) -> Column:
    """Id of the grid cell that holds a point; null outside the grid."""
    xmin, ymin, xmax, ymax = map(float, bbox)
    columns, rows = math.ceil((xmax - xmin) / size), math.ceil((ymax - ymin) / size)
    ix, iy = F.floor((x - xmin) / float(size)), F.floor((y - ymin) / float(size))
    return F.when((ix >= 0) & (ix < columns) & (iy >= 0) & (iy < rows), ix * rows + iy)


def heights(pixels: DataFrame, bbox, size: float, nodata: float | None = None) -> DataFrame:
    """cell_id, mean, least, most, n of the heights in each cell."""
    rows = pixels if nodata is None else pixels.where(F.col("z") != float(nodata))
    keyed = rows.select(cell_of(F.col("x"), F.col("y"), bbox, size).alias("cell_id"), "z").where("cell_id is not null")
    return keyed.groupBy("cell_id").agg(F.avg("z").alias("mean"), F.min("z").alias("least"), F.max("z").alias("most"), F.count("z").alias("n"))


def all_measures(pixels: DataFrame, bbox, size: float, nodata: float | None = None, mask_nodata: bool = False) -> DataFrame:
    """cell_id, mean, least, most, n, sunny, classed, buildable, sloped from pixels with x, y, z, slope, aspect.

    Heights leave out missing pixels.  Slopes do not, unless ``mask_nodata``: a block of missing heights is flat.
    """
    there = F.col("z") != float(nodata) if nodata is not None else F.lit(True)
    known = there if mask_nodata else F.lit(True)
    z = F.when(there, F.col("z"))
    sunny = terrain.solar_class(F.col("slope"), F.col("aspect")) >= 1
    keyed = pixels.withColumn("cell_id", cell_of(F.col("x"), F.col("y"), bbox, size)).where("cell_id is not null")
    return keyed.groupBy("cell_id").agg(
        F.avg(z).alias("mean"),
        F.min(z).alias("least"),
        F.max(z).alias("most"),
        F.count(z).alias("n"),
        F.count_if(known & sunny).alias("sunny"),
        F.count_if(known).alias("classed"),
        F.sum(F.when(known, terrain.buildable(F.col("slope")))).alias("buildable"),
        F.count_if(known).alias("sloped"),
    )
