"""Candidate cells and the rural filter."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import styles
from ..functions.thresholds import CELL_SIZE
from . import spatial


def generate(spark: SparkSession, bbox: tuple[float, float, float, float], size: float = CELL_SIZE) -> DataFrame:
    """Square cells over a bounding box: cell_id, xmin, ymin, xmax, ymax, cx, cy.

    Ids run up each column from the south-west corner; the last column and row may reach beyond the box.  The rows come
    from ``range`` and are made where they are used, whatever their number.
    """
    xmin, ymin, xmax, ymax = map(float, bbox)
    columns, rows = math.ceil((xmax - xmin) / size), math.ceil((ymax - ymin) / size)
    ids = spark.range(max(0, columns) * max(0, rows)).withColumnRenamed("id", "cell_id")
    x, y = F.expr(f"cell_id div {max(rows, 1)}") * float(size) + xmin, (F.col("cell_id") % max(rows, 1)) * float(size) + ymin
    return with_centres(ids.select("cell_id", x.alias("xmin"), y.alias("ymin"), (x + float(size)).alias("xmax"), (y + float(size)).alias("ymax")))


def with_centres(cells: DataFrame) -> DataFrame:
    return cells.withColumns({"cx": (F.col("xmin") + F.col("xmax")) / 2, "cy": (F.col("ymin") + F.col("ymax")) / 2})


def cells_within(cells: DataFrame, mask: DataFrame | None) -> DataFrame:
    """Cells whose centre lies strictly within a polygon of the mask; all cells without a mask."""
    if mask is None:
        return cells
    hits = spatial.points_in_polygons(cells.select("cell_id", "cx", "cy"), mask, "cx", "cy").select("cell_id")
    return cells.join(hits, "cell_id", "left_semi")


def rural_cells(cells: DataFrame, land_cover: DataFrame | None, bbox, kind: str | None) -> DataFrame:
    """Cells in the countryside: centre strictly within the box and neither in nor on an urban polygon.

    That is the box less the urban polygons, without building the difference.  Without land cover, without a type column
    or without urban rows all cells stay.
    """
    if land_cover is None or kind is None:
        return cells
    urban = land_cover.where(styles.urban(F.col(kind)))
    if urban.isEmpty():
        return cells
    hits = spatial.points_in_polygons(cells.select("cell_id", "cx", "cy"), urban, "cx", "cy", closed=True).select("cell_id")
    xmin, ymin, xmax, ymax = map(float, bbox)
    inside = (F.col("cx") > xmin) & (F.col("cx") < xmax) & (F.col("cy") > ymin) & (F.col("cy") < ymax)
    return cells.where(inside).join(hits, "cell_id", "left_anti")


TYPE_COLUMNS = ["type", "land_type", "landcover", "lc_type", "desc", "feature_type", "feat_desc", "feat_code"]


def type_column(land_cover: DataFrame) -> str | None:
    """The first column, in table order, that may hold the kind of land; names are compared without case."""
    return next((name for name in land_cover.columns if name.lower() in TYPE_COLUMNS), None)


def polygons_of_rectangles(df: DataFrame) -> DataFrame:
    """Adds ``edges`` to rows that have xmin, ymin, xmax, ymax."""
    return df.withColumn("edges", g.rectangle_edges("xmin", "ymin", "xmax", "ymax"))
