"""Hard exclusions: protected areas and flood zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.thresholds import OVERLAP_THRESHOLD
from . import spatial

#: Layers in the order in which their reasons are listed.
REASONS = ["protected_area", "flood_zone"]
SCHEMA = "feature_id long, exclusion_reason string, xmin double, ymin double, xmax double, ymax double, edges array<struct<x1:double,y1:double,x2:double,y2:double>>"


def load(spark: SparkSession, protected: DataFrame | None, flood: DataFrame | None, bbox=None) -> DataFrame:
    """Both layers as one, each row with its reason and an id of its own; an empty table without either."""
    out = spark.createDataFrame([], SCHEMA)
    for number, (reason, layer) in enumerate(zip(REASONS, (protected, flood), strict=True)):
        if layer is not None:
            near = spatial.polygons_in_box(layer, bbox) if bbox is not None else layer
            ids = F.col("feature_id") * len(REASONS) + number
            rows = near.withColumns({"feature_id": ids, "exclusion_reason": F.lit(reason)})
            out = out.unionByName(rows.select(*[n for n in rows.columns if n in (*out.columns, "geom")]), allowMissingColumns=True)
    return out


def by_centre(cells: DataFrame, exclusions: DataFrame) -> DataFrame:
    """cell_id, reason of the polygons that hold a cell's centre strictly."""
    features = exclusions.select("exclusion_reason", "xmin", "ymin", "xmax", "ymax", "edges")
    hits = spatial.points_in_polygons(cells.select("cell_id", "cx", "cy"), features, "cx", "cy")
    return hits.select("cell_id", F.col("exclusion_reason").alias("reason")).distinct()


def by_overlap(cells: DataFrame, exclusions: DataFrame, threshold: float = OVERLAP_THRESHOLD) -> DataFrame:
    """cell_id, reason of the features that overlap a cell, where their shares of the cell's area sum to the threshold.

    Shares are summed over features, so ground that two features cover counts twice.
    """
    whole = "geom" in exclusions.columns
    shares = (spatial.polygon_overlaps if whole else spatial.rectangle_overlaps)(cells, exclusions)
    named = shares.join(exclusions.select("feature_id", "exclusion_reason"), "feature_id")
    over = named.groupBy("cell_id").agg(F.sum("share").alias("share"), F.collect_set("exclusion_reason").alias("reasons"))
    return over.where(F.col("share") >= threshold).select("cell_id", F.explode("reasons").alias("reason"))


def apply(cells: DataFrame, exclusions: DataFrame, threshold: float = OVERLAP_THRESHOLD) -> DataFrame:
    """Adds status (eligible, excluded) and exclusion_reasons (joined by ``; ``, empty for eligible cells).

    Overlap is only looked at for cells that no polygon holds by their centre.
    """
    centre = by_centre(cells, exclusions)
    rest = cells.join(centre.select("cell_id").distinct(), "cell_id", "left_anti")
    found = centre.unionByName(by_overlap(rest, exclusions, threshold)).groupBy("cell_id").agg(F.collect_set("reason").alias("__found"))
    listed = F.concat_ws("; ", *(F.when(F.array_contains("__found", r), F.lit(r)) for r in REASONS))
    joined = cells.join(found, "cell_id", "left")
    return joined.withColumns(
        {
            "status": F.when(F.col("__found").isNull(), F.lit("eligible")).otherwise("excluded"),
            "exclusion_reasons": F.when(F.col("__found").isNull(), F.lit("")).otherwise(listed),
        }
    ).drop("__found")
