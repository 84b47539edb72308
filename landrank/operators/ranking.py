"""Confidence, flags, ranks and parcels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import thresholds as t
from ..functions.storage import stored
from . import spatial

#: Cells that are broadcast to the parcels, 21 MB; more are shuffled with them.
FEW = 100_000


def confidence_band(value: Column) -> Column:
    """Bounds are inclusive; what falls between them or above is low."""
    out = F.when(F.lit(False), F.lit("low"))
    for low, high, name in t.BANDS:
        out = out.when(value.between(low, high), F.lit(name))
    return out.otherwise(F.lit("low"))


def confidence(cells: DataFrame, data_flags: dict[str, bool] | None = None, deductions: dict[str, float] | None = None) -> DataFrame:
    """Adds flags, confidence and confidence_band; the last two are null for excluded cells."""
    deductions = t.DEDUCTIONS if deductions is None else deductions
    lost = sum(deductions[f] for f, on in (data_flags or {}).items() if on and f in deductions)
    raised = {
        "access_unverified": F.coalesce(F.col("score_access") < t.ACCESS_FLAG_BELOW, F.lit(False)) if "score_access" in cells.columns else F.lit(False),
        "hydro_low_confidence": F.coalesce(F.col("score_hydro") == 0, F.lit(False)) if "score_hydro" in cells.columns else F.lit(False),
    }
    own = reduce(lambda a, b: a + b, (F.when(on, float(t.CELL_DEDUCTIONS[f])).otherwise(0.0) for f, on in raised.items()))
    left = F.greatest(F.lit(0.0), F.lit(100.0 - lost) - own)
    open_ = F.coalesce(F.col("status") != "excluded", F.lit(True)) if "status" in cells.columns else F.lit(True)
    return cells.withColumns(
        {
            "flags": F.concat_ws("; ", *(F.when(on, F.lit(f)) for f, on in raised.items())),
            "confidence": F.when(open_, left),
            "confidence_band": F.when(open_, confidence_band(left)),
        }
    )


def ranked(cells: DataFrame) -> DataFrame:
    """Adds ``rank``: 1 + the number of eligible cells with a higher score; null for excluded cells and null scores.

    Counts by score are ranked instead of cells, and no task gets them all: the counts are dealt by ranges of scores and
    stored, and a count's place is the sum before it in its range and of the ranges above.  The cells are stored first, as
    they are read twice.
    """
    cells = stored(cells, "scored")
    open_ = F.col("status") != "excluded"
    counts = cells.where(open_ & F.col("score").isNotNull()).groupBy("score").agg(F.count("*").alias("__n"))
    counts = stored(counts.repartitionByRange(F.col("score").desc()).withColumn("__range", F.spark_partition_id()), "score-counts")
    before = lambda column, order, *by: F.coalesce(F.sum(column).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each range, of which there are as many as partitions
    ranges = counts.groupBy("__range").agg(F.sum("__n").alias("__all")).select("__range", before("__all", "__range", F.lit(0)).alias("__above"))
    places = counts.withColumn("__in", before("__n", F.col("score").desc(), "__range")).join(ranges, "__range")
    places = places.select(F.col("score").alias("__score"), (F.col("__above") + F.col("__in") + 1).cast("int").alias("__rank"))
    joined = cells.join(places, F.col("score") == F.col("__score"), "left")
    return joined.withColumn("rank", F.when(open_, F.col("__rank"))).drop("__score", "__rank")


def parcel_size(parcels: DataFrame) -> DataFrame:
    """Adds area_acres, where there is none, from the geometry, and size_score."""
    if "area_acres" not in parcels.columns:
        area = g.edges_area(F.col("edges")) if "edges" in parcels.columns else (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
        parcels = parcels.withColumn("area_acres", area / t.SQUARE_METRES_PER_ACRE)
    return parcels.withColumn("size_score", t.lookup(F.col("area_acres"), t.PARCEL_ACRES))


def parcels(cells: DataFrame, layer: DataFrame, top: int = 3, cell_weight: float = 0.8) -> DataFrame:
    """Adds cell_score (mean of the best cells whose centre lies within), size_score and score; no cells: both scores null.

    A cell in several parcels counts in each.  Only the best ``top`` of a parcel are kept as rows pass, so that a parcel of
    any size is one small state.  The open cells are stored first, so that it is their number that says how they meet the
    parcels, which are never broadcast.
    """
    open_ = cells.where("status <> 'excluded' and score is not null") if "status" in cells.columns else cells.where("score is not null")
    shape = layer.select("parcel_id", "xmin", "ymin", "xmax", "ymax", "edges")
    points = stored(open_.select("cell_id", "cx", "cy", F.col("score").alias("__score")), "parcel-points")
    inside = spatial.points_in_polygons(points, shape, "cx", "cy", few=points.count() <= FEW)
    order = Window.partitionBy("parcel_id").orderBy(F.col("__score").desc(), "cell_id")
    best = inside.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= top)
    means = best.groupBy("parcel_id").agg(F.avg("__score").alias("cell_score"))
    joined = parcel_size(layer).join(means, "parcel_id", "left")
    total = cell_weight * F.col("cell_score") + (1 - cell_weight) * F.col("size_score")
    return joined.withColumn("score", F.when(F.col("cell_score").isNotNull(), total))
