"""Micro-hydro: streams in reach of a cell, head along the stream, flow from drainage, power.

All steps are joins and aggregates of Column expressions: pairs of cell and stream, the stream's point nearest to the
cell's centre, up to 21 sample points around it, their heights by equi-join with the pixels, head by rules, power, maximum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import styles
from ..functions import thresholds as t
from . import spatial, terrain

AREA_COLUMNS = ["drainage_area_km2", "drain_area", "wsarea"]
#: Columns that streams may lack.
OPTIONAL = {"FEAT_CODE": "string", "LINE_CLASS": "int", "MINZ": "double", "MAXZ": "double", **{n: "double" for n in AREA_COLUMNS}}


def with_optional(streams: DataFrame) -> DataFrame:
    return streams.withColumns({n: F.lit(None).cast(kind) for n, kind in OPTIONAL.items() if n not in streams.columns})


def flow(area_km2: Column) -> Column:
    """Cubic metres a second at low water."""
    return area_km2 * t.RUNOFF / 1000.0


def power(flow_m3s: Column, head_m: Column, efficiency: float = t.EFFICIENCY) -> Column:
    """Watts."""
    return efficiency * t.WATER_DENSITY * t.GRAVITY * flow_m3s * head_m


def drainage_area(length: Column) -> Column:
    """km2: an attribute as it is, else by length, with least values for classes 2 and 3 and for connectors."""
    line_class = F.coalesce(F.col("LINE_CLASS").cast("int"), F.lit(1))
    by_length = F.greatest(F.lit(t.LEAST_DRAINAGE), 2.0 * F.pow(length / 1000.0, F.lit(1.5)))
    by_class = F.when(line_class >= 3, 25.0).when(line_class >= 2, 5.0).otherwise(0.0)
    by_code = F.when(connector(), 10.0).otherwise(0.0)
    return F.coalesce(*(F.col(n).cast("double") for n in AREA_COLUMNS), F.greatest(by_length, by_class, by_code))


def connector() -> Column:
    return F.coalesce(F.col("FEAT_CODE").startswith("WACO"), F.lit(False))


def pairs(cells: DataFrame, segments: DataFrame, reach: float = t.STREAM_REACH, bbox=None) -> DataFrame:
    """cell_id, line_id of the streams in reach of a cell; ``bbox``: where the cells lie, so that what is far off is left out at the scan."""
    if bbox is not None:
        xmin, ymin, xmax, ymax = map(float, bbox)
        segments = segments.where((F.greatest("x1", "x2") >= xmin - reach) & (F.least("x1", "x2") <= xmax + reach))
        segments = segments.where((F.greatest("y1", "y2") >= ymin - reach) & (F.least("y1", "y2") <= ymax + reach))
    return spatial.lines_near_cells(cells, segments, reach)


def stretches(found: DataFrame, cells: DataFrame, segments: DataFrame) -> DataFrame:
    """cell_id, line_id, length, start, stop: the stretch of the stream within 500 m along it of the cell.

    The nearest point is that of the segment of least distance, the first one of equal ones.
    """
    rows = found.join(cells.select("cell_id", "cx", "cy"), "cell_id").join(segments, "line_id")
    at = F.col("before") + g.along("cx", "cy", "x1", "y1", "x2", "y2") * F.col("len")
    key = F.struct(g.point_segment("cx", "cy", "x1", "y1", "x2", "y2"), "part", "seg")
    near = rows.groupBy("cell_id", "line_id").agg(F.min_by(at, key).alias("at"), F.max("length").alias("length"))
    start = F.greatest(F.lit(0.0), F.col("at") - t.HEAD_REACH)
    stop = F.least(F.col("length"), F.col("at") + t.HEAD_REACH)
    return near.select("cell_id", "line_id", "length", start.alias("start"), stop.alias("stop"))


def samples(found: DataFrame, segments: DataFrame) -> DataFrame:
    """cell_id, line_id, i, x, y: equally spaced points of each stretch; none of short lines or stretches."""
    width = F.col("stop") - F.col("start")
    n = F.greatest(F.lit(5), F.least(F.lit(20), (width / 25.0).cast("int")))
    rows = found.where((F.col("length") >= 10) & (width >= 20)).withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    rows = rows.withColumn("d", F.col("start") + (F.col("stop") - F.col("start")) * F.col("i") / F.col("n"))
    on = rows.join(segments.select("line_id", "part", "seg", "x1", "y1", "x2", "y2", "len", "before"), "line_id")
    # the first segment that reaches as far; beyond the last end, by rounding, the last one
    on = on.where((F.col("d") <= F.col("before") + F.col("len") + 1e-6) & (F.col("d") >= F.col("before") - 1e-6))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("d") - F.col("before")) / F.when(F.col("len") > 0, F.col("len"))))
    share = F.coalesce(share, F.lit(0.0))
    point = F.struct((F.col("x1") + share * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + share * (F.col("y2") - F.col("y1"))).alias("y"))
    one = on.groupBy("cell_id", "line_id", "i").agg(F.min_by(point, F.struct("part", "seg")).alias("p"))
    return one.select("cell_id", "line_id", "i", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def heads(found: DataFrame, segments: DataFrame, pixels: DataFrame, origin, resolution: float, nodata: float | None) -> DataFrame:
    """cell_id, line_id, head: height difference along the stretch, capped by its least height near sea level.

    Only pairs with two heights or more have a row; heights of -100 or less do not count.
    """
    points = samples(found, segments)
    read = terrain.sample(points, pixels, F.col("x"), F.col("y"), origin, resolution, nodata).where(F.col("elevation") > -100)
    sums = read.groupBy("cell_id", "line_id").agg(F.max("elevation").alias("most"), F.min("elevation").alias("least"), F.count("*").alias("n"))
    rise = F.col("most") - F.col("least")
    head = F.when(F.col("least") < 5.0, F.least(rise, F.col("least"))).otherwise(rise)
    return sums.where("n >= 2").select("cell_id", "line_id", head.alias("head"))


def powers(cells: DataFrame, context) -> DataFrame:
    """cell_id, line_id, area, head, power of every pair in reach that has drainage and head enough."""
    streams = with_optional(context.streams)
    streams = streams.where(styles.flowing(F.col("FEAT_CODE")))
    ends = ["x1", "y1", "x2", "y2"]
    segments = streams.select("line_id", "part", "seg", *ends, "len", "before", "length")
    lines = streams.where("part = 0 and seg = 0").select("line_id", *OPTIONAL)
    # the last column and row of cells may reach beyond the box by less than a cell
    xmin, ymin, xmax, ymax = context.bbox
    found = stretches(pairs(cells, segments, bbox=(xmin, ymin, xmax + context.size, ymax + context.size)), cells, segments)
    rows = found.join(lines, "line_id").withColumn("area", drainage_area(F.col("length"))).where(F.col("area") >= t.LEAST_DRAINAGE)
    if context.pixels is not None:
        along = heads(rows.select("cell_id", "line_id", "length", "start", "stop"), segments, context.pixels, context.origin, context.resolution, context.nodata)
        rows = rows.join(along, ["cell_id", "line_id"], "left").join(context.ranges(), "cell_id", "left")
    else:
        rows = rows.withColumns({"head": F.lit(None).cast("double"), "range": F.lit(None).cast("double")})
    # without heights along the stream: the cell's range, then the stream's own heights, then a slope of 2 %
    own = F.abs(F.col("MAXZ") - F.col("MINZ"))
    proxy = F.when(own > 0.1, own).otherwise(F.col("length") * 0.02)
    cell = F.when((F.col("length") >= 100) & (F.col("range") >= t.LEAST_HEAD), F.col("range"))
    head = F.when(F.col("head").isNotNull(), F.col("head")).when(connector(), F.lit(0.0)).otherwise(F.coalesce(cell, proxy))
    rows = rows.select("cell_id", "line_id", "area", head.alias("head")).where(F.col("head") >= t.LEAST_HEAD)
    return rows.withColumn("power", power(flow(F.col("area")), F.col("head")))


def best_power(cells: DataFrame, context) -> DataFrame:
    return powers(cells, context).groupBy("cell_id").agg(F.max("power").alias("power"))
