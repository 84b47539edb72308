"""Distributions of scores: statistics, histogram, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERCENTILES = [10, 25, 50, 75, 90]


def long_form(cells: DataFrame, columns: list[str]) -> DataFrame:
    """column, value of several columns in one scan; values that are missing have no row."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns)))
    return cells.select(each.alias("e")).select("e.*").where("value is not null and not isnan(value)")


def stats(cells: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, least, most, mean, median, p10 ... p90 (linear interpolation), at_100, at_0 and their per cent."""
    ranks = F.percentile("value", F.array(*(F.lit(p / 100) for p in PERCENTILES)))
    out = long_form(cells, columns).groupBy("column").agg(
        F.count("*").alias("n"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
        F.avg("value").alias("mean"),
        ranks.alias("__p"),
        F.count_if(F.col("value") == 100).alias("at_100"),
        F.count_if(F.col("value") == 0).alias("at_0"),
    )
    named = {f"p{p}": F.col("__p")[i] for i, p in enumerate(PERCENTILES)}
    named |= {"median": F.col("__p")[2], "at_100_percent": F.col("at_100") * 100.0 / F.col("n"), "at_0_percent": F.col("at_0") * 100.0 / F.col("n")}
    return out.withColumns(named).drop("__p")


def histogram(cells: DataFrame, columns: list[str], bins: int = 10, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """column, bin, low, high, n for every bin, empty ones too; the last bin is closed, values outside count nowhere."""
    width = (high - low) / bins
    values = long_form(cells, columns).where(F.col("value").between(low, high))
    binned = values.groupBy("column", F.least(F.floor((F.col("value") - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    spark = cells.sparkSession
    every = spark.createDataFrame([(c, b) for c in columns for b in range(bins)], "column string, bin int")
    joined = every.join(binned, ["column", "bin"], "left")
    return joined.select("column", "bin", (F.col("bin") * width + low).alias("low"), ((F.col("bin") + 1) * width + low).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def band_counts(cells: DataFrame) -> DataFrame:
    """band, n, percent of the cells that have a band; all three bands have a row."""
    seen = cells.where("confidence_band is not null")
    names = ["high", "medium", "low"]
    sums = seen.agg(*(F.count_if(F.col("confidence_band") == b).alias(b) for b in names), F.count("*").alias("__all"))
    each = F.inline(F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).alias("n")) for b in names)))
    return sums.select("__all", each).select("band", "n", (F.col("n") * 100.0 / F.when(F.col("__all") > 0, F.col("__all"))).alias("percent"))
