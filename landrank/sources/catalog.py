"""Data check over tables: which layers are there and can be read."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKED = "layer string, status string, columns string, feature_count long, error string"


def checked_tables(spark: SparkSession, folder: str, names: list[str], required: tuple = ()) -> DataFrame:
    """A row for each table: ok with columns and count, MISSING (required|optional), or error with its message."""
    rows = []
    for name in names:
        try:
            df = spark.read.parquet(f"{folder}/{name}.parquet")
            rows.append((name, "ok", ",".join(df.columns), df.count(), None))
        except PySparkException as e:
            gone = "PATH_NOT_FOUND" in str(e)
            missing = f"MISSING ({'required' if name in required else 'optional'})"
            rows.append((name, missing if gone else "error", None, None, None if gone else str(e).splitlines()[0][:200]))
    return spark.createDataFrame(rows, CHECKED).select("layer", "status", "columns", F.col("feature_count"), "error")
