"""Score tables and the lookups over them, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")

# Fixed values: (low, high, score), low inclusive, high exclusive; the first row that fits gives the score.
HYDRO_POWER = [(2000, INFINITY, 100), (1000, 2000, 80), (500, 1000, 60), (200, 500, 40), (50, 200, 20), (0, 50, 0)]
SOLAR_PERCENT = [(40, INFINITY, 100), (25, 40, 80), (15, 25, 60), (5, 15, 40), (0, 5, 20)]
ELEVATION = [(30, 100, 100), (100, 200, 90), (20, 30, 70), (200, 300, 60), (10, 20, 40), (300, INFINITY, 30), (0, 10, 10)]
ACCESS_DISTANCE = [(0, 0, 100), (0, 50, 80), (50, 200, 50), (200, 500, 20), (500, INFINITY, 0)]
BUILDABLE_PERCENT = [(30, INFINITY, 100), (20, 30, 80), (10, 20, 60), (5, 10, 30), (0, 5, 0)]
PARCEL_ACRES = [(50, INFINITY, 100), (20, 50, 90), (10, 20, 70), (5, 10, 40), (2, 5, 20), (1, 2, 5)]

# Default weights, deductions, bands and limits.
WEIGHTS = {"hydro": 45, "elevation": 25, "access": 20, "solar": 5, "buildable": 5}
DEDUCTIONS = {"no_flood_data": 20, "hydro_drainage_proxy_only": 20, "hydro_20m_dem": 15, "incomplete_land_cover_mask": 10, "no_road_evidence_200m": 15}
BANDS = [(80, 100, "high"), (55, 79, "medium"), (0, 54, "low")]
CELL_DEDUCTIONS = {"access_unverified": 15, "hydro_low_confidence": 10}
ACCESS_FLAG_BELOW = 50
OVERLAP_THRESHOLD = 0.5
CELL_SIZE = 250
EFFICIENCY, WATER_DENSITY, GRAVITY, RUNOFF = 0.5, 1000.0, 9.81, 8.0
LEAST_HEAD, LEAST_DRAINAGE = 3.0, 0.5
STREAM_REACH, ACCESS_REACH, HEAD_REACH = 100.0, 500.0, 500.0
SQUARE_METRES_PER_ACRE = 4046.86
BUILDABLE_SLOPE = 20.0


def lookup(value: Column, table: list[tuple]) -> Column:
    """The score of the first row that holds the value; 0 where none does, and for null and NaN.

    A row whose bounds are equal holds exactly that value.
    """
    out = None
    for low, high, score in table:
        fits = value == F.lit(float(low)) if low == high else value >= F.lit(float(low))
        if low != high and high != INFINITY:
            fits = fits & (value < F.lit(float(high)))
        elif high == INFINITY:
            fits = fits & (value < F.lit(INFINITY))
        out = F.when(fits, F.lit(float(score))) if out is None else out.when(fits, F.lit(float(score)))
    return F.when(value.isNull() | F.isnan(value), F.lit(0.0)).otherwise(out.otherwise(F.lit(0.0)))


def scaled_weights(weights: dict[str, float], enabled: list[str]) -> dict[str, float]:
    """The enabled weights, in their order, scaled to sum to 100; as they are where they sum to 0."""
    kept = {name: weight for name, weight in weights.items() if name in enabled}
    total = sum(kept.values())
    return {name: weight / total * 100 for name, weight in kept.items()} if total else kept
