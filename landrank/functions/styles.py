"""Colours, widths and bands of the map, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Least score, colour, opacity, name of the band; below the last and for null separate ones.
SCORE_BANDS = [(80, "#1a9641", 0.75, "Excellent (80-100)"), (60, "#a6d96a", 0.55, "Good (60-79)"), (40, "#ffffbf", 0.40, "Fair (40-59)"), (20, "#fdae61", 0.35, "Poor (20-39)")]
LOWEST, MISSING = ("#d7191c", 0.30, "Unsuitable (0-19)"), ("#808080", 0.15, "Excluded")
# Highway class -> colour, width.
ROADS = {
    "motorway": ("#e31a1c", 3.0), "motorway_link": ("#e31a1c", 2.0), "trunk": ("#fd8d3c", 2.5), "primary": ("#fd8d3c", 2.0),
    "secondary": ("#feb24c", 1.5), "secondary_link": ("#feb24c", 1.2), "tertiary": ("#888888", 1.2), "unclassified": ("#aaaaaa", 0.8),
    "residential": ("#cccccc", 0.6), "service": ("#cccccc", 0.4), "track": ("#996633", 0.8),
}
OTHER_ROAD = ("#cccccc", 0.5)
STREAM_COLOUR = "#2166ac"
NOT_DRIVEN = ["footway", "path", "steps", "cycleway", "proposed", "construction"]
NOT_MAPPED = ["footway", "path", "steps", "cycleway", "service"]
# Shoreline, tidal, wharf, dam and boundary features.
STILL_WATER = ["WALK", "WATO", "WAWH", "WADM", "WABD"]


def _by_band(score: Column, at: int) -> Column:
    out = F.when(score.isNull(), F.lit(MISSING[at]))
    for low, *values in SCORE_BANDS:
        out = out.when(score >= low, F.lit(values[at]))
    return out.otherwise(F.lit(LOWEST[at]))


def colour(score: Column) -> Column:
    return _by_band(score, 0)


def opacity(score: Column) -> Column:
    return _by_band(score, 1)


def band(score: Column) -> Column:
    return _by_band(score, 2)


def stream_width(line_class: Column) -> Column:
    return F.greatest(F.lit(0.5), 4.0 - (F.coalesce(line_class, F.lit(3)) - 1) * 0.7)


def stream_opacity(line_class: Column) -> Column:
    return F.greatest(F.lit(0.3), 0.9 - (F.coalesce(line_class, F.lit(3)) - 1) * 0.1)


def _road(highway: Column, at: int) -> Column:
    out = F.when(F.lit(False), F.lit(OTHER_ROAD[at]))
    for name, values in ROADS.items():
        out = out.when(highway == name, F.lit(values[at]))
    return out.otherwise(F.lit(OTHER_ROAD[at]))


def road_colour(highway: Column) -> Column:
    return _road(highway, 0)


def road_width(highway: Column) -> Column:
    return _road(highway, 1)


def flowing(feat_code: Column) -> Column:
    """Not a shoreline, tidal outflow, wharf, dam, boundary or island feature; an unknown code is kept."""
    still = F.lit(False)
    for prefix in STILL_WATER:
        still = still | feat_code.startswith(prefix)
    return ~F.coalesce(still | feat_code.contains("IS"), F.lit(False))


def driven(highway: Column) -> Column:
    return F.coalesce(~highway.isin(NOT_DRIVEN), F.lit(True))


def on_stream_map(feat_code: Column, line_class: Column) -> Column:
    return flowing(feat_code) & (F.coalesce(line_class.cast("int"), F.lit(3)) <= 4)


def on_road_map(highway: Column) -> Column:
    return F.coalesce(~highway.isin(NOT_MAPPED), F.lit(True))


def urban(kind: Column) -> Column:
    return F.coalesce(F.lower(kind).rlike("urban|commercial|industrial|institutional|residential"), F.lit(False))
