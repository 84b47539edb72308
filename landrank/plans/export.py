"""Result files: CSV of all cells and of the ranked ones, GeoJSON of all cells. The native store is parquet."""

from __future__ import annotations

import csv
import logging
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import projection
from ..sources import geojson

log = logging.getLogger("landrank")
# Columns of the files, in order.
COLUMNS = ["status", "score", "rank", "score_hydro", "score_solar", "score_elevation", "score_access", "score_buildable", "confidence", "confidence_band", "flags", "exclusion_reasons"]


def csv_view(cells: DataFrame, source: int) -> DataFrame:
    """cell_id, those of the columns that there are, latitude and longitude of the centre."""
    lon, lat = projection.transform((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2, source, 4326)
    return cells.select("cell_id", *[c for c in COLUMNS if c in cells.columns], lat.alias("latitude"), lon.alias("longitude"))


def write_csv(rows: DataFrame, path: Path) -> None:
    """One file; rows stream through the driver a partition at a time."""
    with path.open("w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(rows.columns)
        for row in rows.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])


def run(cells: DataFrame, folder: Path, source: int) -> None:
    folder.mkdir(parents=True, exist_ok=True)
    rows = csv_view(cells, source)
    write_csv(rows.orderBy("cell_id"), folder / "scored_cells.csv")
    try:
        own = [c for c in cells.columns if c not in ("xmin", "ymin", "xmax", "ymax", "cx", "cy")]
        geojson.write(geojson.features(cells, geojson.rectangle_ring, own, source), str(folder / "scored_cells.geojson"))
    except Exception:
        log.exception("Failed to export GeoJSON")
    eligible = rows.where("status <> 'excluded'")
    if not eligible.isEmpty():
        write_csv(eligible.orderBy(F.col("rank").asc_nulls_last() if "rank" in rows.columns else "cell_id", "cell_id"), folder / "ranked_eligible.csv")
