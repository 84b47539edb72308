"""The common frame against values worked out by hand: cell 8 lies on a boundary and is left out."""

from __future__ import annotations

import pytest

# id: (hydro, elevation, access, solar, buildable, score, rank, confidence, band)
EXPECTED = {
    0: (100, 100, 100, 100, 0, 95.0, 1, 60, "medium"), 1: (100, 90, 100, 100, 0, 92.5, 4, 60, "medium"), 2: (100, 90, 100, 100, 0, 92.5, 4, 60, "medium"),
    3: (100, 90, 20, 100, 0, 76.5, 9, 45, "low"), 4: (100, 100, 100, 100, 0, 95.0, 1, 60, "medium"), 5: (100, 90, 100, 100, 0, 92.5, 4, 60, "medium"),
    6: (100, 90, 100, 100, 0, 92.5, 4, 60, "medium"), 7: (100, 90, 100, 100, 0, 92.5, 4, 60, "medium"), 9: (0, 90, 100, 100, 0, 47.5, 10, 50, "low"),
    12: (0, 100, 20, 100, 0, 34.0, 12, 35, "low"), 13: (0, 90, 100, 100, 0, 47.5, 10, 50, "low"),
}


def test_scores_ranks_and_confidence(scored):
    rows = {r["cell_id"]: r for r in scored.collect()}
    assert len(rows) == 16
    for i, (hydro, elevation, access, solar, buildable, score, rank, confidence, band) in EXPECTED.items():
        r = rows[i]
        found = tuple(r[f"score_{n}"] for n in ("hydro", "elevation", "access", "solar", "buildable"))
        assert found == (hydro, elevation, access, solar, buildable), i
        assert r["score"] == pytest.approx(score)
        assert (r["rank"], r["confidence"], r["confidence_band"]) == (rank, confidence, band), i


def test_excluded_cells_have_no_scores(scored):
    rows = [r for r in scored.collect() if r["status"] == "excluded"]
    assert sorted(r["cell_id"] for r in rows) == [10, 11, 14, 15]
    for r in rows:
        assert r["exclusion_reasons"] == "protected_area" and r["flags"] == ""
        assert all(r[c] is None for c in ("score", "score_hydro", "score_access", "confidence", "confidence_band", "rank"))


def test_slope_and_aspect(frame):
    rows = frame.terrain.selectExpr("min(slope) a", "max(slope) b", "min(aspect) c", "max(aspect) d").first()
    assert rows["a"] == pytest.approx(8.6156, abs=1e-3) and rows["b"] == pytest.approx(8.6156, abs=1e-3)
    assert rows["c"] == pytest.approx(180) and rows["d"] == pytest.approx(180)


def test_parcels(scored, rectangles):
    from landrank.operators import ranking

    layer = rectangles([(0, 0, 500, 500), (500, 0, 1000, 500), (0, 500, 500, 1000), (500, 500, 1000, 1000)]).withColumnRenamed("feature_id", "parcel_id")
    rows = {r["parcel_id"]: r for r in ranking.parcels(scored, layer).collect()}
    assert rows[0]["area_acres"] == pytest.approx(61.776, abs=1e-3) and rows[0]["size_score"] == 100
    assert rows[0]["cell_score"] == pytest.approx(94.1667, abs=1e-3) and rows[0]["score"] == pytest.approx(95.3333, abs=1e-3)
    assert rows[2]["cell_score"] == pytest.approx(92.5) and rows[2]["score"] == pytest.approx(94.0)
    assert rows[3]["cell_score"] is None and rows[3]["score"] is None


def test_short_connector_scores_nothing(spark, cells):
    """A 6 m connector beside a step in the ground: too short for a head of its own, and connectors take no other."""
    from pyspark.sql import functions as F

    from landrank.operators import scorers, spatial

    x0, y0 = 380000.0, 4900000.0
    line = spark.createDataFrame([(0, 0, 0, x0 + 100, y0 + 125, x0 + 106, y0 + 125, "WACO25", 3)], "line_id long, part int, seg int, x1 double, y1 double, x2 double, y2 double, FEAT_CODE string, LINE_CLASS int")
    rows = spark.range(625).select(F.expr("id div 25").alias("row"), F.expr("id % 25").alias("col"))
    pixels = rows.select("row", "col", (x0 + F.col("col") * 10 + 5).alias("x"), (y0 + 250 - F.col("row") * 10 - 5).alias("y"), F.when(F.col("row") < 5, 7.0).otherwise(2.0).alias("z"))
    context = scorers.Context(bbox=(x0, y0, x0 + 250, y0 + 250), size=250, pixels=pixels, origin=(x0, y0 + 250), resolution=10, streams=spatial.with_lengths(line))
    assert scorers.hydro_power(cells.where("cell_id = 0"), context).first()["score"] == 0
