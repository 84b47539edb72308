"""Threshold tables, weights, hydraulics, bands and classes, value by value."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from landrank.functions import styles
from landrank.functions import thresholds as t
from landrank.operators import hydro, ranking, scorers, terrain

CASES = [
    (t.ELEVATION, [(50, 100), (150, 90), (5, 10), (100, 90), (300, 30), (30, 100), (-5, 0)]),
    (t.HYDRO_POWER, [(2500, 100), (2000, 100), (1500, 80), (700, 60), (300, 40), (60, 20), (30, 0)]),
    (t.ACCESS_DISTANCE, [(0, 100), (25, 80), (50, 50), (100, 50), (300, 20), (500, 0), (1000, 0), (float("inf"), 0)]),
    (t.BUILDABLE_PERCENT, [(50, 100), (25, 80), (12, 60), (7, 30), (2, 0)]),
    (t.PARCEL_ACRES, [(60, 100), (30, 90), (15, 70), (7, 40), (3, 20), (1.5, 5), (0.5, 0)]),
    (t.SOLAR_PERCENT, [(40, 100), (30, 80), (20, 60), (10, 40), (0, 20)]),
]


@pytest.mark.parametrize("table,pairs", CASES)
def test_lookup(spark, table, pairs):
    rows = spark.createDataFrame([(float(v), float(s)) for v, s in pairs], "v double, s double")
    assert all(r["got"] == r["s"] for r in rows.select("s", t.lookup(F.col("v"), table).alias("got")).collect())


def test_lookup_of_nothing(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),)], "v double").select(t.lookup(F.col("v"), t.ELEVATION).alias("s"))
    assert [r["s"] for r in rows.collect()] == [0.0, 0.0]


def test_weights():
    assert sum(t.WEIGHTS.values()) == 100
    scaled = t.scaled_weights({"a": 35, "b": 25, "c": 40}, ["a", "b"])
    assert scaled["a"] == pytest.approx(35 / 60 * 100) and sum(scaled.values()) == pytest.approx(100)
    assert t.scaled_weights({"a": 0}, ["a"]) == {"a": 0}


def test_flow_and_power(spark):
    row = spark.range(1).select(hydro.flow(F.lit(10.0)).alias("q"), hydro.power(F.lit(0.01), F.lit(10.0)).alias("p"), hydro.power(F.lit(0.01), F.lit(0.0)).alias("none")).first()
    assert row["q"] == pytest.approx(0.08) and row["p"] == pytest.approx(490.5) and row["none"] == 0


@pytest.mark.parametrize("slope,aspect,expected", [(0, 2, 2), (3, 45, 2), (4, 270, 2), (20, 180, 2), (15, 100, 1), (20, 0, 0), (25, 350, 0), (40, 10, 0), (5, 135, 2), (45, 90, 1), (35.5, 180, 1)])
def test_solar_class(spark, slope, aspect, expected):
    assert spark.range(1).select(terrain.solar_class(F.lit(float(slope)), F.lit(float(aspect))).alias("c")).first()["c"] == expected


@pytest.mark.parametrize("value,expected", [(100, "high"), (80, "high"), (79.5, "low"), (79, "medium"), (55, "medium"), (54.5, "low"), (0, "low")])
def test_confidence_band(spark, value, expected):
    assert spark.range(1).select(ranking.confidence_band(F.lit(float(value))).alias("b")).first()["b"] == expected


def test_confidence(spark):
    row = spark.createDataFrame([(0, "eligible", 70.0, 60.0, 40.0), (1, "eligible", 70.0, 20.0, 0.0), (2, "excluded", None, None, None)], "cell_id long, status string, score double, score_access double, score_hydro double")
    assert [r["confidence"] for r in ranking.confidence(row).orderBy("cell_id").collect()] == [100, 75, None]
    assert ranking.confidence(row, {"no_flood_data": True}).where("cell_id = 0").first()["confidence"] == 80
    assert ranking.confidence(row, {"no_flood_data": True, "hydro_drainage_proxy_only": True}).where("cell_id = 0").first()["confidence"] == 60
    assert ranking.confidence(row, {"x": True}, {"x": 500}).where("cell_id = 0").first()["confidence"] == 0
    assert ranking.confidence(row).where("cell_id = 1").first()["flags"] == "access_unverified; hydro_low_confidence"


def test_registry(spark):
    cells = spark.createDataFrame([(0, "eligible"), (1, "excluded")], "cell_id long, status string")

    @scorers.register("always_100")
    def _a(rows, context):
        return rows.select("cell_id", F.lit(100.0).alias("score"))

    @scorers.register("always_50")
    def _b(rows, context):
        return rows.select("cell_id", F.lit(50.0).alias("score"))

    @scorers.register("broken")
    def _c(rows, context):
        return rows.select("cell_id", F.col("no_such_column").alias("score"))

    found = scorers.composite(cells, scorers.Context((0, 0, 1, 1)), {"always_100": 60, "always_50": 40}, ["always_100", "always_50"])
    rows = {r["cell_id"]: r for r in found.collect()}
    assert rows[0]["score"] == pytest.approx(80) and rows[1]["score"] is None and rows[1]["score_always_50"] is None
    assert scorers.composite(cells, scorers.Context((0, 0, 1, 1)), {"broken": 1}, ["broken"]).where("cell_id = 0").first()["score_broken"] == 0
    with pytest.raises(KeyError, match="Unknown scoring metric"):
        scorers.scorer("nothing")
    assert {"hydro", "elevation", "access", "solar", "buildable"} <= set(scorers.names())


def test_failed_criterion_is_logged_or_raised(spark, caplog, monkeypatch):
    from pyspark.errors import AnalysisException

    monkeypatch.setitem(scorers._known, "failing", lambda rows, context: rows.select("cell_id", F.col("no_such_column").alias("score")))
    cells, context = spark.createDataFrame([(0, "eligible")], "cell_id long, status string"), scorers.Context((0, 0, 1, 1))
    assert scorers.composite(cells, context, {"failing": 1}, ["failing"]).first()["score"] == 0
    assert "Criterion failing failed; it scores 0" in caplog.text and "no_such_column" in caplog.text
    with pytest.raises(AnalysisException, match="no_such_column"):
        scorers.composite(cells, context, {"failing": 1}, ["failing"], strict=True)


def test_missing_layers_score_zero(cells):
    empty = scorers.Context((0, 0, 1, 1))
    for name in ("hydro", "elevation", "access", "solar", "buildable"):
        assert {r["score"] for r in scorers.scorer(name)(cells, empty).collect()} == {0.0}


def test_flowing_water_and_roads(spark):
    codes = spark.createDataFrame([("WARV50",), ("WALK1",), ("WATO1",), ("WAIS1",), ("WADM",), (None,)], "c string")
    assert [r["k"] for r in codes.select(styles.flowing(F.col("c")).alias("k")).collect()] == [True, False, False, False, False, True]
    ways = spark.createDataFrame([("primary",), ("footway",), ("service",), (None,)], "h string")
    rows = ways.select(styles.driven(F.col("h")).alias("d"), styles.on_road_map(F.col("h")).alias("m")).collect()
    assert [(r["d"], r["m"]) for r in rows] == [(True, True), (False, False), (True, False), (True, True)]


def test_drainage_area(spark):
    rows = hydro.with_optional(spark.createDataFrame([(0, 1000.0, "WARV", None), (1, 100.0, "WARV", None), (2, 100.0, "WACO1", 1), (3, 100.0, "WARV", 3), (4, 100.0, None, 2)], "line_id long, length double, FEAT_CODE string, LINE_CLASS int"))
    got = [r["a"] for r in rows.select("line_id", hydro.drainage_area(F.col("length")).alias("a")).orderBy("line_id").collect()]
    assert got == pytest.approx([2.0, 0.5, 10.0, 25.0, 5.0])


def test_tables_go_with_their_run(spark):
    import os

    from landrank.functions import storage

    kept = storage.stored(spark.range(3).toDF("id"), "kept")
    with storage.tables_of(spark):
        inner = storage.stored(spark.range(4).toDF("id"), "gone")
        path = inner.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path) and inner.count() == 4
    assert not os.path.exists(path) and kept.count() == 3 and not storage._open
