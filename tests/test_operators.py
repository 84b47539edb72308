"""Operators against brute force, numpy and hand-made cases."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from landrank.functions import geometry as g
from landrank.functions import projection
from landrank.operators import exclusions, flow, grid, ranking, spatial, statistics, terrain


def test_grid(spark):
    rows = grid.generate(spark, (0, 0, 1000, 1000), 250).orderBy("cell_id").collect()
    assert len(rows) == 16 and grid.generate(spark, (0, 0, 1000, 1000), 500).count() == 4
    assert (rows[0]["xmin"], rows[0]["ymin"]) == (0, 0) and (rows[1]["xmin"], rows[1]["ymin"]) == (0, 250)
    assert all(r["xmax"] - r["xmin"] == 250 and r["ymax"] - r["ymin"] == 250 for r in rows)
    assert grid.generate(spark, (0, 0, 1001, 999), 250).count() == 20
    assert grid.generate(spark, (0, 0, 0, 0), 250).count() == 0


def test_mask(cells, rectangles):
    assert grid.cells_within(cells, None).count() == 16
    west = grid.cells_within(cells, rectangles([(0, 0, 500, 1000)]))
    assert west.count() == 8 and west.agg(F.max("cx")).first()[0] < 380501


def test_rural_cells(cells, rectangles):
    land = rectangles([(0, 0, 250, 250, "Urban"), (250, 0, 500, 250, "Forest"), (500, 0, 750, 250, None), (600, 600, 625, 625, "residential area")], ["Land_Type"])
    kind = grid.type_column(land)
    assert kind == "Land_Type"
    got = {r["cell_id"] for r in grid.rural_cells(cells, land, (380000, 4900000, 381000, 4901000), kind).collect()}
    assert got == set(range(16)) - {0, 10}  # the corner (625, 625) of the last one is cell 10's centre: on the boundary counts as urban
    assert grid.rural_cells(cells, None, None, None).count() == 16


def test_exclusions(spark, cells, rectangles):
    assert exclusions.load(spark, None, None).count() == 0
    none = exclusions.apply(cells, exclusions.load(spark, None, None))
    assert {r["status"] for r in none.collect()} == {"eligible"}
    both = exclusions.apply(cells, exclusions.load(spark, rectangles([(0, 0, 200, 200)]), rectangles([(100, 100, 150, 150)])))
    row = both.where("cell_id = 0").first()
    assert row["status"] == "excluded" and row["exclusion_reasons"] == "protected_area; flood_zone"


def test_exclusion_by_overlap_alone(spark, cells, rectangles):
    """Two zones that miss the centre and cover 0.56 of the cell together; each alone does not reach a half."""
    two = exclusions.load(spark, None, rectangles([(0, 0, 250, 70), (0, 180, 250, 250)]))
    found = exclusions.apply(cells, two)
    assert found.where("cell_id = 0").first()["exclusion_reasons"] == "flood_zone"
    assert found.where("status = 'excluded'").count() == 1
    one = exclusions.load(spark, None, rectangles([(0, 0, 250, 70)]))
    assert exclusions.apply(cells, one).where("status = 'excluded'").count() == 0


def test_polygon_overlap_with_hole(spark, cells):
    x, y = 380000.0, 4900000.0
    dots = lambda *ps: [{"x": x + a, "y": y + b} for a, b in ps]
    geom = [[dots((0, 0), (250, 0), (250, 250), (0, 250), (0, 0)), dots((50, 50), (50, 150), (150, 150), (150, 50), (50, 50))], [dots((250, 0), (500, 0), (250, 250))]]
    rows = spark.createDataFrame([(7, geom)], f"feature_id long, geom {g.POLYGONS}")
    rows = rows.withColumn("edges", g.polygon_edges(F.col("geom"))).withColumns(dict(zip(("xmin", "ymin", "xmax", "ymax"), g.edges_bounds(F.col("edges")), strict=True)))
    got = {r["cell_id"]: r["share"] for r in spatial.polygon_overlaps(cells, rows).collect()}
    assert got == {0: pytest.approx(1 - 10000 / 62500), 4: pytest.approx(0.5)}


def _random_segments(n, seed):
    r = random.Random(seed)
    return [(i, *(x := (r.uniform(0, 1000), r.uniform(0, 1000))), x[0] + r.uniform(-200, 200), x[1] + r.uniform(-200, 200)) for i in range(n)]


def _point_segment(px, py, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    t = max(0, min(1, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy or 1)))
    return math.hypot(px - x1 - t * dx, py - y1 - t * dy)


def _meets(x1, y1, x2, y2, box):
    t0, t1 = 0.0, 1.0
    for p, q in ((x1 - x2, x1 - box[0]), (x2 - x1, box[2] - x1), (y1 - y2, y1 - box[1]), (y2 - y1, box[3] - y1)):
        if p == 0:
            if q < 0:
                return False
        elif p < 0:
            t0 = max(t0, q / p)
        else:
            t1 = min(t1, q / p)
    return t0 <= t1


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_is_brute_force(spark, seed):
    cells = grid.generate(spark, (0, 0, 1000, 1000), 125)
    segments = _random_segments(12, seed)
    rows = spark.createDataFrame(segments, "line_id long, x1 double, y1 double, x2 double, y2 double")
    got = {r["cell_id"]: r["distance"] for r in spatial.nearest_within(cells, rows, 150).collect()}
    for c in cells.collect():
        box = (c["xmin"], c["ymin"], c["xmax"], c["ymax"])
        want = min(0.0 if _meets(*s[1:], box) else _point_segment(c["cx"], c["cy"], *s[1:]) for s in segments)
        assert got.get(c["cell_id"]) == (pytest.approx(want) if want <= 150 else None)


def test_points_in_polygons_is_brute_force(spark):
    r = random.Random(5)
    shapes = [[(math.cos(a) * r.uniform(50, 200) + cx, math.sin(a) * r.uniform(50, 200) + cy) for a in np.linspace(0, 2 * math.pi, 9)[:-1]] for cx, cy in ((300, 300), (700, 600), (500, 500))]
    rows = spark.createDataFrame([(i, [[[{"x": x, "y": y} for x, y in s]]]) for i, s in enumerate(shapes)], f"feature_id long, geom {g.POLYGONS}")
    rows = rows.withColumn("edges", g.polygon_edges(F.col("geom"))).withColumns(dict(zip(("xmin", "ymin", "xmax", "ymax"), g.edges_bounds(F.col("edges")), strict=True)))
    points = [(i, r.uniform(0, 1000), r.uniform(0, 1000)) for i in range(400)]
    got = {(a["id"], a["feature_id"]) for a in spatial.points_in_polygons(spark.createDataFrame(points, "id long, px double, py double"), rows, "px", "py", size=100).collect()}

    def inside(px, py, s):
        odd = False
        for (x1, y1), (x2, y2) in zip(s, s[1:] + s[:1], strict=True):
            if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    assert got == {(i, k) for i, x, y in points for k, s in enumerate(shapes) if inside(x, y, s)}


def test_boundary_is_outside(spark, rectangles):
    box = rectangles([(0, 0, 100, 100)])
    points = spark.createDataFrame([(0, 380050.0, 4900000.0), (1, 380050.0, 4900050.0), (2, 380000.0, 4900000.0)], "id long, px double, py double")
    assert [r["id"] for r in spatial.points_in_polygons(points, box, "px", "py").collect()] == [1]
    assert sorted(r["id"] for r in spatial.points_in_polygons(points, box, "px", "py", closed=True).collect()) == [0, 1, 2]


@pytest.mark.parametrize("tiled", [False, True])
def test_slope_is_a_gradient(spark, tiled):
    r = np.random.default_rng(3)
    z = r.uniform(0, 300, (23, 31))
    z[5:8, 5:8] = -9999
    rows = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(23) for j in range(31)], "row long, col long, z double")
    found = terrain.tiled_slope_aspect(rows, 10, 8) if tiled else terrain.slope_aspect(rows, 10)
    dy, dx = np.gradient(z, 10)
    slope = np.degrees(np.arctan(np.hypot(dx, dy)))
    aspect = np.degrees(np.arctan2(-dx, dy))
    aspect = np.where(aspect < 0, aspect + 360, aspect)
    aspect[(abs(dx) < 1e-10) & (abs(dy) < 1e-10)] = -1
    got = found.collect()
    assert len(got) == z.size
    for p in got:
        assert p["slope"] == pytest.approx(slope[p["row"], p["col"]]) and p["aspect"] == pytest.approx(aspect[p["row"], p["col"]])


def test_statistics_are_numpy(spark):
    r = np.random.default_rng(42)
    values = np.concatenate([np.zeros(30), r.uniform(0, 100, 40), np.full(30, 100.0)])
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "score double")
    row = statistics.stats(rows, ["score"]).first()
    assert (row["n"], row["at_100"], row["at_0"]) == (100, 30, 30)
    assert [row[f"p{p}"] for p in statistics.PERCENTILES] == pytest.approx(list(np.percentile(values, statistics.PERCENTILES)))
    assert row["mean"] == pytest.approx(values.mean()) and row["median"] == pytest.approx(np.median(values))
    counts = [b["n"] for b in statistics.histogram(rows, ["score"]).orderBy("bin").collect()]
    assert counts == list(np.histogram(values, bins=10, range=(0, 100))[0])


def test_band_counts(spark):
    rows = spark.createDataFrame([("high",)] * 60 + [("medium",)] * 25 + [("low",)] * 15 + [(None,)] * 5, "confidence_band string")
    assert [(r["band"], r["n"], r["percent"]) for r in statistics.band_counts(rows).collect()] == [("high", 60, 60.0), ("medium", 25, 25.0), ("low", 15, 15.0)]


def test_rank_ties(spark):
    rows = spark.createDataFrame([(0, "eligible", 9.0), (1, "eligible", 9.0), (2, "eligible", 5.0), (3, "excluded", None), (4, "eligible", None)], "cell_id long, status string, score double")
    assert {r["cell_id"]: r["rank"] for r in ranking.ranked(rows).collect()} == {0: 1, 1: 1, 2: 3, 3: None, 4: None}


def test_projection_round_trip(spark):
    rows = spark.createDataFrame([(380000.0, 4900000.0), (500000.0, 5000000.0), (650000.0, 4700000.0)], "x double, y double")
    for target in (4326, 3857):
        u, w = projection.transform(F.col("x"), F.col("y"), 2961, target)
        a, b = projection.transform(u, w, target, 2961)
        for r in rows.select("x", "y", a.alias("a"), b.alias("b")).collect():
            assert r["a"] == pytest.approx(r["x"], abs=1e-5) and r["b"] == pytest.approx(r["y"], abs=1e-5)
    lat, lon = projection.to_geographic(F.lit(500000.0), F.lit(0.0))
    row = spark.range(1).select(lat.alias("lat"), lon.alias("lon")).first()
    assert row["lat"] == pytest.approx(0) and row["lon"] == pytest.approx(-63)
    # one degree east of the meridian at 45 north, by the series of geodesy textbooks
    x, y = projection.from_geographic(F.lit(45.0), F.lit(-62.0))
    row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert row["x"] == pytest.approx(578815.30, abs=0.05) and row["y"] == pytest.approx(4983436.77, abs=0.05)
    with pytest.raises(ValueError):
        projection.transform(F.col("x"), F.col("y"), 2961, 32620)


def test_clip_and_simplify(spark):
    rows = spark.createDataFrame([(0, -50.0, 50.0, 150.0, 50.0), (1, 200.0, 200.0, 300.0, 300.0), (2, 10.0, 10.0, 20.0, 20.0)], "line_id long, x1 double, y1 double, x2 double, y2 double")
    got = {r["line_id"]: (r["x1"], r["y1"], r["x2"], r["y2"]) for r in spatial.clip_segments(rows, (0, 0, 100, 100)).collect()}
    assert got == {0: (0, 50, 100, 50), 2: (10, 10, 20, 20)}
    assert spatial.simplified_points([(0, 0), (1, 0.01), (2, 0), (3, 5), (4, 0)], 0.1) == [(0, 0), (2, 0), (3, 5), (4, 0)]


def test_contours_of_a_plane(spark):
    rows = spark.createDataFrame([(r, c, c * 10.0, -r * 10.0, c * 10.0 + 5) for r in range(5) for c in range(12)], "row long, col long, x double, y double, z double")
    got = terrain.contour_segments(rows, 50).collect()
    assert {r["elevation"] for r in got} == {50.0, 100.0} and len(got) == 8
    assert all(r["x1"] == pytest.approx(r["elevation"] - 5) and r["major"] == (r["elevation"] == 100) for r in got)


def test_flow(spark):
    z = np.array([[9, 9, 9, 9, 9, 9], [9, 2, 8, 7, 6, 9], [9, 1, 8, 7, 5, 4], [9, 3, 8, 7, 6, 9], [9, 9, 9, 9, 9, 9]], float)
    rows = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(5) for j in range(6)], "row long, col long, z double")
    filled = {(r["row"], r["col"]): r["z"] for r in flow.fill_depressions(rows, 3).collect()}
    assert filled[(2, 1)] == 8 and filled[(1, 1)] == 8 and filled[(2, 4)] == 5
    pointer = {(r["row"], r["col"]): r["pointer"] for r in flow.pointers(rows).collect()}
    assert pointer[(2, 3)] == 2 and pointer[(2, 4)] == 2 and pointer[(2, 5)] == 0 and pointer[(1, 1)] == 8
    cells = {(r["row"], r["col"]): r["cells"] for r in flow.accumulation(flow.pointers(rows)).collect()}

    def drains(at):
        seen = set()
        while pointer[at]:
            step = flow.POINTERS[pointer[at]]
            at = (at[0] + step[0], at[1] + step[1])
            assert at not in seen
            seen.add(at)
        return seen

    want = {k: 1 for k in pointer}
    for k in pointer:
        for at in drains(k):
            want[at] += 1
    assert cells == want


def test_fill_is_brute_force(spark):
    r = np.random.default_rng(11)
    z = r.integers(0, 20, (13, 17)).astype(float)
    level = np.where(np.pad(np.zeros((11, 15), bool), 1, constant_values=True), z, np.inf)
    while True:
        wide = np.pad(level, 1, constant_values=np.inf)
        low = np.min([wide[1 + a : 14 + a, 1 + b : 18 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0)
        new = np.minimum(level, np.maximum(z, low))
        if (new == level).all():
            break
        level = new
    rows = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(13) for j in range(17)], "row long, col long, z double")
    assert {(p["row"], p["col"]): p["z"] for p in flow.fill_depressions(rows, 5).collect()} == {(i, j): level[i, j] for i in range(13) for j in range(17)}


def test_flow_passes_flat_ground(spark):
    """Of a filled raster every pixel drains to an outlet, and no water is lost."""
    import numpy as np

    from landrank.operators import flow

    r = np.random.default_rng(3)
    z = r.integers(0, 4, (14, 17)).astype(float)
    z[4:9, 5:12] = -3  # a hollow wider than a tile, which fills to a flat
    z[11, 3] = np.nan
    rows = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(14) for j in range(17) if not np.isnan(z[i, j])], "row long, col long, z double")
    filled = flow.fill_depressions(rows, 5)
    to = {(p["row"], p["col"]): p["pointer"] for p in flow.pointers(filled).collect()}
    level = {(p["row"], p["col"]): p["z"] for p in filled.collect()}
    ends = set()
    for at in to:
        seen = [at]
        while to[at]:
            before, (a, b) = at, flow.POINTERS[to[at]]
            at = (at[0] + a, at[1] + b)
            assert at not in seen and level[at] <= level[before]
            seen.append(at)
        ends.add(at)
    outlets = {(i, j) for i, j in to if sum((i + a, j + b) in to for a, b in flow.POINTERS.values()) < 8}
    assert ends <= outlets
    cells = {(p["row"], p["col"]): p["cells"] for p in flow.accumulation(flow.pointers(filled)).collect()}
    assert sum(cells[e] for e in ends) == len(to)


def test_slopes_beside_holes_have_one_rule(spark):
    """A plane with a hole has the plane's slope throughout, by windows and by tiles."""
    from landrank.operators import terrain

    rows = spark.range(400).selectExpr("id div 20 row", "id % 20 col", "cast((id div 20) * 10 + (id % 20) * 10 as double) z").where("not (row = 7 and col between 4 and 6) and not (row = 0 and col = 0)")
    a = {(r["row"], r["col"]): (r["slope"], r["aspect"]) for r in terrain.slope_aspect(rows, 10).collect()}
    b = {(r["row"], r["col"]): (r["slope"], r["aspect"]) for r in terrain.tiled_slope_aspect(rows, 10, 6).collect()}
    assert set(a) == set(b) and all(x == pytest.approx(b[k], abs=1e-9) for k, x in a.items())
    plane = a[(15, 15)]
    assert sum(x == pytest.approx(plane, abs=1e-9) for x in a.values()) == len(a)


def test_ranks_of_continuous_scores(spark):
    from landrank.operators import ranking

    rows = [(i, "excluded" if i % 11 == 0 else "eligible", None if i % 7 == 0 else float(i * 7919 % 1000) / 3 + i % 5) for i in range(900)]
    got = {r["cell_id"]: r["rank"] for r in ranking.ranked(spark.createDataFrame(rows, "cell_id long, status string, score double")).collect()}
    scores = [s for _, st, s in rows if st == "eligible" and s is not None]
    for i, status, s in rows:
        assert got[i] == (None if status == "excluded" or s is None else 1 + sum(x > s for x in scores))


@pytest.mark.parametrize("few", [100_000, 0])
def test_parcels_are_not_broadcast(spark, monkeypatch, few):
    """Cells that come out of joins look large, and parcels small whatever their number; the build side must not be theirs."""
    monkeypatch.setattr(ranking, "FEW", few)
    cells = grid.generate(spark, (0, 0, 10000, 10000), 250)
    scores = spark.range(1600).select(F.col("id").alias("cell_id"), F.expr("if(id % 11 = 0, null, id * 37 % 101 / 1.0D)").alias("score"))
    scores = scores.withColumn("status", F.expr("if(cell_id % 5 = 0, 'excluded', 'eligible')"))
    cells = cells.join(scores, "cell_id").join(scores.select("cell_id", F.lit(1).alias("more")), "cell_id", "left")
    layer = spark.range(300).select(F.col("id").alias("parcel_id"), F.expr("id * 433 % 9000 / 1.0D").alias("xmin"), F.expr("id * 719 % 9000 / 1.0D").alias("ymin"))
    layer = layer.withColumns({"xmax": F.expr("xmin + parcel_id * 37 % 1301 + 20.0D"), "ymax": F.expr("ymin + parcel_id * 53 % 1301 + 20.0D")})
    found = ranking.parcels(cells, grid.polygons_of_rectangles(layer))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    joins = [x for x in plan.splitlines() if "Join [__bx" in x]
    assert len(joins) == 1 and ("BroadcastHashJoin" in joins[0] and "BuildLeft" in joins[0] if few else "SortMergeJoin" in joins[0])
    points = [r for r in cells.collect() if r["status"] != "excluded" and r["score"] is not None]
    got = {r["parcel_id"]: r["cell_score"] for r in found.collect()}
    assert len(got) == 300
    for p in layer.collect():
        best = sorted((-r["score"], r["cell_id"]) for r in points if p["xmin"] < r["cx"] < p["xmax"] and p["ymin"] < r["cy"] < p["ymax"])[:3]
        assert got[p["parcel_id"]] == (pytest.approx(-sum(s for s, _ in best) / len(best)) if best else None)


def test_what_the_log_says(spark):
    from landrank.operators import scorers

    rows = [(0, "eligible", 10.0, 40.0, "low"), (1, "eligible", 30.0, 60.0, "high"), (2, "excluded", None, None, None)]
    cells, seen = scorers.observed(spark.createDataFrame(rows, "cell_id long, status string, score_solar double, score double, confidence_band string"), ["solar"])
    assert cells.count() == 3
    assert scorers.told(seen.get) == ["1 of 3 cells excluded", "score_solar: mean 20.0, median 10.0", "score: mean 50.0, median 40.0", "confidence: 1 high, 0 medium, 1 low"]


@pytest.mark.parametrize("tile", [100.0, 300.0, 1e9])
def test_contour_lines(spark, tile):
    """Every segment is in one line; rings close; lines end only at the rim or beside missing pixels; tiles make no difference."""
    z = lambda i, j: 120 + 90 * math.sin(i / 5) * math.cos(j / 6) + i
    rows = spark.createDataFrame([(i, j, j * 10.0, -i * 10.0, z(i, j)) for i in range(40) for j in range(50) if not (18 <= i < 21 and 20 <= j < 24)], "row long, col long, x double, y double, z double")
    segments = {frozenset({(r["x1"], r["y1"]), (r["x2"], r["y2"])}) for r in terrain.contour_segments(rows, 50).collect() if (r["x1"], r["y1"]) != (r["x2"], r["y2"])}
    lines = [[(p["x"], p["y"]) for p in r["parts"][0]] for r in terrain.contour_lines(rows, 50, None, 2, tile).collect()]
    steps = [frozenset(s) for line in lines for s in zip(line, line[1:])]
    assert len(steps) == len(set(steps)) and set(steps) == segments
    ends = [p for line in lines if line[0] != line[-1] for p in (line[0], line[-1])]
    assert any(line[0] == line[-1] for line in lines) and len(ends) == len(set(ends))
    degree = Counter(p for s in segments for p in s)
    assert sorted(ends) == sorted(p for p, n in degree.items() if n % 2)
    assert all(len(r["parts"][0]) >= 5 for r in terrain.contour_lines(rows, 50, None, 5, tile).collect())


def test_no_contours(spark):
    rows = spark.createDataFrame([], "row long, col long, x double, y double, z double")
    assert terrain.contour_lines(rows).collect() == []


def test_fine_shapes(spark):
    """Overlaps and centres of polygons with holes and several parts."""
    outer, hole, other = ([(0.0, 0.0), (400.0, 0.0), (400.0, 400.0), (0.0, 400.0), (0.0, 0.0)], [(100.0, 100.0), (300.0, 100.0), (300.0, 300.0), (100.0, 300.0), (100.0, 100.0)], [(600.0, 0.0), (700.0, 0.0), (600.0, 100.0), (600.0, 0.0)])
    shapes = spark.createDataFrame([(0, "protected_area", [[outer, hole], [other]])], "feature_id long, exclusion_reason string, geom array<array<array<struct<x:double,y:double>>>>")
    from landrank.sources import vector

    rows = vector.with_bounds(shapes.withColumns({"parts": F.lit(None).cast(g.PARTS), "x": F.lit(None).cast("double"), "y": F.lit(None).cast("double")}))
    cells = grid.generate(spark, (0, 0, 1000, 500), 250)
    shares = {r["cell_id"]: r["share"] * 62500 for r in spatial.polygon_overlaps(cells, rows).collect()}
    assert shares == pytest.approx({0: 62500 - 22500, 1: 37500 - 7500, 2: 37500 - 7500, 3: 22500 - 2500, 4: 5000.0})
    centres = {r["cell_id"] for r in spatial.points_in_polygons(cells, rows.select("feature_id", "xmin", "ymin", "xmax", "ymax", "edges"), "cx", "cy").collect()}
    assert centres == {1, 2, 3}
