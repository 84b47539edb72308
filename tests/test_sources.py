"""Files in and out: configuration, GeoJSON, GeoPackage, shapefile, GeoTIFF, reports, the long commands."""

from __future__ import annotations

import csv
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from landrank import cli
from landrank.operators import grid
from landrank.plans import export, mapview, pipeline, report
from landrank.sources import config as configuration
from landrank.sources import geojson, ingest, raster, vector, wkb

X0, Y0 = 380000.0, 4900000.0


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("study_area:\n  name: here\n  bbox: [0, 0, 10, 10]\ncell_size_m: 5\nweights: {hydro: 50, solar: 50}\nenabled_criteria: [hydro, solar]\n")
    c = configuration.load(path)
    assert c.bbox == (0, 0, 10, 10) and c.cell_size == 5 and c.name == "here" and c.scaled_weights() == {"hydro": 50, "solar": 50}
    with pytest.raises(FileNotFoundError):
        configuration.load(tmp_path / "none.yaml")
    path.write_text("weights: {hydro: 50}\nenabled_criteria: [hydro, wind]\n")
    with pytest.raises(ValueError, match="wind"):
        configuration.load(path)
    path.write_text("{}")
    assert sum(configuration.load(path).scaled_weights().values()) == pytest.approx(100)


def _square(a, b, c, d):
    return [(X0 + a, Y0 + b), (X0 + c, Y0 + b), (X0 + c, Y0 + d), (X0 + a, Y0 + d), (X0 + a, Y0 + b)]


def test_wkb():
    ring = _square(0, 0, 10, 10)
    assert wkb.read(wkb.polygon([ring]))["geom"] == [[[{"x": x, "y": y} for x, y in ring]]]
    assert wkb.read(wkb.line(ring[:2]))["parts"] == [[{"x": x, "y": y} for x, y in ring[:2]]]
    assert (wkb.read(wkb.point(1, 2))["x"], wkb.read(wkb.point(1, 2))["y"]) == (1, 2)
    high = struct.pack(">BI3d", 0, 1001, 1, 2, 3)
    assert wkb.read(high)["x"] == 1
    many = struct.pack("<BII", 1, 6, 2) + wkb.polygon([ring]) + wkb.polygon([ring])
    assert len(wkb.read(many)["geom"]) == 2


def test_geopackage(spark, tmp_path):
    cells = grid.generate(spark, (X0, Y0, X0 + 500, Y0 + 500), 250).withColumn("name", F.concat(F.lit("n"), "cell_id"))
    path = str(tmp_path / "cells.gpkg")
    vector.write_gpkg(cells, path, "cells")
    back = vector.read(spark, path).orderBy("cell_id").collect()
    assert [r["name"] for r in back] == ["n0", "n1", "n2", "n3"] and vector.epsg_of(path) == 2961
    assert (back[3]["xmin"], back[3]["ymax"]) == (X0 + 250, Y0 + 500)
    with pytest.raises(Exception, match="has no layer"):
        vector.read(spark, path, layer="other").count()


def _shapefile(path, kind, shapes, names):
    """A small shapefile with one text attribute."""
    body = b""
    for i, parts in enumerate(shapes):
        flat = [p for part in parts for p in part]
        starts = np.cumsum([0, *map(len, parts[:-1])]).tolist()
        data = struct.pack("<i4d", kind, 0, 0, 0, 0) + struct.pack(f"<2i{len(parts)}i", len(parts), len(flat), *starts) + b"".join(struct.pack("<2d", *p) for p in flat)
        body += struct.pack(">2i", i + 1, len(data) // 2) + data
    path.with_suffix(".shp").write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, kind, *[0] * 8) + body)
    field = b"NAME\0\0\0\0\0\0\0C" + bytes(4) + bytes([10, 0]) + bytes(14) + b"KEY\0\0\0\0\0\0\0\0N" + bytes(4) + bytes([6, 0]) + bytes(14)
    head = struct.pack("<4BIHH", 3, 1, 1, 1, len(names), 32 + 64 + 1, 17) + bytes(20)
    rows = b"".join(b" " + n.encode().ljust(10) + str(i).rjust(6).encode() for i, n in enumerate(names))
    path.with_suffix(".dbf").write_bytes(head + field + b"\r" + rows)
    path.with_suffix(".prj").write_text('PROJCS["NAD_1983_CSRS_UTM_Zone_20N",GEOGCS["x"]]'.replace("Zone", "zone"))


def test_shapefile(spark, tmp_path):
    outer, hole = _square(0, 0, 100, 100)[::-1], _square(20, 20, 40, 40)
    _shapefile(tmp_path / "areas", 5, [[outer, hole], [_square(200, 0, 300, 100)[::-1]]], ["Urban", ""])
    rows = vector.read(spark, str(tmp_path / "areas.shp")).orderBy("feature_id").collect()
    assert [r["NAME"] for r in rows] == ["Urban", None] and [r["KEY"] for r in rows] == [0, 1]
    assert len(rows[0]["geom"]) == 1 and len(rows[0]["geom"][0]) == 2
    assert (rows[1]["xmin"], rows[1]["xmax"]) == (X0 + 200, X0 + 300)


def test_geojson(spark, tmp_path):
    shapes = [
        {"type": "Polygon", "coordinates": [[[-64, 44], [-63.9, 44], [-63.9, 44.1], [-64, 44]]]},
        {"type": "LineString", "coordinates": [[-64, 44], [-63.9, 44.1]]},
        {"type": "Point", "coordinates": [-63, 45]},
    ]
    path = tmp_path / "l.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": s, "properties": {"highway": k}} for s, k in zip(shapes, ("a", None, "c"), strict=True)]}))
    rows = {r["feature_id"]: r for r in geojson.read(spark, str(path)).collect()}
    assert [rows[i]["highway"] for i in range(3)] == ["a", None, "c"]
    assert len(rows[0]["edges"]) >= 3 and rows[1]["parts"] and rows[2]["x"] == pytest.approx(500000)
    cells = grid.generate(spark, (X0, Y0, X0 + 250, Y0 + 250), 250)
    feature = json.loads(geojson.features(cells, geojson.rectangle_ring, ["cell_id"], 2961).first()["feature"])
    assert feature["properties"] == {"cell_id": 0} and len(feature["geometry"]["coordinates"][0]) == 5
    assert feature["geometry"]["coordinates"][0][0][0] == pytest.approx(-64.49, abs=0.02)


@pytest.mark.parametrize("kind", ["f4", "f8", "i2", "u1"])
def test_geotiff(spark, tmp_path, kind):
    z = (np.arange(35).reshape(5, 7) * 3).astype(kind)
    path = tmp_path / "z.tif"
    path.write_bytes(raster.encode(z, X0, Y0 + 50, 10.0, -9999 if kind != "u1" else 255))
    head = raster.read_header(spark, str(path))
    assert (head.width, head.height, head.epsg, head.left, head.top) == (7, 5, 2961, X0, Y0 + 50)
    rows = {(r["row"], r["col"]): r for r in raster.read(spark, str(path)).collect()}
    assert len(rows) == 35 and all(rows[i, j]["z"] == z[i, j] for i in range(5) for j in range(7))
    assert (rows[0, 0]["x"], rows[0, 0]["y"]) == (X0 + 5, Y0 + 45)


def test_tiff_unpacking():
    assert raster._packbits(bytes([2, 1, 2, 3, 254, 9])) == bytes([1, 2, 3, 9, 9, 9])
    codes = [256, 45, 45 + 0, 258, 257]  # clear, "-", "-", "--", end
    bits = "".join(f"{c:09b}" for c in codes)
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert raster._lzw(packed) == b"----"
    with pytest.raises(ValueError):
        raster.header(b"no tiff")


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    """Raw files of the common frame, and a configuration for them."""
    root = tmp_path_factory.mktemp("project")
    for d in ("dem", "hydro", "roads", "exclusions", "land-cover", "buildings"):
        (root / "raw" / d).mkdir(parents=True)
    z = np.repeat(np.linspace(50, 200, 100)[::-1, None], 100, axis=1).astype("f4")
    (root / "raw/dem/cdem_a.tif").write_bytes(raster.encode(z, X0, Y0 + 1000, 10.0, -9999))
    line = [(X0 + a, Y0 + b) for a, b in ((100, 900), (200, 700), (300, 400), (400, 100))]
    _shapefile(root / "raw/hydro/streams", 3, [[line]], ["WARV50"])
    _shapefile(root / "raw/roads/roads", 3, [[[(X0 - 500, Y0 + 500), (X0 + 1500, Y0 + 500)]], [[(X0 + 500, Y0), (X0 + 500, Y0 + 1000)]]], ["primary", "track"])
    _shapefile(root / "raw/exclusions/parks", 5, [[_square(500, 500, 1000, 1000)[::-1]]], ["park"])
    _shapefile(root / "raw/buildings/b", 5, [[_square(100, 100, 110, 110)[::-1]]], ["house"])
    path = root / "config.yaml"
    path.write_text(f"study_area:\n  bbox: [{X0}, {Y0}, {X0 + 1000}, {Y0 + 1000}]\npaths:\n  raw: {root}/raw\n  processed: {root}/processed\n  output: {root}/output\n")
    return path


def test_long_commands(spark, project, capsys):
    config = configuration.load(project)
    assert cli.main(["--config", str(project), "analyze"], spark) == 1  # nothing scored yet
    found = ingest.check(spark, config)
    assert found["dem"]["status"] == "ok" and found["dem"]["shape"] == (100, 100) and found["streams"]["feature_count"] == 1
    assert found["civic"]["status"] == "MISSING (optional)" and found["land_cover"]["status"] == "MISSING (required)"
    assert pipeline.score(spark, config) is None  # no grid yet
    assert cli.main(["--config", str(project), "prepare"], spark) == 0
    assert ingest.load(spark, config, "candidate_grid").count() == 16 and ingest.load(spark, config, "dem").count() == 10000
    slopes = raster.read(spark, str(config.processed / "slope.tif")).collect()
    assert len(slopes) == 10000 and all(r["z"] == pytest.approx(8.6156, abs=1e-3) for r in slopes)
    assert {r["z"] for r in raster.read(spark, str(config.processed / "buildable.tif")).collect()} == {1.0}
    road = ingest.load(spark, config, "roads").where("line_id = 0").first()
    assert road["x1"] == X0 - 500  # such files are not cut
    assert cli.main(["--config", str(project), "score"], spark) == 0
    cells = {r["cell_id"]: r for r in report.scored_cells(spark, config).collect()}
    assert sorted(i for i, r in cells.items() if r["status"] == "excluded") == [10, 11, 14, 15]
    assert cells[0]["score_elevation"] == 100 and cells[0]["score_solar"] == 100 and cells[0]["score_buildable"] == 100 and cells[12]["score_access"] == 20
    rows = list(csv.DictReader((config.output / "scored_cells.csv").open()))
    assert len(rows) == 16 and float(rows[0]["latitude"]) == pytest.approx(44.24, abs=0.05)
    ranked = list(csv.DictReader((config.output / "ranked_eligible.csv").open()))
    assert len(ranked) == 12 and [int(r["rank"]) for r in ranked] == sorted(int(r["rank"]) for r in ranked)
    assert len(json.loads((config.output / "scored_cells.geojson").read_text())["features"]) == 16
    assert cli.main(["--config", str(project), "visualize"], spark) == 0
    page = (config.output / "map.html").read_text()
    assert all(t in page for t in ("Excellent (80-100)", "Streams & Rivers", "Roads", "Buildings", "Protected Areas", "Elevation Contours"))
    capsys.readouterr()
    assert cli.main(["--config", str(project), "analyze"], spark) == 0
    text = capsys.readouterr().out
    assert "--- score_hydro ---" in text and "Confidence bands:" in text and text.count("     0-   10 |") == 7


def test_report_text(spark):
    rows = spark.createDataFrame([(100.0,)] * 3 + [(0.0,)], "score double")
    text = report.text(rows)
    assert "Count: 4  |  Min: 0.0  |  Max: 100.0  |  Mean: 75.0  |  Median: 100.0" in text
    assert "Cells at 100: 3 (75.0%)  |  Cells at 0: 1 (25.0%)" in text and "--- score_hydro ---\n  Column not found in output" in text
    assert "No valid data" in report.text(spark.createDataFrame([], "score double"))


def test_export_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "cell_id long, xmin double, ymin double, xmax double, ymax double, status string, score double, rank int")
    export.run(empty, tmp_path, 2961)
    assert (tmp_path / "scored_cells.csv").exists() and not (tmp_path / "ranked_eligible.csv").exists()


def test_map_page_without_features():
    assert "layers = {}" in mapview.page({"a": []}, [[0, 0], [1, 1]], [[0, 0], [1, 1]], {"hydro": 100})


def test_command_line(capsys):
    with pytest.raises(SystemExit) as e:
        cli.main(["--help"])
    assert e.value.code == 0 and "visualize" in capsys.readouterr().out
    for name in cli.COMMANDS:
        with pytest.raises(SystemExit) as e:
            cli.main([name, "--help"])
        assert e.value.code == 0
    assert cli.main(["--config", "/nowhere/config.yaml", "check-data"]) == 1


def test_dem_in_degrees_is_turned(spark, tmp_path):
    """A plane given in longitude and latitude comes out as the same plane at the turned centres."""
    from landrank.functions import projection

    (tmp_path / "raw/hrdem").mkdir(parents=True)
    step, left, top = 0.0005, -64.52, 44.27
    z = (100 + 1000 * ((left + (np.arange(160) + 0.5) * step) + 64.5)[None, :] + 500 * ((top - (np.arange(160) + 0.5) * step) - 44.2)[:, None]).astype("f8")
    (tmp_path / "raw/hrdem/a.tif").write_bytes(raster.encode(z, left, top, step, -9999, 4326))
    config = configuration.Config(bbox=(X0, Y0, X0 + 1000, Y0 + 1000), raw=tmp_path / "raw", processed=tmp_path / "processed")
    assert ingest.dem(spark, config) == ingest.dem(spark, config)  # the second time it is there already
    lat, lon = projection.to_geographic(F.col("x"), F.col("y"))
    rows = ingest.load(spark, config, "dem").select("row", "col", "z", lat.alias("lat"), lon.alias("lon")).collect()
    head = ingest.dem_header(config)
    assert len(rows) == int(-(-1000 // head["resolution"])) ** 2 and min(r["row"] for r in rows) == 0
    assert all(r["z"] == pytest.approx(100 + 1000 * (r["lon"] + 64.5) + 500 * (r["lat"] - 44.2), abs=1e-6) for r in rows)


def test_rings_with_holes_are_written_apart(spark, tmp_path):
    from landrank.sources import vector

    square = lambda x, y, n: [(x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y)]
    rings = [square(0.0, 0.0, 100), square(20.0, 20.0, 10), square(300.0, 0.0, 50)]
    edges = [(*a, *b) for ring in rings for a, b in zip(ring, ring[1:])]
    rows = spark.createDataFrame([(1, edges)], "cell_id long, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")
    vector.write_gpkg(rows, str(tmp_path / "a.gpkg"), "cells")
    got = vector.read(spark, str(tmp_path / "a.gpkg")).first()
    assert [[[(p["x"], p["y"]) for p in r] for r in polygon] for polygon in got["geom"]] == [rings[:2], rings[2:]]
    assert [[tuple(p) for p in r] for r in vector.rings_of(got["edges"])] == rings


def test_ids_of_a_folder_of_files_do_not_clash(spark, tmp_path):
    from landrank.sources import vector

    for name in "ab":
        rows = spark.createDataFrame([(i, 0.0, 0.0, 1.0, 1.0) for i in range(3)], "cell_id long, xmin double, ymin double, xmax double, ymax double")
        vector.write_gpkg(rows, str(tmp_path / f"{name}.gpkg"), "cells")
    spark.dataSource.register(vector.GeoPackage)
    ids = [r["feature_id"] for r in spark.read.format("geopackage").load(str(tmp_path)).collect()]
    assert len(set(ids)) == 6 and sorted(ids)[:3] == [0, 1, 2]


def test_strips_are_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(raster, "TASK_PIXELS", 30)
    z = (np.arange(23 * 7).reshape(23, 7) * 3).astype("f4")
    path = tmp_path / "z.tif"
    path.write_bytes(raster.encode(z, X0, Y0 + 230, 10.0, -9999, strip=4))
    assert len(raster._Reader(str(path)).partitions()) == 6
    data = path.read_bytes()
    assert raster.read_header(spark, str(path)) == raster.header(data)
    want = {(i, j): float(z[i, j]) for i in range(23) for j in range(7)}
    assert {(r["row"], r["col"]): r["z"] for r in raster.read(spark, str(path)).collect()} == want
    assert {(r["row"], r["col"]): r["z"] for r in raster.read(spark, "file:" + str(path)).collect()} == want


def _message(*parts):
    """Fields of a message: (number, number or bytes)."""
    out = b""
    for number, value in parts:
        out += _vary(number << 3 | (2 if isinstance(value, bytes) else 0))
        out += _vary(len(value)) + value if isinstance(value, bytes) else _vary(value & (1 << 64) - 1)
    return out


def _vary(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _zigzag(values):
    return b"".join(_vary((v << 1) ^ (v >> 63) if v >= 0 else ((-v) << 1) - 1) for v in values)


def _deltas(values):
    return _zigzag([b - a for a, b in zip([0, *values], values)])


def test_openstreetmap_extract(spark, tmp_path):
    """Ways with a highway tag, their nodes from dense and single form, in another blob, compressed and plain."""
    import zlib

    from landrank.sources import osm, vector

    at = {10: (-64.5, 44.25), 11: (-64.4, 44.5), -7: (-64.25, 44.75), 900000000000: (-63.0, 45.0)}
    words = [b"", b"highway", b"residential", b"name", "Rue É".encode(), b"building", b"yes"]
    strings = _message(*((1, w) for w in words))
    dense = [10, 11, -7]
    unit = lambda x: round(x * 1e7)
    group = _message((2, _message((1, _deltas(dense)), (8, _deltas([unit(at[i][1]) for i in dense])), (9, _deltas([unit(at[i][0]) for i in dense])))))
    lon, lat = at[900000000000]
    one = _message((1, 900000000000 << 1), (8, unit(lat) << 1), (9, (unit(-lon) << 1) - 1))
    nodes = _message((1, strings), (2, group), (2, _message((1, one))))
    way = lambda i, keys, values, refs: (3, _message((1, i), (2, bytes(keys)), (3, bytes(values)), (8, _deltas(refs))))
    ways = _message((1, strings), (2, _message(way(5, [1, 3], [2, 4], [10, -7, 11, 900000000000]), way(6, [5], [6], [10, 11]), way(7, [1], [2], [10, 12345]))))
    path = tmp_path / "a.osm.pbf"
    with path.open("wb") as f:
        for kind, body in ((b"OSMHeader", _message((1, b"x"))), (b"OSMData", _message((2, len(nodes)), (3, zlib.compress(nodes)))), (b"OSMData", _message((1, ways)))):
            head = _message((1, kind), (3, len(body)))
            f.write(len(head).to_bytes(4, "big") + head + body)
    assert len(osm.blobs(str(path))) == 2
    got = osm.lines(spark, str(path)).collect()
    assert [(r["feature_id"], r["name"], r["highway"]) for r in got] == [(5, "Rue É", "residential")]
    points = [(p["x"], p["y"]) for p in got[0]["parts"][0]]
    assert points == [pytest.approx(at[i], abs=1e-7) for i in (10, -7, 11, 900000000000)]
    row = vector.read(spark, str(path), 4326).first()
    assert row["xmin"] == pytest.approx(-64.5) and row["ymax"] == pytest.approx(45.0) and row["geom"] is None
    assert vector.read(spark, str(path)).first()["xmin"] > 300000


@pytest.mark.parametrize("kind, nodata", [("f4", -9999.0), ("u1", 255)])
def test_rasters_are_written_by_strips(spark, tmp_path, monkeypatch, kind, nodata):
    monkeypatch.setattr(raster, "TASK_PIXELS", 16 * 21)  # three rows to a strip
    z = {(i, j): float((i * 7 + j) % 200) for i in range(20) for j in range(7) if not (6 <= i < 9 or i > 17 or (i, j) == (2, 2))}
    rows = spark.createDataFrame([(i, j, v) for (i, j), v in z.items()] + [(10, 3, None), (50, 0, 1.0)], "row long, col long, z double").dropDuplicates(["row", "col"])
    there = {(r["row"], r["col"]): r["z"] for r in rows.collect()}
    raster.write(rows, "z", str(tmp_path / "z.tif"), (20, 7), X0, Y0, 10.0, nodata, kind)
    head = raster.read_header(spark, str(tmp_path / "z.tif"))
    assert (head.width, head.height, head.nodata, head.epsg, head.left, head.top) == (7, 20, nodata, 2961, X0, Y0)
    got = {(r["row"], r["col"]): r["z"] for r in raster.read(spark, str(tmp_path / "z.tif")).collect()}
    assert got == {(i, j): nodata if there.get((i, j)) is None else there[i, j] for i in range(20) for j in range(7)}
