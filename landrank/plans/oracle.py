"""The queries as SQL, written independently of the operators: brute-force joins over the same views, constants written out."""

from __future__ import annotations

SCORES = ["score_hydro", "score_elevation", "score_access", "score_solar", "score_buildable"]

VIEWS = {
    "cells": "SELECT range AS cell_id, (range // 40) * 250e0 AS xmin, (range % 40) * 250e0 AS ymin, (range // 40) * 250e0 + 250e0 AS xmax, (range % 40) * 250e0 + 250e0 AS ymax, ((range // 40) * 250e0 + (range // 40) * 250e0 + 250e0) / 2 AS cx, ((range % 40) * 250e0 + (range % 40) * 250e0 + 250e0) / 2 AS cy FROM range(1600)",
    "civic": "SELECT c_custkey::BIGINT AS civic_id, ((c_custkey::BIGINT * 7919) % 10000)::DOUBLE AS x, ((c_custkey::BIGINT * 104729) % 10000)::DOUBLE AS y FROM customer",
    "roads": """SELECT k AS line_id, x1, y1, x1 + (k % 7 - 3) * 150e0 AS x2, y1 + (k % 5 - 2) * 200e0 AS y2,
        CASE k % 8 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary' WHEN 2 THEN 'residential' WHEN 3 THEN 'track' WHEN 4 THEN 'footway' WHEN 5 THEN 'path' WHEN 6 THEN 'cycleway' END AS highway
        FROM (SELECT s_suppkey::BIGINT AS k, ((s_suppkey::BIGINT * 1237) % 10000)::DOUBLE AS x1, ((s_suppkey::BIGINT * 3571) % 10000)::DOUBLE AS y1 FROM supplier)""",
    "raw_streams": """SELECT id AS line_id, x1, y1, x1 + (k % 9 - 4) * 120e0 AS x2, y1 + (k % 7 - 3) * 160e0 AS y2,
        CASE k % 10 WHEN 0 THEN 'WARV50' WHEN 1 THEN 'WARV59' WHEN 2 THEN 'WACO25' WHEN 3 THEN 'WALK40' WHEN 4 THEN 'WATO30' WHEN 5 THEN 'WARVIS' WHEN 6 THEN 'WARV50' WHEN 8 THEN 'WADM10' WHEN 9 THEN 'WARV30' END AS feat_code,
        CASE WHEN k % 5 = 4 THEN NULL ELSE k % 4 + 1 END AS line_class,
        CASE WHEN k % 3 <> 0 THEN (k % 50)::DOUBLE END AS minz, CASE WHEN k % 3 <> 0 THEN (k % 50 + k % 13)::DOUBLE END AS maxz,
        CASE WHEN k % 6 = 0 THEN (k % 400) / 4e0 END AS attr
        FROM (SELECT o_orderkey::BIGINT AS id, o_orderkey::BIGINT AS k, ((o_orderkey::BIGINT * 811) % 40000 - 15000)::DOUBLE AS x1, ((o_orderkey::BIGINT * 3163) % 40000 - 15000)::DOUBLE AS y1
              FROM orders)""",
    "all_streams": "SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM raw_streams",
    "streams": "SELECT * FROM all_streams WHERE feat_code IS NULL OR NOT (left(feat_code, 4) IN ('WALK', 'WATO', 'WAWH', 'WADM', 'WABD') OR contains(feat_code, 'IS'))",
    "samples": """SELECT (l_orderkey::BIGINT * 7919 + l_linenumber::BIGINT * 977 + l_partkey::BIGINT * 31) % 10000 + 0.5e0 AS x,
        (l_orderkey::BIGINT * 104729 + l_linenumber::BIGINT * 3571 + l_suppkey::BIGINT * 17) % 10000 + 0.5e0 AS y, l_quantity::DOUBLE * 6 - 10 AS z FROM lineitem""",
    "pixels": """SELECT r AS "row", c AS col, c * 50e0 + 25e0 AS x, 10000e0 - r * 50e0 - 25e0 AS y,
        CASE WHEN r BETWEEN 50 AND 59 AND c BETWEEN 70 AND 79 THEN -9999e0 ELSE ((r * 7 + c * 3 + (r * c) % 17 + (r // 20) * (c // 25) * 9) % 150 + 2)::DOUBLE END AS z
        FROM (SELECT range // 200 AS r, range % 200 AS c FROM range(40000))""",
    "gradients": """SELECT *, (coalesce(lead(z) OVER h, z) - coalesce(lag(z) OVER h, z)) / (CASE WHEN col IN (0, 199) THEN 50e0 ELSE 100e0 END) AS dx,
        (coalesce(lead(z) OVER w, z) - coalesce(lag(z) OVER w, z)) / (CASE WHEN "row" IN (0, 199) THEN 50e0 ELSE 100e0 END) AS dy
        FROM pixels WINDOW h AS (PARTITION BY "row" ORDER BY col), w AS (PARTITION BY col ORDER BY "row")""",
    "relief": """SELECT *, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope,
        CASE WHEN abs(dx) < 1e-10 AND abs(dy) < 1e-10 THEN -1e0 WHEN degrees(atan2(-dx, dy)) < 0 THEN degrees(atan2(-dx, dy)) + 360 ELSE degrees(atan2(-dx, dy)) + 0e0 END AS aspect FROM gradients""",
    "classes": """SELECT *, CASE WHEN slope < 5 THEN 2 WHEN aspect BETWEEN 135 AND 225 AND slope BETWEEN 5 AND 35 THEN 2 WHEN aspect BETWEEN 90 AND 270 AND slope BETWEEN 5 AND 45 THEN 1 ELSE 0 END AS class,
        CASE WHEN slope <= 20 THEN 1 ELSE 0 END AS buildable FROM relief""",
    "measures": """SELECT floor(x / 250)::BIGINT * 40 + floor(y / 250)::BIGINT AS cell_id, avg(CASE WHEN z <> -9999 THEN z END) AS mean,
        max(CASE WHEN z <> -9999 THEN z END) - min(CASE WHEN z <> -9999 THEN z END) AS span, avg(CASE WHEN class >= 1 THEN 100e0 ELSE 0e0 END) AS sunny, avg(buildable * 100e0) AS flat FROM classes GROUP BY 1""",
    "parcels": """SELECT id AS parcel_id, xmin, ymin, xmin + (k * 37) % 1301 + 20e0 AS xmax, ymin + (k * 53) % 1301 + 20e0 AS ymax
        FROM (SELECT p_partkey::BIGINT AS id, p_partkey::BIGINT AS k, ((p_partkey::BIGINT * 433) % 9000)::DOUBLE AS xmin, ((p_partkey::BIGINT * 719) % 9000)::DOUBLE AS ymin FROM part)""",
    "zones": """SELECT k * 2 AS feature_id, 'protected_area' AS reason, ((k * 1723) % 9000 + 13)::DOUBLE AS xmin, ((k * 2917) % 9000 + 17)::DOUBLE AS ymin,
          ((k * 1723) % 9000 + 13 + 300 + (k % 6) * 150)::DOUBLE AS xmax, ((k * 2917) % 9000 + 17 + 280 + (k % 4) * 210)::DOUBLE AS ymax FROM (SELECT n_nationkey::BIGINT AS k FROM nation)
        UNION ALL SELECT k * 2 + 1, 'flood_zone', ((k * 2311) % 9000 + 29)::DOUBLE, ((k * 1259) % 9000 + 31)::DOUBLE,
          ((k * 2311) % 9000 + 29 + 700 + k * 130)::DOUBLE, ((k * 1259) % 9000 + 31 + 640 + k * 170)::DOUBLE FROM (SELECT r_regionkey::BIGINT AS k FROM region)""",
    "shapes": """SELECT id, x, y, w, h, x + w + 50 AS tx FROM (SELECT s_suppkey::BIGINT AS id, ((s_suppkey::BIGINT * 1723) % 8000 + 13)::DOUBLE AS x, ((s_suppkey::BIGINT * 2917) % 8000 + 17)::DOUBLE AS y,
        (300 + (s_suppkey::BIGINT % 6) * 152)::DOUBLE AS w, (280 + (s_suppkey::BIGINT % 4) * 212)::DOUBLE AS h FROM supplier)""",
    "by_centre": "SELECT DISTINCT cell_id, reason FROM cells c, zones z WHERE cx > z.xmin AND cx < z.xmax AND cy > z.ymin AND cy < z.ymax",
    "zone_shares": """SELECT cell_id, reason, greatest(0e0, least(c.xmax, z.xmax) - greatest(c.xmin, z.xmin)) * greatest(0e0, least(c.ymax, z.ymax) - greatest(c.ymin, z.ymin)) / 62500e0 AS share
        FROM cells c, zones z WHERE least(c.xmax, z.xmax) > greatest(c.xmin, z.xmin) AND least(c.ymax, z.ymax) > greatest(c.ymin, z.ymin)""",
    "by_overlap": "SELECT DISTINCT cell_id, reason FROM zone_shares WHERE cell_id IN (SELECT cell_id FROM zone_shares GROUP BY cell_id HAVING sum(share) >= 0.5)",
    "reasons": "SELECT * FROM by_centre UNION SELECT * FROM by_overlap WHERE cell_id NOT IN (SELECT cell_id FROM by_centre)",
    "open_cells": """SELECT c.*, CASE WHEN p.cell_id IS NULL AND f.cell_id IS NULL THEN 'eligible' ELSE 'excluded' END AS status,
        concat_ws('; ', p.reason, f.reason) AS exclusion_reasons FROM cells c
        LEFT JOIN (SELECT * FROM reasons WHERE reason = 'protected_area') p ON p.cell_id = c.cell_id LEFT JOIN (SELECT * FROM reasons WHERE reason = 'flood_zone') f ON f.cell_id = c.cell_id""",
    "land": """SELECT k AS feature_id, ((k * 3643) % 9500 + 7)::DOUBLE AS xmin, ((k * 5231) % 9500 + 11)::DOUBLE AS ymin, ((k * 3643) % 9500 + 7 + 200 + (k % 5) * 90)::DOUBLE AS xmax,
        ((k * 5231) % 9500 + 11 + 150 + (k % 7) * 70)::DOUBLE AS ymax, CASE k % 6 WHEN 0 THEN 'Urban area' WHEN 1 THEN 'Forest' WHEN 2 THEN 'Commercial' WHEN 3 THEN 'Wetland' WHEN 5 THEN 'RESIDENTIAL' END AS kind
        FROM (SELECT s_suppkey::BIGINT AS k FROM supplier)""",
}


def _along(px, py, x1, y1, x2, y2):
    return f"coalesce(greatest(0e0, least(1e0, (({px} - {x1}) * ({x2} - {x1}) + ({py} - {y1}) * ({y2} - {y1})) / nullif(({x2} - {x1}) * ({x2} - {x1}) + ({y2} - {y1}) * ({y2} - {y1}), 0))), 0e0)"


def _far(px, py, x1="x1", y1="y1", x2="x2", y2="y2"):
    k = _along(px, py, x1, y1, x2, y2)
    dx, dy = f"({px} - {x1} - {k} * ({x2} - {x1}))", f"({py} - {y1} - {k} * ({y2} - {y1}))"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def _out(px, py):
    return f"sqrt(pow(greatest(xmin - {px}, 0e0, {px} - xmax), 2) + pow(greatest(ymin - {py}, 0e0, {py} - ymax), 2))"


def _range(xmin="xmin", ymin="ymin", xmax="xmax", ymax="ymax"):
    steps = [("(x1 - x2)", f"(x1 - {xmin})"), ("(x2 - x1)", f"({xmax} - x1)"), ("(y1 - y2)", f"(y1 - {ymin})"), ("(y2 - y1)", f"({ymax} - y1)")]
    first = "greatest(0e0, " + ", ".join(f"CASE WHEN {s} < 0 THEN {r} / {s} END" for s, r in steps) + ")"
    last = "least(1e0, " + ", ".join(f"CASE WHEN {s} > 0 THEN {r} / {s} END" for s, r in steps) + ")"
    inside = " AND ".join(f"({s} <> 0 OR {r} >= 0)" for s, r in steps)
    return first, last, f"({inside} AND {first} <= {last})"


def _common(xmin, ymin, xmax, ymax):
    """Area that a rectangle shares with a cell."""
    return f"greatest(0e0, least(xmax, {xmax}) - greatest(xmin, {xmin})) * greatest(0e0, least(ymax, {ymax}) - greatest(ymin, {ymin}))"


MEETS = _range()[2]
CORNERS = ", ".join(_far(x, y) for x in ("xmin", "xmax") for y in ("ymin", "ymax"))
APART = f"CASE WHEN {MEETS} THEN 0e0 ELSE least({CORNERS}, {_out('x1', 'y1')}, {_out('x2', 'y2')}) END"


def _nearest(source: str) -> str:
    return f"SELECT cell_id, min(CASE WHEN {MEETS} THEN 0e0 ELSE {_far('cx', 'cy')} END) AS distance FROM cells, ({source}) GROUP BY cell_id HAVING min(CASE WHEN {MEETS} THEN 0e0 ELSE {_far('cx', 'cy')} END) <= 500"


ROADS = "SELECT x1, y1, x2, y2 FROM roads WHERE highway IS NULL OR highway NOT IN ('footway', 'path', 'steps', 'cycleway', 'proposed', 'construction')"
CIVIC = "SELECT x AS x1, y AS y1, x AS x2, y AS y2 FROM civic"


# The score of a value, and where it ends.
HYDRO = "CASE WHEN {v} >= 2000 THEN 100e0 WHEN {v} >= 1000 THEN 80e0 WHEN {v} >= 500 THEN 60e0 WHEN {v} >= 200 THEN 40e0 WHEN {v} >= 50 THEN 20e0 ELSE 0e0 END"
ELEVATION = """CASE WHEN {v} >= 300 THEN 30e0 WHEN {v} >= 200 THEN 60e0 WHEN {v} >= 100 THEN 90e0 WHEN {v} >= 30 THEN 100e0 WHEN {v} >= 20 THEN 70e0
    WHEN {v} >= 10 THEN 40e0 WHEN {v} >= 0 THEN 10e0 ELSE 0e0 END"""
ACCESS = "CASE WHEN {v} = 0 THEN 100e0 WHEN {v} > 0 AND {v} < 50 THEN 80e0 WHEN {v} >= 50 AND {v} < 200 THEN 50e0 WHEN {v} >= 200 AND {v} < 500 THEN 20e0 ELSE 0e0 END"
SOLAR = "CASE WHEN {v} >= 40 THEN 100e0 WHEN {v} >= 25 THEN 80e0 WHEN {v} >= 15 THEN 60e0 WHEN {v} >= 5 THEN 40e0 WHEN {v} >= 0 THEN 20e0 ELSE 0e0 END"
BUILDABLE = "CASE WHEN {v} >= 30 THEN 100e0 WHEN {v} >= 20 THEN 80e0 WHEN {v} >= 10 THEN 60e0 WHEN {v} >= 5 THEN 30e0 ELSE 0e0 END"
ACRES = "CASE WHEN {v} >= 50 THEN 100e0 WHEN {v} >= 20 THEN 90e0 WHEN {v} >= 10 THEN 70e0 WHEN {v} >= 5 THEN 40e0 WHEN {v} >= 2 THEN 20e0 WHEN {v} >= 1 THEN 5e0 ELSE 0e0 END"


def _score(value: str, table: str) -> str:
    return f"({table.format(v=value)})"


VIEWS |= {
    "near": _nearest(f"{ROADS} UNION ALL {CIVIC}"),
    "pairs": f"SELECT cell_id, line_id FROM cells, streams WHERE x1 <= xmax + 1500 AND x1 >= xmin - 1500 AND y1 <= ymax + 1500 AND y1 >= ymin - 1500 AND {APART} <= 100",
    "stretches": f"""SELECT *, greatest(0e0, along - 500) AS start, least(len, along + 500) AS stop FROM (
        SELECT cell_id, s.*, {_along('cx', 'cy', 'x1', 'y1', 'x2', 'y2')} * len AS along FROM pairs JOIN cells USING (cell_id) JOIN streams s USING (line_id))""",
    "sampled": "SELECT *, greatest(5, least(20, trunc((stop - start) / 25)::BIGINT)) AS n FROM stretches WHERE len >= 10 AND stop - start >= 20",
    "points": "SELECT cell_id, line_id, x1 + share * (x2 - x1) AS x, y1 + share * (y2 - y1) AS y FROM (SELECT *, least(1e0, greatest(0e0, (start + (stop - start) * i / n) / len)) AS share FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM sampled))",
    "read": "SELECT p.cell_id, p.line_id, z FROM points p JOIN pixels q ON q.col = floor(p.x / 50) AND q.\"row\" = floor((10000 - p.y) / 50) WHERE z > -100",
    "heads": "SELECT cell_id, line_id, CASE WHEN min(z) < 5 THEN least(max(z) - min(z), min(z)) ELSE max(z) - min(z) END AS head FROM read GROUP BY 1, 2 HAVING count(*) >= 2",
    "areas": "SELECT *, coalesce(attr, greatest(0.5e0, 2e0 * pow(len / 1000e0, 1.5e0), CASE WHEN coalesce(line_class, 1) >= 3 THEN 25e0 WHEN coalesce(line_class, 1) >= 2 THEN 5e0 ELSE 0e0 END, CASE WHEN feat_code LIKE 'WACO%' THEN 10e0 ELSE 0e0 END)) AS area FROM all_streams",
    "final_heads": """SELECT p.cell_id, p.line_id, a.area, CASE WHEN h.head IS NOT NULL THEN h.head WHEN a.feat_code LIKE 'WACO%' THEN 0e0
        WHEN a.len >= 100 AND m.span >= 3 THEN m.span WHEN abs(a.maxz - a.minz) > 0.1 THEN abs(a.maxz - a.minz) ELSE a.len * 0.02e0 END AS head
        FROM pairs p JOIN areas a USING (line_id) LEFT JOIN heads h ON h.cell_id = p.cell_id AND h.line_id = p.line_id LEFT JOIN measures m ON m.cell_id = p.cell_id WHERE a.area >= 0.5""",
    "powers": "SELECT cell_id, max(0.5e0 * 1000e0 * 9.81e0 * (area * 8e0 / 1000e0) * head) AS power FROM final_heads WHERE head >= 3 GROUP BY cell_id",
    "raw_scores": f"""SELECT c.*, {_score('coalesce(power, 0e0)', HYDRO)} AS score_hydro, CASE WHEN mean IS NULL THEN 50e0 ELSE {_score('mean', ELEVATION)} END AS score_elevation,
        {_score('distance', ACCESS)} AS score_access, {_score('sunny', SOLAR)} AS score_solar, {_score('flat', BUILDABLE)} AS score_buildable
        FROM open_cells c LEFT JOIN powers USING (cell_id) LEFT JOIN near USING (cell_id) LEFT JOIN measures USING (cell_id)""",
    "scores": "SELECT cell_id, xmin, ymin, xmax, ymax, cx, cy, status, exclusion_reasons, "
    + ", ".join(f"CASE WHEN status = 'eligible' THEN {s} END AS {s}" for s in SCORES)
    + ", CASE WHEN status = 'eligible' THEN "
    + "0e0 + score_hydro * 0.45e0 + score_elevation * 0.25e0 + score_access * 0.2e0 + score_solar * 0.05e0 + score_buildable * 0.05e0"
    + " END AS score FROM raw_scores",
    "sure": """SELECT *, CASE WHEN status = 'eligible' THEN lost END AS confidence,
        CASE WHEN status = 'eligible' THEN CASE WHEN lost BETWEEN 80 AND 100 THEN 'high' WHEN lost BETWEEN 55 AND 79 THEN 'medium' ELSE 'low' END END AS confidence_band
        FROM (SELECT *, greatest(0e0, 65e0 - (CASE WHEN score_access < 50 THEN 15e0 ELSE 0e0 END + CASE WHEN score_hydro = 0 THEN 10e0 ELSE 0e0 END)) AS lost,
          concat_ws('; ', CASE WHEN score_access < 50 THEN 'access_unverified' END, CASE WHEN score_hydro = 0 THEN 'hydro_low_confidence' END) AS flags FROM scores)""",
    "ranked": "SELECT *, CASE WHEN status = 'eligible' THEN rank() OVER (PARTITION BY status ORDER BY score DESC)::INTEGER END AS \"rank\" FROM sure",
    "ways": "SELECT * FROM (VALUES (1, -1, 1), (2, 0, 1), (4, 1, 1), (8, 1, 0), (16, 1, -1), (32, 0, -1), (64, -1, -1), (128, -1, 0)) AS d(code, r, c)",
    "solid": "SELECT * FROM pixels WHERE z <> -9999",
    "around": 'SELECT "row", col, z, code, "row" + w.r AS r, col + w.c AS c, sqrt(w.r * w.r + w.c * w.c) AS far FROM solid CROSS JOIN ways w',
    "pointers": """SELECT p."row", p.col, coalesce(arg_max(code, (drop, -code)), 0)::INTEGER AS pointer FROM solid p LEFT JOIN (
          SELECT a."row", a.col, a.code, (a.z - b.z) / far AS drop FROM around a JOIN solid b ON b."row" = a.r AND b.col = a.c WHERE a.z > b.z) o ON o."row" = p."row" AND o.col = p.col GROUP BY 1, 2""",
    "walk(r, c)": """SELECT "row", col FROM pointers UNION ALL
        SELECT w.r + d.r, w.c + d.c FROM walk w JOIN pointers p ON p."row" = w.r AND p.col = w.c JOIN ways d ON d.code = p.pointer""",
    "beside": """SELECT a."row", a.col, a.z, count(b.z) < 8 AS outlet FROM around a LEFT JOIN solid b ON b."row" = a.r AND b.col = a.c GROUP BY 1, 2, 3""",
    "water(r, c, level) USING KEY (r, c)": """SELECT "row", col, z FROM beside WHERE outlet UNION
        SELECT p."row", p.col, min(greatest(p.z, w.level)) FROM water w JOIN around a ON a.r = w.r AND a.c = w.c JOIN solid p ON p."row" = a."row" AND p.col = a.col
        LEFT JOIN recurring.water k ON k.r = p."row" AND k.c = p.col WHERE k.level IS NULL OR greatest(p.z, w.level) < k.level GROUP BY 1, 2""",
    "gaps": """SELECT p.*, e.z AS east, w.z AS west, n.z AS north, s.z AS south FROM solid p LEFT JOIN solid e ON e."row" = p."row" AND e.col = p.col + 1 LEFT JOIN solid w ON w."row" = p."row" AND w.col = p.col - 1
        LEFT JOIN solid n ON n."row" = p."row" - 1 AND n.col = p.col LEFT JOIN solid s ON s."row" = p."row" + 1 AND s.col = p.col""",
    "gap_gradients": """SELECT "row", col, coalesce((coalesce(east, z) - coalesce(west, z)) / nullif(50e0 * ((east IS NOT NULL)::INT + (west IS NOT NULL)::INT), 0), 0e0) AS dx,
        coalesce((coalesce(south, z) - coalesce(north, z)) / nullif(50e0 * ((south IS NOT NULL)::INT + (north IS NOT NULL)::INT), 0), 0e0) AS dy FROM gaps""",
    "corners": "SELECT cell_id, status, score, \"rank\", unnest([1, 2, 3, 4, 5]) AS i, unnest([xmin, xmax, xmax, xmin, xmin]) + 380000e0 AS east, unnest([ymin, ymin, ymax, ymax, ymin]) + 4900000e0 AS north FROM ranked",
    "long": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM scores WHERE {c} IS NOT NULL" for c in [*SCORES, "score"]),
    "best_cells": """SELECT parcel_id, avg(score) AS cell_score FROM (SELECT parcel_id, score, row_number() OVER (PARTITION BY parcel_id ORDER BY score DESC, cell_id) AS place
        FROM scores s, parcels p WHERE status = 'eligible' AND cx > p.xmin AND cx < p.xmax AND cy > p.ymin AND cy < p.ymax) WHERE place <= 3 GROUP BY parcel_id""",
}


# Radius times scale of the zone's meridian, coefficients of the series from northing and of latitude.
METRES = "6364902.16611274e0"
BACKWARD = ("0.000837732168164144e0", "5.905869626082731e-08", "1.6734889049883464e-10", "2.1677378055967573e-13")
DELTA = ("0.0033565514855966932e0", "6.571873148458866e-06", "1.7646564264542834e-08", "5.400482187759887e-11")


def _series(a, b, fa, fb):
    return "".join(f" - {c} * {fa}({2 * k} * {a}) * {fb}({2 * k} * {b})" for k, c in enumerate(BACKWARD, 1))


def _geographic(x: str, y: str) -> tuple[str, str]:
    xi, eta = f"(({y}) / {METRES})", f"((({x}) - 500000e0) / {METRES})"
    xi1, eta1 = f"({xi}{_series(xi, eta, 'sin', 'cosh')})", f"({eta}{_series(xi, eta, 'cos', 'sinh')})"
    chi = f"asin(sin({xi1}) / cosh({eta1}))"
    lat = chi + "".join(f" + {d} * sin({2 * k} * {chi})" for k, d in enumerate(DELTA, 1))
    return f"degrees({lat})", f"(-63e0 + degrees(atan2(sinh({eta1}), cos({xi1}))))"


LATITUDE, LONGITUDE = _geographic("cx + 380000e0", "cy + 4900000e0")
CLIP = _range("2000e0", "2000e0", "6000e0", "5000e0")

SELECTS = {
    "q_grid": "SELECT * FROM cells",
    "q_rural_filter": """SELECT cell_id FROM cells WHERE cx > 0 AND cx < 10000 AND cy > 0 AND cy < 10000 AND cell_id NOT IN (
        SELECT cell_id FROM cells, land l WHERE regexp_matches(lower(kind), 'urban|commercial|industrial|institutional|residential') AND cx BETWEEN l.xmin AND l.xmax AND cy BETWEEN l.ymin AND l.ymax)""",
    "q_mask_filter": "SELECT DISTINCT cell_id FROM by_centre WHERE reason = 'protected_area'",
    "q_load_exclusions": "SELECT feature_id, reason AS exclusion_reason, xmin, ymin, xmax, ymax FROM zones",
    "q_exclusion_centroid": "SELECT * FROM by_centre",
    "q_exclusion_overlap": "SELECT * FROM by_overlap",
    "q_shape_overlap": f"""SELECT cell_id, feature_id, round(share, 6) AS share FROM (SELECT cell_id, id AS feature_id, ({_common('x', 'y', 'x + w', 'y + h')} - {_common('x + w / 4', 'y + h / 4', 'x + w / 2', 'y + h / 2')}) / 62500e0 AS share
        FROM cells, shapes WHERE x < xmax AND x + w > xmin AND y < ymax AND y + h > ymin) WHERE share > 0""",
    "q_shape_centres": """SELECT cell_id, id AS feature_id FROM cells, shapes WHERE cx > x AND cx < x + w AND cy > y AND cy < y + h AND NOT (cx BETWEEN x + w / 4 AND x + w / 2 AND cy BETWEEN y + h / 4 AND y + h / 2)
        OR cx > tx AND cy > y AND (cx - tx) / 300e0 + (cy - y) / 400e0 < 1""",
    "q_shape_parcels": f"SELECT id AS parcel_id, round(acres, 6) AS area_acres, {_score('acres', ACRES)} AS size_score FROM (SELECT *, (w * h * 15 / 16 + 60000e0) / 4046.86e0 AS acres FROM shapes)",
    "q_exclusions": "SELECT cell_id, status, exclusion_reasons FROM open_cells",
    "q_zonal_elevation": f"SELECT cell_id, round(mean, 6) AS mean, n, {_score('mean', ELEVATION)} AS score FROM (SELECT floor(x / 250)::BIGINT * 40 + floor(y / 250)::BIGINT AS cell_id, avg(z) AS mean, count(*) AS n FROM samples GROUP BY 1)",
    "q_zonal_range": "SELECT floor(x / 250)::BIGINT * 40 + floor(y / 250)::BIGINT AS cell_id, max(z) - min(z) AS range FROM samples GROUP BY 1",
    "q_elevation_score": f"SELECT cell_id, CASE WHEN mean IS NULL THEN 50e0 ELSE {_score('mean', ELEVATION)} END AS score FROM cells LEFT JOIN measures USING (cell_id)",
    "q_slope": 'SELECT "row", col, round(slope, 6) AS slope FROM relief',
    "q_aspect": 'SELECT "row", col, round(aspect, 6) AS aspect FROM relief',
    "q_slope_tiled": 'SELECT "row", col, round(slope, 6) AS slope, round(aspect, 6) AS aspect FROM relief',
    "q_buildable_mask": 'SELECT "row", col, buildable FROM classes',
    "q_solar_class": 'SELECT "row", col, class FROM classes',
    "q_solar_score": f"SELECT cell_id, {_score('sunny', SOLAR)} AS score FROM cells LEFT JOIN measures USING (cell_id)",
    "q_buildable_score": f"SELECT cell_id, {_score('flat', BUILDABLE)} AS score FROM cells LEFT JOIN measures USING (cell_id)",
    "q_resample": """SELECT r AS "row", c AS col, round(sum(z * (1 - abs(u - q.col)) * (1 - abs(v - q."row"))) / nullif(sum((1 - abs(u - q.col)) * (1 - abs(v - q."row"))), 0), 6) AS z
        FROM (SELECT range // 60 AS r, range % 60 AS c, ((range % 60) * 20 + 2010e0) / 50e0 - 0.5e0 AS u, (10000e0 - (7990e0 - (range // 60) * 20)) / 50e0 - 0.5e0 AS v FROM range(3600)) g
        JOIN pixels q ON q.col IN (floor(u), floor(u) + 1) AND q."row" IN (floor(v), floor(v) + 1) GROUP BY 1, 2""",
    "q_access_roads": f"SELECT cell_id, round(distance, 6) AS distance FROM ({_nearest(ROADS)})",
    "q_access_civic": f"SELECT cell_id, round(distance, 6) AS distance FROM ({_nearest(CIVIC)})",
    "q_access_score": f"SELECT cell_id, {_score('distance', ACCESS)} AS score FROM cells LEFT JOIN near USING (cell_id)",
    "q_vehicle_roads": "SELECT line_id, highway FROM roads WHERE highway IS NULL OR highway NOT IN ('footway', 'path', 'steps', 'cycleway', 'proposed', 'construction')",
    "q_flowing_water": "SELECT line_id, feat_code FROM streams",
    "q_drainage_area": "SELECT line_id, round(area, 6) AS area, round(area * 8e0 / 1000e0, 9) AS flow, round(0.5e0 * 1000e0 * 9.81e0 * (area * 8e0 / 1000e0) * 10e0, 6) AS power_at_10m FROM areas",
    "q_stream_cells": "SELECT cell_id, line_id FROM pairs",
    "q_head": "SELECT cell_id, line_id, round(head, 6) AS head FROM heads",
    "q_hydro_power": "SELECT cell_id, round(power, 4) AS power FROM powers",
    "q_hydro_score": f"SELECT cell_id, {_score('coalesce(power, 0e0)', HYDRO)} AS score FROM cells LEFT JOIN powers USING (cell_id)",
    "q_dem_sample": 'SELECT civic_id, z AS elevation FROM civic c LEFT JOIN (SELECT * FROM pixels WHERE z <> -9999) q ON q.col = floor(c.x / 50) AND q."row" = floor((10000 - c.y) / 50)',
    "q_composite": f"SELECT cell_id, status, {', '.join(SCORES)}, round(score, 6) AS score FROM scores",
    "q_disabled_criterion": f"SELECT cell_id, score_elevation, score_access, round(0e0 + score_elevation * {25 / 45 * 100 / 100!r}e0 + score_access * {20 / 45 * 100 / 100!r}e0, 6) AS score FROM scores",
    "q_renormalised_weights": "SELECT * FROM (VALUES ('hydro', round(45 / 70e0 * 100, 6)), ('access', round(20 / 70e0 * 100, 6)), ('solar', round(5 / 70e0 * 100, 6))) AS w(criterion, weight)",
    "q_confidence": "SELECT cell_id, confidence, confidence_band FROM sure",
    "q_flags": "SELECT cell_id, flags FROM sure",
    "q_band_counts": "SELECT b.band, count(s.cell_id) AS n, round(count(s.cell_id) * 100e0 / (SELECT count(confidence_band) FROM sure), 6) AS percent FROM (VALUES ('high'), ('medium'), ('low')) AS b(band) LEFT JOIN sure s ON s.confidence_band = b.band GROUP BY 1",
    "q_rank": 'SELECT cell_id, status, round(score, 6) AS score, "rank", confidence, confidence_band FROM ranked',
    "q_ranked_eligible": "SELECT \"rank\", cell_id, round(score, 6) AS score FROM ranked WHERE status = 'eligible' ORDER BY 1, 2",
    "q_parcel_size": f"SELECT parcel_id, round((xmax - xmin) * (ymax - ymin) / 4046.86e0, 6) AS area_acres, {_score('((xmax - xmin) * (ymax - ymin) / 4046.86e0)', ACRES)} AS size_score FROM parcels",
    "q_parcel_scores": f"""SELECT parcel_id, round(cell_score, 6) AS cell_score, size_score, round(0.8e0 * cell_score + 0.2e0 * size_score, 6) AS score FROM (
        SELECT parcel_id, cell_score, {_score('((xmax - xmin) * (ymax - ymin) / 4046.86e0)', ACRES)} AS size_score FROM parcels LEFT JOIN best_cells USING (parcel_id))""",
    "q_stats": 'SELECT "column", count(*) AS n, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS mean, round(median(value), 6) AS median, '
    + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90))
    + ', count(*) FILTER (value = 100) AS at_100, count(*) FILTER (value = 0) AS at_0, round(count(*) FILTER (value = 100) * 100e0 / count(*), 6) AS at_100_percent, round(count(*) FILTER (value = 0) * 100e0 / count(*), 6) AS at_0_percent FROM long GROUP BY 1',
    "q_histogram": f"""SELECT c."column", b.range::INTEGER AS bin, b.range * 10e0 AS low, (b.range + 1) * 10e0 AS high, count(l.value) AS n
        FROM (VALUES {', '.join(f"('{c}')" for c in [*SCORES, 'score'])}) AS c("column"), range(10) b
        LEFT JOIN long l ON l."column" = c."column" AND l.value BETWEEN 0 AND 100 AND least(floor(l.value / 10), 9) = b.range GROUP BY 1, 2, 3, 4""",
    "q_export_csv_view": f'SELECT cell_id, status, round(score, 6) AS score, "rank", {", ".join(SCORES)}, confidence, confidence_band, flags, exclusion_reasons, round({LATITUDE}, 6) AS latitude, round({LONGITUDE}, 6) AS longitude FROM ranked',
    "q_projection_round_trip": "SELECT civic_id, 0e0 AS dx, 0e0 AS dy FROM civic",
    "q_map_bands": "SELECT CASE WHEN score IS NULL THEN 'Excluded' WHEN score >= 80 THEN 'Excellent (80-100)' WHEN score >= 60 THEN 'Good (60-79)' WHEN score >= 40 THEN 'Fair (40-59)' WHEN score >= 20 THEN 'Poor (20-39)' ELSE 'Unsuitable (0-19)' END AS band, count(*) AS n FROM scores GROUP BY 1",
    "q_colors": """SELECT cell_id, CASE WHEN score IS NULL THEN '#808080' WHEN score >= 80 THEN '#1a9641' WHEN score >= 60 THEN '#a6d96a' WHEN score >= 40 THEN '#ffffbf' WHEN score >= 20 THEN '#fdae61' ELSE '#d7191c' END AS colour,
        CASE WHEN score IS NULL THEN 0.15e0 WHEN score >= 80 THEN 0.75e0 WHEN score >= 60 THEN 0.55e0 WHEN score >= 40 THEN 0.4e0 WHEN score >= 20 THEN 0.35e0 ELSE 0.3e0 END AS opacity FROM scores""",
    "q_map_streams": "SELECT line_id, round(greatest(0.5e0, 4e0 - (coalesce(line_class, 3) - 1) * 0.7e0), 6) AS width, round(greatest(0.3e0, 0.9e0 - (coalesce(line_class, 3) - 1) * 0.1e0), 6) AS opacity FROM streams WHERE coalesce(line_class, 3) <= 4",
    "q_map_roads": """SELECT line_id, CASE highway WHEN 'motorway' THEN '#e31a1c' WHEN 'primary' THEN '#fd8d3c' WHEN 'residential' THEN '#cccccc' WHEN 'track' THEN '#996633' ELSE '#cccccc' END AS colour,
        CASE highway WHEN 'motorway' THEN 3e0 WHEN 'primary' THEN 2e0 WHEN 'residential' THEN 0.6e0 WHEN 'track' THEN 0.8e0 ELSE 0.5e0 END AS width FROM roads WHERE highway IS NULL OR highway NOT IN ('footway', 'path', 'steps', 'cycleway', 'service')""",
    "q_bbox_filter": "SELECT feature_id FROM land WHERE xmax >= 2000 AND xmin <= 6000 AND ymax >= 2000 AND ymin <= 5000",
    "q_clip_roads": f"""SELECT line_id, round(x1 + t0 * (x2 - x1), 6) AS x1, round(y1 + t0 * (y2 - y1), 6) AS y1, round(x1 + t1 * (x2 - x1), 6) AS x2, round(y1 + t1 * (y2 - y1), 6) AS y2
        FROM (SELECT *, {CLIP[0]} AS t0, {CLIP[1]} AS t1 FROM roads WHERE highway IS NOT NULL AND {CLIP[2]})""",
    "q_linear_reference": """SELECT g AS line_id, seg::INTEGER AS seg, round(coalesce(sum(len) OVER (PARTITION BY g ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0), 6) AS before, round(sum(len) OVER (PARTITION BY g), 6) AS length
        FROM (SELECT line_id // 10 AS g, row_number() OVER (PARTITION BY line_id // 10 ORDER BY line_id) AS seg, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM roads)""",
    "q_d8_pointer": 'SELECT "row", col, pointer FROM pointers',
    "q_flow_accumulation": 'SELECT r AS "row", c AS col, count(*) AS cells FROM walk GROUP BY 1, 2',
    "q_fill_depressions": 'SELECT r AS "row", c AS col, level AS z FROM water',
    "q_slope_holes": """SELECT "row", col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope, round(CASE WHEN abs(dx) < 1e-10 AND abs(dy) < 1e-10 THEN -1e0
        WHEN degrees(atan2(-dx, dy)) < 0 THEN degrees(atan2(-dx, dy)) + 360 ELSE degrees(atan2(-dx, dy)) + 0e0 END, 6) AS aspect FROM gap_gradients""",
    "q_check_data": " UNION ALL ".join(f"SELECT '{n}' AS layer, 'ok' AS status, (SELECT string_agg(name, ',' ORDER BY cid) FROM pragma_table_info('{n}')) AS columns, (SELECT count(*) FROM {n}) AS feature_count, NULL::VARCHAR AS error" for n in ("region", "nation", "supplier", "customer"))
    + " UNION ALL SELECT 'missing_layer', 'MISSING (optional)', NULL, NULL, NULL",
    "q_export_geojson": f"""SELECT cell_id, '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[' || string_agg('[' || lon || ',' || lat || ']', ',' ORDER BY i) || ']]}},"properties":{{"cell_id":' || cell_id
        || ',"status":"' || status || '","score":' || coalesce(score::VARCHAR, 'null') || ',"rank":' || coalesce("rank"::VARCHAR, 'null') || '}}}}' AS feature
        FROM (SELECT cell_id, status, score, "rank", i, round({_geographic('east', 'north')[1]}, 6) AS lon, round({_geographic('east', 'north')[0]}, 6) AS lat FROM corners) GROUP BY 1, status, score, "rank" """,
    "q_total_bounds": "SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM land",
}

_CROSS = "CASE WHEN (z{a} >= e) <> (z{b} >= e) THEN {{'x': x{a} + (e - z{a}) / (z{b} - z{a}) * (x{b} - x{a}), 'y': y{a} + (e - z{a}) / (z{b} - z{a}) * (y{b} - y{a})}} END"
_TOP, _RIGHT, _BOTTOM, _LEFT = (_CROSS.format(a=a, b=b) for a, b in ((0, 1), (1, 2), (3, 2), (0, 3)))
SELECTS["q_contour_segments"] = f"""
    SELECT e AS elevation, e % 100 = 0 AS major, round(s.a.x, 6) AS x1, round(s.a.y, 6) AS y1, round(s.b.x, 6) AS x2, round(s.b.y, 6) AS y2 FROM (
      SELECT e, unnest(CASE WHEN len(hits) = 2 THEN [{{'a': hits[1], 'b': hits[2]}}]
          WHEN len(hits) = 4 AND (((z0 + z1 + z2 + z3) / 4 >= e) = (z0 >= e)) THEN [{{'a': hits[1], 'b': hits[2]}}, {{'a': hits[3], 'b': hits[4]}}]
          WHEN len(hits) = 4 THEN [{{'a': hits[1], 'b': hits[4]}}, {{'a': hits[2], 'b': hits[3]}}] END) AS s
      FROM (SELECT *, list_filter([{_TOP}, {_RIGHT}, {_BOTTOM}, {_LEFT}], lambda p: p IS NOT NULL) AS hits FROM (
        SELECT *, unnest(range(greatest(1, floor(least(z0, z1, z2, z3) / 50)::BIGINT + 1), floor(greatest(z0, z1, z2, z3) / 50)::BIGINT + 1)) * 50e0 AS e FROM (
          SELECT a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2, d.x AS x3, d.y AS y3, d.z AS z3
          FROM pixels a JOIN pixels b ON b."row" = a."row" AND b.col = a.col + 1 JOIN pixels c ON c."row" = a."row" + 1 AND c.col = a.col + 1 JOIN pixels d ON d."row" = a."row" + 1 AND d.col = a.col
          WHERE a.z <> -9999 AND b.z <> -9999 AND c.z <> -9999 AND d.z <> -9999))))"""


def _with(select: str) -> str:
    """The select after the views that it needs, directly or through others."""
    needed, todo = set(), [select]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in needed and _mentions(text, name.split("(")[0]):
                needed.add(name)
                todo.append(VIEWS[name])
    again = " RECURSIVE" if any("(" in n for n in needed) else ""
    return f"WITH{again} " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed) + f" {select}" if needed else select


def _mentions(text: str, name: str) -> bool:
    import re

    return re.search(rf"\b{name}\b", text) is not None


ORACLE = {name: _with(select) for name, select in SELECTS.items()}
