"""Spatial operators on hot tiles, crowded windows and boundary contact."""

import math

import numpy as np
from pyspark.sql import functions as F

from gridpanel.functions import geometry as GE
from gridpanel.operators import nearest as N
from gridpanel.operators import raster as R
from gridpanel.operators import spatial as SP
from gridpanel.operators import sweep as SW


def polys(spark, boxes, extra=()):
    rows = [(i, [[(float(x), float(y)) for x, y in ((a, b), (c, b), (c, d), (a, d), (a, b))]]) for i, (a, b, c, d) in enumerate(boxes)]
    rows += [(len(boxes) + i, [[(float(x), float(y)) for x, y in [*ring, ring[0]]]]) for i, ring in enumerate(extra)]
    return spark.createDataFrame(rows, "poly_id int, rings array<array<struct<x:double,y:double>>>")


def union_by_lattice(boxes, size, step):
    seen = {}
    for a, b, c, d in boxes:
        for x in range(a, c, step):
            for y in range(b, d, step):
                seen.setdefault((x // size, y // size), set()).add((x, y))
    return {k: len(v) * step * step for k, v in seen.items()}


def test_crowded_window_is_split_and_stays_exact(spark):
    rng = np.random.default_rng(1)
    boxes = [(a, b, a + w, b + h) for a, b, w, h in rng.integers(1, 30, size=(150, 4)).tolist()]
    expected = union_by_lattice(boxes, 100, 1)
    for limit in (4000, 40):
        got = {(r["ix"], r["iy"]): r["area"] for r in SP.window_areas(polys(spark, boxes), [], 100, max_edges=limit).collect()}
        assert got.keys() == expected.keys()
        assert all(abs(got[k] - v) < 1e-6 for k, v in expected.items())


def test_slanted_crowd_is_merged_exactly(spark):
    """Many thin triangles through one point stay crowded however often the window is split."""
    rays = []
    for i in range(30):
        a, b = math.radians(12 * i), math.radians(12 * i + 3)
        rays.append([(50, 50), (50 + 40 * math.cos(a), 50 + 40 * math.sin(a)), (50 + 40 * math.cos(b), 50 + 40 * math.sin(b))])
    layer = polys(spark, [], rays)
    want = 30 * 0.5 * 40 * 40 * math.sin(math.radians(3))
    for limit in (4000, 10):
        got = SP.window_areas(layer, [], 100, max_edges=limit).agg(F.sum("area")).first()[0]
        assert abs(got - want) < 1e-6


def test_large_polygon_is_precut(spark):
    ring = [(500 + 400 * math.cos(t), 500 + 400 * math.sin(t)) for t in np.linspace(0, 2 * math.pi, 600, endpoint=False)]
    layer = polys(spark, [], [ring])
    total = SP.clip_to_cells(layer, ["poly_id"], 50).agg(F.sum("area")).first()[0]
    whole = layer.select(GE.polygon_area(F.col("rings"))).first()[0]
    assert abs(total - whole) < 1e-6
    assert abs(SP.window_areas(layer, [], 50).agg(F.sum("area")).first()[0] - whole) < 1e-6


def test_spatial_join_hot_tile_finds_each_pair_once(spark):
    rng = np.random.default_rng(2)
    boxes = [(x, y, x + w, y + h) for x, y, w, h in rng.integers(0, 40, size=(120, 4)).tolist()]
    df = spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(boxes)], "i int, xmin double, ymin double, xmax double, ymax double")
    want = {(i, j) for i, a in enumerate(boxes) for j, b in enumerate(boxes) if a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]}
    for limit in (200_000, 20):
        got = [(r["i"], r["r_i"]) for r in SP.spatial_join(df, df, 32, per_tile=limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_contains_and_covers_on_the_boundary(spark):
    layer = polys(spark, [(0, 0, 10, 10)], [[(20, 0), (30, 0), (25, 10)]])
    points = spark.createDataFrame([(1, 10.0, 5.0), (2, 5.0, 5.0), (3, 25.0, 10.0), (4, 25.0, 3.0), (5, 11.0, 1.0)], "p int, x double, y double")
    covers = {r["p"] for r in SW.points_in_polygons(points, layer, ["p"], 7, covers=True).collect()}
    inner = {r["p"] for r in SW.points_in_polygons(points, layer, ["p"], 7, covers=False).collect()}
    assert covers == {1, 2, 3, 4} and inner == {2, 4}


def test_hole_area_and_parity(spark):
    outer = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    hole = [(2, 2), (2, 8), (8, 8), (8, 2), (2, 2)]
    row = [(1, [[(float(x), float(y)) for x, y in r] for r in (outer, hole)])]
    layer = spark.createDataFrame(row, "poly_id int, rings array<array<struct<x:double,y:double>>>")
    assert layer.select(GE.polygon_area(F.col("rings"))).first()[0] == 64
    assert SP.window_areas(layer, [], 100).first()["area"] == 64
    clipped = layer.select(GE.clipped_area(F.col("rings"), F.lit(0.0), F.lit(0.0), F.lit(5.0), F.lit(10.0))).first()[0]
    assert abs(clipped - 32) < 1e-9


def test_mask_limits_window_areas(spark):
    layer, mask = polys(spark, [(0, 0, 300, 100)]), polys(spark, [], [[(0, 0), (200, 0), (0, 200)]])
    got = SP.window_areas(layer, [], 100, mask=mask).agg(F.sum("area")).first()[0]
    assert abs(got - (200 + 100) / 2 * 100) < 1e-6
    pieces = SP.mask_polygons(layer, mask, ["poly_id"], 100)
    assert abs(pieces.select(GE.polygon_area(F.col("rings")).alias("a")).agg(F.sum("a")).first()[0] - 15000) < 1e-6


def test_knn_matches_brute_force_on_clustered_sources(spark):
    rng = np.random.default_rng(5)
    cluster = rng.normal(50, 0.01, size=(400, 2))
    scattered = rng.random((30, 2)) * 1000
    places = np.round(np.vstack([cluster, scattered, cluster[:20]]), 3)
    spots = np.round(np.vstack([rng.random((60, 2)) * 1000, places[:5]]), 3)
    sources = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(places)], "sid int, sx double, sy double")
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spots)], "pid int, px double, py double")
    for k in (1, 5):
        got = {}
        for r in N.knn(points, sources, k, per_box=8).collect():
            got.setdefault(r["pid"], {})[r["rank"]] = (r["sid"], r["distance"])
        for i, p in enumerate(spots):
            d2 = ((places - p) ** 2).sum(axis=1)
            best = sorted(range(len(places)), key=lambda j: (d2[j], j))[:k]
            assert [round(got[i][n + 1][1], 9) for n in range(k)] == [round(math.sqrt(d2[j]), 9) for j in best]
            if k == 1:
                assert got[i][1][0] == best[0]


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(-8.133108333333334, 39.66825833333333), (-6.2, 42.1), (-9.5, 37.0)], "lon double, lat double")
    rows = df.select("lon", "lat", GE.tm_forward(F.col("lon"), F.col("lat")).alias("m")).select(
        "lon", "lat", "m", GE.tm_inverse(F.col("m.x"), F.col("m.y")).alias("g")
    ).collect()
    assert abs(rows[0]["m"]["x"]) < 1e-6 and abs(rows[0]["m"]["y"]) < 1e-6
    for r in rows:
        assert abs(r["g"]["lon"] - r["lon"]) < 1e-9 and abs(r["g"]["lat"] - r["lat"]) < 1e-9


def test_slope_block_edges_equal_numpy_gradient(spark):
    rng = np.random.default_rng(4)
    z = rng.random((9, 11)) * 50
    df = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(9) for j in range(11)], "row int, col int, value double")
    gy, gx = np.gradient(z, 30, 30)
    want = np.degrees(np.arctan(np.hypot(gx, gy)))
    for block in (4, 512):
        for r in R.terrain_slope(df, 30.0, block=block).collect():
            assert abs(r["slope"] - want[r["row"], r["col"]]) < 1e-9


def test_repair_policy(spark):
    rows = [
        (1, [[(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]]),
        (2, [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]]),
        (3, [[(0.0, 0.0), (4.0, 0.0), (0.0, 0.0)]]),
        (4, None),
    ]
    layer = spark.createDataFrame(rows, "poly_id int, rings array<array<struct<x:double,y:double>>>")
    repaired = SP.repair_polygons(layer, ["poly_id"])
    got = {r["poly_id"]: (r["status"], r["area_after"]) for r in repaired.collect()}
    assert got == {1: ("repaired", 8.0), 2: ("accepted", 16.0), 3: ("rejected", 0.0), 4: ("rejected", 0.0)}
    # the parts are polygons like any others: they measure the same, and repairing them again changes nothing
    parts = repaired.where("status <> 'rejected'").select("poly_id", F.col("part").alias("piece"), "rings")
    again = SP.repair_polygons(parts, ["poly_id", "piece"])
    assert {r["status"] for r in again.collect()} == {"accepted"}
    measured = parts.groupBy("poly_id").agg(F.sum(GE.polygon_area(F.col("rings"))).alias("a"))
    assert dict(measured.collect()) == {1: 8.0, 2: 16.0}


def test_repair_by_windows_keeps_the_even_odd_area(spark, monkeypatch):
    rng = np.random.default_rng(8)
    shapes = []
    for i in range(6):
        # a closed walk that crosses itself many times, beside a plain star
        walk = rng.random((12, 2)) * 100
        angles = np.sort(rng.random(30)) * 2 * math.pi
        star = np.column_stack([np.cos(angles), np.sin(angles)]) * rng.uniform(20, 40, (30, 1))
        for kind, points in (("walk", walk), ("star", star)):
            ring = [(float(x), float(y)) for x, y in [*points, points[0]]]
            shapes.append((f"{kind}{i}", [ring]))
    layer = spark.createDataFrame(shapes, "name string, rings array<array<struct<x:double,y:double>>>")

    def crosses(ring):
        edges = list(zip(ring, ring[1:]))
        side = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        return any(side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0 for i, (a, b) in enumerate(edges) for c, d in edges[:i])

    def told():
        rows = SP.repair_polygons(layer, ["name"]).collect()
        parts = {}
        for r in rows:
            parts.setdefault(r["name"], []).append(r["part"])
        assert all(sorted(p) == list(range(len(p))) for p in parts.values())
        return {r["name"]: (r["invalid"], r["area_after"]) for r in rows}

    whole = told()
    assert {n: v[0] for n, v in whole.items()} == {n: crosses(r[0]) for n, r in shapes}
    monkeypatch.setattr(SP, "REPAIR_EDGES", 2)
    cut = told()
    assert {n: v[0] for n, v in cut.items()} == {n: v[0] for n, v in whole.items()}
    assert all(abs(cut[n][1] - whole[n][1]) < 1e-6 for n in whole)
    # a plain lattice count of the even-odd fill
    name, rings = next(s for s in shapes if s[0].startswith("walk"))
    inside = sum(
        sum((ya > y) != (yb > y) and x < xa + (y - ya) / (yb - ya) * (xb - xa) for (xa, ya), (xb, yb) in zip(rings[0], rings[0][1:])) % 2
        for x in np.arange(0.25, 100, 0.5) for y in np.arange(0.25, 100, 0.5)
    )
    assert abs(inside * 0.25 - whole[name][1]) < 0.02 * whole[name][1] + 5
