"""Larger copies of the tables: what is joined, repeated and crowded there, at the smallest size that shows it."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from gridpanel.operators import grid as G
from gridpanel.operators import lookup as L
from gridpanel.operators import metrics as M
from gridpanel.operators import nearest as N
from gridpanel.functions import geometry as GE
from gridpanel.operators import raster as R
from gridpanel.operators import spatial as SP
from gridpanel.operators import sweep as SW
from gridpanel.operators.skew import packed
from gridpanel.sources import registry as RG


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_exploded_neighbours_are_never_broadcast(spark):
    cells = spark.range(400).select(
        F.col("id").cast("string").alias("cell_id"), (F.col("id") % 20).cast("int").alias("ix"), F.floor(F.col("id") / 20).cast("int").alias("iy")
    )
    pairs = G.grid_neighbourhood(cells, 1000, 2000)
    assert "Broadcast" not in plan_of(pairs)
    assert pairs.where("cell_id = '210'").count() == len(G.neighbourhood_offsets(1000, 2000))


def test_a_table_kept_as_a_folder_is_one_inventory_entry(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "few.parquet"))
    (tmp_path / "one.parquet").write_bytes(b"abc")
    rows = {r["name"]: r for r in RG.file_inventory(spark, f"{tmp_path}/*.parquet").collect()}
    assert sorted(rows) == ["few.parquet", "many.parquet", "one.parquet"]
    assert rows["one.parquet"]["sha256"] == hashlib.sha256(b"abc").hexdigest().upper()
    inner = sorted((f.name, hashlib.sha256(f.read_bytes()).hexdigest().upper()) for f in (tmp_path / "many.parquet").glob("part-*"))
    assert rows["many.parquet"]["sha256"] == hashlib.sha256("\n".join(" ".join(i) for i in inner).encode()).hexdigest().upper()
    assert rows["many.parquet"]["length"] == sum(f.stat().st_size for f in (tmp_path / "many.parquet").glob("part-*"))
    assert rows["many.parquet"]["path"].endswith("/many.parquet")


def test_means_by_count_do_not_depend_on_the_order_of_rows(spark):
    """Sums of doubles differ in the last bit by order; a rank joined on such a mean then finds no partner."""
    rows = [(i % 2, float(v)) for i, v in enumerate(np.random.default_rng(5).integers(45, 101, 4000) / 100)]
    seen = set()
    for turn in (rows, rows[::-1], sorted(rows), sorted(rows, reverse=True)):
        table = spark.createDataFrame(turn, "n int, t double").coalesce(1)
        seen.add(tuple((r["n"], r["mean_target"]) for r in M.mean_by_count(table, "n", "t").orderBy("n").collect()))
    assert len(seen) == 1


def stacked(spark, boxes, copies):
    """Every box ``copies`` times as a polygon ``poly_id``."""
    rows = [
        (i + len(boxes) * k, [[(float(x), float(y)) for x, y in ((a, b), (c, b), (c, d), (a, d), (a, b))]])
        for k in range(copies) for i, (a, b, c, d) in enumerate(boxes)
    ]
    return spark.createDataFrame(rows, "poly_id long, rings array<array<struct<x:double,y:double>>>")


BOXES = [(10, 10, 150, 60), (120, 20, 260, 90), (40, 110, 90, 180)]


def test_copies_of_a_polygon_are_cut_once(spark, monkeypatch):
    cut = []
    windows = SP.cell_windows
    monkeypatch.setattr(SP, "cell_windows", lambda polys, size: cut.append(polys.count()) or windows(polys, size))
    total = SP.window_areas(stacked(spark, BOXES, 20), [], 100).agg(F.sum("area")).first()[0]
    assert total == 140 * 50 + 140 * 70 - 30 * 40 + 50 * 70
    assert cut == [len(BOXES)]


def test_joined_boxes_shuffle_the_sides_and_not_the_pairs(spark):
    layer = SP.with_bbox(stacked(spark, BOXES, 30)).drop("rings")
    assert packed(layer, SP.BOX, "rows").count() == len(BOXES)
    assert packed(layer, SP.BOX, "rows", per_pack=10).select(F.sum(F.size("rows"))).first()[0] == 90
    pairs = SP.spatial_join(layer, layer, 100)
    assert "Generate" in plan_of(pairs)  # copies are taken apart behind the join
    found = {(r["poly_id"], r["r_poly_id"]) for r in pairs.collect()}
    near = {(0, 0), (1, 1), (2, 2), (0, 1), (1, 0)}
    assert found == {(a, b) for a in range(90) for b in range(90) if (a % 3, b % 3) in near}
    assert pairs.count() == len(found)


def test_copies_of_points_and_polygons_are_compared_once(spark, monkeypatch):
    seen = []
    core = SW._places_in_shapes
    monkeypatch.setattr(SW, "_places_in_shapes", lambda points, polys, *a: seen.append((points.count(), polys.count())) or core(points, polys, *a))
    points = spark.createDataFrame([(i, *[(20.0, 20.0), (10.0, 30.0), (500.0, 500.0)][i % 3]) for i in range(60)], "id int, x double, y double")
    found = SW.points_in_polygons(points, stacked(spark, BOXES, 20), ["id"], 100, edge="on").collect()
    want = {(i, p, i % 3 == 1) for i in range(60) if i % 3 < 2 for p in range(0, 60, 3)}
    assert {(r["id"], r["poly_id"], r["on"]) for r in found} == want and len(found) == len(want)
    assert seen == [(3, 3)]


def test_copies_are_clipped_masked_repaired_and_drawn_once(spark, monkeypatch):
    seen = []
    windows, repair, lines = SP.cell_windows, SP._repair_shapes, R.scanline_spans
    monkeypatch.setattr(SP, "cell_windows", lambda polys, size: seen.append(polys.count()) or windows(polys, size))
    monkeypatch.setattr(SP, "_repair_shapes", lambda polys: seen.append(polys.count()) or repair(polys))
    monkeypatch.setattr(R, "scanline_spans", lambda polys, *a: seen.append(polys.count()) or lines(polys, *a))
    layer = stacked(spark, BOXES, 20)
    whole = {i: a for i, a in enumerate((140 * 50, 140 * 70, 50 * 70))}
    clipped = SP.clip_to_cells(layer, ["poly_id"], 100).groupBy("poly_id").agg(F.sum("area").alias("a")).collect()
    assert {r["poly_id"]: r["a"] for r in clipped} == {i: whole[i % 3] for i in range(60)}
    boundary = stacked(spark, [(0, 0, 1000, 1000)], 1).select("rings")
    masked = SP.mask_polygons(layer, boundary, ["poly_id"], 100).groupBy("poly_id").agg(F.sum(GE.polygon_area(F.col("rings"))).alias("a")).collect()
    assert {r["poly_id"]: round(r["a"], 6) for r in masked} == {i: whole[i % 3] for i in range(60)}
    fixed = SP.repair_polygons(layer.withColumn("note", F.lit("n")), ["poly_id"]).collect()
    assert {(r["poly_id"], r["note"], r["status"], r["area_after"]) for r in fixed} == {(i, "n", "accepted", whole[i % 3]) for i in range(60)} and len(fixed) == 60
    drawn = R.rasterize(layer, 10, "poly_id", "poly_id").groupBy("poly_id").count().collect()
    assert {r["poly_id"] for r in drawn} == {57, 58, 59}
    assert max(seen) == len(BOXES)


def test_copies_of_a_request_are_answered_once(spark, monkeypatch):
    cells = spark.range(100).select(
        F.format_string("C%03d", "id").alias("cell_id"), (F.col("id") % 10).cast("int").alias("ix"), F.floor(F.col("id") / 10).cast("int").alias("iy"),
        (F.col("id") / 100).alias("estimate"), (F.col("id") / 100).alias("rank_pct"), F.col("id").cast("double").alias("history"),
    )
    asked = [(5500.5, 5500.5, "1,3"), (5500.5, 5500.5, "1"), (2000.0, 300.0, "1"), (99000.0, 5.0, "1"), (10.0, 10.0, "x"), (None, 10.0, "1")]
    requests = spark.createDataFrame([(i * 6 + j, *a) for i in range(20) for j, a in enumerate(asked)], "event_id long, x double, y double, buffers_km string")
    seen = []
    placed = L.containing_cell
    monkeypatch.setattr(L, "containing_cell", lambda points, *rest: seen.append(points.count()) or placed(points, *rest))
    rows = L.lookup_job(requests, cells, 1000).orderBy("event_id").collect()
    assert seen == [4]
    assert [r["status"] for r in rows] == [200, 200, 200, 404, 422, 404] * 20
    assert [len(r["contexts"] or []) for r in rows] == [2, 1, 1, 0, 0, 0] * 20
    assert len({str(r["contexts"]) for r in rows if r["event_id"] % 6 == 0}) == 1
    assert [r["cell_id"] for r in rows[:3]] == ["C055", "C055", "C001"]


def test_the_kernel_runs_once_for_a_context(spark):
    """Counting crowded squares used to run it a second time."""
    cells = spark.createDataFrame([("A", 0, 0, 1.0, 0.5, 2.0)], "cell_id string, ix int, iy int, estimate double, rank_pct double, history double")
    runs = spark.sparkContext.accumulator(0)
    area = F.pandas_udf(lambda px, py, r, a, b, c, d: (runs.add(1), px * 0 + 1.0)[1], "double")
    kept, L._disc_rect_area = L._disc_rect_area, area
    try:
        points = spark.createDataFrame([(500.0, 500.0, 0.6)], "x double, y double, radius_km double").coalesce(1)
        assert len(L.context_summary(points, cells, 1000).collect()) == 1
    finally:
        L._disc_rect_area = kept
    assert runs.value == 1


def test_far_points_keep_a_handful_of_boxes(spark, monkeypatch):
    """Far away the corners of boxes side by side are almost equally far; a point then kept the whole row of boxes."""
    rng = np.random.default_rng(4)
    sources = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 10_000, (3000, 2)))]
    sources += [(i + 5000, x, y) for i, x, y in sources]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 10_000, (50, 2)) + [[0, 5_000_000]])]
    points += [(99, 5000.0, 5000.0), (100, 5000.0, 5000.0), (101, -70_000.0, 3000.0)]
    table, asked = spark.createDataFrame(sources, "sid int, sx double, sy double"), spark.createDataFrame(points, "pid int, px double, py double")
    seen = []
    meet = N._meet_boxes
    monkeypatch.setattr(N, "_meet_boxes", lambda frontier, *rest: seen.append(frontier) or meet(frontier, *rest))
    s = np.array(sources)
    for k in (1, 2, 5):
        seen.clear()
        got = {}
        for r in N.knn(asked, table, k, per_box=8).collect():
            got.setdefault(r["pid"], []).append((r["rank"], r["sid"], r["distance"]))
        for pid, x, y in points:
            d2 = (s[:, 1] - x) ** 2 + (s[:, 2] - y) ** 2
            best = np.lexsort((s[:, 0], d2))[:k]
            assert sorted(got[pid]) == [(n + 1, int(s[i, 0]), float(np.sqrt(d2[i]))) for n, i in enumerate(best)]
        assert seen[-1].groupBy("px", "py").count().agg(F.max("count")).first()[0] <= 12


def test_nearest_of_fewer_sources_than_asked_for(spark):
    sources = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0), (3, 9.0, 0.0)], "sid int, sx double, sy double")
    points = spark.createDataFrame([(1, 100.0, 1.0)], "pid int, px double, py double")
    assert [r["sid"] for r in N.knn(points, sources, 2, per_box=1).orderBy("rank").collect()] == [3, 2]
    assert [r["sid"] for r in N.knn(points, sources, 5, per_box=1).orderBy("rank").collect()] == [3, 2, 1]
