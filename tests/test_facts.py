"""Facts of layers, artefact sets and the closed buffer predicate on small cases."""

import math

import pytest
from pyspark.sql import functions as F

from gridpanel.operators import facts as FA
from gridpanel.operators import gates as GT
from gridpanel.operators import spatial as SP
from gridpanel.session import ship_package
from gridpanel.sinks import publish as K

RINGS = "array<array<struct<x:double,y:double>>>"


def ring(*points):
    return [[(float(x), float(y)) for x, y in (*points, points[0])]]


def states(observed, expected, **more):
    return {(r["layer"], r["fact"]): r["state"] for r in FA.facts_gate(observed, expected, **more).collect()}


def test_vector_facts(spark):
    open_ring = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]]
    flat = ring((0, 0), (1, 1), (2, 2))
    rows = [("a", 2001, ring((0, 0), (4, 0), (4, 3))), ("a", 2002, None), ("a", 2001, open_ring), ("b", None, flat), ("b", 1999, [])]
    df = spark.createDataFrame(rows, f"layer string, year int, rings {RINGS}")
    got = {(r["layer"], r["fact"]): r["number"] if r["text"] is None else r["text"] for r in FA.vector_facts(df, "layer", year="year", crs="X").collect()}
    want_a = {"features": 3, "null_geometry": 1, "empty_geometry": 0, "invalid_geometry": 1, "xmin": 0, "xmax": 4, "ymax": 3, "types": "None,Polygon", "years": "2001,2002", "crs": "X", "fields": "layer,year"}
    assert {k: got["a", k] for k in want_a} == want_a
    assert (got["b", "empty_geometry"], got["b", "invalid_geometry"], got["b", "null_geometry"], got["b", "years"]) == (1, 1, 0, "1999")
    assert FA.vector_facts(df.limit(0), "layer", crs="X").count() == 0


def test_gate_states_and_tolerances(spark):
    seen = spark.createDataFrame([("a", "x", 1.0, None), ("a", "t", None, "one"), ("a", "gone", None, None)], "layer string, fact string, number double, text string")
    rows = [("a", "x", 1.0 + 1e-12, None), ("a", "t", None, "two"), ("a", "none", 3.0, None), ("b", "x", 1.0, None), ("a", "gone", 2.0, None)]
    expected = spark.createDataFrame(rows, "layer string, fact string, number double, text string")
    assert states(seen, expected) == {("a", "x"): "agrees", ("a", "t"): "differs", ("a", "none"): "absent", ("b", "x"): "no layer", ("a", "gone"): "differs"}
    wide = expected.where("fact = 'x'").withColumns({"number": F.lit(1.4), "tolerance": F.lit(0.5)})
    assert states(seen, wide)["a", "x"] == "agrees" and states(seen, wide.drop("tolerance"))["a", "x"] == "differs"
    told = {r["layer"]: (r["facts"], r["agree"], r["ready"]) for r in FA.gate_summary(FA.facts_gate(seen, expected)).collect()}
    assert told == {"a": (4, 1, False), "b": (1, 0, False)}


def test_axis_and_raster_facts(spark):
    grid = spark.createDataFrame([("g", 40.0 - 0.1 * i, m, None if i == 2 else 1.0) for i in range(4) for m in (6, 7)], "layer string, lat double, month int, v double")
    got = {r["fact"]: r["number"] if r["text"] is None else r["text"] for r in FA.climate_facts(grid, "layer", "lat", "month", "month", {"v": "K"}).collect()}
    assert got["lat_count"] == 4 and abs(got["lat_step_max"] - 0.1) < 1e-12 and got["missing_v"] == 2 and got["months"] == "06,07" and got["unit_v"] == "K" and got["lon_count"] == 2
    pixels = spark.createDataFrame([("r", i, j, -9.0 if i == j else float(i)) for i in range(2, 5) for j in range(4)], "t string, row int, col int, value double")
    got = {r["fact"]: r["number"] if r["text"] is None else r["text"] for r in FA.raster_facts(pixels, "t", crs="X", resolution=25, nodata=-9.0).collect()}
    assert (got["height"], got["width"], got["pixels"], got["nodata_pixels"], got["least"], got["most"], got["dtype"], got["nodata"]) == (3, 4, 12, 2, 2, 4, "double", "-9")


def test_artefact_sets(spark):
    df = spark.range(5).select(F.col("id").cast("string").alias("cell_id"))
    folder = K.scratch_path(spark, "set")
    assert [r["gate"] for r in GT.gate_artefacts(spark, folder, ["one"]).collect()] == ["missing_artefact"]
    K.publish(df, f"{folder}/one", "one")
    assert GT.gate_artefacts(spark, folder, ["one"]).isEmpty()
    df.write.mode("append").parquet(f"{folder}/one")
    df.write.parquet(f"{folder}/two")
    found = {(r["gate"], r["key"]) for r in GT.gate_artefacts(spark, folder, ["one", "two"]).collect()}
    assert found == {("altered_artefact", "one"), ("half_written", "two")}


def test_ordering_per_year(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "c"), (1, "b"), (2, "a"), (2, "b")], "y int, c string").coalesce(1)
    assert [tuple(r) for r in GT.ordering_gate(rows, ["y", "c"]).collect()] == [("ordering", "1|b", "1 rows")]


@pytest.mark.parametrize("size, distance", [(1000, 2000)])
def test_closed_buffers(spark, size, distance):
    ship_package(spark)
    cells = spark.createDataFrame([(f"{i}_{j}", i, j) for i in range(-6, 7) for j in range(-6, 7)], "cell_id string, ix int, iy int")
    shapes = {
        "corner": ring((3000, 3000), (3100, 3000), (3100, 3100)), "side": ring((3000, 200), (3400, 200), (3400, 600)),
        "far": ring((3000.01, 200), (3400, 200), (3400, 600)), "cover": ring((-20000, -20000), (20000, -20000), (20000, 20000), (-20000, 20000)),
        "inside": ring((400, 400), (410, 400), (405, 410)), "slanted": ring((2300, 2800), (2800, 2300), (2900, 2900)), "holed": ring((-9000, -9000), (9000, -9000), (9000, 9000), (-9000, 9000)) + ring((-4000, -4000), (-4000, 4000), (4000, 4000), (4000, -4000)),
    }
    layer = spark.createDataFrame(list(shapes.items()), f"name string, rings {RINGS}")
    got = {(r["cell_id"], r["name"]) for r in SP.intersects_within(layer, ["name"], cells, size, distance).collect()}
    outline = SP.context_outline(size, distance)
    planes = [(-(yb - ya), xb - xa, (yb - ya) * xa - (xb - xa) * ya) for (xa, ya), (xb, yb) in zip(outline, outline[1:] + outline[:1])]

    def plain(i, j, rings):
        dx, dy = i * size, j * size
        for r in rings:
            for (xa, ya), (xb, yb) in zip(r, r[1:]):
                low, high = 0.0, 1.0
                for a, b, c in planes:
                    n = math.hypot(a, b)
                    if n < 1e-9:
                        continue
                    da, db = (a * (xa - dx) + b * (ya - dy) + c) / n + 1e-7, (a * (xb - dx) + b * (yb - dy) + c) / n + 1e-7
                    if da < 0 and db < 0:
                        low = 2.0
                    elif da < 0:
                        low = max(low, da / (da - db))
                    elif db < 0:
                        high = min(high, da / (da - db))
                if low <= high:
                    return True
        x, y, inside = dx + size / 2, dy + size / 2, False
        for r in rings:
            for (xa, ya), (xb, yb) in zip(r, r[1:]):
                if (ya > y) != (yb > y) and x < xa + (y - ya) / (yb - ya) * (xb - xa):
                    inside = not inside
        return inside

    want = {(f"{i}_{j}", n) for i in range(-6, 7) for j in range(-6, 7) for n, r in shapes.items() if plain(i, j, r)}
    assert got == want
    assert ("0_0", "side") in got and ("0_0", "far") not in got and ("0_0", "holed") not in got and ("0_0", "cover") in got
