"""Rasters in degrees on the metric grid, against plain projection of single pixels."""

import math
from pathlib import Path

from pyspark.sql import functions as F

from gridpanel.functions import geometry as G
from gridpanel.operators import reproject as RP
from gridpanel.session import ship_package

BOUNDS = (1000.0, 2000.0, 9000.0, 7000.0)
SOURCE = RP.SourceGrid(-8.2, 39.8, 0.004, block=8)


def degrees(spark, spots):
    """By inverting the forward projection numerically, apart from the inverse series."""
    out = {}
    df = spark.createDataFrame(spots, "i long, x double, y double")
    scale = {"lon": 1 / (111_320 * math.cos(math.radians(39.7))), "lat": 1 / 111_132}
    now = df.select("i", "x", "y", F.lit(G.NATIONAL_TM.lon0).alias("lon"), F.lit(G.NATIONAL_TM.lat0).alias("lat"))
    for _ in range(6):
        at = G.tm_forward(F.col("lon"), F.col("lat"))
        now = now.withColumn("p", at).select("i", "x", "y", (F.col("lon") + (F.col("x") - F.col("p.x")) * scale["lon"]).alias("lon"), (F.col("lat") + (F.col("y") - F.col("p.y")) * scale["lat"]).alias("lat"))
    for r in now.collect():
        out[r["i"]] = (r["lon"], r["lat"])
    return out


def source_rows(spark, rows, cols):
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"), (F.col("id") * 1.5).alias("value"))


def test_grid_is_padded_and_snapped_outward():
    grid = RP.TargetGrid.covering((30.0, -1.0, 95.0, 61.0), 30.0)
    assert (grid.west, grid.north, grid.rows, grid.cols) == (-30.0, 150.0, 8, 7)


def test_nearest_pixels(spark):
    ship_package(spark)
    grid = RP.TargetGrid.covering(BOUNDS, 250.0)
    told = RP.resample_projected(source_rows(spark, 60, 50), SOURCE, grid, block=7).collect()
    assert len(told) == grid.rows * grid.cols == len({(r["row"], r["col"]) for r in told})
    spots = [(r["row"] * grid.cols + r["col"], grid.west + (r["col"] + 0.5) * 250, grid.north - (r["row"] + 0.5) * 250) for r in told]
    at = degrees(spark, spots)
    filled = 0
    for r in told:
        lon, lat = at[r["row"] * grid.cols + r["col"]]
        srow, scol = math.floor((SOURCE.lat0 - lat) / SOURCE.step), math.floor((lon - SOURCE.lon0) / SOURCE.step)
        assert (r["srow"], r["scol"]) == (srow, scol)
        want = (srow * 50 + scol) * 1.5 if 0 <= srow < 60 and 0 <= scol < 50 else None
        assert r["value"] == want
        filled += want is not None
    assert 0 < filled


def test_windows_hold_every_source_pixel(spark):
    ship_package(spark)
    grid = RP.TargetGrid.covering(BOUNDS, 100.0)
    blocks = RP.target_blocks(spark, grid, 16)
    assert blocks.select(F.sum((F.col("row1") - F.col("row0")) * (F.col("col1") - F.col("col0")))).first()[0] == grid.rows * grid.cols
    windows = {(r["br"], r["bc"]): r for r in RP.source_windows(blocks, grid, SOURCE).collect()}
    for r in RP.resample_projected(source_rows(spark, 1, 1), SOURCE, grid, block=16).collect():
        w = windows[r["row"] // 16, r["col"] // 16]
        assert w["srow0"] <= r["srow"] <= w["srow1"] and w["scol0"] <= r["scol"] <= w["scol1"]


def test_a_wider_source_is_read_only_where_needed(spark, tmp_path):
    ship_package(spark)
    path = str(tmp_path / "elevation")
    source = RP.SourceGrid(SOURCE.lon0, SOURCE.lat0, SOURCE.step, block=30)
    wide = source_rows(spark, 60, 4000)  # a hundred times as wide as the cells
    RP.write_source_blocks(wide, source, path)
    grid = RP.TargetGrid.covering(BOUNDS, 250.0)
    windows = RP.source_windows(RP.target_blocks(spark, grid, 16), grid, source)
    need = {(r["brow"], r["bcol"]) for r in RP.needed_blocks(windows, source).collect()}
    files = list(Path(path).rglob("*.parquet"))
    broken = 0
    for f in files:
        at = (int(f.parent.parent.name.split("=")[1]), int(f.parent.name.split("=")[1]))
        if at not in need:
            f.write_bytes(b"no parquet")
            f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
            broken += 1
    assert broken > 30 * len(need)
    schema = "row long, col long, value double, brow long, bcol long"
    stored = spark.read.schema(schema).parquet(path)
    told = RP.resample_projected(stored, source, grid, block=16)
    plain = RP.resample_projected(wide, source, grid, block=64)
    assert sorted(map(tuple, told.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_slope_of_a_plane_and_cells_without_source(spark):
    ship_package(spark)
    # value rises with the latitude row: the slope is the same everywhere inside
    plane = spark.range(400 * 400).select(F.floor(F.col("id") / 400).alias("row"), (F.col("id") % 400).alias("col"), (F.floor(F.col("id") / 400) * 40.0).alias("value"))
    source = RP.SourceGrid(-8.2, 39.8, 0.0005)
    cells = spark.createDataFrame([(f"c{i}", i, 3) for i in (2, 3, 4)] + [("far", 900, 900)], "cell_id string, ix int, iy int")
    told = RP.mean_slope(plane, source, cells, (2000.0, 3000.0, 5000.0, 4000.0), res=100.0, cell_size=1000, context=500, require=False)
    slopes = {r["cell_id"]: r["mean_slope"] for r in told.collect()}
    want = math.degrees(math.atan(40.0 / (0.0005 * 111_040)))
    assert slopes["far"] is None and all(abs(slopes[c] - want) < 0.1 * want for c in ("c2", "c3", "c4"))
    empty = plane.limit(0)
    assert {r["value"] for r in RP.resample_projected(empty, source, RP.TargetGrid(0.0, 1000.0, 100.0, 10, 10)).collect()} == {None}
