"""Raster layers as pixel tables: zones, slope, resampling, mosaics, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridpanel.functions.geometry import tm_inverse
from gridpanel.operators.skew import classes
from gridpanel.operators.spatial import context_offsets, context_planes
from gridpanel.operators.sweep import scanline_spans


def pixel_centres(pix: DataFrame, ox: float, oy: float, res: float) -> DataFrame:
    """Centre of each ``(row, col)`` of a raster whose upper-left corner is ``(ox, oy)``."""
    return pix.withColumns({"x": ox + (F.col("col") + 0.5) * res, "y": oy - (F.col("row") + 0.5) * res})


def pixel_window(pix: DataFrame, row0: int, row1: int, col0: int, col1: int) -> DataFrame:
    """Half-open row and column window; range predicates that reach the scan."""
    return pix.where((F.col("row") >= row0) & (F.col("row") < row1) & (F.col("col") >= col0) & (F.col("col") < col1))


def zonal_mean(
    pix: DataFrame, cells: DataFrame, size: float, distance: float | None = None, value: str = "value",
    require: bool = True, out: str = "zonal_mean",
) -> DataFrame:
    """Mean of the finite pixels whose centre lies in the cell (or in its context).

    Pixels are reduced to sums per square first; only those sums travel to the cells
    whose context holds the square. A cell without any finite pixel is an error.
    """
    placed = pix.withColumns(
        {"ix": F.floor(F.col("x") / size).cast("int"), "iy": F.floor(F.col("y") / size).cast("int")}
    )
    finite = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    number = F.col(value).cast("double")

    whole, partial = context_offsets(size, distance) if distance else ([(0, 0)], {})
    placed = placed.withColumns({"_dx": F.col("x") - F.col("ix") * size, "_dy": F.col("y") - F.col("iy") * size})
    # the context is convex, so a few half-planes decide inside one square; one bit per outline
    bits = ["0"]
    for i, (ox, oy, _) in enumerate(partial.values()):
        tests = [f"{a!r}D * _dx + {b!r}D * _dy + {c!r}D >= 0" for a, b, c in context_planes(size, distance, ox, oy)]
        bits.append(f"CASE WHEN {' AND '.join(tests)} THEN {1 << i} ELSE 0 END")
    placed = placed.select("ix", "iy", F.when(finite, number).alias("_v"), F.expr(" + ".join(bits)).alias("_bits"))
    aggregates = [F.sum("_v").alias("s_whole"), F.count("_v").alias("n_whole")]
    for i, name in enumerate(partial):
        seen = F.when(F.col("_bits").bitwiseAND(1 << i) != 0, F.col("_v"))
        aggregates += [F.sum(seen).alias(f"s_{name}"), F.count(seen).alias(f"n_{name}")]
    reduced = placed.groupBy("ix", "iy").agg(*aggregates)
    part = lambda ox, oy, n: F.struct(
        F.lit(ox).alias("dx"), F.lit(oy).alias("dy"), F.col(f"s_{n}").alias("s"), F.col(f"n_{n}").alias("n")
    )
    parts = [part(ox, oy, "whole") for ox, oy in whole] + [part(p[0], p[1], n) for n, p in partial.items()]
    spread = reduced.withColumn("_p", F.explode(F.array(*parts))).select(
        (F.col("ix") - F.col("_p.dx")).alias("ix"), (F.col("iy") - F.col("_p.dy")).alias("iy"), "_p.s", "_p.n"
    )
    means = spread.groupBy("ix", "iy").agg((F.sum("s") / F.when(F.sum("n") > 0, F.sum("n"))).alias("_mean"))
    joined = cells.join(means, ["ix", "iy"], "left")
    result = F.col("_mean")
    if require:
        result = F.when(result.isNotNull(), result).otherwise(F.raise_error(F.lit("cell has no finite pixel")))
    return joined.withColumn(out, result).drop("_mean")


def zonal_mode(pix: DataFrame, cells: DataFrame, codes: Sequence[int], key: str = "cell_id", code: str = "code") -> DataFrame:
    """Predominant valid class per zone; ties take the higher code and are flagged.

    Coverage is measured against all pixels of the zone. A zone without a valid pixel
    gets code -1 and no tie.
    """
    counts = pix.groupBy(key, code).agg(F.count(F.lit(1)).alias("n"))
    valid = F.col(code).isin(list(codes))
    zones = counts.groupBy(key).agg(
        F.sum("n").alias("total_pixels"),
        F.coalesce(F.sum(F.when(valid, F.col("n"))), F.lit(0)).alias("valid_pixels"),
        F.max(F.when(valid, F.col("n"))).alias("_max"),
        F.max_by(F.when(valid, F.col(code)), F.when(valid, F.struct("n", code))).alias("_mode"),
        # at most one entry per allowed code
        F.collect_list(F.when(valid, F.col("n"))).alias("_ns"),
    )
    joined = cells.select(key).join(zones, key, "left")
    zero = F.lit(0).cast("bigint")
    pixels = F.coalesce("valid_pixels", zero)
    return joined.select(
        key,
        F.coalesce("_mode", F.lit(-1)).alias("modal_code"),
        F.coalesce(F.size(F.filter("_ns", lambda n: n == F.col("_max"))) > 1, F.lit(False)).alias("modal_tie"),
        pixels.alias("valid_pixels"),
        F.coalesce(F.try_divide(pixels, "total_pixels"), F.lit(0.0)).alias("coverage_share"),
        F.coalesce(F.try_divide("_max", "valid_pixels"), F.lit(0.0)).alias("modal_share"),
    )


def _difference(value: Column, before: Column, after: Column, has_before: Column, has_after: Column, res: float) -> Column:
    """Central inside, one-sided at an edge; null neighbours give null."""
    return (
        F.when(has_before & has_after, (after - before) / (2 * res))
        .when(has_after, (after - value) / res)
        .when(has_before, (value - before) / res)
    )


def terrain_slope(pix: DataFrame, res: float, block: int = 512, value: str = "value") -> DataFrame:
    """Slope in degrees of an elevation grid ``(row, col, value)``.

    Pixels are shuffled once by block, each with the one-pixel rim its neighbours
    need; both neighbour windows then reuse that partitioning.
    """
    def reach(c: str) -> Column:
        here = F.floor(F.col(c) / block)
        return F.array_distinct(F.array(here, F.floor((F.col(c) - 1) / block), F.floor((F.col(c) + 1) / block)))

    haloed = (
        pix.withColumn("_v", F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")))
        .withColumn("_br", F.explode(reach("row"))).withColumn("_bc", F.explode(reach("col")))
        .repartition("_br", "_bc")
    )
    along = W.partitionBy("_br", "_bc", "row").orderBy("col")
    across = W.partitionBy("_br", "_bc", "col").orderBy("row")

    def gradient(axis: str, window) -> Column:
        has_before = F.coalesce(F.lag(axis).over(window) == F.col(axis) - 1, F.lit(False))
        has_after = F.coalesce(F.lead(axis).over(window) == F.col(axis) + 1, F.lit(False))
        return _difference(F.col("_v"), F.lag("_v").over(window), F.lead("_v").over(window), has_before, has_after, res)

    gradients = haloed.withColumn("_gx", gradient("col", along)).withColumn("_gy", gradient("row", across))
    own = (F.floor(F.col("row") / block) == F.col("_br")) & (F.floor(F.col("col") / block) == F.col("_bc"))
    slope = F.degrees(F.atan(F.hypot("_gx", "_gy")))
    return gradients.where(own).select("row", "col", slope.alias("slope"))


def neighbour_differences(pix: DataFrame, res: float, value: str = "value") -> DataFrame:
    """``(row, col, gx, gy)`` by plain row and column windows (two shuffles, no blocks)."""
    along, across = W.partitionBy("row").orderBy("col"), W.partitionBy("col").orderBy("row")
    v = F.col(value).cast("double")

    def gradient(axis: str, window) -> Column:
        has_before = F.coalesce(F.lag(axis).over(window) == F.col(axis) - 1, F.lit(False))
        has_after = F.coalesce(F.lead(axis).over(window) == F.col(axis) + 1, F.lit(False))
        return _difference(v, F.lag(v).over(window), F.lead(v).over(window), has_before, has_after, res)

    return pix.select("row", "col", gradient("col", along).alias("gx"), gradient("row", across).alias("gy"))


def snapped_target(xmin: float, ymin: float, xmax: float, ymax: float, res: float, pad: float = 60.0) -> tuple[int, int, int, int]:
    """Pixel index range of the padded, outward snapped target grid (col0, row0, col1, row1 in metres/res)."""
    import math

    return (
        math.floor((xmin - pad) / res), math.floor((ymin - pad) / res),
        math.ceil((xmax + pad) / res), math.ceil((ymax + pad) / res),
    )


def resample_nearest(
    target: DataFrame, source: DataFrame, source_x0: float, source_y0: float, step: float, projected: bool = True
) -> DataFrame:
    """Value of the source pixel that holds each target centre ``(x, y)``; null outside the source.

    ``source(row, col, value)`` is a regular grid with upper-left corner
    ``(source_x0, source_y0)``; with ``projected`` the target is metric and the source
    in degrees.
    """
    if projected:
        lonlat = tm_inverse(F.col("x"), F.col("y"))
        sx, sy = lonlat["lon"], lonlat["lat"]
    else:
        sx, sy = F.col("x"), F.col("y")
    indexed = target.withColumns(
        {
            "_scol": F.floor((sx - source_x0) / step).cast("bigint"),
            "_srow": F.floor((source_y0 - sy) / step).cast("bigint"),
        }
    )
    src = source.select(F.col("row").cast("bigint").alias("_srow"), F.col("col").cast("bigint").alias("_scol"), "value")
    return indexed.join(src, ["_srow", "_scol"], "left").drop("_srow", "_scol")


def mosaic(pixels: DataFrame, order: str = "tile_order", nodata: float | None = None) -> DataFrame:
    """First valid value per pixel in tile order."""
    valid = F.col("value").isNotNull()
    if nodata is not None:
        valid = valid & (F.col("value") != nodata)
    return pixels.groupBy("row", "col").agg(
        F.min_by(F.when(valid, F.col("value")), F.when(valid, F.col(order))).alias("value")
    )


def rasterize(polys: DataFrame, res: float, label: str, order: str) -> DataFrame:
    """Pixels whose centre lies in a polygon, ``(px, py, label)``; the highest ``order`` wins.

    The crossings of a polygon with a scanline make its even-odd spans and each span its
    run of pixel columns; a centre on the left edge is inside, on the right edge outside.
    """
    # of copies of a polygon only the highest can win
    keep = list(dict.fromkeys([label, order]))
    values, rows = classes(polys.select(*keep, "rings"), ["rings"], "_shape")
    winners = rows.groupBy("_shape").agg(F.max_by(F.struct(*keep), order).alias("_w")).select("_shape", "_w.*")
    spans = scanline_spans(values.join(winners, "_shape"), res, keep)
    cells = spans.withColumn("px", F.explode(F.sequence("a", "b")))
    return cells.groupBy("px", "py").agg(F.max_by(label, order).alias(label))


def degree_tile_bounds(df: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Bounds of one-degree tiles named like ``N39_00_W009_00``."""
    lat = F.regexp_extract(tile, r"([NS])(\d{2})_", 2).cast("int")
    lon = F.regexp_extract(tile, r"([EW])(\d{3})_", 2).cast("int")
    south = F.when(F.regexp_extract(tile, r"([NS])(\d{2})_", 1) == "S", -lat).otherwise(lat)
    west = F.when(F.regexp_extract(tile, r"([EW])(\d{3})_", 1) == "W", -lon).otherwise(lon)
    return df.withColumns({"xmin": west, "ymin": south, "xmax": west + 1, "ymax": south + 1})


def raster_contract(pixels: DataFrame, facts: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Observed size, pixel count and nodata count of each tile beside its registered facts."""
    seen = pixels.groupBy(tile).agg(
        (F.max("row") + 1).cast("bigint").alias("height"),
        (F.max("col") + 1).cast("bigint").alias("width"),
        F.count(F.lit(1)).alias("pixels"),
        F.count_if(F.col("value").isNull()).alias("nodata_pixels"),
    )
    joined = facts.join(seen, tile, "left")
    good = (
        F.col("height").eqNullSafe(F.col("expected_height"))
        & F.col("width").eqNullSafe(F.col("expected_width"))
        & (F.col("pixels") == F.col("height") * F.col("width"))
    )
    return joined.withColumn("ready", F.coalesce(good, F.lit(False)))
