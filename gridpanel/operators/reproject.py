"""Reprojected resampling: a metric target grid from a raster in degrees, block by block.

Every block of the target knows its window of the source from the projected centres of its border
pixels (a block's interior lies inside the image of its border), so a source that is much larger
than the target is read by literal row and column ranges, and by block folders where it has them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpanel.functions.geometry import NATIONAL_TM, TransverseMercator, tm_inverse
from gridpanel.operators.raster import snapped_target, terrain_slope, zonal_mean
from gridpanel.session import broadcast_if_small, materialize


@dataclass(frozen=True)
class TargetGrid:
    """Metric pixels, rows counted southwards from ``north``."""

    west: float
    north: float
    res: float
    rows: int
    cols: int

    @classmethod
    def covering(cls, bounds: tuple[float, float, float, float], res: float, pad: float = 60.0) -> "TargetGrid":
        """The grid of whole pixels around padded bounds, snapped outward."""
        col0, row0, col1, row1 = snapped_target(*bounds, res, pad)
        return cls(col0 * res, row1 * res, res, row1 - row0, col1 - col0)


@dataclass(frozen=True)
class SourceGrid:
    """Pixels of ``step`` degrees whose upper-left corner is ``(lon0, lat0)``; ``block`` pixels make the side of a stored block."""

    lon0: float
    lat0: float
    step: float
    block: int = 512


def target_blocks(spark: SparkSession, grid: TargetGrid, block: int = 256) -> DataFrame:
    """``br, bc`` and the half-open pixel ranges ``row0, row1, col0, col1`` of every block."""
    down, across = math.ceil(grid.rows / block), math.ceil(grid.cols / block)
    br, bc = F.floor(F.col("id") / across), F.col("id") % across
    return spark.range(down * across).select(
        br.alias("br"), bc.alias("bc"), (br * block).alias("row0"), F.least((br + 1) * block, F.lit(grid.rows)).alias("row1"),
        (bc * block).alias("col0"), F.least((bc + 1) * block, F.lit(grid.cols)).alias("col1"),
    )


def _in_source(pixels: DataFrame, grid: TargetGrid, source: SourceGrid, crs: TransverseMercator) -> DataFrame:
    """``x, y`` of the centres and the source pixel ``srow, scol`` that holds each."""
    centred = pixels.withColumns({"x": grid.west + (F.col("col") + 0.5) * grid.res, "y": grid.north - (F.col("row") + 0.5) * grid.res})
    degrees = centred.withColumn("_d", tm_inverse(F.col("x"), F.col("y"), crs))
    return degrees.withColumns({
        "srow": F.floor((source.lat0 - F.col("_d.lat")) / source.step), "scol": F.floor((F.col("_d.lon") - source.lon0) / source.step),
    }).drop("_d")


def source_windows(blocks: DataFrame, grid: TargetGrid, source: SourceGrid, crs: TransverseMercator = NATIONAL_TM) -> DataFrame:
    """Inclusive source ranges ``srow0, srow1, scol0, scol1`` of each target block, one pixel wider than its border needs."""
    along = F.sequence("col0", F.col("col1") - 1)
    down = F.sequence("row0", F.col("row1") - 1)

    def edge(cells, row, col):
        return F.transform(cells, lambda i: F.struct(row(i).alias("row"), col(i).alias("col")))

    border = F.concat(
        edge(along, lambda i: F.col("row0"), lambda i: i), edge(along, lambda i: F.col("row1") - 1, lambda i: i),
        edge(down, lambda i: i, lambda i: F.col("col0")), edge(down, lambda i: i, lambda i: F.col("col1") - 1),
    )
    pixels = blocks.select("br", "bc", F.explode(border).alias("_p")).select("br", "bc", "_p.row", "_p.col")
    return _in_source(pixels, grid, source, crs).groupBy("br", "bc").agg(
        (F.min("srow") - 1).alias("srow0"), (F.max("srow") + 1).alias("srow1"), (F.min("scol") - 1).alias("scol0"), (F.max("scol") + 1).alias("scol1"),
    )


def needed_blocks(windows: DataFrame, source: SourceGrid) -> DataFrame:
    """Source blocks ``brow, bcol`` that some target block's window meets."""
    of = lambda lo, hi: F.sequence(F.floor(F.col(lo) / source.block), F.floor(F.col(hi) / source.block))
    rows = windows.withColumn("brow", F.explode(of("srow0", "srow1")))
    return rows.select("brow", F.explode(of("scol0", "scol1")).alias("bcol")).distinct()


def write_source_blocks(pixels: DataFrame, source: SourceGrid, path: str) -> None:
    """Store ``row, col, value`` in one folder per block of rows and of columns."""
    placed = pixels.withColumns({"brow": F.floor(F.col("row") / source.block), "bcol": F.floor(F.col("col") / source.block)})
    placed.repartition("brow", "bcol").sortWithinPartitions("brow", "bcol", "row", "col").write.partitionBy("brow", "bcol").parquet(path)


def read_source_blocks(source_pixels: DataFrame, windows: DataFrame, source: SourceGrid) -> DataFrame:
    """``row, col, value`` of the blocks that the windows meet.

    The range over all windows is four numbers; as literals they prune block folders, where the
    source has ``brow`` and ``bcol``, and row groups. Blocks inside the range that no window meets go in a semi-join.
    """
    r = windows.agg(F.min("srow0").alias("r0"), F.max("srow1").alias("r1"), F.min("scol0").alias("c0"), F.max("scol1").alias("c1")).first()
    if r["r0"] is None:
        return source_pixels.select("row", "col", "value").limit(0)
    inside = F.col("row").between(r["r0"], r["r1"]) & F.col("col").between(r["c0"], r["c1"])
    if "brow" in source_pixels.columns:
        span = {"brow": (r["r0"], r["r1"]), "bcol": (r["c0"], r["c1"])}
        for name, (lo, hi) in span.items():
            inside &= F.col(name).between(lo // source.block, hi // source.block)
    else:
        source_pixels = source_pixels.withColumns({"brow": F.floor(F.col("row") / source.block), "bcol": F.floor(F.col("col") / source.block)})
    wanted = broadcast_if_small(materialize(needed_blocks(windows, source)))
    return source_pixels.where(inside).join(wanted, ["brow", "bcol"], "left_semi").select("row", "col", "value")


def resample_projected(
    pixels: DataFrame, source: SourceGrid, grid: TargetGrid, crs: TransverseMercator = NATIONAL_TM, block: int = 256,
) -> DataFrame:
    """``row, col, x, y, srow, scol, value`` of every target pixel: the source pixel that holds its centre, null outside.

    ``pixels(row, col, value)`` may carry the block folders of :func:`write_source_blocks`.
    """
    spark = pixels.sparkSession
    blocks = target_blocks(spark, grid, block)
    windows = materialize(source_windows(blocks, grid, source, crs))
    values = read_source_blocks(pixels, windows, source).select(
        F.col("row").cast("bigint").alias("srow"), F.col("col").cast("bigint").alias("scol"), "value"
    )
    rows = blocks.withColumn("row", F.explode(F.sequence("row0", F.col("row1") - 1)))
    target = rows.select("row", F.explode(F.sequence("col0", F.col("col1") - 1)).alias("col"))
    return _in_source(target, grid, source, crs).join(values, ["srow", "scol"], "left").select("row", "col", "x", "y", "srow", "scol", "value")


def slope_surface(
    pixels: DataFrame, source: SourceGrid, grid: TargetGrid, crs: TransverseMercator = NATIONAL_TM, block: int = 256,
) -> DataFrame:
    """``row, col, x, y, slope`` in degrees of an elevation source, on the metric grid."""
    elevation = resample_projected(pixels, source, grid, crs, block).select("row", "col", "value")
    slope = terrain_slope(elevation, grid.res, block)
    return slope.withColumns({"x": grid.west + (F.col("col") + 0.5) * grid.res, "y": grid.north - (F.col("row") + 0.5) * grid.res})


def mean_slope(
    pixels: DataFrame, source: SourceGrid, cells: DataFrame, bounds: tuple[float, float, float, float], *, res: float, cell_size: float,
    context: float | None, crs: TransverseMercator = NATIONAL_TM, block: int = 256, require: bool = True,
) -> DataFrame:
    """``cell_id, mean_slope`` over each cell, or over the ``context`` metres around it."""
    wide = (bounds[0] - (context or 0), bounds[1] - (context or 0), bounds[2] + (context or 0), bounds[3] + (context or 0))
    surface = slope_surface(pixels, source, TargetGrid.covering(wide, res), crs, block)
    return zonal_mean(surface, cells, cell_size, context, value="slope", require=require, out="mean_slope").select("cell_id", "mean_slope")
