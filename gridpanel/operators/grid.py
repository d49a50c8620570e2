"""Regular grids: cells, tiles and neighbourhoods from integer algebra."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpanel.functions.geometry import polygon_contains, tm_inverse
from gridpanel.operators.prefix import row_index


def make_grid(
    spark: SparkSession,
    bounds: tuple[float, float, float, float],
    size: float,
    boundary: DataFrame | None = None,
    prefix: str = "CELL_",
    tile: float | None = None,
) -> DataFrame:
    """Squares snapped to ``size``; ids run west to east, then south to north.

    With a ``boundary`` (column ``rings``) only squares whose centre lies inside one
    of its polygons stay. Centres meet polygons on a tile key, never all-against-all.
    """
    xmin, ymin, xmax, ymax = bounds
    ox, oy = math.floor(xmin / size) * size, math.floor(ymin / size) * size
    nx, ny = math.ceil((xmax - ox) / size), math.ceil((ymax - oy) / size)
    i = F.col("id")
    cells = spark.range(nx * ny).select(
        (i % nx).cast("int").alias("ix"),
        F.floor(i / nx).cast("int").alias("iy"),
        (F.lit(ox) + (i % nx) * size).alias("x0"),
        (F.lit(oy) + F.floor(i / nx) * size).alias("y0"),
    )
    if boundary is not None:
        from gridpanel.operators.sweep import points_in_polygons

        centres = cells.withColumns({"x": F.col("x0") + size / 2, "y": F.col("y0") + size / 2})
        kept = points_in_polygons(centres, boundary, ["ix", "iy"], tile or 20 * size, covers=False)
        cells = cells.join(kept.select("ix", "iy").distinct(), ["ix", "iy"], "left_semi")
    # the reference order sorts by x first and y second
    numbered = row_index(cells, ["ix", "iy"])
    return numbered.withColumn(
        "cell_id", F.format_string(prefix + "%06d", F.col("row_index"))
    ).drop("row_index")


def tile_key(x: Column, y: Column, size: float, ox: float = 0.0, oy: float = 0.0) -> Column:
    tx, ty = F.floor((x - ox) / size), F.floor((y - oy) / size)
    return F.format_string("x%02d_y%02d", tx, ty)


def tile_bounds(df: DataFrame, size: float, ox: float = 0.0, oy: float = 0.0, tile: str = "tile_id") -> DataFrame:
    """Rectangle of a ``x%02d_y%02d`` tile id."""
    tx = F.regexp_extract(tile, r"x(-?\d+)_", 1).cast("bigint")
    ty = F.regexp_extract(tile, r"_y(-?\d+)", 1).cast("bigint")
    return df.withColumns(
        {
            "txmin": (tx * size + ox).cast("double"), "tymin": (ty * size + oy).cast("double"),
            "txmax": ((tx + 1) * size + ox).cast("double"), "tymax": ((ty + 1) * size + oy).cast("double"),
        }
    )


def candidate_tiles(df: DataFrame, size: float, ox: float = 0.0, oy: float = 0.0) -> DataFrame:
    """One row per tile an extent ``xmin..ymax`` covers; the upper edge is exclusive by one metre."""
    first_x, last_x = F.floor((F.col("xmin") - ox) / size), F.floor((F.col("xmax") - 1 - ox) / size)
    first_y, last_y = F.floor((F.col("ymin") - oy) / size), F.floor((F.col("ymax") - 1 - oy) / size)
    return (
        df.withColumn("tx", F.explode(F.sequence(first_x, last_x)))
        .withColumn("ty", F.explode(F.sequence(first_y, last_y)))
        .withColumn("tile_id", F.format_string("x%02d_y%02d", "tx", "ty"))
    )


def tile_catalog(cells: DataFrame, size: float, cell_size: float, key: str = "cell_id") -> DataFrame:
    """Rows and bounds per tile by cell centroid, with the number of duplicated cells."""
    half = cell_size / 2
    tiled = cells.withColumn("tile_id", tile_key(F.col("x0") + half, F.col("y0") + half, size))
    repeated = tiled.groupBy("tile_id", key).agg(
        F.count(F.lit(1)).alias("_n"), F.min("x0").alias("_x0"), F.min("y0").alias("_y0")
    )
    return repeated.groupBy("tile_id").agg(
        F.sum("_n").alias("cells"),
        F.sum((F.col("_n") > 1).cast("int")).alias("duplicated"),
        F.min("_x0").alias("xmin"), F.min("_y0").alias("ymin"),
        (F.max("_x0") + int(cell_size)).alias("xmax"), (F.max("_y0") + int(cell_size)).alias("ymax"),
    )


def centroids(cells: DataFrame, cell_size: float) -> DataFrame:
    half = cell_size / 2
    lonlat = tm_inverse(F.col("cx"), F.col("cy"))
    return cells.withColumns({"cx": F.col("x0") + half, "cy": F.col("y0") + half}).withColumns(
        {"centroid_longitude": lonlat["lon"], "centroid_latitude": lonlat["lat"]}
    )


def neighbourhood_offsets(cell_size: float, distance: float) -> list[tuple[int, int]]:
    """Offsets of squares within ``distance`` of a square; the list depends on the ratio only."""
    reach = int(distance // cell_size) + 1
    inside = []
    for dx in range(-reach, reach + 1):
        for dy in range(-reach, reach + 1):
            gap = math.hypot(max(abs(dx) - 1, 0), max(abs(dy) - 1, 0)) * cell_size
            if gap <= distance:
                inside.append((dx, dy))
    return inside


def explode_neighbours(df: DataFrame, cell_size: float, distance: float) -> DataFrame:
    """Each ``(ix, iy)`` row once per square within ``distance`` (itself included), as ``nix, niy``.

    Spark sizes the exploded rows like the rows before, so a join with them is told never to broadcast them.
    """
    offsets = F.array(
        *[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in neighbourhood_offsets(cell_size, distance)]
    )
    spread = df.withColumn("_o", F.explode(offsets))
    return spread.withColumns(
        {"nix": F.col("ix") + F.col("_o.dx"), "niy": F.col("iy") + F.col("_o.dy")}
    ).drop("_o").hint("merge")


def grid_neighbourhood(cells: DataFrame, cell_size: float, distance: float, key: str = "cell_id") -> DataFrame:
    """Existing pairs ``(cell, neighbour)`` within ``distance``."""
    spread = explode_neighbours(cells.select(key, "ix", "iy"), cell_size, distance)
    other = cells.select(F.col("ix").alias("nix"), F.col("iy").alias("niy"), F.col(key).alias("neighbour"))
    return spread.join(other, ["nix", "niy"]).select(key, "neighbour")


def in_boundary(points: DataFrame, rings: Column, covers: bool) -> DataFrame:
    return points.where(polygon_contains(F.col("x"), F.col("y"), rings, covers))
