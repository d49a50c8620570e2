"""Queries on rasters in degrees brought to the metric grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpanel.catalog.registry import query
from gridpanel.catalog.stats_ranking import rounded
from gridpanel.catalog.views import Views
from gridpanel.functions import geometry as G
from gridpanel.operators import reproject as RP

RES, STEP, LON0, SOUTH, BLOCK = 500.0, 0.0125, -8.15, 39.64, 16


def tm_inverse_sql(source: str) -> str:
    """CTEs from ``source`` with ``x, y`` to ``deg`` with ``lon, lat``, by the series and Newton steps of ``tm_inverse``."""
    crs = G.NATIONAL_TM
    e, n = G._ellipsoid(crs.rf)
    radius, m0 = G._tm_origin(crs)
    beta = list(enumerate(G._beta(n), start=1))
    xi = "".join(f" - {b!r}::DOUBLE * sin({2 * j} * xi0) * cosh({2 * j} * eta0)" for j, b in beta)
    eta = "".join(f" - {b!r}::DOUBLE * cos({2 * j} * xi0) * sinh({2 * j} * eta0)" for j, b in beta)
    steps, before = [], "tm2"
    for k in (1, 2, 3):
        steps.append(f"""tn{k} AS (SELECT * REPLACE (tau + (t - c) / sqrt(1 + c * c) * (1 + {1 - e * e!r}::DOUBLE * tau * tau) / ({1 - e * e!r}::DOUBLE * r) AS tau) FROM (
  SELECT *, tau * sqrt(1 + sg * sg) - sg * r AS c FROM (SELECT *, sinh({e!r}::DOUBLE * atanh({e!r}::DOUBLE * tau / r)) AS sg FROM (
    SELECT * {"EXCLUDE (c, sg, r)" if k > 1 else ""}, sqrt(1 + tau * tau) AS r FROM {before}) q1) q2) q3)""")
        before = f"tn{k}"
    return f"""tm0 AS (SELECT *, (y - {crs.fn!r} + {m0!r}::DOUBLE) / {crs.k0 * radius!r}::DOUBLE AS xi0, (x - {crs.fe!r}) / {crs.k0 * radius!r}::DOUBLE AS eta0 FROM {source}),
tm1 AS (SELECT *, xi0{xi} AS xi, eta0{eta} AS eta FROM tm0),
tm2 AS (SELECT *, sin(xi) / sqrt(sinh(eta) * sinh(eta) + cos(xi) * cos(xi)) AS t, t AS tau FROM tm1),
{", ".join(steps)},
deg AS (SELECT *, degrees(atan2(sinh(eta), cos(xi))) + {crs.lon0!r} AS lon, degrees(atan(tau)) AS lat FROM tn3)"""


def grid_sql(context: int) -> str:
    return f"""m AS (SELECT CAST(FLOOR(MAX(p_partkey) / 100) AS INT) AS top FROM part),
src AS (SELECT CAST(m.top - p_partkey // 100 AS BIGINT) AS srow, CAST(p_partkey % 100 AS BIGINT) AS scol, p_retailprice AS value FROM part, m),
g AS (SELECT FLOOR(({-context} - 60) / {RES}) * {RES} AS west, CEIL((100000 + {context} + 60) / {RES}) * {RES} AS east,
  FLOOR(({-context} - 60) / {RES}) * {RES} AS south, CEIL(((top + 1) * 1000 + {context} + 60) / {RES}) * {RES} AS north, {SOUTH} + (top + 2) * {STEP} AS lat0 FROM m),
px AS (SELECT r.range AS "row", c.range AS col, west + (c.range + 0.5) * {RES} AS x, north - (r.range + 0.5) * {RES} AS y, lat0
  FROM g, range(100000) r, range(100000) c WHERE r.range < (north - south) / {RES} AND c.range < (east - west) / {RES}),
{tm_inverse_sql("px")},
ix AS (SELECT "row", col, x, y, CAST(FLOOR((lat0 - lat) / {STEP}) AS BIGINT) AS srow, CAST(FLOOR((lon - {LON0}) / {STEP}) AS BIGINT) AS scol FROM deg),
warped AS (SELECT ix.*, src.value FROM ix LEFT JOIN src ON src.srow = ix.srow AND src.scol = ix.scol)"""


SLOPES_SQL = f"""
g1 AS (SELECT *, lag(value) OVER a AS l, lead(value) OVER a AS r, lag(value) OVER d AS u, lead(value) OVER d AS b,
  lag(1) OVER a AS hl, lead(1) OVER a AS hr, lag(1) OVER d AS hu, lead(1) OVER d AS hb FROM warped WINDOW a AS (PARTITION BY "row" ORDER BY col), d AS (PARTITION BY col ORDER BY "row")),
g2 AS (SELECT *, CASE WHEN hl = 1 AND hr = 1 THEN (r - l) / {2 * RES} WHEN hr = 1 THEN (r - value) / {RES} ELSE (value - l) / {RES} END AS gx,
  CASE WHEN hu = 1 AND hb = 1 THEN (b - u) / {2 * RES} WHEN hb = 1 THEN (b - value) / {RES} ELSE (value - u) / {RES} END AS gy FROM g1),
slopes AS (SELECT "row", col, x, y, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope FROM g2)"""


def _source(v: Views) -> tuple:
    """An elevation in degrees over the cells, its grid and the metric bounds of the cells."""
    part = v.table("part")
    top = part.agg(F.floor(F.max("p_partkey") / 100)).first()[0] or 0
    pixels = part.select((top - F.floor(F.col("p_partkey") / 100)).alias("row"), (F.col("p_partkey") % 100).alias("col"), F.col("p_retailprice").alias("value"))
    return pixels, RP.SourceGrid(LON0, SOUTH + (top + 2) * STEP, STEP, BLOCK), (0.0, 0.0, 100000.0, (top + 1) * 1000.0)


@query("g18_resample_projected", f"""
WITH {grid_sql(0)}
SELECT "row", col, srow, scol, value FROM warped""")
def resample_projected(spark, sf):
    """Nearest source pixel of a raster in degrees for every pixel of the padded, outward snapped metric grid."""
    pixels, source, bounds = _source(Views(spark, sf))
    out = RP.resample_projected(pixels, source, RP.TargetGrid.covering(bounds, RES), block=64)
    return out.select("row", "col", "srow", "scol", "value")


@query("g18_needed_blocks", f"""
WITH {grid_sql(0)}
SELECT DISTINCT CAST(FLOOR(srow / {BLOCK}.0) AS BIGINT) AS brow, CAST(FLOOR(scol / {BLOCK}.0) AS BIGINT) AS bcol, true AS listed FROM ix""")
def needed_blocks(spark, sf):
    """Source blocks that hold target pixels; each must be among those that the block windows list."""
    pixels, source, bounds = _source(Views(spark, sf))
    grid = RP.TargetGrid.covering(bounds, RES)
    blocks = RP.target_blocks(spark, grid, 64)
    listed = RP.needed_blocks(RP.source_windows(blocks, grid, source), source).withColumn("listed", F.lit(True))
    held = RP.resample_projected(pixels, source, grid, block=64).select(
        F.floor(F.col("srow") / source.block).alias("brow"), F.floor(F.col("scol") / source.block).alias("bcol")).distinct()
    return held.join(listed, ["brow", "bcol"], "left").select("brow", "bcol", F.coalesce("listed", F.lit(False)).alias("listed"))


@query("b1_slope_surface", f"""
WITH {grid_sql(0)}, {SLOPES_SQL}
SELECT "row", col, ROUND(slope, 6) AS slope FROM slopes""")
def slope_surface(spark, sf):
    pixels, source, bounds = _source(Views(spark, sf))
    return rounded(RP.slope_surface(pixels, source, RP.TargetGrid.covering(bounds, RES), block=64).select("row", "col", "slope"))


@query("b1_mean_slope", f"""
WITH {grid_sql(2000)}, {SLOPES_SQL},
o AS (SELECT x.range - 5 AS dx, y.range - 5 AS dy FROM range(12) x, range(12) y
  WHERE pow(greatest(-(x.range - 5) - 0.5, (x.range - 5) + 0.5 - 2, 0), 2) + pow(greatest(-(y.range - 5) - 0.5, (y.range - 5) + 0.5 - 2, 0), 2) < 16),
s AS (SELECT CAST(FLOOR(x / {RES}) AS INT) AS gx, CAST(FLOOR(y / {RES}) AS INT) AS gy, slope FROM slopes WHERE slope IS NOT NULL)
SELECT c.cell_id, ROUND(AVG(s.slope), 6) AS mean_slope FROM cell c CROSS JOIN o LEFT JOIN s ON s.gx = c.ix * 2 + o.dx AND s.gy = c.iy * 2 + o.dy GROUP BY c.cell_id""", "cell")
def mean_slope(spark, sf):
    """Mean slope of the pixels within 2 km of every cell, from a source in degrees."""
    v = Views(spark, sf)
    pixels, source, bounds = _source(v)
    return rounded(RP.mean_slope(pixels, source, v.cell(), bounds, res=RES, cell_size=1000, context=2000, block=64, require=False))
