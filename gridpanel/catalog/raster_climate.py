"""Queries on pixel tables, zones, coarse climate grids and nearest sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpanel.catalog.registry import query
from gridpanel.catalog.stats_ranking import rounded
from gridpanel.catalog.views import Views
from gridpanel.operators import climate as C
from gridpanel.operators import nearest as N
from gridpanel.operators import raster as R

VARS = ["t2m_k", "tp_m"]

# elevation-like raster: one pixel per part, 100 columns wide, retail price as height
ELEV_SQL = "elev AS (SELECT CAST(p_partkey // 100 AS INT) AS row, CAST(p_partkey % 100 AS INT) AS col, p_retailprice AS value FROM part)"


def _elevation(v):
    return v.table("part").select(
        F.floor(F.col("p_partkey") / 100).cast("int").alias("row"), (F.col("p_partkey") % 100).cast("int").alias("col"),
        F.col("p_retailprice").alias("value"),
    )


@query("s8_read_climate_long", """
SELECT CAST(YEAR(l_shipdate) AS INT) AS year, CAST(MONTH(l_shipdate) AS INT) AS month, CAST(i.range AS INT) AS lat_idx, CAST(j.range AS INT) AS lon_idx,
  40.0::DOUBLE - i.range AS lat, -9.0::DOUBLE + j.range AS lon, ROUND(SUM(CAST(l_quantity AS DECIMAL(12,2)))::DOUBLE * (i.range + 1) + j.range, 3) AS value
FROM lineitem, range(2) i, range(3) j GROUP BY 1, 2, 3, 4, 5, 6, i.range, j.range""")
def read_climate_long(spark, sf):
    """Monthly 2 × 3 arrays made from the facts, read back as long rows with both source indexes."""
    monthly = Views(spark, sf).table("lineitem").groupBy(F.trunc("l_shipdate", "month").alias("ts")).agg(
        F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("double").alias("q")
    )
    values = F.array(*[F.array(*[F.col("q") * (i + 1) + j for j in range(3)]) for i in range(2)])
    arrays = monthly.select(
        "ts", F.array(F.lit(40.0), F.lit(39.0)).alias("lats"), F.array(F.lit(-9.0), F.lit(-8.0), F.lit(-7.0)).alias("lons"), values.alias("values")
    )
    return rounded(C.climate_from_arrays(arrays), 3)


@query("s9_read_pixels", f"""WITH {ELEV_SQL}
SELECT "row", col, ROUND(-500 + (col + 0.5) * 25, 3)::DOUBLE AS x, ROUND(90000 - ("row" + 0.5) * 25, 3)::DOUBLE AS y, value FROM elev
WHERE "row" >= 2 AND "row" < 15 AND col >= 10 AND col < 90""")
def read_pixels(spark, sf):
    window = R.pixel_window(_elevation(Views(spark, sf)), 2, 15, 10, 90)
    return R.pixel_centres(window, -500.0, 90000.0, 25.0)


@query("s10_choose_source", """
SELECT c.lon_idx, c.lat_idx, c.year, c.month, ROUND(CASE WHEN c.year >= 2000 THEN x.v ELSE c.tp_m END, 9) AS tp_m, c.year >= 2000 AS corrected
FROM clim c LEFT JOIN (SELECT lon_idx, lat_idx, year, month, tp_m / 2 AS v FROM clim WHERE year >= 2000) x
  ON x.lon_idx = c.lon_idx AND x.lat_idx = c.lat_idx AND x.year = c.year AND x.month = c.month""", "clim")
def choose_source(spark, sf):
    base = Views(spark, sf).clim().select("lon_idx", "lat_idx", "year", "month", "tp_m")
    fixed = base.where("year >= 2000").withColumn("tp_m", F.col("tp_m") / 2)
    out = C.choose_source(base, fixed, ["lon_idx", "lat_idx", "year", "month"], ["tp_m"], mandatory=[2000, 2001])
    return rounded(out, 9)


@query("a4_season_stats", """
SELECT lat_idx, lon_idx, year, ROUND(AVG(t2m_k), 6) AS mean_t2m_k, ROUND(MAX(t2m_k), 6) AS max_t2m_k, ROUND(MIN(tp_m), 6) AS min_tp_m
FROM clim GROUP BY lat_idx, lon_idx, year""", "clim")
def season_stats(spark, sf):
    return rounded(C.season_stats(Views(spark, sf).clim(), {"t2m_k": ["mean", "max"], "tp_m": ["min"]}))


@query("a5_season_total", """
SELECT lat_idx, lon_idx, year, ROUND(CASE WHEN COUNT(tp_m) > 0 THEN SUM(tp_m * CASE WHEN month IN (7, 8) THEN 31 ELSE 30 END * 1000) END, 6) AS mm
FROM clim GROUP BY lat_idx, lon_idx, year""", "clim")
def season_total(spark, sf):
    return rounded(C.season_total(Views(spark, sf).clim(), "tp_m", "mm"))


@query("a5_month_violations", """
SELECT lat_idx, lon_idx, year, CAST(COUNT(DISTINCT month) AS INT) AS months FROM clim GROUP BY 1, 2, 3 HAVING COUNT(DISTINCT month) <> 4
UNION ALL SELECT -1, -1, -1, CAST(COUNT(*) AS INT) FROM clim""", "clim")
def month_violations(spark, sf):
    """Sources with an incomplete season, and one marker row with the number of rows checked."""
    clim = Views(spark, sf).clim()
    bad = C.month_violations(clim).select("lat_idx", "lon_idx", "year", F.size("months").alias("months"))
    total = clim.agg(F.count(F.lit(1)).cast("int").alias("months"))
    marker = total.select(F.lit(-1).alias("lat_idx"), F.lit(-1).alias("lon_idx"), F.lit(-1).alias("year"), "months")
    return bad.unionByName(marker)


@query("a8_stable_mask", """
WITH y AS (SELECT lat_idx, lon_idx, year, BOOL_AND(t2m_k IS NOT NULL AND tp_m IS NOT NULL) AS v FROM clim GROUP BY 1, 2, 3)
SELECT lat_idx, lon_idx, BOOL_AND(v) AS valid, CAST(COUNT(DISTINCT v) AS INT) AS states, COUNT(DISTINCT v) = 1 AS stable FROM y GROUP BY 1, 2""", "clim")
def stable_mask(spark, sf):
    return C.stable_mask(Views(spark, sf).clim(), VARS)


@query("a35_climate_contract", """
WITH l AS (SELECT lat_idx, lon_idx, year, month, 't2m_k' AS variable, t2m_k AS v FROM clim UNION ALL SELECT lat_idx, lon_idx, year, month, 'tp_m', tp_m FROM clim),
f AS (SELECT year, variable, COUNT(DISTINCT month) AS months, list_sort(list(DISTINCT month)) = [6, 7, 8, 9] AS right_months, COUNT(DISTINCT lat_idx) AS lat_count, COUNT(DISTINCT lon_idx) AS lon_count,
  COUNT(*) FILTER (WHERE v IS NULL) AS nulls, COUNT(*) AS rows FROM l GROUP BY year, variable),
s AS (SELECT year, MAX(nulls) = MIN(nulls) AS same_nulls FROM f GROUP BY year)
SELECT f.*, s.same_nulls, right_months AND same_nulls AND rows = months * lat_count * lon_count AS ready FROM f JOIN s ON s.year = f.year""", "clim")
def climate_contract(spark, sf):
    return C.climate_contract(Views(spark, sf).clim(), VARS)


@query("a6_zonal_mean", f"""
WITH off AS (SELECT x.range - 12 AS dx, y.range - 12 AS dy FROM range(28) x, range(28) y
  WHERE sqrt(pow(greatest(greatest(-(x.range - 12) - 0.5, 0), (x.range - 12) + 0.5 - 4), 2) + pow(greatest(greatest(-(y.range - 12) - 0.5, 0), (y.range - 12) + 0.5 - 4), 2)) < 8),
p AS (SELECT CAST(FLOOR(x / 250) AS INT) AS gx, CAST(FLOOR(y / 250) AS INT) AS gy, CASE WHEN code < 6 THEN code END AS v FROM pix)
SELECT c.cell_id, ROUND(SUM(p.v)::DOUBLE / COUNT(p.v), 6) AS zonal_mean FROM cell c CROSS JOIN off o
JOIN p ON p.gx = c.ix * 4 + o.dx AND p.gy = c.iy * 4 + o.dy GROUP BY c.cell_id""", "cell pix")
def zonal_mean(spark, sf):
    """Mean of valid pixels in the 2 km outward buffer of every cell."""
    v = Views(spark, sf)
    pix = v.pix().withColumn("value", F.when(F.col("code") < 6, F.col("code")).cast("double"))
    return rounded(R.zonal_mean(pix, v.cell(), 1000, 2000).select("cell_id", "zonal_mean"))


@query("a7_zonal_mode", """
WITH n AS (SELECT cell_id, code, COUNT(*) AS c FROM pix WHERE code BETWEEN 0 AND 5 GROUP BY cell_id, code),
m AS (SELECT cell_id, MAX(c) AS mx, CAST(SUM(c) AS BIGINT) AS valid FROM n GROUP BY cell_id),
t AS (SELECT n.cell_id, MAX(n.code) AS modal, COUNT(*) > 1 AS tie FROM n JOIN m ON m.cell_id = n.cell_id AND n.c = m.mx GROUP BY n.cell_id),
a AS (SELECT cell_id, COUNT(*) AS total FROM pix GROUP BY cell_id)
SELECT a.cell_id, COALESCE(t.modal, -1) AS modal_code, COALESCE(t.tie, false) AS modal_tie, COALESCE(m.valid, 0) AS valid_pixels,
  ROUND(COALESCE(m.valid, 0)::DOUBLE / a.total, 9) AS coverage_share, ROUND(COALESCE(m.mx::DOUBLE / m.valid, 0), 9) AS modal_share
FROM a LEFT JOIN m ON m.cell_id = a.cell_id LEFT JOIN t ON t.cell_id = a.cell_id""", "pix")
def zonal_mode(spark, sf):
    v = Views(spark, sf)
    return rounded(R.zonal_mode(v.pix(), v.cell(), range(6)), 9)


SLOPE_SQL = f"""
WITH {ELEV_SQL},
g AS (SELECT e.*, (SELECT MAX("row") FROM elev) AS mr,
  CASE WHEN e.col = 0 THEN (r.value - e.value) / 30 WHEN r.value IS NULL THEN (e.value - l.value) / 30 ELSE (r.value - l.value) / 60 END AS gx,
  CASE WHEN u.value IS NULL THEN (d.value - e.value) / 30 WHEN d.value IS NULL THEN (e.value - u.value) / 30 ELSE (d.value - u.value) / 60 END AS gy
FROM elev e LEFT JOIN elev l ON l."row" = e."row" AND l.col = e.col - 1 LEFT JOIN elev r ON r."row" = e."row" AND r.col = e.col + 1
LEFT JOIN elev u ON u."row" = e."row" - 1 AND u.col = e.col LEFT JOIN elev d ON d."row" = e."row" + 1 AND d.col = e.col)"""


@query("g17_terrain_slope", SLOPE_SQL + """
SELECT "row", col, ROUND(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope FROM g""")
def terrain_slope(spark, sf):
    return rounded(R.terrain_slope(_elevation(Views(spark, sf)), 30.0, block=16))


@query("w5_spatial_neighbours", SLOPE_SQL + """
SELECT "row", col, ROUND(gx, 6) AS gx, ROUND(gy, 6) AS gy FROM g""")
def spatial_neighbours(spark, sf):
    return rounded(R.neighbour_differences(_elevation(Views(spark, sf)), 30.0))


@query("g18_resample_nearest", f"""
WITH {ELEV_SQL}
SELECT c.cell_id, e.value FROM cell c LEFT JOIN elev e ON e.col = CAST(FLOOR((c.x0 + 500 + 250) / 1700) AS INT)
  AND e."row" = CAST(FLOOR((30000 - (c.y0 + 500)) / 1700.0) AS INT)""", "cell")
def resample_nearest(spark, sf):
    v = Views(spark, sf)
    target = v.cell().select("cell_id", (F.col("x0") + 500.0).alias("x"), (F.col("y0") + 500.0).alias("y"))
    out = R.resample_nearest(target, _elevation(v), -250.0, 30000.0, 1700.0, projected=False)
    return out.select("cell_id", "value")


@query("g20_mosaic", """
WITH p AS (SELECT CAST(l_partkey // 100 AS INT) AS "row", CAST(l_partkey % 100 AS INT) AS col, l_orderkey * 10 + l_linenumber AS t,
  CASE WHEN l_quantity < 10 THEN NULL ELSE l_extendedprice END AS value FROM lineitem),
f AS (SELECT "row", col, MIN(t) AS t FROM p WHERE value IS NOT NULL GROUP BY 1, 2),
k AS (SELECT DISTINCT "row", col FROM p)
SELECT k."row", k.col, MAX(p.value) IS NOT NULL AS filled, COUNT(DISTINCT p.value) >= 1 AS found FROM k LEFT JOIN f ON f."row" = k."row" AND f.col = k.col
LEFT JOIN p ON p."row" = f."row" AND p.col = f.col AND p.t = f.t GROUP BY 1, 2""")
def mosaic(spark, sf):
    """First valid value per pixel over overlapping tiles; the value must belong to the first valid tile."""
    item = Views(spark, sf).table("lineitem")
    tiles = item.select(
        F.floor(F.col("l_partkey") / 100).cast("int").alias("row"), (F.col("l_partkey") % 100).cast("int").alias("col"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tile_order"),
        F.when(F.col("l_quantity") >= 10, F.col("l_extendedprice")).alias("value"),
    )
    merged = R.mosaic(tiles)
    first = tiles.where(F.col("value").isNotNull()).groupBy("row", "col").agg(F.min("tile_order").alias("tile_order"))
    own = tiles.join(first, ["row", "col", "tile_order"]).select("row", "col", "value", F.lit(True).alias("own")).distinct()
    checked = merged.join(own, ["row", "col", "value"], "left")
    return checked.select("row", "col", F.col("value").isNotNull().alias("filled"), F.coalesce("own", F.lit(False)).alias("found"))


@query("j10_range_overlap", """
WITH t AS (SELECT DISTINCT CAST(FLOOR(c_acctbal / 250) AS INT) % 40 + 10 AS lat, CAST(c_nationkey AS INT) AS lon FROM customer),
e AS (SELECT s_suppkey, s_nationkey::DOUBLE AS xmin, s_nationkey + 1.5::DOUBLE AS xmax, 20.0::DOUBLE AS ymin, 20.0 + s_suppkey % 7::DOUBLE AS ymax FROM supplier)
SELECT CONCAT(CASE WHEN lat < 0 THEN 'S' ELSE 'N' END, LPAD(CAST(ABS(lat) AS VARCHAR), 2, '0'), '_00_E', LPAD(CAST(lon AS VARCHAR), 3, '0'), '_00') AS tile_id, s_suppkey
FROM t JOIN e ON lon + 1 > xmin AND lon < xmax AND lat + 1 > ymin AND lat < ymax""")
def range_overlap(spark, sf):
    """One-degree tiles that openly overlap an extent; touching is not overlap."""
    from gridpanel.operators.spatial import spatial_join

    v = Views(spark, sf)
    lat = (F.floor(F.col("c_acctbal") / 250).cast("int") % 40) + 10
    side = F.when(lat < 0, "S").otherwise("N")
    tiles = v.table("customer").select(
        F.format_string("%s%02d_00_E%03d_00", side, F.abs(lat), F.col("c_nationkey")).alias("tile_id")
    ).distinct()
    extents = v.table("supplier").select(
        "s_suppkey", F.col("s_nationkey").cast("double").alias("xmin"), (F.col("s_nationkey") + 1.5).alias("xmax"),
        F.lit(20.0).alias("ymin"), (20.0 + F.col("s_suppkey") % 7).alias("ymax"),
    )
    pairs = spatial_join(R.degree_tile_bounds(tiles), extents, 1.0, touching=False)
    return pairs.select("tile_id", F.col("r_s_suppkey").alias("s_suppkey"))


@query("a41_raster_contract", """
WITH p AS (SELECT CAST(l_suppkey AS VARCHAR) AS tile_id, CAST(l_linenumber AS INT) AS "row", CAST(l_quantity AS INT) AS col FROM lineitem)
SELECT tile_id, CAST(8 AS BIGINT) AS expected_height, CAST(51 AS BIGINT) AS expected_width, CAST(MAX("row") + 1 AS BIGINT) AS height,
  CAST(MAX(col) + 1 AS BIGINT) AS width, COUNT(*) AS pixels, CAST(0 AS BIGINT) AS nodata_pixels,
  MAX("row") = 7 AND MAX(col) = 50 AND COUNT(*) = (MAX("row") + 1) * (MAX(col) + 1) AS ready FROM p GROUP BY tile_id""")
def raster_contract(spark, sf):
    v = Views(spark, sf)
    pixels = v.table("lineitem").select(
        F.col("l_suppkey").cast("string").alias("tile_id"), F.col("l_linenumber").alias("row"), F.col("l_quantity").cast("int").alias("col"),
        F.col("l_extendedprice").alias("value"),
    )
    facts = pixels.select("tile_id").distinct().select(
        "tile_id", F.lit(8).cast("bigint").alias("expected_height"), F.lit(51).cast("bigint").alias("expected_width")
    )
    return R.raster_contract(pixels, facts)


# ------------------------------------------------------------------- nearest


def sources(v):
    """Coarse climate cells with centre, id and validity."""
    mask = C.stable_mask(v.clim(), VARS)
    return mask.select(
        "lat_idx", "lon_idx", "valid", (F.col("lat_idx") * 1000 + F.col("lon_idx")).cast("bigint").alias("sid"),
        (F.col("lon_idx") * 10000 + 5000).cast("double").alias("sx"), (F.col("lat_idx") * 10000 + 5000).cast("double").alias("sy"),
    )


def centred(v):
    return v.cell().select(
        "k", "cell_id", (F.col("x0") + 500).cast("double").alias("cx"), (F.col("y0") + 500).cast("double").alias("cy")
    )


@query("j6_nearest_axis_join", """
WITH lat AS (SELECT DISTINCT lat_idx, CAST(lat_idx * 10000 + 5000 AS DOUBLE) AS c FROM clim), lon AS (SELECT DISTINCT lon_idx, CAST(lon_idx * 10000 + 5000 AS DOUBLE) AS c FROM clim)
SELECT cell_id, (SELECT ARG_MIN(lat_idx, ABS(lat.c - (y0 + 1000)) * 1000000 + lat_idx) FROM lat) AS lat_idx,
  (SELECT ARG_MIN(lon_idx, ABS(lon.c - (x0 + 1000)) * 1000000 + lon_idx) FROM lon) AS lon_idx FROM cell""", "cell clim")
def nearest_axis_join(spark, sf):
    """Cells measured from their upper right corner, so some lie exactly between two sources."""
    v = Views(spark, sf)
    cells = v.cell().select("cell_id", (F.col("y0") + 1000).cast("double").alias("lat"), (F.col("x0") + 1000).cast("double").alias("lon"))
    src = sources(v)
    lats = src.select("lat_idx", F.col("sy").alias("lat")).distinct()
    lons = src.select("lon_idx", F.col("sx").alias("lon")).distinct()
    return N.nearest_axis_join(cells, lats, lons).select("cell_id", "lat_idx", "lon_idx")


KNN_SQL = """
WITH s AS (SELECT c_custkey AS sid, (c_custkey * 7919) % 100000 AS sx, (c_custkey * 104729) % 40000 AS sy FROM customer),
r AS (SELECT c.cell_id, s.sid, sqrt(pow(c.x0 + 500 - sx, 2) + pow(c.y0 + 500 - sy, 2)) AS d,
  ROW_NUMBER() OVER (PARTITION BY c.cell_id ORDER BY pow(c.x0 + 500 - sx, 2) + pow(c.y0 + 500 - sy, 2), s.sid) AS rank FROM cell c CROSS JOIN s)
SELECT cell_id, CAST(rank AS INT) AS rank, sid, ROUND(d, 6) AS distance FROM r WHERE rank <= {k}"""


def _scattered(v):
    """Irregular sources: one per customer."""
    k = F.col("c_custkey")
    return v.table("customer").select(
        k.alias("sid"), ((k * 7919) % 100000).cast("double").alias("sx"), ((k * 104729) % 40000).cast("double").alias("sy")
    )


def _knn(spark, sf, k):
    v = Views(spark, sf)
    points = centred(v).select(F.col("cell_id").alias("pid"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    out = N.knn(points, _scattered(v), k)
    return out.select(F.col("pid").alias("cell_id"), "rank", "sid", F.round("distance", 6).alias("distance"))


@query("j7_knn_nearest", KNN_SQL.format(k=1), "cell")
def knn_one(spark, sf):
    return _knn(spark, sf, 1)


@query("h3_ring_search", KNN_SQL.format(k=5), "cell")
def knn_five(spark, sf):
    return _knn(spark, sf, 5)


MAPPING_SQL = """
aff AS (SELECT c.cell_id, c.x0, c.y0, CAST(FLOOR(c.ix / 10) AS INT) AS lon_idx, CAST(FLOOR(c.iy / 10) AS INT) AS lat_idx FROM cell c
  JOIN axis_src s ON s.lon_idx = FLOOR(c.ix / 10) AND s.lat_idx = FLOOR(c.iy / 10) WHERE NOT s.valid),
mp AS (SELECT cell_id, fallback_sid, distance_km, sx, sy FROM (SELECT a.cell_id, s.sid AS fallback_sid, s.sx, s.sy,
  sqrt(pow(a.x0 + 500 - s.sx, 2) + pow(a.y0 + 500 - s.sy, 2)) / 1000 AS distance_km,
  ROW_NUMBER() OVER (PARTITION BY a.cell_id ORDER BY pow(a.x0 + 500 - s.sx, 2) + pow(a.y0 + 500 - s.sy, 2), s.sid) AS rn
  FROM aff a CROSS JOIN axis_src s WHERE s.valid) z WHERE rn = 1)"""


def located(v):
    return centred(v).withColumns(
        {"lat_idx": F.floor(F.col("cy") / 10000).cast("int"), "lon_idx": F.floor(F.col("cx") / 10000).cast("int")}
    )


@query("b3_fallback_mapping", f"WITH {MAPPING_SQL} SELECT cell_id, fallback_sid, ROUND(distance_km, 6) AS distance_km FROM mp", "cell axis_src")
def fallback_mapping(spark, sf):
    v = Views(spark, sf)
    out = N.fallback_mapping(located(v), sources(v))
    return out.select("cell_id", "fallback_sid", F.round("distance_km", 6).alias("distance_km"))


@query("j8_local_consistency", f"""
WITH {MAPPING_SQL},
cl AS (SELECT lat_idx * 1000 + lon_idx AS sid, year, AVG(t2m_k) AS t FROM clim GROUP BY 1, 2),
nn AS (SELECT * FROM (SELECT a.cell_id, s.sid, ROW_NUMBER() OVER (PARTITION BY a.cell_id ORDER BY pow(a.x0 + 500 - s.sx, 2) + pow(a.y0 + 500 - s.sy, 2), s.sid) AS rn
  FROM aff a CROSS JOIN axis_src s WHERE s.valid) z WHERE rn <= 5),
md AS (SELECT nn.cell_id, cl.year, quantile_cont(cl.t, 0.5) AS m FROM nn JOIN cl ON cl.sid = nn.sid GROUP BY 1, 2)
SELECT mp.cell_id, ROUND(MAX(ABS(cl.t - md.m)), 6) AS max_gap_t FROM mp JOIN cl ON cl.sid = mp.fallback_sid JOIN md ON md.cell_id = mp.cell_id AND md.year = cl.year
GROUP BY mp.cell_id""", "cell axis_src clim")
def local_consistency(spark, sf):
    v = Views(spark, sf)
    src = sources(v)
    mapping = N.fallback_mapping(located(v), src)
    climate = v.clim().groupBy((F.col("lat_idx") * 1000 + F.col("lon_idx")).cast("bigint").alias("sid"), "year").agg(F.avg("t2m_k").alias("t"))
    affected = located(v).join(mapping.select("cell_id"), "cell_id", "left_semi")
    points = affected.select(F.col("cell_id").alias("pid"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    out = N.local_consistency(mapping, points, src.where("valid"), climate, ["t"])
    return rounded(out)


@query("j9_fill_from_mapping", f"""
WITH {MAPPING_SQL},
cl AS (SELECT lat_idx * 1000 + lon_idx AS sid, year, AVG(t2m_k) AS t, AVG(tp_m) AS p FROM clim GROUP BY 1, 2),
ce AS (SELECT cell_id, FLOOR(iy / 10) * 1000 + FLOOR(ix / 10) AS sid FROM cell)
SELECT ce.cell_id, y.year, ROUND(CASE WHEN o.t IS NULL OR o.p IS NULL THEN f.t ELSE o.t END, 6) AS t, ROUND(CASE WHEN o.t IS NULL OR o.p IS NULL THEN f.p ELSE o.p END, 6) AS p,
  CASE WHEN o.t IS NOT NULL AND o.p IS NOT NULL THEN 'containing_source' WHEN mp.fallback_sid IS NOT NULL THEN 'nearest_valid_source' ELSE 'unassigned' END AS assignment_method
FROM ce CROSS JOIN yrs y LEFT JOIN cl o ON o.sid = ce.sid AND o.year = y.year LEFT JOIN mp ON mp.cell_id = ce.cell_id
LEFT JOIN cl f ON f.sid = mp.fallback_sid AND f.year = y.year""", "cell axis_src clim yrs")
def fill_from_mapping(spark, sf):
    v = Views(spark, sf)
    mapping = N.fallback_mapping(located(v), sources(v))
    climate = v.clim().groupBy((F.col("lat_idx") * 1000 + F.col("lon_idx")).cast("bigint").alias("sid"), "year").agg(
        F.avg("t2m_k").alias("t"), F.avg("tp_m").alias("p")
    )
    years = F.array(*[F.lit(y) for y in v.years()])
    rows = located(v).select("cell_id", (F.col("lat_idx") * 1000 + F.col("lon_idx")).cast("bigint").alias("sid")).withColumn("year", F.explode(years))
    return rounded(N.fill_from_mapping(rows, climate, mapping, ["t", "p"])).select("cell_id", "year", "t", "p", "assignment_method")


@query("a28_source_extent", f"""
WITH {MAPPING_SQL},
e AS (SELECT MIN(lat_idx) AS a, MAX(lat_idx) AS b, MIN(lon_idx) AS c, MAX(lon_idx) AS d FROM axis_src),
ch AS (SELECT mp.*, s.lat_idx, s.lon_idx FROM mp JOIN axis_src s ON s.sid = mp.fallback_sid),
ob AS (SELECT COUNT(*) FILTER (WHERE lat_idx IN (e.a, e.b) OR lon_idx IN (e.c, e.d)) AS n, MAX(distance_km) AS mx, COUNT(*) AS af FROM ch, e)
SELECT MAX(lat_idx) AS last_lat, MAX(lon_idx) AS last_lon, COUNT(*) FILTER (WHERE valid) AS valid_sources, COUNT(*) FILTER (WHERE NOT valid) AS masked_sources,
  MIN(sx) AS west, MAX(sx) AS east, MIN(sy) AS south, MAX(sy) AS north, (SELECT af FROM ob) AS affected, (SELECT n FROM ob) AS on_boundary,
  (SELECT n = 0 AND mx < 20 FROM ob) AS accepted FROM axis_src""", "cell axis_src")
def source_extent(spark, sf):
    v = Views(spark, sf)
    src = sources(v)
    return N.source_extent(src, N.fallback_mapping(located(v), src)).drop("first_lat", "first_lon")


@query("a29_mask_summary", f"""
WITH {MAPPING_SQL}
SELECT CASE WHEN p_retailprice * 1000 < 999999.999 THEN 'partial_land_coastal' ELSE 'full_land_coastal' END AS land_class, COUNT(*) AS cells,
  MIN(aff.x0) AS xmin, MIN(aff.y0) AS ymin, MAX(aff.x0) + 1000 AS xmax, MAX(aff.y0) + 1000 AS ymax
FROM aff JOIN cell USING (cell_id) JOIN part ON p_partkey = k GROUP BY 1""", "cell axis_src")
def mask_summary(spark, sf):
    """Affected cells by land class, with their bounds."""
    from gridpanel.functions.scalars import land_class

    v = Views(spark, sf)
    masked = sources(v).where(~F.col("valid")).select("lat_idx", "lon_idx")
    affected = located(v).join(masked, ["lat_idx", "lon_idx"], "left_semi").select("k", "cell_id")
    land = v.table("part").select(F.col("p_partkey").alias("k"), land_class(F.col("p_retailprice") * 1000).alias("land_class"))
    return affected.join(v.cell().select("cell_id", "x0", "y0"), "cell_id").join(land, "k").groupBy("land_class").agg(
        F.count(F.lit(1)).alias("cells"), F.min("x0").alias("xmin"), F.min("y0").alias("ymin"),
        (F.max("x0") + 1000).alias("xmax"), (F.max("y0") + 1000).alias("ymax"),
    )
