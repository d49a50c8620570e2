"""Queries on polygon layers: areas, clips, dissolves, joins, masks and layer audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpanel.catalog.registry import query
from gridpanel.catalog.views import Views
from gridpanel.functions import geometry as GE
from gridpanel.operators import grid as G
from gridpanel.operators import raster as RA
from gridpanel.operators import screening as SC
from gridpanel.operators import spatial as SP
from gridpanel.operators import sweep as SW
from gridpanel.sources import registry as RG
from gridpanel.sources import tables as TB

GROUPS = {"built": ["112"], "forest": ["311"]}


def green_sql(edges: str, x0: str, y0: str, x1: str, y1: str) -> str:
    """SQL text of the area of polygon edges ``(xa, ya, xb, yb)`` inside a rectangle."""
    return f"""SUM((hi - lo) * CASE WHEN GREATEST(ua, ub) <= 0 THEN 0 WHEN LEAST(ua, ub) >= wd THEN wd
      WHEN LEAST(ua, ub) >= 0 AND GREATEST(ua, ub) <= wd THEN (ua + ub) / 2
      ELSE ((CASE WHEN ub <= 0 THEN 0 WHEN ub < wd THEN ub * ub / 2 ELSE wd * ub - wd * wd / 2 END)
          - (CASE WHEN ua <= 0 THEN 0 WHEN ua < wd THEN ua * ua / 2 ELSE wd * ua - wd * wd / 2 END)) / (ub - ua) END)
    FROM (SELECT *, xa + (lo - ya) * (xb - xa) / NULLIF(yb - ya, 0) - rx0 AS ua, xa + (hi - ya) * (xb - xa) / NULLIF(yb - ya, 0) - rx0 AS ub
      FROM (SELECT *, LEAST(GREATEST(ya, ry0), ry1) AS lo, LEAST(GREATEST(yb, ry0), ry1) AS hi, rx1 - rx0 AS wd
        FROM (SELECT *, CAST({x0} AS DOUBLE) AS rx0, CAST({y0} AS DOUBLE) AS ry0, CAST({x1} AS DOUBLE) AS rx1, CAST({y1} AS DOUBLE) AS ry1 FROM {edges}) a) b) c
    WHERE ya <> yb"""


# the outward buffer of a 1 km square, 16 segments per quarter, and its weight on every 250 m square
CONTEXT_SQL = f"""
vtx AS (SELECT c.range * 17 + i.range AS n, CASE WHEN c.range IN (0, 3) THEN 1000 ELSE 0 END + 2000 * cos(radians(90.0::DOUBLE * c.range + 90.0::DOUBLE * i.range / 16)) AS x,
  CASE WHEN c.range IN (0, 1) THEN 1000 ELSE 0 END + 2000 * sin(radians(90.0::DOUBLE * c.range + 90.0::DOUBLE * i.range / 16)) AS y FROM range(4) c, range(17) i),
edg AS (SELECT a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb FROM vtx a JOIN vtx b ON b.n = (a.n + 1) % 68),
sq AS (SELECT CAST(x.range - 8 AS INT) AS lx, CAST(y.range - 8 AS INT) AS ly FROM range(20) x, range(20) y),
wgt AS (SELECT lx, ly, {green_sql("(SELECT * FROM sq CROSS JOIN edg) z", "lx * 250", "ly * 250", "lx * 250 + 250", "ly * 250 + 250")} GROUP BY lx, ly),
wts AS (SELECT lx, ly, w FROM wgt AS t(lx, ly, w) WHERE w > 1e-6)"""

# the 250 m squares that meet the buffer, if only in a point: no side of either lies between them
TOUCH_SQL = """
tsq AS (SELECT CAST(x.range - 10 AS INT) AS lx, CAST(y.range - 10 AS INT) AS ly FROM range(24) x, range(24) y),
tch AS (SELECT lx, ly FROM tsq WHERE lx * 250 <= 3000 AND lx * 250 + 250 >= -2000 AND ly * 250 <= 3000 AND ly * 250 + 250 >= -2000 AND NOT EXISTS (
  SELECT 1 FROM edg, range(2) i, range(2) j WHERE true GROUP BY xa, ya, xb, yb
  HAVING MAX((xb - xa) * ((ly + j.range) * 250 - ya) - (yb - ya) * ((lx + i.range) * 250 - xa)) < -1e-3))"""


@query("g1_poly_area", """SELECT poly_id, CAST((xmax - xmin) * (ymax - ymin) AS DOUBLE) AS area FROM rect""", "rect")
def poly_area(spark, sf):
    return Views(spark, sf).polygons().select("poly_id", GE.polygon_area(F.col("rings")).alias("area"))


@query("g2_bbox", """SELECT poly_id, CAST(xmin AS DOUBLE) AS xmin, CAST(ymin AS DOUBLE) AS ymin, CAST(xmax AS DOUBLE) AS xmax,
  CAST(ymax AS DOUBLE) AS ymax FROM rect""", "rect")
def bbox(spark, sf):
    return SP.with_bbox(Views(spark, sf).polygons()).select("poly_id", "xmin", "ymin", "xmax", "ymax")


@query("s5_read_bbox", """SELECT poly_id, year FROM rect WHERE xmax >= 20000 AND xmin <= 45000 AND ymax >= 3000 AND ymin <= 9000""", "rect")
def read_bbox(spark, sf):
    return SP.read_bbox(Views(spark, sf).rect(), 20000, 3000, 45000, 9000).select("poly_id", "year")


@query("s6_read_polygons", """SELECT CAST(poly_id AS VARCHAR) AS id, code, CAST(0 AS INT) AS part, CAST(xmin AS DOUBLE) AS xmin,
  CAST(ymax AS DOUBLE) AS ymax, CAST((xmax - xmin) * (ymax - ymin) AS DOUBLE) AS area FROM rect""", "rect")
def read_polygons(spark, sf):
    """Feature text made from the layer and read back as polygons."""
    rows = Views(spark, sf).polygons()
    coordinates = F.to_json(F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))))
    features = rows.select(
        F.lit("Feature").alias("type"), F.create_map(F.lit("id"), F.col("poly_id").cast("string"), F.lit("code"), F.col("code")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
    )
    text = features.select(F.to_json(F.struct("type", "properties", F.struct(F.col("geometry.type"), F.parse_json("geometry.coordinates").alias("coordinates")).alias("geometry"))).alias("v"))
    parsed = text.select(F.from_json("v", TB.GEOJSON_SCHEMA).alias("f")).select("f.*")
    polys = TB.polygons_from_features(parsed, ["id", "code"])
    return polys.select("id", "code", "part", "xmin", "ymax", GE.polygon_area(F.col("rings")).alias("area"))


@query("s7_split_archive", """SELECT poly_id, year FROM rect WHERE year = 1997""", "rect")
def split_archive(spark, sf):
    layer = Views(spark, sf).rect().withColumn("Ano", F.col("year").cast("string")).drop("year")
    return TB.split_archive_by_year(layer, "Ano", 1997).select("poly_id", "year")


@query("p28_boundary_select", """SELECT r_name, n_name, (SELECT COUNT(*) FROM nation) AS units FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_name = (SELECT MIN(n_name) FROM nation)""")
def boundary_select(spark, sf):
    v = Views(spark, sf)
    rows = v.table("nation").join(v.table("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    chosen, units = TB.boundary_select(rows, "n_name", rows.agg(F.min("n_name")).first()[0], "n_name")
    return chosen.select("r_name", "n_name", units.agg(F.count(F.lit(1)).alias("units")).scalar().alias("units"))


@query("h2_tile_explode", """SELECT poly_id, tx.range AS tx, ty.range AS ty FROM rect
JOIN range(0, 110) tx ON tx.range * 1000 < xmax AND (tx.range + 1) * 1000 > xmin
JOIN range(0, 30) ty ON ty.range * 1000 < ymax AND (ty.range + 1) * 1000 > ymin""", "rect")
def tile_explode(spark, sf):
    return SP.tile_explode(Views(spark, sf).rect(), 1000, closed=False).select("poly_id", "tx", "ty")


@query("g6_clip_to_cell", """SELECT poly_id, CAST(tx.range AS INT) AS ix, CAST(ty.range AS INT) AS iy,
  CAST((LEAST(xmax, (tx.range + 1) * 1000) - GREATEST(xmin, tx.range * 1000)) * (LEAST(ymax, (ty.range + 1) * 1000) - GREATEST(ymin, ty.range * 1000)) AS DOUBLE) AS area
FROM rect JOIN range(0, 110) tx ON tx.range * 1000 < xmax AND (tx.range + 1) * 1000 > xmin
JOIN range(0, 30) ty ON ty.range * 1000 < ymax AND (ty.range + 1) * 1000 > ymin""", "rect")
def clip_to_cell(spark, sf):
    return SP.clip_to_cells(Views(spark, sf).polygons(), ["poly_id"], 1000)


@query("g8_union_area", """SELECT CAST(FLOOR(x / 1000) AS INT) AS ix, CAST(FLOOR(y / 1000) AS INT) AS iy, year,
  ROUND(COUNT(DISTINCT x * 100000 + y) * 62500.0::DOUBLE, 3) AS area FROM lat GROUP BY 1, 2, 3""", "lat")
def union_area(spark, sf):
    out = SP.window_areas(Views(spark, sf).polygons(), ["year"], 1000)
    return out.select("ix", "iy", "year", F.round("area", 3).alias("area"))


@query("a2_burn_share", """
WITH a AS (SELECT CAST(FLOOR(x / 1000) AS INT) AS ix, CAST(FLOOR(y / 1000) AS INT) AS iy, year, COUNT(DISTINCT x * 100000 + y) / 16.0::DOUBLE AS share
  FROM lat GROUP BY 1, 2, 3)
SELECT c.cell_id, y.year, ROUND(COALESCE(a.share, 0), 9) AS share FROM cell c CROSS JOIN yrs y
LEFT JOIN a ON a.ix = c.ix AND a.iy = c.iy AND a.year = y.year""", "cell yrs lat")
def burn_share(spark, sf):
    v = Views(spark, sf)
    out = SP.burn_share(v.polygons(), v.cell(), v.years(), 1000)
    return out.select("cell_id", "year", F.round("share", 9).alias("share"))


@query("a3_class_share", """
WITH a AS (SELECT CAST(FLOOR(x / 1000) AS INT) AS ix, CAST(FLOOR(y / 1000) AS INT) AS iy,
  COUNT(DISTINCT CASE WHEN code = '112' THEN x * 100000 + y END) / 16.0::DOUBLE AS b, COUNT(DISTINCT CASE WHEN code = '311' THEN x * 100000 + y END) / 16.0::DOUBLE AS f
  FROM lat GROUP BY 1, 2)
SELECT c.cell_id, ROUND(COALESCE(a.b, 0), 9) AS built_share, ROUND(COALESCE(a.f, 0), 9) AS forest_share
FROM cell c LEFT JOIN a ON a.ix = c.ix AND a.iy = c.iy""", "cell lat")
def class_share(spark, sf):
    v = Views(spark, sf)
    out = SP.class_share(v.polygons(), v.cell(), GROUPS, 1000)
    return out.select("cell_id", F.round("built_share", 9).alias("built_share"), F.round("forest_share", 9).alias("forest_share"))


@query("g7_clip_to_context", f"""
WITH {CONTEXT_SQL},
s AS (SELECT DISTINCT CAST(FLOOR(x / 250) AS INT) AS gx, CAST(FLOOR(y / 250) AS INT) AS gy FROM lat WHERE code = '311'),
tot AS (SELECT ABS(SUM(xa * yb - xb * ya)) / 2 AS a FROM edg),
a AS (SELECT c.cell_id, SUM(w.w) AS area FROM cell c CROSS JOIN wts w JOIN s ON s.gx = c.ix * 4 + w.lx AND s.gy = c.iy * 4 + w.ly GROUP BY c.cell_id)
SELECT c.cell_id, ROUND(COALESCE(a.area, 0) / (SELECT a FROM tot), 6) AS forest_share FROM cell c LEFT JOIN a ON a.cell_id = c.cell_id""", "cell lat")
def clip_to_context(spark, sf):
    """Dissolved forest share of every cell's 2 km outward buffer."""
    v = Views(spark, sf)
    out = SP.class_share(v.polygons(), v.cell(), {"forest": ["311"]}, 1000, 2000)
    return out.select("cell_id", F.round("forest_share", 6).alias("forest_share"))


@query("g10_intersects_within", f"""
WITH {CONTEXT_SQL}, {TOUCH_SQL},
s AS (SELECT DISTINCT CAST(FLOOR(x / 250) AS INT) AS gx, CAST(FLOOR(y / 250) AS INT) AS gy, year FROM lat)
SELECT DISTINCT c.cell_id, s.year FROM cell c CROSS JOIN tch w JOIN s ON s.gx = c.ix * 4 + w.lx AND s.gy = c.iy * 4 + w.ly""", "cell lat")
def intersects_within(spark, sf):
    v = Views(spark, sf)
    return SP.intersects_within(v.polygons(), ["year"], v.cell(), 1000, 2000)


@query("j5_spatial_join", """SELECT a.poly_id, b.poly_id AS r_poly_id FROM rect a JOIN rect b ON a.poly_id < b.poly_id
  AND a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax AND a.year = b.year""", "rect")
def spatial_join(spark, sf):
    rect = Views(spark, sf).rect()
    pairs = SP.spatial_join(rect, rect, 2000, on=["year"])
    return pairs.where("poly_id < r_poly_id").select("poly_id", "r_poly_id")


@query("g5_point_in_polygon", """
WITH p AS (SELECT c_custkey, (c_custkey * 250) % 100000 AS x, (c_custkey * 750) % 20000 AS y FROM customer)
SELECT c_custkey, poly_id, (x > xmin AND x < xmax AND y > ymin AND y < ymax) AS contains
FROM p JOIN rect ON x >= xmin AND x <= xmax AND y >= ymin AND y <= ymax""", "rect")
def point_in_polygon(spark, sf):
    """Pairs under *covers*, with a flag for the stricter *contains*."""
    v = Views(spark, sf)
    key = F.col("c_custkey")
    points = v.table("customer").select("c_custkey", ((key * 250) % 100000).cast("double").alias("x"), ((key * 750) % 20000).cast("double").alias("y"))
    polys = v.polygons().select("poly_id", "rings")
    covers = SW.points_in_polygons(points, polys, ["c_custkey"], 2000, covers=True, edge="on_edge")
    return covers.select("c_custkey", "poly_id", (~F.col("on_edge")).alias("contains"))


@query("g12_rasterize", """
WITH g AS (SELECT CAST(x.range AS BIGINT) AS px, poly_id, ymin, ymax FROM rect JOIN range(0, 520) x ON x.range * 200 + 100 >= xmin AND x.range * 200 + 100 < xmax)
SELECT px, CAST(y.range AS BIGINT) AS py, MAX(poly_id) AS poly_id FROM g JOIN range(0, 120) y ON y.range * 200 + 100 >= ymin AND y.range * 200 + 100 < ymax
GROUP BY 1, 2""", "rect")
def rasterize(spark, sf):
    return RA.rasterize(Views(spark, sf).polygons(), 200, "poly_id", "poly_id")


TRIANGLE = ((3100.0, 700.0), (96300.0, 5200.0), (41000.0, 19300.0))
TRI_SQL = "tri AS (SELECT * FROM (VALUES " + ", ".join(
    f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(TRIANGLE, TRIANGLE[1:] + TRIANGLE[:1])
) + ") t(xa, ya, xb, yb))"


def _triangle(v):
    """A slanted boundary with one row; its presence depends on the layer having rows."""
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in (*TRIANGLE, TRIANGLE[0])])
    return v.rect().agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.array(ring).alias("rings"))


@query("g13_mask_mainland", f"""
WITH {TRI_SQL},
m AS (SELECT poly_id, {green_sql("(SELECT * FROM rect CROSS JOIN tri) z", "xmin", "ymin", "xmax", "ymax")} GROUP BY poly_id)
SELECT poly_id, ROUND(area, 2) AS area FROM m AS t(poly_id, area) WHERE area > 1e-6""", "rect")
def mask_mainland(spark, sf):
    """Area that each polygon keeps inside a slanted boundary."""
    v = Views(spark, sf)
    pieces = SP.mask_polygons(v.polygons(), _triangle(v), ["poly_id"], 1000)
    areas = pieces.groupBy("poly_id").agg(F.sum(GE.polygon_area(F.col("rings"))).alias("area"))
    return areas.where("area > 1e-6").select("poly_id", F.round("area", 2).alias("area"))


@query("g14_coverage_gap", f"""
WITH {TRI_SQL}, sq AS (SELECT DISTINCT x, y FROM lat),
both_ AS (SELECT SUM(a) AS a FROM (SELECT x, y, {green_sql("(SELECT * FROM sq CROSS JOIN tri) z", "x", "y", "x + 250", "y + 250")} GROUP BY x, y) t(x, y, a)),
b AS (SELECT ABS(SUM(xa * yb - xb * ya)) / 2 AS a FROM tri), l AS (SELECT COUNT(*) * 62500.0::DOUBLE AS a FROM sq)
SELECT ROUND(b.a, 1) AS boundary_area, ROUND(l.a, 1) AS layer_area, ROUND(both_.a, 1) AS covered_area,
  ROUND(1 - both_.a / b.a, 9) AS uncovered_share, ROUND(1 - both_.a / l.a, 9) AS outside_share FROM b, l, both_""", "lat")
def coverage_gap(spark, sf):
    v = Views(spark, sf)
    out = SP.coverage_gap(v.polygons(), _triangle(v), 1000)
    return out.select(
        *[F.round(c, 1).alias(c) for c in ("boundary_area", "layer_area", "covered_area")],
        *[F.round(c, 9).alias(c) for c in ("uncovered_share", "outside_share")],
    )


def _damaged(v):
    """The layer with crossed, open, repeated and collapsed rings, by order key."""
    r = v.rect()
    p = lambda x, y: GE.point(F.col(x), F.col(y))
    a, b, c, d = p("xmin", "ymin"), p("xmax", "ymin"), p("xmax", "ymax"), p("xmin", "ymax")
    kind = F.col("poly_id") % 10
    ring = (
        F.when(kind == 0, F.array(a, c, b, d, a)).when(kind == 1, F.array(a, b, c, d)).when(kind == 2, F.array(a, b, b, c, c, d, a))
        .when(kind == 3, F.array(a, b, a)).when(kind == 4, F.array(a, d, c, b, a)).otherwise(F.array(a, b, c, d, a))
    )
    return r.select("poly_id", "year", F.array(ring).alias("rings"))


DAMAGED_SQL = """d AS (SELECT poly_id, year, poly_id % 10 AS kind, CAST((xmax - xmin) * (ymax - ymin) AS DOUBLE) AS a FROM rect)"""


@query("g3_repair_polygons", f"""
WITH {DAMAGED_SQL}
SELECT poly_id, CASE WHEN kind = 0 THEN 'repaired' WHEN kind = 3 THEN 'rejected' ELSE 'accepted' END AS status, kind = 0 AS invalid,
  ROUND(CASE WHEN kind = 0 THEN a / 2 WHEN kind = 3 THEN 0 ELSE a END, 3) AS area_after,
  ROUND(CASE WHEN kind = 0 THEN a / 2 WHEN kind = 3 THEN 0 ELSE a END, 3) AS ring_area FROM d""", "rect")
def repair_polygons(spark, sf):
    """The rings that come back must measure what the repair says."""
    out = SP.repair_polygons(_damaged(Views(spark, sf)), ["poly_id"])
    measured = F.coalesce(F.sum(GE.polygon_area(F.col("rings"))), F.lit(0.0))
    whole = out.groupBy("poly_id", "status", "invalid", "area_after").agg(measured.alias("ring_area"))
    return whole.select("poly_id", "status", "invalid", F.round("area_after", 3).alias("area_after"), F.round("ring_area", 3).alias("ring_area"))


@query("a31_repair_log", f"""
WITH {DAMAGED_SQL}
SELECT year, COUNT(*) AS input_count, COUNT(*) FILTER (WHERE kind = 0) AS invalid_count, COUNT(*) FILTER (WHERE kind = 0) AS repaired_count,
  COUNT(*) FILTER (WHERE kind = 3) AS rejected_count,
  ROUND(SUM(CASE WHEN kind IN (0, 3) THEN 0 ELSE a END), 1) AS input_area, ROUND(SUM(CASE WHEN kind = 0 THEN a / 2 WHEN kind = 3 THEN 0 ELSE a END), 1) AS accepted_area,
  COUNT(*) FILTER (WHERE kind = 0) AS change_over_0_1, COUNT(*) FILTER (WHERE kind = 0) AS change_over_1, COUNT(*) FILTER (WHERE kind = 0) AS change_over_5
FROM d GROUP BY year""", "rect")
def repair_log(spark, sf):
    log = SP.repair_log(SP.repair_polygons(_damaged(Views(spark, sf)), ["poly_id"]), ["year"])
    return log.withColumns({c: F.round(c, 1) for c in ("input_area", "accepted_area")})


@query("a32_layer_audit", """
SELECT code, COUNT(*) AS features, CAST(0 AS BIGINT) AS empty, MIN(xmin) AS xmin, MIN(ymin) AS ymin, MAX(xmax) AS xmax, MAX(ymax) AS ymax,
  array_to_string(list_sort(list(DISTINCT year)), ',') AS years,
  '1993,1994' AS missing_years
FROM rect GROUP BY code""", "rect")
def layer_audit(spark, sf):
    rect = Views(spark, sf).rect()
    last = rect.agg(F.max("year")).first()[0]
    out = RG.layer_audit(rect, "code", "year", 1993, last)
    text = {c: F.array_join(F.transform(c, lambda y: y.cast("string")), ",") for c in ("years", "missing_years")}
    return out.withColumns(text)


@query("a33_layer_validation", """
SELECT year, COUNT(*) AS features, CAST(0 AS BIGINT) AS null_geometry, CAST(0 AS BIGINT) AS invalid,
  CASE WHEN COUNT(*) FILTER (WHERE code = '211') > 0 THEN '211' ELSE '' END AS unexpected,
  CONCAT(CASE WHEN COUNT(*) FILTER (WHERE code = '112') = 0 THEN '112,' ELSE '' END, '999') AS absent, false AS ready FROM rect GROUP BY year""", "rect")
def layer_validation(spark, sf):
    return RG.layer_validation(Views(spark, sf).rect(), "year", "code", ["112", "311", "999"])


@query("a34_burn_layer_validation", """
SELECT year, COUNT(*) AS features, COUNT(*) + CASE WHEN year = 1996 THEN 1 ELSE 0 END AS expected_features, year <> 1996 AS matches FROM rect GROUP BY year
UNION ALL SELECT 1900, NULL, 7, false""", "rect")
def burn_layer_validation(spark, sf):
    """Layer counts beside registered ones: one year has another count, one registered year has no layer."""
    v = Views(spark, sf)
    seen = RG.layer_validation(v.rect(), "year", "code", ["112", "211", "311"])
    counted = v.table("orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("features"))
    facts = counted.withColumn("features", F.col("features") + F.when(F.col("year") == 1996, 1).otherwise(0))
    facts = facts.unionByName(counted.limit(1).select(F.lit(1900).alias("year"), F.lit(7).cast("bigint").alias("features")))
    return RG.against_facts(seen, facts, "year", ["features"])


@query("j18_area_coverage", """
WITH s AS (SELECT c.*, CAST(FLOOR(ix / 20) AS INT) AS region_id FROM cell c)
SELECT region_id, COUNT(*) AS eligible, COUNT(*) FILTER (WHERE k % 3 = 0) AS scored, COUNT(*) FILTER (WHERE k % 3 = 1) AS insufficient,
  COUNT(*) FILTER (WHERE k % 3 = 2) AS excluded FROM s GROUP BY region_id""", "cell")
def area_coverage(spark, sf):
    v = Views(spark, sf)
    status = F.when(F.col("k") % 3 == 0, "scored").when(F.col("k") % 3 == 1, "insufficient").otherwise("excluded")
    cells = v.cell().select("cell_id", (F.col("x0") + 500.0).alias("x"), (F.col("y0") + 500.0).alias("y"), status.alias("status"))
    top = v.cell().agg(F.max("y0")).first()[0] + 1000
    stripes = v.table("region").select(
        F.col("r_regionkey").alias("region_id"), (F.col("r_regionkey") * 20000).alias("xa"), F.lit(0).alias("ya"),
        ((F.col("r_regionkey") + 1) * 20000).alias("xb"), F.lit(top).alias("yb"),
    )
    regions = stripes.select("region_id", F.array(GE.rect_ring("xa", "ya", "xb", "yb")).alias("rings"))
    return SC.area_coverage(cells, regions, "status", 20000)
