"""Queries on facts of source layers against registered ones; each has sound layers and broken ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpanel.catalog.registry import query
from gridpanel.catalog.views import Views
from gridpanel.operators import facts as FA

LAYER_FACTS = ["features", "null_geometry", "empty_geometry", "invalid_geometry", "xmin", "ymin", "xmax", "ymax", "types", "years", "crs", "fields"]


def values(names) -> str:
    return "(VALUES " + ", ".join(f"('{n}')" for n in names) + ") f(fact)"


@query("a32_layer_facts", """
WITH l AS (SELECT code AS layer, COUNT(*) AS features, MIN(xmin) AS xmin, MAX(ymax) AS ymax, array_to_string(list_sort(list(DISTINCT CAST(year AS VARCHAR))), ',') AS years FROM rect GROUP BY code)
SELECT layer, 'features' AS fact, features::DOUBLE AS number, NULL::VARCHAR AS text FROM l UNION ALL SELECT layer, 'null_geometry', 0, NULL FROM l
UNION ALL SELECT layer, 'empty_geometry', 0, NULL FROM l UNION ALL SELECT layer, 'invalid_geometry', 0, NULL FROM l
UNION ALL SELECT layer, 'xmin', xmin::DOUBLE, NULL FROM l UNION ALL SELECT layer, 'ymax', ymax::DOUBLE, NULL FROM l
UNION ALL SELECT layer, 'types', NULL, 'Polygon' FROM l UNION ALL SELECT layer, 'years', NULL, years FROM l UNION ALL SELECT layer, 'crs', NULL, 'EPSG:3763' FROM l
UNION ALL SELECT layer, 'fields', NULL, 'poly_id,year,code' FROM l""", "rect")
def layer_facts(spark, sf):
    facts = FA.vector_facts(Views(spark, sf).polygons(), "code", year="year", crs="EPSG:3763")
    return facts.where(~F.col("fact").isin("ymin", "xmax"))


@query("a33_layer_facts_gate", f"""
SELECT code AS layer, fact, CASE WHEN code = '311' AND fact IN ('types', 'crs', 'features') OR code = '112' AND fact = 'fields' THEN 'differs' ELSE 'agrees' END AS state
FROM (SELECT DISTINCT code FROM rect) CROSS JOIN {values(LAYER_FACTS)} UNION ALL SELECT '999', 'features', 'no layer' UNION ALL SELECT '211', 'release', 'absent'""", "rect")
def layer_facts_gate(spark, sf):
    """Land-cover layers: one of another type, reference system and count, one with other fields, one missing."""
    v = Views(spark, sf)
    r = v.rect()
    told = r.groupBy("code").agg(
        F.count(F.lit(1)).alias("features"), *[F.min(c).cast("double").alias(c) for c in ("xmin", "ymin")], *[F.max(c).cast("double").alias(c) for c in ("xmax", "ymax")],
        F.array_join(F.array_sort(F.collect_set(F.col("year").cast("string"))), ",").alias("years"))
    odd, bare = F.col("code") == "311", F.col("code") == "112"
    zero = F.lit(0.0)
    told = told.withColumns({
        "features": (F.col("features") + F.when(odd, 1).otherwise(0)).cast("double"), "null_geometry": zero, "empty_geometry": zero, "invalid_geometry": zero,
        "types": F.when(odd, "MultiPolygon").otherwise("Polygon"), "crs": F.when(odd, "EPSG:3035").otherwise("EPSG:3763"),
        "fields": F.when(bare, "poly_id,year").otherwise("poly_id,year,code"), "release": F.when(F.col("code") == "211", "v2020"),
    })
    gone = told.limit(1).select(F.lit("999").alias("layer"), F.lit("features").alias("fact"), F.lit(1.0).alias("number"), F.lit(None).cast("string").alias("text"))
    expected = FA.registered(told, "code", [*LAYER_FACTS, "release"]).unionByName(gone)
    seen = FA.vector_facts(v.polygons(), "code", year="year", crs="EPSG:3763")
    return FA.facts_gate(seen, expected).select("layer", "fact", "state")


@query("a34_burn_facts_gate", """
SELECT CAST(year AS VARCHAR) AS layer, CAST(5 AS BIGINT) AS facts, CAST(CASE year WHEN 1996 THEN 3 WHEN 1998 THEN 4 ELSE 5 END AS BIGINT) AS agree, year NOT IN (1996, 1998) AS ready FROM (SELECT DISTINCT year FROM rect)""", "rect")
def burn_facts_gate(spark, sf):
    """Annual burned layers: required fields, year value, count and invalid count; two years broken on purpose."""
    v = Views(spark, sf)
    # a bow tie crosses itself and has no net area; one year holds an extra one
    burns = v.polygons().select("poly_id", "year", F.col("year").alias("Ano"), "rings")
    bow = F.array(F.array(*[F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y")) for x, y in ((0, 0), (4, 4), (4, 0), (0, 4), (0, 0))]))
    extra = burns.where("year = 1996").limit(1).select("poly_id", "year", F.lit(1997).alias("Ano"), bow.alias("rings"))
    layer = burns.unionByName(extra)
    seen = FA.vector_facts(layer, "year", year="Ano", crs="EPSG:3763")
    counted = layer.groupBy("year").agg(F.count(F.lit(1)).cast("double").alias("features")).withColumns({
        "invalid_geometry": F.lit(0.0), "years": F.col("year").cast("string"), "fields": F.lit("poly_id,year,Ano"),
        "null_geometry": F.when(F.col("year") == 1998, 2.0).otherwise(0.0),
    })
    return FA.gate_summary(FA.facts_gate(seen, FA.registered(counted, "year", ["features", "invalid_geometry", "null_geometry", "years", "fields"])))


@query("a35_climate_facts_gate", """
WITH y AS (SELECT year, COUNT(*) AS rows, COUNT(*) FILTER (t2m_k IS NULL) AS m FROM clim GROUP BY year),
f AS (SELECT * FROM (VALUES ('lat_count'), ('lon_count'), ('lat_first'), ('lat_last'), ('lon_first'), ('lon_last'), ('lat_step_min'), ('lat_step_max'), ('lon_step_min'), ('lon_step_max'),
  ('rows'), ('missing_t2m_k'), ('months'), ('variables'), ('unit_t2m_k'), ('unit_tp_m'), ('type_t2m_k')) t(fact))
SELECT CAST(year AS VARCHAR) AS layer, fact, CASE WHEN year = 1996 AND fact IN ('lat_first', 'unit_tp_m') OR year = 1999 AND fact IN ('months', 'missing_t2m_k') THEN 'differs' ELSE 'agrees' END AS state
FROM y CROSS JOIN f""", "clim")
def climate_facts_gate(spark, sf):
    """Yearly grids: months, shape, extent within 1e-9, step, missing cells, units and types; two years broken on purpose."""
    v = Views(spark, sf)
    long = v.clim().withColumns({"lat": 40.0 - F.col("lat_idx") * 0.1, "lon": -9.0 + F.col("lon_idx") * 0.1})
    seen = FA.climate_facts(long, "year", "lat", "lon", "month", {"t2m_k": "K", "tp_m": "m"})
    ends = [F.min("lat").alias("lat_first"), F.max("lat").alias("lat_last"), F.min("lon").alias("lon_first"), F.max("lon").alias("lon_last")]
    told = long.groupBy("year").agg(F.count(F.lit(1)).cast("double").alias("rows"), F.count_if(F.col("t2m_k").isNull()).cast("double").alias("missing_t2m_k"),
        F.countDistinct("lat_idx").cast("double").alias("lat_count"), F.countDistinct("lon_idx").cast("double").alias("lon_count"), *ends)
    odd, late, even = F.col("year") == 1996, F.col("year") == 1999, F.col("year") == 1997
    told = told.withColumns({
        # a hair below the tolerance agrees, one above does not
        "lat_first": F.col("lat_first") + F.when(odd, 1e-6).when(even, 1e-12).otherwise(0.0),
        "missing_t2m_k": F.col("missing_t2m_k") + F.when(late, 1.0).otherwise(0.0), "months": F.when(late, "06,07,08").otherwise("06,07,08,09"),
        "unit_tp_m": F.when(odd, "mm").otherwise("m"), "unit_t2m_k": F.lit("K"), "variables": F.lit("t2m_k,tp_m"), "type_t2m_k": F.lit("double"),
        **{f"{a}_step_{e}": F.lit(0.1) for a in ("lat", "lon") for e in ("min", "max")},
    })
    expected = FA.registered(told, "year", [c for c in told.columns if c != "year"])
    # a step is a difference of decimal fractions
    return FA.facts_gate(seen, expected).select("layer", "fact", "state")


@query("a41_raster_facts_gate", """
WITH t AS (SELECT CAST(l_suppkey % 7 AS VARCHAR) AS layer, COUNT(*) FILTER (l_quantity < 10) AS gone FROM lineitem GROUP BY 1),
f AS (SELECT * FROM (VALUES ('height'), ('width'), ('pixels'), ('nodata_pixels'), ('crs'), ('dtype'), ('resolution'), ('nodata')) f(fact))
SELECT layer, fact, CASE WHEN layer = '3' AND fact IN ('crs', 'dtype') OR layer = '5' AND fact IN ('nodata', 'height', 'resolution') THEN 'differs' ELSE 'agrees' END AS state FROM t CROSS JOIN f
UNION ALL SELECT '77', 'crs', 'no layer'""")
def raster_facts_gate(spark, sf):
    """Raster tiles: size, no-data count and code, type, resolution and reference system; two tiles broken on purpose."""
    item = Views(spark, sf).table("lineitem")
    pixels = item.select(
        (F.col("l_suppkey") % 7).alias("tile"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"),
        F.when(F.col("l_quantity") < 10, -9999.0).otherwise(F.col("l_extendedprice")).alias("value"))
    seen = FA.raster_facts(pixels, "tile", crs="EPSG:3763", resolution=25, nodata=-9999)
    told = item.groupBy((F.col("l_suppkey") % 7).alias("tile")).agg(
        (F.max("l_orderkey") - F.min("l_orderkey") + 1).cast("double").alias("height"), (F.max("l_linenumber") - F.min("l_linenumber") + 1).cast("double").alias("width"),
        F.count(F.lit(1)).cast("double").alias("pixels"), F.count_if(F.col("l_quantity") < 10).cast("double").alias("nodata_pixels"))
    a, b = F.col("tile") == 3, F.col("tile") == 5
    told = told.withColumns({
        "height": F.col("height") + F.when(b, 2.0).otherwise(0.0), "crs": F.when(a, "EPSG:4326").otherwise("EPSG:3763"), "dtype": F.when(a, "float").otherwise("double"),
        "resolution": F.when(b, "30").otherwise("25"), "nodata": F.when(b, "none").otherwise("-9999"),
    })
    gone = told.limit(1).select(F.lit("77").alias("layer"), F.lit("crs").alias("fact"), F.lit(None).cast("double").alias("number"), F.lit("EPSG:3763").alias("text"))
    expected = FA.registered(told, "tile", [c for c in told.columns if c != "tile"]).unionByName(gone)
    return FA.facts_gate(seen, expected).select("layer", "fact", "state")
