"""Queries on scans, inventories and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpanel.catalog.registry import query
from gridpanel.catalog.views import Views
from gridpanel.sinks.publish import scratch_path, write_panel
from gridpanel.sources import registry as RG
from gridpanel.sources import tables as TB


@query("s1_read_columns", "SELECT l_partkey, l_quantity FROM lineitem")
def read_columns(spark, sf):
    return TB.read_columns(spark, f"{sf}/lineitem.parquet", ["l_partkey", "l_quantity"])


@query("s2_read_years", "SELECT cell_id, observation_year, target FROM pred WHERE observation_year IN (1996, 1999)", "pred")
def read_years(spark, sf):
    """Two years of a year-partitioned panel; the scan opens their partitions only."""
    path = scratch_path(spark, "panel")
    write_panel(Views(spark, sf).pred(), path)
    return TB.read_years(spark, path, [1996, 1999]).select("cell_id", "observation_year", "target")


@query("s3_access_audit", """
SELECT observation_year, COUNT(*) AS rows, observation_year <= 1998 AS read FROM pred GROUP BY observation_year""", "pred")
def access_audit(spark, sf):
    v = Views(spark, sf)
    path = scratch_path(spark, "panel")
    write_panel(v.pred(), path)
    audit = TB.access_audit(spark, path, [y for y in v.labelled_years() if y <= 1998])
    return audit.groupBy("observation_year").agg(F.sum("rows").alias("rows"), F.bool_or("read").alias("read"))


@query("s4_read_filtered", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 150000 AND o_orderstatus = 'F'")
def read_filtered(spark, sf):
    predicate = (F.col("o_totalprice") >= 150000) & (F.col("o_orderstatus") == "F")
    return TB.read_filtered(spark, f"{sf}/orders.parquet", predicate, ["o_orderkey", "o_totalprice"])


@query("s11_read_tables", "SELECT o_orderpriority AS band, COUNT(*) AS n FROM orders GROUP BY 1")
def read_tables(spark, sf):
    """A summary written as CSV and JSON and read back from both."""
    from gridpanel.sinks.publish import write_report_tables

    summary = Views(spark, sf).table("orders").groupBy(F.col("o_orderpriority").alias("band")).agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "report")
    write_report_tables({"bands": summary}, path)
    summary.coalesce(1).write.json(f"{path}/json")
    csv = TB.read_csv(spark, f"{path}/bands", "band string, n bigint")
    return csv.intersect(TB.read_json(spark, f"{path}/json", "band string, n bigint").select("band", "n"))


@query("s12_file_inventory", """
SELECT n || '.parquet' AS name, true AS sized, true AS hashed, 14 AS checksums FROM (VALUES ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('orders'), ('lineitem'), ('events'), ('documents'), ('embeddings'), ('pages'), ('benchmark'), ('labels'), ('conversations')) t(n)""")
def file_inventory(spark, sf):
    """Size and checksum of every table file; no two tables share a checksum."""
    have = RG.file_inventory(spark, f"{sf}/*.parquet")
    different = have.agg(F.countDistinct("sha256").cast("int")).scalar()
    return have.select("name", (F.col("length") > 0).alias("sized"), F.col("sha256").rlike("^[0-9A-F]{64}$").alias("hashed"), different.alias("checksums"))


@query("s13_verify_inventory", """
SELECT 'fact' AS kind, CAST(2 AS BIGINT) AS expected, CAST(2 AS BIGINT) AS ready, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS changed, true AS complete
UNION ALL SELECT 'dimension', 3, 1, 1, 1, false""")
def verify_inventory(spark, sf):
    """Expected files against present ones: one is missing and one has another checksum."""
    have = RG.file_inventory(spark, f"{sf}/*.parquet")
    fact = have.where(F.col("name").isin("lineitem.parquet", "orders.parquet")).select("name", "sha256", F.lit("fact").alias("kind"))
    part = have.where(F.col("name") == "part.parquet").select("name", "sha256", F.lit("dimension").alias("kind"))
    other = part.select(F.lit("supplier.parquet").alias("name"), "sha256", "kind")
    gone = part.select(F.lit("absent.parquet").alias("name"), "sha256", "kind")
    expected = fact.unionByName(part).unionByName(other).unionByName(gone)
    return RG.inventory_summary(RG.verify_inventory(expected, have))


@query("s15_expected_sources", """
SELECT CAST(year AS INT) AS year, COUNT(*) AS feature_count, CAST(3 AS INT) AS codes FROM rect GROUP BY year""", "rect")
def expected_sources(spark, sf):
    """Registry rows written as JSON with nested facts and read back."""
    facts = Views(spark, sf).rect().groupBy("year").agg(
        F.count(F.lit(1)).alias("feature_count"), F.array_sort(F.collect_set("code")).alias("codes")
    )
    rows = facts.select(
        F.format_string("layer_%d", "year").alias("path"), F.lit("burn").alias("kind"), "year", F.sha2(F.col("year").cast("string"), 256).alias("sha256"),
        F.struct("feature_count", "codes").alias("facts"),
    )
    path = scratch_path(spark, "registry")
    rows.write.json(path)
    read = RG.expected_sources(spark, path)
    return read.select("year", F.col("facts.feature_count").alias("feature_count"), F.size("facts.codes").alias("codes"))


@query("q9_forecast_preflight", """
WITH need AS (SELECT 'burn' AS kind, y AS year FROM (SELECT UNNEST(range((SELECT MAX(year) FROM yrs) - 9, (SELECT MAX(year) FROM yrs) + 1)) AS y) a
  UNION ALL SELECT 'climate', (SELECT MAX(year) FROM yrs))
SELECT kind, CAST(need.year AS INT) AS year, 'no registry record' AS reason FROM need
WHERE kind = 'burn' AND need.year NOT IN (SELECT year FROM burn)""", "yrs burn")
def forecast_preflight(spark, sf):
    """Requirement rows derived from the forecast year against the years the layers really hold."""
    from gridpanel.functions.years import forecast_years

    v = Views(spark, sf)
    last = v.table("lineitem").agg((F.year(F.max("l_shipdate")) + 1).alias("y"))
    years = forecast_years(last, "y")
    burns = years.select(F.lit("burn").alias("kind"), F.explode(F.sequence(F.col("history_start_year") + 1, F.col("latest_outcome_year"))).alias("year"))
    climate = years.select(F.lit("climate").alias("kind"), F.col("predictor_year").alias("year"))
    present = v.burn().select(F.lit("burn").alias("kind"), "year").distinct().unionByName(
        v.clim().select(F.lit("climate").alias("kind"), "year").distinct()
    ).withColumn("present", F.lit(True))
    return RG.forecast_preflight(burns.unionByName(climate), present)
