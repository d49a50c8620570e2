"""Scans that push columns, years and boxes to the files, and layer readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpanel.operators.spatial import RINGS_TYPE, with_bbox


def read_columns(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*cols)


def read_years(spark: SparkSession, path: str, years: Sequence[int], year: str = "observation_year") -> DataFrame:
    """Only the partitions (or row groups) of the wanted years."""
    return spark.read.parquet(path).where(F.col(year).isin([int(y) for y in years]))


def read_filtered(spark: SparkSession, path: str, predicate: Column, cols: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).where(predicate).select(*cols)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def access_audit(spark: SparkSession, path: str, allowed: Sequence[int], year: str = "observation_year") -> DataFrame:
    """Rows per partition file and year with ``read``; shows that other years stay untouched.

    ``read`` comes from the files the pruned scan really opens, not from the request.
    """
    every = spark.read.parquet(path).groupBy(year, F.col("_metadata.file_path").alias("partition")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    opened = read_years(spark, path, allowed, year).select(F.col("_metadata.file_path").alias("partition")).distinct()
    audit = every.join(opened.withColumn("_o", F.lit(True)), "partition", "left").withColumn("read", F.coalesce("_o", F.lit(False)))
    legal = ~F.col("read") | F.col(year).isin([int(y) for y in allowed])
    checked = F.when(legal, F.col("read")).otherwise(F.raise_error(F.lit("a forbidden year shares an opened file")))
    return audit.select("partition", year, "rows", checked.alias("read"))


GEOJSON_SCHEMA = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"


def polygons_from_features(features: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """GeoJSON ``Feature`` rows to polygon rows ``(attributes…, part, rings, box)``.

    Multi-polygons give one row per part. ``coordinates`` is kept as JSON text until the
    geometry type says how deep it is nested.
    """
    deep = "array<array<array<array<double>>>>"
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    nested = F.when(kind == "Polygon", F.from_json(F.concat(F.lit("["), text, F.lit("]")), deep)).when(
        kind == "MultiPolygon", F.from_json(text, deep)
    )
    parts = features.select(
        *[F.col("properties")[a].alias(a) for a in attributes], F.posexplode(nested).alias("part", "_rings")
    )
    ring = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    rings = F.transform("_rings", ring).cast(RINGS_TYPE)
    return with_bbox(parts.withColumn("rings", rings).drop("_rings"))


def read_polygons(spark: SparkSession, path: str, attributes: Sequence[str]) -> DataFrame:
    """Polygon table from newline-delimited GeoJSON features."""
    return polygons_from_features(spark.read.schema(GEOJSON_SCHEMA).json(path), attributes)


def split_archive_by_year(layer: DataFrame, column: str, year: int | None = None) -> DataFrame:
    """Multi-year layer kept long with an integer ``year``, or one year of it; a year that is none is an error."""
    parsed = F.col(column).try_cast("int")
    said = F.concat(F.lit("no year: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))
    long = layer.withColumn("year", F.when(parsed.isNull(), F.raise_error(said)).otherwise(parsed))
    return long if year is None else long.where(F.col("year") == year)


def boundary_select(regions: DataFrame, level: str, wanted: str, unit: str) -> tuple[DataFrame, DataFrame]:
    """The one boundary row of the wanted area, and the regions with each unit once.

    No or several boundary rows, and a unit without name or with several rows, are errors.
    """
    boundary = regions.where(F.col(level) == wanted)
    if boundary.limit(2).count() != 1:
        raise ValueError(f"not exactly one boundary row has {level} = {wanted}")
    repeated = regions.groupBy(unit).agg(F.count(F.lit(1)).alias("rows")).where((F.col("rows") > 1) | F.col(unit).isNull()).head(5)
    if repeated:
        raise ValueError(f"units without name or with several rows: {[r[unit] for r in repeated]}")
    return boundary, regions
