"""Publishing: panel layout, publish-once with manifest, geometry and report outputs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpanel.functions.geometry import to_wkt
from gridpanel.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, so it is on the shared file system."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names of the direct children of a folder, without hidden files."""
    fs, p, _ = _fs(spark, folder)
    names = [entry.getPath().getName() for entry in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in names if not n.startswith((".", "_")))


def _move(spark: SparkSession, source: str, target: str) -> None:
    fs, src, jvm = _fs(spark, source)
    if not fs.rename(src, jvm.org.apache.hadoop.fs.Path(target)):
        raise RuntimeError(f"could not move {source} to {target}")


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p, _ = _fs(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def content_hash(df: DataFrame) -> DataFrame:
    """Row count and an order-free checksum of the content; one distributed aggregate."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.select(h.alias("h")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("hash_sum"),
        F.bit_xor("h").alias("hash_xor"),
    )


def write_panel(df: DataFrame, path: str, year: str = "observation_year", cell: str = "cell_id") -> None:
    """Year-major, cell-ordered, zstd panel.

    Rows are range-partitioned by year and cell, so a large year is written by many
    tasks, and every file holds one ordered range of one year.
    """
    ranged = df.repartitionByRange(F.col(year), F.col(cell)).sortWithinPartitions(year, cell)
    ranged.write.mode("error").option("compression", "zstd").partitionBy(year).parquet(path)


def fits_existing(spark: SparkSession, path: str, required: Sequence[str]) -> bool:
    """An existing output that lacks a required column is rebuilt, not reused."""
    if not exists(spark, path):
        return False
    return set(required) <= set(spark.read.parquet(path).columns)


def publish(
    df: DataFrame, path: str, component: str, lineage: Mapping | None = None, *, replace: bool = False,
    partition_by: Sequence[str] = (),
) -> dict:
    """Publish once: stage, read back, check, then move into place with a manifest.

    An identical existing artefact is reused, a different one needs ``replace``, and a
    data folder without its manifest (or the reverse) is refused.
    """
    spark = df.sparkSession
    manifest_path = f"{path}.manifest.json"
    have = exists(spark, path), exists(spark, manifest_path)
    if any(have) and not all(have):
        raise FileExistsError(f"half-written artefact needs inspection: {path}")
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    df.write.mode("error").option("compression", "zstd").partitionBy(*partition_by).parquet(staging)
    stored = spark.read.schema(df.schema).parquet(staging).select(*df.columns)
    facts = content_hash(stored).first().asDict()
    manifest = {"component": component, "columns": df.columns, "lineage": dict(lineage or {}), **facts}
    fs, staged, jvm = _fs(spark, staging)
    if all(have):
        old = json.loads(_read_text(spark, manifest_path))
        same = all(old.get(k) == manifest[k] for k in ("columns", "rows", "hash_sum", "hash_xor"))
        if same:
            fs.delete(staged, True)
            return {**old, "status": "reused"}
        if not replace:
            fs.delete(staged, True)
            raise FileExistsError(f"a different artefact is already published: {path}")
        fs.delete(jvm.org.apache.hadoop.fs.Path(manifest_path), False)
        fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)
    _move(spark, staging, path)
    _write_text(spark, manifest_path, json.dumps(manifest, sort_keys=True))
    return {**manifest, "status": "created"}


def verify_published(spark: SparkSession, path: str) -> DataFrame:
    """Violations between a published folder and its manifest."""
    manifest = json.loads(_read_text(spark, f"{path}.manifest.json"))
    stored = content_hash(spark.read.parquet(path).select(*manifest["columns"]))
    expected = F.struct(
        F.lit(manifest["rows"]).cast("bigint").alias("rows"), F.lit(manifest["hash_sum"]).alias("hash_sum"),
        F.lit(manifest["hash_xor"]).cast("bigint").alias("hash_xor"),
    )
    broken = stored.where(F.struct("rows", "hash_sum", "hash_xor") != expected)
    return broken.select(F.lit("manifest").alias("gate"), F.lit(path).alias("key"), F.col("hash_sum").alias("detail"))


def write_if_changed(df: DataFrame, path: str, component: str) -> bool:
    """Rewrite only when the content differs; true when something was written."""
    spark = df.sparkSession
    if exists(spark, f"{path}.manifest.json"):
        old = json.loads(_read_text(spark, f"{path}.manifest.json"))
        new = content_hash(df).first().asDict()
        if old["columns"] == df.columns and all(old[k] == new[k] for k in new):
            return False
    publish(df, path, component, replace=True)
    return True


def with_geometry(table: DataFrame, cells: DataFrame, size: float, key: str = "cell_id", fields: Sequence[str] = ()) -> DataFrame:
    """Attributes with the ``fields`` and the square of each cell as ring and WKT; every row must find its cell."""
    x0, y0 = F.col("x0").cast("double"), F.col("y0").cast("double")
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(p(x0, y0), p(x0 + size, y0), p(x0 + size, y0 + size), p(x0, y0 + size), p(x0, y0))
    shapes = cells.select(key, *fields, F.array(ring).alias("rings"))
    joined = table.join(shapes, key, "left")
    placed = F.when(F.col("rings").isNotNull(), True).otherwise(F.raise_error(F.lit("row has no cell geometry")))
    return joined.where(placed).withColumn("wkt", to_wkt(F.col("rings")))


def geojson_features(df: DataFrame, fields: Sequence[str], digits: int = 6) -> DataFrame:
    """One compact GeoJSON ``Feature`` per row, public fields only; ``rings`` in degrees."""
    coordinates = F.transform(
        "rings", lambda r: F.transform(r, lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits)))
    )
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        F.struct(*[F.col(f) for f in fields]).alias("properties"),
    )
    return df.select(F.to_json(feature).alias("value"))


def write_geojson(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """Newline-delimited features, written by every task."""
    geojson_features(df, fields).write.mode("error").text(path)


def metadata_row(scores: DataFrame, version: str, extra: Mapping[str, str] | None = None) -> DataFrame:
    """One provenance row: version, years, counts, model id and content hash."""
    facts = scores.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("forecast_year").alias("forecast_year"), F.max("prediction_input_year").alias("input_year"),
        F.min("model_id").alias("model_id"), F.count_distinct("model_id").alias("model_ids"),
        F.min("estimate").alias("min_estimate"), F.max("estimate").alias("max_estimate"),
    )
    digest = content_hash(scores).select("hash_xor").scalar()
    columns = {"version": F.lit(version), "content_hash": digest}
    columns |= {k: F.lit(v) for k, v in (extra or {}).items()}
    return facts.withColumns(columns)


def write_report_tables(tables: Mapping[str, DataFrame], path: str, max_rows: int = 100_000) -> None:
    """Aggregated summaries as one headed CSV each; a table above ``max_rows`` is no summary and an error."""
    for name, df in tables.items():
        if df.limit(max_rows + 1).count() > max_rows:
            raise ValueError(f"{name} has more than {max_rows} rows; publish it as a table instead")
        df.coalesce(1).write.mode("error").option("header", True).csv(f"{path}/{name}")


def year_snapshot(panel: DataFrame, cells: DataFrame, affected: DataFrame, year: int, size: float, key: str = "cell_id") -> DataFrame:
    """One year of the panel with the assignment flag and cell geometry.

    ``key`` tells cells apart in ``cells`` and ``affected``; a row gets flag and square of every cell of its ``cell_id``.
    """
    one = panel.where(F.col("observation_year") == year)
    flagged = cells.join(affected.select(key).distinct().withColumn("_f", F.lit(True)), key, "left")
    flag = F.when(F.col("_f"), "nearest_valid_source").otherwise("containing_source")
    return with_geometry(one, flagged.withColumn("assignment_method", flag).drop("_f"), size, fields=["assignment_method"])


PUBLIC_FIELDS = ("cell_id", "forecast_year", "estimate", "rank_pct", "band_code", "band_label")


def public_fields(scores: DataFrame) -> DataFrame:
    """Validated scores reduced to the allow-listed fields and bands."""
    from gridpanel.functions.scalars import band3

    legal = F.col("estimate").between(0.0, 1.0) & (F.col("rank_pct") > 0) & (F.col("rank_pct") <= 1)
    checked = scores.where(F.when(legal, True).otherwise(F.raise_error(F.lit("score outside its range"))))
    band = band3(F.col("rank_pct"))
    return checked.withColumns({"band_code": band["code"], "band_label": band["label"]}).select(*PUBLIC_FIELDS)
