"""Registered sources and the files that must match them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXPECTED_SOURCE = (
    "path string, kind string, year int, sha256 string, length bigint, crs string, units string, "
    "facts struct<feature_count:bigint,invalid_count:bigint,rows:bigint,width:bigint,height:bigint,"
    "codes:array<string>,months:array<int>,null_count:bigint>"
)


def expected_sources(spark: SparkSession, path: str) -> DataFrame:
    """Registry rows from JSON; a row without path, kind or checksum is an error."""
    raw = spark.read.schema(EXPECTED_SOURCE).option("mode", "FAILFAST").json(path)
    return checked_registry(raw)


def checked_registry(raw: DataFrame) -> DataFrame:
    whole = F.col("path").isNotNull() & F.col("kind").isNotNull() & F.col("sha256").isNotNull()
    return raw.where(F.when(whole, True).otherwise(F.raise_error(F.lit("registry row lacks path, kind or checksum"))))


def file_inventory(spark: SparkSession, glob: str) -> DataFrame:
    """Path, size and upper-case sha256 of every file or folder that ``glob`` names; bytes are streamed inside tasks, whatever a file's size.

    A folder, as Spark writes tables, is one entry: the sum of its files' sizes and the sha256 of its files' relative paths
    and checksums in order. ``pyarrow`` opens a file by its address, so the store must be one that it knows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob).select("path", "length")

    def hash_chunks(batches):
        import hashlib

        from pyarrow import fs

        for batch in batches:
            digests = []
            for path in batch["path"]:
                digest = hashlib.sha256()
                address = "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
                store, name = fs.FileSystem.from_uri(address)
                with store.open_input_stream(name) as handle:
                    while chunk := handle.read(1 << 24):
                        digest.update(chunk)
                digests.append(digest.hexdigest().upper())
            batch["sha256"] = digests
            yield batch

    hashed = files.repartition("path").mapInPandas(hash_chunks, "path string, length bigint, sha256 string")
    # the entry's own name stands as deep in the path as the last part of the pattern, whatever scheme or host precedes it
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    depth = len([part for part in re.sub(scheme, "", glob).split("/") if part not in ("", ".")])
    if not re.match(scheme + "/|^/", glob):
        raise ValueError(f"inventory needs an absolute path: {glob}")
    bare = F.regexp_replace("path", scheme, "")
    parts = F.filter(F.split(bare, "/"), lambda part: part != "")
    placed = hashed.select(
        "path", "length", "sha256", F.element_at(parts, depth).alias("name"), F.array_join(F.slice(parts, depth + 1, F.size(parts)), "/").alias("_inner"),
        F.array_join(F.slice(parts, 1, depth), "/").alias("_entry"),
    )
    # one row per file of a folder, its path and checksum only
    listed = F.array_sort(F.collect_list(F.struct("_inner", "sha256")))
    lines = F.array_join(F.transform(listed, lambda f: F.concat_ws(" ", f["_inner"], f["sha256"])), "\n")
    whole = F.when(F.max("_inner") == "", F.max("sha256")).otherwise(F.upper(F.sha2(lines, 256)))
    path = F.min(F.when(F.col("_inner") == "", F.col("path")).otherwise(F.expr("left(path, length(path) - length(_inner) - 1)")))
    entries = placed.groupBy("_entry", "name").agg(path.alias("path"), F.sum("length").alias("length"), whole.alias("sha256"))
    return entries.select("path", "length", "sha256", "name")


def verify_inventory(expected: DataFrame, actual: DataFrame, key: str = "name", group: str = "kind") -> DataFrame:
    """State of every expected file: ready, missing, or changed."""
    have = actual.select(key, F.col("sha256").alias("_sha"), F.col("length").alias("_len"))
    joined = expected.join(have, key, "left")
    state = (
        F.when(F.col("_sha").isNull(), "missing")
        .when(F.col("_sha") != F.col("sha256"), "changed")
        .otherwise("ready")
    )
    return joined.select(key, group, state.alias("state"))


def inventory_summary(verified: DataFrame, group: str = "kind") -> DataFrame:
    return verified.groupBy(group).agg(
        F.count(F.lit(1)).alias("expected"),
        F.count_if(F.col("state") == "ready").alias("ready"),
        F.count_if(F.col("state") == "missing").alias("missing"),
        F.count_if(F.col("state") == "changed").alias("changed"),
        F.bool_and(F.col("state") == "ready").alias("complete"),
    )


def forecast_preflight(required: DataFrame, available: DataFrame) -> DataFrame:
    """Missing inputs as rows; ``required(kind, year)`` against ``available(kind, year, present)``."""
    joined = required.join(available, ["kind", "year"], "left")
    reason = F.when(F.col("present").isNull(), "no registry record").when(~F.col("present"), "registered file missing")
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("kind", "year", "reason")


def layer_audit(layer: DataFrame, by: str, year: str, first: int, last: int) -> DataFrame:
    """Features, empty rings, bounds and years per layer, with the years of a range it lacks."""
    grouped = layer.groupBy(by).agg(
        F.count(F.lit(1)).alias("features"),
        F.count_if(F.col("xmin").isNull() | (F.col("xmax") <= F.col("xmin"))).alias("empty"),
        F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"),
        F.array_sort(F.collect_set(year)).alias("years"),
    )
    wanted = F.sequence(F.lit(first), F.lit(last))
    return grouped.withColumn("missing_years", F.array_except(wanted, "years"))


def layer_validation(layer: DataFrame, by: str, code: str, allowed: list[str]) -> DataFrame:
    """Counts and observed codes per layer against the allowed list."""
    bad = (F.col("xmax") <= F.col("xmin")) | (F.col("ymax") <= F.col("ymin"))
    grouped = layer.groupBy(by).agg(
        F.count(F.lit(1)).alias("features"),
        F.count_if(F.col("xmin").isNull()).alias("null_geometry"),
        F.count_if(bad).alias("invalid"),
        F.array_sort(F.collect_set(code)).alias("codes"),
    )
    permitted = F.array(*[F.lit(c) for c in allowed])
    unexpected = F.array_except("codes", permitted)
    absent = F.array_except(permitted, "codes")
    return grouped.withColumns(
        {
            "unexpected": F.array_join(unexpected, ","), "absent": F.array_join(absent, ","),
            "ready": (F.size(unexpected) == 0) & (F.size(absent) == 0) & (F.col("null_geometry") == 0) & (F.col("invalid") == 0),
        }
    ).drop("codes")


def against_facts(observed: DataFrame, facts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Observed numbers beside the registered ones and whether all agree."""
    named = facts.select(key, *[F.col(c).alias(f"expected_{c}") for c in columns])
    joined = named.join(observed.select(key, *columns), key, "left")
    same = None
    for c in columns:
        one = F.col(c).eqNullSafe(F.col(f"expected_{c}"))
        same = one if same is None else same & one
    return joined.withColumn("matches", same)
