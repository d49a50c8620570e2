"""Seasonal climate features from long monthly rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.functions.scalars import SEASON_DAYS, month_mm, null_if_nan

KEYS = ("lat_idx", "lon_idx", "year")


def clean(climate: DataFrame, variables: Sequence[str]) -> DataFrame:
    return climate.withColumns({v: null_if_nan(F.col(v).cast("double")) for v in variables})


def season_stats(climate: DataFrame, variables: Mapping[str, Sequence[str]], keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean, maximum or minimum over the season's months; nulls are skipped."""
    functions = {"mean": F.avg, "max": F.max, "min": F.min}
    return climate.groupBy(*keys).agg(
        *[functions[kind](v).alias(f"{kind}_{v}") for v, kinds in variables.items() for kind in kinds]
    )


def season_total(
    climate: DataFrame, value: str, out: str, keys: Sequence[str] = KEYS, days: Mapping[int, int] = SEASON_DAYS
) -> DataFrame:
    """Day-weighted millimetres; a missing month counts as zero, all missing gives null."""
    amount = F.sum(month_mm(F.col(value), F.col("month"), days))
    return climate.groupBy(*keys).agg(F.when(F.count(value) > 0, amount).alias(out))


def month_violations(climate: DataFrame, keys: Sequence[str] = KEYS, months: Sequence[int] = (6, 7, 8, 9)) -> DataFrame:
    """Keys whose rows are not exactly one per season month."""
    wanted = F.array(*[F.lit(m) for m in months])
    seen = climate.groupBy(*keys, "month").agg(F.count(F.lit(1)).alias("n"))
    grouped = seen.groupBy(*keys).agg(
        F.array_sort(F.collect_set("month")).alias("months"), F.max("n").alias("repeats")
    )
    return grouped.where((F.col("months") != wanted) | (F.col("repeats") > 1))


def stable_mask(climate: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Validity of each source and whether it is the same in every year."""
    whole = F.least(*[F.col(v).isNotNull().cast("int") for v in variables], F.lit(1)) == 1
    yearly = climate.groupBy(*KEYS).agg(F.bool_and(whole).alias("valid"))
    return yearly.groupBy("lat_idx", "lon_idx").agg(
        F.bool_and("valid").alias("valid"),
        F.count_distinct("valid").cast("int").alias("states"),
        (F.count_distinct("valid") == 1).alias("stable"),
    )


def climate_contract(climate: DataFrame, variables: Sequence[str], months: Sequence[int] = (6, 7, 8, 9)) -> DataFrame:
    """Shape, months and null counts per year and variable; null counts must agree across variables.

    A year is ready only with exactly the wanted months, each of them on the whole grid.
    """
    long = climate.unpivot(["lat_idx", "lon_idx", "year", "month"], list(variables), "variable", "value")
    facts = long.groupBy("year", "variable").agg(
        F.count_distinct("month").alias("months"),
        (F.array_sort(F.collect_set("month")) == F.lit(sorted(int(m) for m in months)).cast("array<int>")).alias("right_months"),
        F.count_distinct("lat_idx").alias("lat_count"),
        F.count_distinct("lon_idx").alias("lon_count"),
        F.count_if(F.col("value").isNull()).alias("nulls"),
        F.count(F.lit(1)).alias("rows"),
    )
    yearly = facts.groupBy("year").agg((F.max("nulls") == F.min("nulls")).alias("same_nulls"))
    return facts.join(yearly, "year").withColumn(
        "ready", F.col("right_months") & F.col("same_nulls")
        & (F.col("rows") == F.col("months") * F.col("lat_count") * F.col("lon_count"))
    )


def choose_source(base: DataFrame, corrections: DataFrame, keys: Sequence[str], values: Sequence[str], mandatory: Sequence[int] = ()) -> DataFrame:
    """Corrected value where a correction is registered, else the base value.

    Years in ``mandatory`` must be corrected; a missing correction there is an error.
    """
    fixed = corrections.select(*keys, *[F.col(v).alias(f"_c_{v}") for v in values], F.lit(True).alias("_fixed"))
    joined = base.join(fixed, list(keys), "left")
    must = F.col("year").isin([int(y) for y in mandatory]) & F.col("_fixed").isNull() if mandatory else F.lit(False)
    picked = {
        v: F.when(must, F.raise_error(F.lit("mandatory correction is missing"))).otherwise(
            F.when(F.col("_fixed"), F.col(f"_c_{v}")).otherwise(F.col(v))
        )
        for v in values
    }
    return joined.withColumns({**picked, "corrected": F.coalesce("_fixed", F.lit(False))}).drop(
        "_fixed", *[f"_c_{v}" for v in values]
    )


def climate_from_arrays(arrays: DataFrame) -> DataFrame:
    """``(ts, lats, lons, values[lat][lon])`` rows to long rows that keep both source indexes."""
    by_lat = arrays.select("ts", "lats", "lons", F.posexplode("values").alias("lat_idx", "_row"))
    return by_lat.select("ts", "lats", "lons", "lat_idx", F.posexplode("_row").alias("lon_idx", "value")).select(
        F.year("ts").alias("year"), F.month("ts").alias("month"), "lat_idx", "lon_idx",
        F.col("lats")[F.col("lat_idx")].alias("lat"), F.col("lons")[F.col("lon_idx")].alias("lon"),
        null_if_nan(F.col("value")).alias("value"),
    )
