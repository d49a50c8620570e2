"""Descriptive screening: recurrence bands beside an official class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.functions.scalars import (
    HAZARD_CLASSES,
    broad_level,
    evidence_status,
    mapped,
    recurrence_band,
    recurrence_note,
)
from gridpanel.operators.prefix import nearest_rank_quantiles


def recurrence_thresholds(df: DataFrame, count: str, maximum: int = 10) -> DataFrame:
    """Nearest-rank tertiles of the count; three bands must remain."""
    q = nearest_rank_quantiles(df, [count], {"q33": 1 / 3, "q67": 2 / 3})
    low, mid = F.col("q33").cast("int"), F.col("q67").cast("int")
    useful = (low >= 0) & (low < mid) & (mid < maximum)
    checked = F.when(useful, low).otherwise(F.raise_error(F.lit("tertiles do not form three bands")))
    return q.select(checked.alias("lower_max"), mid.alias("moderate_max"))


def screening_core(recurrence: DataFrame, land_cover: DataFrame, slope: DataFrame, area: DataFrame, key: str = "cell_id") -> DataFrame:
    """Descriptive components of every key of ``area``; a key that a component lacks is an error."""
    joined, parts = area, (recurrence, land_cover, slope)
    for i, part in enumerate(parts):
        joined = joined.join(part.withColumn(f"_has{i}", F.lit(True)), key, "left")
    lacking = F.array_compact(F.array(*[F.when(F.col(f"_has{i}").isNull(), F.lit(n)) for i, n in enumerate(("recurrence", "land cover", "slope"))]))
    said = F.concat(F.col(key).cast("string"), F.lit(" lacks "), F.array_join(lacking, ", "))
    whole = F.when(F.size(lacking) > 0, F.raise_error(said).cast("boolean")).otherwise(F.lit(True))
    return joined.where(whole).drop(*[f"_has{i}" for i in range(len(parts))])


def assemble_screening(
    core: DataFrame, hazard: DataFrame, count: str, first: int, last: int, key: str = "cell_id"
) -> DataFrame:
    """Bands, notes, official class and evidence status for every cell."""
    limits = recurrence_thresholds(core, count).select(F.struct("lower_max", "moderate_max").alias("t")).scalar()
    low, mid = limits["lower_max"], limits["moderate_max"]
    banded = core.withColumn("historical_exposure_band", recurrence_band(F.col(count), low, mid))
    banded = banded.withColumn(
        "historical_exposure_note", recurrence_note(F.col("historical_exposure_band"), low, mid, first, last)
    )
    named = hazard.withColumn("hazard_class", mapped(F.col("modal_code"), HAZARD_CLASSES, "unmatched"))
    joined = banded.join(named, key, "left")
    return joined.withColumns(
        {
            "history_start_year": F.lit(first), "history_end_year": F.lit(last),
            "evidence_status": evidence_status(F.col("hazard_class")),
            "hazard_level": broad_level(F.col("hazard_class")),
        }
    )


# Report order of the bands and of the official classes.
BAND_ORDER = ("lower", "moderate", "higher")
HAZARD_ORDER = ("null", "very_low", "low", "medium", "high", "very_high", "unmatched")


def area_coverage(cells: DataFrame, regions: DataFrame, status: str, tile: float, key: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Eligible, scored, insufficient and excluded cells per region, by cell centre."""
    from gridpanel.operators.sweep import points_in_polygons

    placed = points_in_polygons(cells, regions, [*key, status], tile, covers=False)
    return placed.groupBy("region_id").agg(
        F.count(F.lit(1)).alias("eligible"),
        F.count_if(F.col(status) == "scored").alias("scored"),
        F.count_if(F.col(status) == "insufficient").alias("insufficient"),
        F.count_if(F.col(status) == "excluded").alias("excluded"),
    )
