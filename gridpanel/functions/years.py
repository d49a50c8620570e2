"""Year algebra: which source years belong to a predictor year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.contract import TimeDesign


def guarded(value: Column, valid: Column, message: str) -> Column:
    """``value`` where ``valid`` holds, otherwise a task failure with ``message``."""
    return F.when(valid, value).otherwise(F.raise_error(F.lit(message)))


def interval_lookup(year: Column, intervals: Sequence[tuple[int, int, int]]) -> Column:
    """Value of the closed interval that contains ``year``; null outside all of them."""
    result = None
    for first, last, value in intervals:
        inside = year.between(first, last)
        result = F.when(inside, value) if result is None else result.when(inside, value)
    return result


def assign_reference(df: DataFrame, year: str, design: TimeDesign, out: str = "land_cover_reference_year") -> DataFrame:
    """Governed reference year by validity interval, never later than the year itself."""
    found = interval_lookup(F.col(year), design.references).cast("int")
    legal = found.isNotNull() & (found <= F.col(year))
    return df.withColumn(out, guarded(found, legal, "no governed reference layer for this year"))


def source_years(df: DataFrame, year: str, design: TimeDesign) -> DataFrame:
    """History window, climate, reference and outcome years of each predictor year."""
    t = F.col(year)
    inside = t.between(design.first_year, design.last_year)
    checked = df.withColumn("climate_year", guarded(t, inside, "predictor year is outside the time design"))
    return assign_reference(checked, "climate_year", design).withColumns(
        {
            "history_start_year": t - design.history_length,
            "history_end_year": t - 1,
            "history_years": F.sequence(t - design.history_length, t - 1),
            "outcome_year": t + 1,
        }
    )


def split_for_year(year: Column, splits: Sequence[tuple[str, int, int]]) -> Column:
    """Name of the temporal split; a year outside every split fails."""
    result = None
    for name, first, last in splits:
        inside = year.between(first, last)
        result = F.when(inside, name) if result is None else result.when(inside, name)
    return result.otherwise(F.raise_error(F.lit("year belongs to no declared split")))


def forecast_years(df: DataFrame, year: str, history_length: int = 10) -> DataFrame:
    """Predictor, latest label and outcome years and the history behind a forecast year."""
    y = F.col(year)
    return df.withColumns(
        {
            "predictor_year": y - 1,
            "latest_label_year": y - 2,
            "latest_outcome_year": y - 1,
            "history_start_year": y - 1 - history_length,
            "history_end_year": y - 2,
        }
    )


def cell_year_id(cell: str = "cell_id", year: str = "observation_year") -> Column:
    return F.concat_ws("_", F.col(cell), F.col(year).cast("string"))


def panel_metadata(
    df: DataFrame, year: str, design: TimeDesign, release_ids: dict[int, tuple[str, str]], terrain_release: str
) -> DataFrame:
    """Outcome, history and source-release columns that travel with each panel row."""
    t = F.col(year)
    ref = F.col("land_cover_reference_year")
    ids = F.create_map(*[x for k, v in release_ids.items() for x in (F.lit(k), F.lit(v[0]))])
    dates = F.create_map(*[x for k, v in release_ids.items() for x in (F.lit(k), F.lit(v[1]))])
    return assign_reference(df, year, design).withColumns(
        {
            "outcome_year": t + 1,
            "historical_fire_start_year": t - design.history_length,
            "historical_fire_end_year": t - 1,
            "climate_reference_year": t,
            "land_cover_release_id": F.element_at(ids, ref),
            "land_cover_release_date": F.element_at(dates, ref),
            "terrain_release_id": F.lit(terrain_release),
        }
    )
