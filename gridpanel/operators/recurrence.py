"""Event history before a year and outcomes after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridpanel.operators.grid import explode_neighbours


def context_years(events: DataFrame, cells: DataFrame, cell_size: float, distance: float, key: str = "k") -> DataFrame:
    """Distinct ``(cell, year)`` with an event within ``distance``; events are one row per cell-year first."""
    hit = events.select(key, "year").distinct().join(cells.select(key, "ix", "iy"), key)
    # drop duplicates on integer coordinates before meeting the grid again
    spread = explode_neighbours(hit, cell_size, distance).select(
        F.col("nix").alias("ix"), F.col("niy").alias("iy"), "year"
    ).distinct()
    return spread.join(cells.select(key, "ix", "iy"), ["ix", "iy"]).select(key, "year")


def recurrence(
    hits: DataFrame, cell_years: DataFrame, window: int, key: str = "k", year: str = "observation_year", out: str = "recurrence"
) -> DataFrame:
    """Distinct hit years in ``[T-window, T-1]``, zero when there is none.

    Each hit year is sent to the ``window`` later years it counts for, so the window
    is an equi-join and never a range join.
    """
    counted = (
        hits.select(key, "year").distinct()
        .withColumn(year, F.explode(F.sequence(F.col("year") + 1, F.col("year") + window)))
        .groupBy(key, year).agg(F.count(F.lit(1)).cast("int").alias(out))
    )
    return cell_years.join(counted, [key, year], "left").withColumn(out, F.coalesce(out, F.lit(0)))


def rolling_recurrence(flags: DataFrame, window: int, key: str = "k", year: str = "year", hit: str = "hit") -> DataFrame:
    """Running count over a dense cell-year table; null until a full window exists.

    A window holds one row per year of one cell, so its size is the number of years.
    """
    span = W.partitionBy(key).orderBy(year)
    past = span.rangeBetween(-window, -1)
    return flags.withColumn(
        "recurrence", F.when(F.count(F.lit(1)).over(past) == window, F.sum(hit).over(past).cast("int"))
    )


def target_shift(
    cell_years: DataFrame, outcomes: DataFrame, outcome_years: Sequence[int], key: str = "k",
    year: str = "observation_year", value: str = "share", out: str = "target",
) -> DataFrame:
    """Outcome of ``T + 1`` on row ``T``; a year nobody observed is an error, not zero."""
    wanted = F.col(year) + 1
    known = wanted.isin([int(y) for y in outcome_years])
    shifted = outcomes.select(key, (F.col("year") - 1).alias(year), F.col(value).alias("_value"))
    joined = cell_years.join(shifted, [key, year], "left")
    observed = F.coalesce("_value", F.lit(0.0))
    return joined.withColumn(
        out, F.when(known, observed).otherwise(F.raise_error(F.lit("outcome year was not observed")))
    ).drop("_value")
