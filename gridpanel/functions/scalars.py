"""Column expressions: units, clamps, bands, labels and request parsing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days of June to September, the season the climate columns cover.
SEASON_DAYS = {6: 30, 7: 31, 8: 31, 9: 30}
FULL_CELL_AREA_M2 = 999_999.999


def null_if_nan(col: Column) -> Column:
    """NaN means no data; every source turns it into null so aggregates skip it."""
    return F.when(~F.isnan(col), col)


def clip01(col: Column) -> Column:
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(0.0)), F.lit(1.0)))


def to_celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def month_days(month: Column, days: Mapping[int, int] = SEASON_DAYS) -> Column:
    table = F.create_map(*[F.lit(x) for pair in days.items() for x in pair])
    return F.element_at(table, month)


def month_mm(metres_per_day: Column, month: Column, days: Mapping[int, int] = SEASON_DAYS) -> Column:
    return metres_per_day * month_days(month, days) * 1000


def normalise_code(code: Column, width: int = 3) -> Column:
    return F.lpad(F.trim(code.cast("string")), width, "0")


def code_group(code: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """Feature group of a class code; null when the code belongs to none."""
    normal, result = normalise_code(code), None
    for name, members in groups.items():
        hit = normal.isin(list(members))
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result


# Limits and labels of the three published percentile bands.
def band3(p: Column, low: float = 0.50, high: float = 0.80) -> Column:
    """Code and label of the three right-closed percentile bands."""
    return (
        F.when(p.isNull(), None)
        .when(p <= low, F.struct(F.lit(1).alias("code"), F.lit("lower").alias("label")))
        .when(p <= high, F.struct(F.lit(2).alias("code"), F.lit("intermediate").alias("label")))
        .otherwise(F.struct(F.lit(3).alias("code"), F.lit("higher").alias("label")))
    )


def band_intervals(p: Column, edges: Sequence[float]) -> Column:
    """Number of the right-closed interval between consecutive edges; values above all edges get the last."""
    result = F.when(p.isNull(), None)
    for index, edge in enumerate(edges, start=1):
        result = result.when(p <= edge, index)
    return result.otherwise(len(edges) + 1)


def recurrence_band(n: Column, low: Column, mid: Column) -> Column:
    return F.when(n <= low, "lower").when(n <= mid, "moderate").otherwise("higher")


def recurrence_note(
    band: Column, low: Column, mid: Column, first: int, last: int, length: int = 10, noun: str = "years with a fire", distance: str = "2 km"
) -> Column:
    """What a band stands for, in words; the lowest one warns against reading it as no risk."""
    text = lambda a, b: F.concat(
        F.lit(f"Between {first} and {last}, "), a.cast("string"), F.lit(" to "), b.cast("string"), F.lit(f" {noun} within {distance}")
    )
    return (
        F.when(band == "lower", F.concat(text(F.lit(0), low), F.lit("; a low count is no proof of safety")))
        .when(band == "moderate", text(low + 1, mid))
        .otherwise(text(mid + 1, F.lit(length)))
    )


# The official hazard classes and the broad level each belongs to.
BROAD_LEVELS = {
    "null": "lower",
    "very_low": "lower",
    "low": "lower",
    "medium": "moderate",
    "high": "higher",
    "very_high": "higher",
}
HAZARD_CLASSES = {0: "null", 1: "very_low", 2: "low", 3: "medium", 4: "high", 5: "very_high"}


def mapped(key: Column, table: Mapping, default: str | None = None) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(lookup, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def broad_level(class_name: Column) -> Column:
    return mapped(class_name, BROAD_LEVELS)


# Fixed values of the two functions below: the published class names.
def land_class(area: Column, full: float = FULL_CELL_AREA_M2) -> Column:
    return F.when(area < full, "partial_land_coastal").otherwise("full_land_coastal")


def evidence_status(class_name: Column) -> Column:
    return F.when(class_name == "unmatched", "official_hazard_unmatched").otherwise("complete_descriptive_evidence")


def parse_radii(text: Column, maximum: float = 10.0) -> tuple[Column, Column]:
    """Radii of a comma list and the error of a bad one (null when the list is good)."""
    radii = F.transform(F.split(text, ","), lambda s: F.trim(s).try_cast("double"))
    finite = F.forall(radii, lambda r: r.isNotNull())
    in_range = F.forall(radii, lambda r: ~F.isnan(r) & (r > 0) & (r <= maximum))
    unique = F.size(F.array_distinct(radii)) == F.size(radii)
    error = (
        F.when(text.isNull() | ~finite, "radii must be comma-separated numbers")
        .when(~in_range, f"radii must be finite, above 0 and at most {maximum:g}")
        .when(~unique, "radii must be unique")
    )
    return F.when(error.isNull(), radii), error


def edge_band(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Left-closed bands: ``labels[i]`` holds values below ``edges[i]``, the last label the rest."""
    result = F.when(value.isNull(), None)
    for edge, label in zip(edges, labels):
        result = result.when(value < edge, label)
    return result.otherwise(labels[-1])


# Distance bands of the nearest-source report, in kilometres.
DISTANCE_EDGES = (10.0, 20.0, 30.0, 50.0)
DISTANCE_LABELS = (
    "under_10_km",
    "10_to_under_20_km",
    "20_to_under_30_km",
    "30_to_under_50_km",
    "50_km_or_more",
)


def insufficient_evidence(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Status instead of a low score when a mandatory group of columns is incomplete."""
    missing = [
        F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in cols], F.lit(0)) == 1, F.lit(name))
        for name, cols in groups.items()
    ]
    lacking = F.array_compact(F.array(*missing))
    return df.withColumn("missing_groups", F.concat_ws(",", lacking)).withColumn(
        "evidence", F.when(F.size(lacking) > 0, "insufficient_evidence").otherwise("eligible")
    )
