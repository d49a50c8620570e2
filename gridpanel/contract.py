"""The panel contract: columns, ranges and the time design, all as parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class FieldRule:
    """Allowed range of one numeric panel column; ``None`` leaves a side open."""

    name: str
    minimum: float | None = None
    maximum: float | None = None
    integral: bool = False
    group: str = ""


@dataclass(frozen=True)
class TimeDesign:
    """Which years may feed a predictor year and which reference layer is governed."""

    first_year: int
    last_year: int
    history_length: int = 10
    # (first predictor year, last predictor year, reference year); not a plain as-of lookup
    references: tuple[tuple[int, int, int], ...] = ()
    splits: tuple[tuple[str, int, int], ...] = ()


@dataclass(frozen=True)
class PanelContract:
    features: tuple[FieldRule, ...]
    target: FieldRule
    cell: str = "cell_id"
    year: str = "observation_year"
    metadata: tuple[str, ...] = field(default=())
    tolerance: float = 1e-9

    @property
    def key(self) -> tuple[str, str]:
        return (self.cell, self.year)

    @property
    def feature_names(self) -> list[str]:
        return [rule.name for rule in self.features]

    @property
    def columns(self) -> list[str]:
        return ["cell_year_id", *self.key, *self.metadata, *self.feature_names, self.target.name]

    def joint_null_columns(self, group: str = "climate") -> list[str]:
        return [rule.name for rule in self.features if rule.group == group]

    def schema(self, strings: Sequence[str] = ()) -> T.StructType:
        kinds = {"cell_year_id": T.StringType(), self.cell: T.StringType(), self.year: T.IntegerType()}
        for name in self.metadata:
            kinds[name] = T.StringType() if name in strings or name.endswith(("_id", "_date")) else T.IntegerType()
        return T.StructType(
            [T.StructField(name, kinds.get(name, T.DoubleType())) for name in self.columns]
        )


# The national instance's field names, ranges and years.
PANEL_METADATA = (
    "outcome_year",
    "historical_fire_start_year",
    "historical_fire_end_year",
    "climate_reference_year",
    "land_cover_reference_year",
    "land_cover_release_id",
    "land_cover_release_date",
    "terrain_release_id",
)
NATIONAL_PANEL = PanelContract(
    features=(
        FieldRule("built_up_share", 0.0, 1.0),
        FieldRule("forest_shrub_share_2km", 0.0, 1.0),
        FieldRule("mean_slope_2km", 0.0, 90.0),
        FieldRule("fire_years_previous_10y_2km", 0.0, 10.0, integral=True),
        FieldRule("warm_season_mean_2m_temperature_c", -20.0, 60.0, group="climate"),
        FieldRule("warm_season_total_precipitation_mm", 0.0, 3000.0, group="climate"),
        FieldRule("warm_season_mean_soil_water_layer1", 0.0, 1.0, group="climate"),
        FieldRule("warm_season_max_monthly_2m_temperature_c", -20.0, 60.0, group="climate"),
        FieldRule("warm_season_min_monthly_soil_water_layer1", 0.0, 1.0, group="climate"),
    ),
    target=FieldRule("burned_share_next_year", 0.0, 1.0),
    metadata=PANEL_METADATA,
)
NATIONAL_DESIGN = TimeDesign(
    first_year=2010,
    last_year=2025,
    references=((2010, 2015, 2006), (2016, 2018, 2012), (2019, 2026, 2018)),
    splits=(("train", 2010, 2019), ("validation", 2020, 2021), ("final_test", 2022, 2024)),
)
