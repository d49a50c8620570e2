"""Composite jobs that turn layers into a panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.contract import TimeDesign
from gridpanel.functions.years import assign_reference, cell_year_id
from gridpanel.operators import climate as C
from gridpanel.operators import nearest as N
from gridpanel.operators import raster as RA
from gridpanel.operators import recurrence as R
from gridpanel.operators import spatial as SP
from gridpanel.operators.compare import frame_differences
from gridpanel.sinks.publish import exists, fits_existing, publish, verify_published


def assemble(keyed: DataFrame, components: Sequence[tuple[DataFrame, Sequence[str], bool]]) -> DataFrame:
    """Join components onto the cell-years; a missing row of a mandatory one is an error."""
    out = keyed
    for i, (component, keys, mandatory) in enumerate(components):
        flag = f"_has{i}"
        out = out.join(component.withColumn(flag, F.lit(True)), list(keys), "left")
        if mandatory:
            out = out.where(F.when(F.col(flag), True).otherwise(F.raise_error(F.lit(f"component {i} lacks a key"))))
        out = out.drop(flag)
    return out


def build_panel(
    cells: DataFrame, burns: DataFrame, cover: DataFrame, elevation: DataFrame, climate: DataFrame, design: TimeDesign,
    years: Sequence[int], *, cell_size: float, context: float, pixel: float, classes: Mapping[str, Sequence[str]],
    source_size: float, variables: Sequence[str], tile_rows: int = 512,
) -> DataFrame:
    """Cells and layers to one row per cell and predictor year, in one DAG without a tile loop.

    ``burns(year, rings)``, ``cover(ref_year, code, rings)``, ``elevation(row, col, value)`` with
    rows counted northwards from the origin, ``climate(lat_idx, lon_idx, year, month, variables…)``.
    """
    event_years = sorted({y for t in years for y in range(t - design.history_length, t)} | {t + 1 for t in years})
    share = SP.burn_share(burns, cells, event_years, cell_size)
    hits = SP.intersects_within(burns, ["year"], cells, cell_size, context)
    keys = cells.select("cell_id", "ix", "iy").withColumn("observation_year", F.explode(F.array(*[F.lit(int(y)) for y in years])))
    keyed = assign_reference(keys, "observation_year", design)
    history = R.recurrence(hits, keyed, design.history_length, key="cell_id", out="events_previous_years")
    target = R.target_shift(history, share, event_years, key="cell_id", out="share_next_year")

    cover_shares = SP.class_share(cover, cells, classes, cell_size, keys=["ref_year"]).withColumnRenamed("ref_year", "land_cover_reference_year")
    slope = RA.terrain_slope(elevation, pixel, block=tile_rows)
    # centres of row/col counted from the origin
    placed = slope.withColumns({"x": (F.col("col") + 0.5) * pixel, "y": (F.col("row") + 0.5) * pixel})
    mean_slope = RA.zonal_mean(placed, cells, cell_size, value="slope", require=False, out="mean_slope").select("cell_id", "mean_slope")

    features = climate_features(climate, variables)
    mask = C.stable_mask(climate, variables)
    sources = mask.select(
        "lat_idx", "lon_idx", "valid", source_id().alias("sid"),
        ((F.col("lon_idx") + 0.5) * source_size).alias("sx"), ((F.col("lat_idx") + 0.5) * source_size).alias("sy"),
    )
    centred = cells.select(
        "cell_id", ((F.col("ix") + 0.5) * cell_size).alias("cx"), ((F.col("iy") + 0.5) * cell_size).alias("cy")
    )
    lats = sources.select("lat_idx", F.col("sy").alias("lat")).distinct()
    lons = sources.select("lon_idx", F.col("sx").alias("lon")).distinct()
    located = N.nearest_axis_join(centred.withColumns({"lat": F.col("cy"), "lon": F.col("cx")}), lats, lons)
    mapping = N.fallback_mapping(located, sources)
    names = [c for c in features.columns if c not in ("sid", "observation_year")]
    rows = located.select("cell_id", source_id().alias("sid")).withColumn(
        "observation_year", F.explode(F.array(*[F.lit(int(y)) for y in years]))
    )
    filled = N.fill_from_mapping(rows, features, mapping, names, by=["observation_year"]).drop("sid")

    joined = assemble(
        target,
        [
            (cover_shares, ["cell_id", "land_cover_reference_year"], False),
            (mean_slope, ["cell_id"], True),
            (filled, ["cell_id", "observation_year"], True),
        ],
    )
    shares = {f"{g}_share": F.coalesce(f"{g}_share", F.lit(0.0)) for g in classes}
    return joined.withColumns({**shares, "cell_year_id": cell_year_id(), "outcome_year": F.col("observation_year") + 1}).drop("ix", "iy")


def source_id():
    return (F.col("lat_idx") * 100_000 + F.col("lon_idx")).cast("bigint")


def climate_features(climate: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Seasonal means and the day-weighted total of the last variable, per source and year."""
    stats = C.season_stats(climate, {v: ["mean", "max"] for v in variables[:-1]})
    total = C.season_total(climate, variables[-1], f"total_{variables[-1]}")
    joined = stats.join(total, list(C.KEYS))
    return joined.select(source_id().alias("sid"), F.col("year").alias("observation_year"), *[c for c in joined.columns if c not in C.KEYS])


def extend_panel_back(early: DataFrame, existing: DataFrame, year: str = "observation_year") -> DataFrame:
    """New early years in front of the existing ones, whose rows are copied unchanged."""
    from gridpanel.operators.compare import align_columns

    return align_columns(early, existing).unionByName(existing)


def copied_unchanged(extended: DataFrame, existing: DataFrame, years: Sequence[int], year: str = "observation_year") -> DataFrame:
    """Differences between the reused years and their source; empty when they were copied exactly."""
    kept = F.col(year).isin([int(y) for y in years])
    return frame_differences(extended.where(kept), existing.where(kept))


def component_tables(components: Mapping[str, DataFrame], folder: str, lineage: Mapping[str, Mapping] | None = None) -> dict[str, dict]:
    """Publish every component once; one that exists with the right columns and content is reused.

    A folder without manifest, or one that no longer agrees with it, is an error.
    """
    status = {}
    for name, df in components.items():
        path = f"{folder}/{name}"
        have = exists(df.sparkSession, path), exists(df.sparkSession, f"{path}.manifest.json")
        if any(have) and not all(have):
            raise FileExistsError(f"half-written artefact needs inspection: {path}")
        if all(have) and not verify_published(df.sparkSession, path).isEmpty():
            raise ValueError(f"artefact does not agree with its manifest: {path}")
        if fits_existing(df.sparkSession, path, df.columns):
            status[name] = {"status": "reused"}
        else:
            status[name] = publish(df, path, name, (lineage or {}).get(name), replace=True)
    return status
