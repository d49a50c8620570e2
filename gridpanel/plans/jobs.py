"""Composite jobs over a finished panel: ranking slice, description, screening, annual cycle, export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.contract import PanelContract, TimeDesign
from gridpanel.functions.geometry import rect_ring, tm_inverse
from gridpanel.operators import describe as D
from gridpanel.operators import gates as GT
from gridpanel.operators import metrics as M
from gridpanel.operators import models as MD
from gridpanel.operators import raster as RA
from gridpanel.operators import recurrence as R
from gridpanel.operators import screening as SC
from gridpanel.operators.compare import append_labelled
from gridpanel.operators.prefix import rank_pct, stratified_sample
from gridpanel.session import materialize
from gridpanel.sinks.publish import geojson_features, metadata_row, public_fields
from gridpanel.sources.registry import forecast_preflight


def recurrence_ranking(
    cells: DataFrame, events: DataFrame, cell_years: DataFrame, outcome_years: Sequence[int], train_last: int, *,
    cell_size: float, context: float, window: int, threshold: float = 0.0,
) -> DataFrame:
    """Neighbourhood history, next-year outcome, mean-by-count estimate and its rank per cell-year."""
    hits = R.context_years(events.where(F.col("share") >= threshold), cells, cell_size, context)
    counted = R.recurrence(hits, cell_years, window, out="events_previous_years")
    # three consumers below read these rows
    rows = materialize(R.target_shift(counted, events, outcome_years, out="share_next_year"))
    train = rows.where(F.col("observation_year") <= train_last)
    table = M.mean_by_count(train, "events_previous_years", "share_next_year")
    estimated = M.predict_by_count(rows, table, train.agg(M.exact_mean("share_next_year")).scalar(), "events_previous_years", "estimate")
    return rank_pct(estimated, "estimate")


def run_eda(panel: DataFrame, year: str, split: str, cols: Sequence[str], target: str) -> dict[str, DataFrame]:
    """All descriptive tables of one panel; the panel is materialised once."""
    panel = materialize(panel)
    every = [*cols, target]
    return {
        "split_counts": D.split_counts(panel, split),
        "target_by_year": D.target_by_year(panel, year, target),
        "describe": D.describe(panel, [split], every),
        "means_by_year": D.means_by_year(panel, year, cols),
        "standardized_difference": D.standardized_difference(panel, split, cols),
        "correlations": D.correlations(panel, every),
        "redundant_pairs": D.redundant_pairs(panel, cols),
        "outliers": D.iqr_outliers(panel, split, cols),
    }


def eda_rows(tables: Mapping[str, DataFrame], split: str) -> DataFrame:
    """The numeric results as tidy rows ``(table, scope, column, metric, value)``."""
    def tidy(name: str, df: DataFrame, scope: str, column, metrics: Sequence[str]) -> DataFrame:
        keyed = df.select(F.lit(name).alias("table"), F.col(scope).cast("string").alias("scope"), column.alias("column"), *metrics)
        return M.metrics_to_rows(keyed, ["table", "scope", "column"], metrics)

    smd, outliers, target = tables["standardized_difference"], tables["outliers"], tables["target_by_year"]
    year = target.columns[0]
    parts = [
        tidy("standardized_difference", smd, split, F.col("column"), ["smd"]),
        tidy("outliers", outliers, split, F.col("column"), ["outliers"]),
        tidy("target_by_year", target, year, F.lit("target"), ["zero_share", "mean", "median", "p99"]),
        tidy("describe", tables["describe"], split, F.col("column"), ["count", "missing", "median"]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def screening(
    core: DataFrame, pixels: DataFrame, cells: DataFrame, count: str, first: int, last: int, codes: Sequence[int] = range(6)
) -> dict[str, DataFrame]:
    """Bands beside the official class for every cell, its summary tables and gate violations."""
    hazard = RA.zonal_mode(pixels, cells, codes)
    table = materialize(SC.assemble_screening(core, hazard, count, first, last))
    return {
        "table": table,
        "bands": D.distribution(table, "historical_exposure_band", SC.BAND_ORDER),
        "classes": D.distribution(table, "hazard_class", SC.HAZARD_ORDER),
        "crosstab": D.crosstab(table, "historical_exposure_band", "hazard_class"),
        "agreement": D.agreement_share(table, "historical_exposure_band", "hazard_level"),
        "violations": GT.gate_screening(table, cells.select("cell_id")),
    }


def select_model(
    panel: DataFrame, features: Sequence[str], target: str, key: Sequence[str], year: str, train: Sequence[int], validation: Sequence[int],
    per_year: int, candidates: Mapping[str, Mapping] = MD.CANDIDATES,
) -> DataFrame:
    """Compare candidates on a yearly sample of the training years, best first."""
    rows = panel.where(F.col(year).isin(list(train)))
    sample = materialize(stratified_sample(rows, year, per_year, key, MD.SEED))
    held = panel.where(F.col(year).isin(list(validation)))
    long = materialize(MD.compare_candidates(sample, held, features, target, key, year, candidates))
    scoped = M.with_scopes(long, year)
    return M.candidate_summary(M.regression_metrics(long, year), M.tie_aware_ranking(scoped, 0.2, ["model", "scope"]))


def annual_cycle(
    labelled: DataFrame, matrix: DataFrame, estimator, years: Sequence[int], forecast_year: int, cells: DataFrame,
    contract: PanelContract, design: TimeDesign, model_id: str,
) -> tuple[Model, DataFrame, DataFrame]:
    """Refit on all labelled years, gate the scoring matrix, score, and gate the published scores."""
    GT.enforce(GT.gate_scoring(matrix, contract, design, forecast_year, cells))
    model = MD.refit(labelled, estimator, years)
    scores = materialize(MD.score(model, matrix.withColumn("assignment_method", F.lit("containing_source")), forecast_year, model_id))
    repeated = model.transform(matrix).select("cell_id", F.col(model.out).alias("estimate"))
    violations = GT.gate_forecast(scores, cells, repeated, forecast_year, scores.dtypes)
    return model, scores, violations


def operational_cycle(
    blocks: Sequence[tuple[str, DataFrame, Sequence[int]]], matrix: DataFrame, estimator, forecast_year: int, cells: DataFrame,
    contract: PanelContract, design: TimeDesign, model_id: str, required: DataFrame, available: DataFrame,
) -> tuple[Model, DataFrame, DataFrame, DataFrame]:
    """The annual cycle from stored blocks: check that every input exists, append the labelled blocks in order, refit and score.

    A missing input ends the cycle before anything is fitted. Also returned are the labelled rows with the block each came from.
    """
    missing = forecast_preflight(required, available)
    GT.enforce(missing.select(F.lit("missing_input").alias("gate"), F.concat_ws(" ", "kind", F.col("year").cast("string")).alias("key"), F.col("reason").alias("detail")))
    labelled = append_labelled(blocks, contract.year)
    years = [y for _, _, block in blocks for y in block]
    model, scores, violations = annual_cycle(labelled.drop("source"), matrix, estimator, years, forecast_year, cells, contract, design, model_id)
    return model, scores, violations, labelled


def diagnostics(pred: DataFrame, year: str, target: str, models: Sequence[str]) -> dict[str, DataFrame]:
    """Regression metrics, binned comparison, residual quartiles and 2-D counts of stored predictions."""
    renamed = pred.withColumnRenamed(target, "target") if target != "target" else pred
    long = M.melt_models(renamed, [year, "target"], models)
    first = models[0]
    return {
        "regression": M.regression_metrics(long, year),
        "bins": M.binned_comparison(renamed, first, "target"),
        "residuals": D.residual_quartiles(renamed, year, "target", first),
        "density": D.bin_counts(renamed, "target", first),
    }


def web_export(scores: DataFrame, cells: DataFrame, size: float, version: str) -> tuple[DataFrame, DataFrame]:
    """Public GeoJSON features in degrees and one provenance row."""
    corners = cells.select(
        "cell_id", F.col("x0").alias("xa"), F.col("y0").alias("ya"), (F.col("x0") + size).alias("xb"), (F.col("y0") + size).alias("yb")
    )
    ring = F.transform(
        rect_ring("xa", "ya", "xb", "yb"), lambda p: F.transform(F.array(tm_inverse(p["x"], p["y"])), lambda q: F.struct(q["lon"].alias("x"), q["lat"].alias("y")))[0]
    )
    shapes = corners.select("cell_id", F.array(ring).alias("rings"))
    public = public_fields(scores)
    return geojson_features(public.join(shapes, "cell_id"), public.columns), metadata_row(scores, version)
