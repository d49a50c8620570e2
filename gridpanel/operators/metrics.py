"""Regression and ranking metrics as tidy rows, skew-safe on heavily tied scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.operators.prefix import exact_quantiles, prefix_sum, row_index
from gridpanel.operators.skew import salted_join


def melt_models(pred: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """One row per prediction and model: ``(keys…, model, score)``."""
    return pred.unpivot([F.col(k) for k in keys], [F.col(m) for m in models], "model", "score")


def with_scopes(long: DataFrame, year: str) -> DataFrame:
    """Each row once for its year and once for ``overall``."""
    scopes = F.array(F.lit("overall"), F.col(year).cast("string"))
    return long.withColumn("scope", F.explode(scopes))


def regression_metrics(long: DataFrame, year: str, target: str = "target", score: str = "score") -> DataFrame:
    """Error metrics overall and per year; positive-only metrics of no positives are null."""
    t, s = F.col(target), F.col(score)
    error, positive = s - t, t > 0
    grouped = long.groupingSets([["model"], ["model", year]], "model", year).agg(
        F.coalesce(F.col(year).cast("string"), F.lit("overall")).alias("scope"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(positive).alias("positives"),
        F.avg(F.abs(error)).alias("mae_all"),
        F.sqrt(F.avg(error * error)).alias("rmse_all"),
        F.avg(F.when(positive, F.abs(error))).alias("mae_positive"),
        F.sqrt(F.avg(F.when(positive, error * error))).alias("rmse_positive"),
        F.avg(t).alias("mean_observed"),
        F.avg(s).alias("mean_predicted"),
        F.min(s).alias("min_predicted"),
        F.max(s).alias("max_predicted"),
    )
    return grouped.drop(year)


def score_groups(scoped: DataFrame, by: Sequence[str], target: str = "target", score: str = "score") -> DataFrame:
    """One row per distinct score with rows, positives, mass and the rows above it."""
    t = F.col(target)
    groups = scoped.groupBy(*by, score).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(t > 0).alias("p"),
        F.sum(t.cast("decimal(20,10)")).cast("decimal(38,10)").alias("m"),
    )
    totals = groups.groupBy(*by).agg(
        F.sum("n").alias("total_n"), F.sum("p").alias("total_p"), F.sum("m").alias("total_m"),
        F.count(F.lit(1)).alias("unique_scores"),
    )
    ordered = prefix_sum(groups, [f"-{score}"], {"before": F.col("n")}, by)
    return ordered.join(totals, list(by))


def capture_at(
    scoped: DataFrame, fraction: float, by: Sequence[str], tie_break: Sequence[str], target: str = "target", score: str = "score"
) -> DataFrame:
    """Share of positives among the first ``ceil(fraction * n)`` rows, ties by the given keys.

    Whole score groups above the cut are summed as groups; only rows of the one group
    the cut runs through are ordered individually.
    """
    groups = score_groups(scoped, by, target, score)
    take = F.ceil(F.lit(fraction) * F.col("total_n"))
    marked = groups.withColumn("take", take)
    above = marked.groupBy(*by).agg(
        F.first("total_p").alias("total_p"),
        F.coalesce(F.sum(F.when(F.col("before") + F.col("n") <= F.col("take"), F.col("p"))), F.lit(0)).alias("whole"),
    )
    cut = marked.where((F.col("before") < F.col("take")) & (F.col("take") < F.col("before") + F.col("n"))).select(
        *by, score, (F.col("take") - F.col("before")).alias("_left")
    )
    tied = salted_join(scoped, cut, [*by, score])
    ranked = row_index(tied.select(*by, *tie_break, target, "_left"), tie_break, by)
    inside = ranked.where(F.col("row_index") < F.col("_left")).groupBy(*by).agg(
        F.count_if(F.col(target) > 0).alias("_cut")
    )
    captured = F.col("whole") + F.coalesce(F.col("_cut"), F.lit(0))
    return above.join(inside, list(by), "left").select(
        *by, captured.alias("captured"), F.try_divide(captured, "total_p").alias("capture")
    )


def tie_aware_ranking(
    scoped: DataFrame, fraction: float, by: Sequence[str], target: str = "target", score: str = "score"
) -> DataFrame:
    """Spend ``fraction * n`` rows over descending scores; the last group counts in part."""
    groups = score_groups(scoped, by, target, score)
    budget = F.lit(fraction) * F.col("total_n")
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (budget - F.col("before")) / F.col("n")))
    weighted = groups.withColumn("w", weight)
    picked = weighted.groupBy(*by).agg(
        F.first("unique_scores").alias("unique_scores"), F.first("total_n").alias("total_n"),
        F.first("total_p").alias("total_p"), F.first("total_m").cast("double").alias("total_m"),
        F.sum(F.col("w") * F.col("n")).alias("selected_rows"),
        F.sum(F.col("w") * F.col("p")).alias("sp"),
        F.sum(F.col("w") * F.col("m").cast("double")).alias("sm"),
    )
    precision = F.try_divide("sp", "selected_rows")
    base_rate = F.col("total_p") / F.col("total_n")
    return picked.select(
        *by, "unique_scores", "selected_rows",
        F.try_divide("sp", "total_p").alias("positive_capture"),
        F.try_divide("sm", "total_m").alias("mass_capture"),
        precision.alias("precision"),
        F.try_divide(precision, base_rate).alias("lift"),
    )


def mean_by_count(train: DataFrame, count: str, target: str) -> DataFrame:
    """Training mean per integer count."""
    return train.groupBy(F.col(count).cast("int").alias(count)).agg(exact_mean(target).alias("mean_target"))


def exact_mean(share: str) -> Column:
    """Mean of shares whose sum does not depend on the order of the rows, so two runs agree to the last bit."""
    total = F.sum(F.col(share).cast("decimal(28,18)")).cast("double")
    return total / F.when(F.count(share) > 0, F.count(share))


def predict_by_count(rows: DataFrame, table: DataFrame, overall: Column, count: str, out: str = "baseline") -> DataFrame:
    """Mean of the row's count, the overall mean for a count never seen, clamped to [0, 1]."""
    looked = salted_join(rows, table, [count], "left")
    value = F.coalesce(F.col("mean_target"), overall)
    return looked.withColumn(out, F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))).drop("mean_target")


def binned_comparison(df: DataFrame, score: str, target: str, bins: int = 10) -> DataFrame:
    """Right-closed quantile bins of the score (repeated edges dropped) with means and positive share."""
    rows = df.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    probs = {f"e{i}": i / bins for i in range(bins + 1)}
    # bins + 1 numbers; repeated edges collapse
    edges = sorted(set(exact_quantiles(rows, [score], probs).select(*probs).first() or ()))
    # number of edges below the value; the lowest edge itself belongs to bin 1
    below = sum(((F.col(score) > e).cast("int") for e in edges), F.lit(0))
    slot = F.greatest(F.lit(1), below)
    t = F.col(target)
    return rows.groupBy(slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("cell_count"),
        F.avg(score).alias("mean_estimated"), F.avg(t).alias("mean_observed"),
        F.avg((t > 0).cast("double")).alias("positive_share"),
    )


def prediction_summary(scores: DataFrame, score: str) -> DataFrame:
    """Minimum, median, mean, maximum and zero count of a score column."""
    ends = scores.groupBy(F.lit(score).alias("column")).agg(
        F.min(score).alias("minimum"), F.avg(score).alias("mean"), F.max(score).alias("maximum"),
        F.count_if(F.col(score) == 0).alias("zero_count"),
    )
    return ends.join(exact_quantiles(scores, [score], {"median": 0.5}), "column")


def method_counts(scores: DataFrame, method: str) -> DataFrame:
    return scores.groupBy(method).agg(F.count(F.lit(1)).alias("row_count"))


def metrics_to_rows(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metric columns to tidy ``(keys…, metric, value)`` rows."""
    return wide.unpivot(
        [F.col(k) for k in keys], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value"
    )


def metrics_to_columns(tidy: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return tidy.groupBy(*keys).pivot("metric", list(metrics)).agg(F.first("value"))


def candidate_summary(regression: DataFrame, ranking: DataFrame) -> DataFrame:
    """One row per candidate, lowest overall error first, then highest mass capture."""
    return regression.join(ranking, ["model", "scope"]).where(F.col("scope") == "overall").orderBy(
        F.col("mae_all").asc(), F.col("mass_capture").desc(), F.col("model").asc()
    )


def evaluate_published(scores: DataFrame, outcomes: DataFrame, years: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """Published scores with their later outcome; only years whose outcomes have arrived."""
    known = scores.where(F.col(keys[1]).isin([int(y) for y in years]))
    joined = known.join(outcomes, list(keys), "left")
    return joined.withColumn("target", F.coalesce("share", F.lit(0.0))).drop("share")
