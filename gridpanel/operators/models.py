"""Mean-by-count baseline and two-part regression on Spark ML."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpanel.functions.scalars import clip01
from gridpanel.operators.metrics import exact_mean, mean_by_count, melt_models, predict_by_count
from gridpanel.operators.prefix import prefix_sum, rank_pct
from gridpanel.operators.skew import salted_join
from gridpanel.session import broadcast_if_small, materialize

# Reference boosting settings in Spark ML terms (depth-wise trees, no L2 term).
DEFAULTS = {
    "occurrence": {"stepSize": 0.07, "maxIter": 160, "maxDepth": 5, "minInstancesPerNode": 80},
    "share": {"stepSize": 0.06, "maxIter": 210, "maxDepth": 5, "minInstancesPerNode": 55},
}
CANDIDATES = {
    "current_frozen": {
        "occurrence": {"stepSize": 0.08, "maxIter": 120, "maxDepth": 5, "minInstancesPerNode": 120},
        "share": {"stepSize": 0.07, "maxIter": 150, "maxDepth": 5, "minInstancesPerNode": 80},
    },
    "smaller_regularized_trees": {
        "occurrence": {"stepSize": 0.06, "maxIter": 160, "maxDepth": 4, "minInstancesPerNode": 200},
        "share": {"stepSize": 0.06, "maxIter": 200, "maxDepth": 4, "minInstancesPerNode": 140},
    },
    "slower_learning": {
        "occurrence": {"stepSize": 0.04, "maxIter": 240, "maxDepth": 5, "minInstancesPerNode": 80},
        "share": {"stepSize": 0.04, "maxIter": 300, "maxDepth": 5, "minInstancesPerNode": 55},
    },
    "larger_trees": {
        "occurrence": {"stepSize": 0.07, "maxIter": 160, "maxDepth": 5, "minInstancesPerNode": 80},
        "share": {"stepSize": 0.06, "maxIter": 210, "maxDepth": 5, "minInstancesPerNode": 55},
    },
    "moderate_complexity": {
        "occurrence": {"stepSize": 0.06, "maxIter": 180, "maxDepth": 5, "minInstancesPerNode": 150},
        "share": {"stepSize": 0.06, "maxIter": 220, "maxDepth": 5, "minInstancesPerNode": 100},
    },
}
SEED = 42
#: Rows of a partition of the feature matrix. A boosting round is a few short jobs, so small data stays in few tasks.
MATRIX_ROWS = 100_000
#: Fits that run side by side; each of their jobs takes a few tasks only.
PARALLEL_FITS = 10
#: Bins of a feature at most, as many as the trees look at.
BINS = 255


def side_by_side(spark: SparkSession, jobs: Sequence[Callable]) -> list:
    """Results of independent Spark jobs that are started from threads of their own.

    Without a fair scheduler the jobs still share the cores, as none fills them. The first error is raised once all have ended.
    """
    run = inheritable_thread_target(spark)
    with ThreadPoolExecutor(min(PARALLEL_FITS, max(len(jobs), 1))) as pool:
        waiting = [pool.submit(run(job)) for job in jobs]
    return [w.result() for w in waiting]


def feature_bins(values: DataFrame, features: Sequence[str], weight: str) -> Bucketizer:
    """Bins of every feature: one for each value if they are few, otherwise of about equal weight."""
    each = F.array(*[F.struct(F.lit(name).alias("column"), F.col(name).cast("double").alias("value")) for name in features])
    long = values.select(weight, F.inline(each)).dropna().groupBy("column", "value").agg(F.sum(weight).alias("n"))
    whole = long.groupBy("column").agg(F.sum("n").alias("_total"), F.count(F.lit(1)).alias("_values"))
    ranked = prefix_sum(long, ["value"], {"_before": F.col("n")}, ["column"]).join(whole, "column")
    slot = F.when(F.col("_values") <= BINS, F.col("value")).otherwise(F.floor(F.col("_before") * BINS / F.col("_total")).cast("double"))
    # at most BINS rows of each feature
    found = ranked.groupBy("column", slot.alias("slot")).agg(F.min("value").alias("low"), F.max("value").alias("high")).collect()
    splits = []
    for name in features:
        mine = sorted((r["low"], r["high"]) for r in found if r["column"] == name)
        # halfway between neighbours, where a tree would cut them
        cuts = [half if (half := (a[1] + b[0]) / 2) > a[1] else b[0] for a, b in zip(mine, mine[1:])]
        splits.append([-math.inf, *(cuts or [0.0]), math.inf])
    return Bucketizer(splitsArray=splits, inputCols=list(features), outputCols=[f"_bin_{name}" for name in features], handleInvalid="error")


def by_bins(dataset: DataFrame, bins: Bucketizer, outs: Sequence[str], transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``dataset`` with the columns ``outs`` that ``transform`` tells from its features.

    Rows of the same bins have the same estimates: ``transform`` gets one row for each combination that occurs, with features that lie in it.
    """
    keys, columns = bins.getOutputCols(), dataset.columns
    binned = bins.transform(dataset.drop(*keys))
    inside = [F.min(name).alias(name) for name in bins.getInputCols()]
    met = materialize(binned.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *inside))
    told = materialize(transform(met.drop("_n")).select(*keys, *outs))
    return salted_join(binned, broadcast_if_small(told), keys, "left", key_counts=met.select(*keys, "_n")).select(*columns, *outs)


class FeatureMatrix:
    """Binned features and labels of training rows, laid out once for any number of fits.

    Trees see the bins of a feature only, so rows that agree in all bins and the target are one row with a weight; how many there
    are hangs on the values that occur and not on the number of rows.
    """

    def __init__(self, dataset: DataFrame, features: Sequence[str], target: str, key: Sequence[str] = (), partitions: int | None = None):
        self.features, self.target, self.key = list(features), target, list(key)
        rows = dataset.select(*features, target)
        positive = F.col(target) > 0
        # rows of the same values first, so that bins are looked for and dealt out among few rows
        values = materialize(rows.groupBy(*features, target).agg(F.count(F.lit(1)).alias("_weight")))
        counts = values.agg(F.sum(F.when(positive, F.col("_weight"))).alias("p"), F.sum(F.when(~positive, F.col("_weight"))).alias("z")).first()
        self.positives, self.zeros = counts["p"] or 0, counts["z"] or 0
        if self.positives < 2 or self.zeros < 2:
            raise ValueError("hurdle model needs at least two zero and two positive targets")
        self.bins = feature_bins(values, self.features, "_weight")
        order = [*self.bins.getOutputCols(), target]
        grouped = materialize(self.bins.transform(values).groupBy(*order).agg(F.sum("_weight").cast("double").alias("_weight")))
        # a fixed layout makes the sampled split candidates, and so the trees, repeatable
        n = partitions or math.ceil(grouped.count() / MATRIX_ROWS)
        laid = grouped.repartition(n, *order).sortWithinPartitions(*order)
        self.assembler = VectorAssembler(inputCols=self.bins.getOutputCols(), outputCol="_features", handleInvalid="error")
        # bins come marked as categories, but they have an order
        ordered = [F.col(c).alias(c, metadata={}) for c in self.bins.getOutputCols()]
        labelled = laid.select(*ordered, target, "_weight", positive.cast("double").alias("_label"))
        self.rows = materialize(self.assembler.transform(labelled).select("_features", "_label", target, "_weight"))

    @staticmethod
    def weighted(settings: Mapping, total: int) -> dict:
        """The least number of rows in a leaf as the least share of the total weight."""
        least = settings.get("minInstancesPerNode", 1)
        if 2 * least > total:
            return {**settings, "minInstancesPerNode": 1, "maxDepth": 0}
        return {**settings, "minInstancesPerNode": 1, "minWeightFractionPerNode": (least - 0.5) / total}

    def occurrence(self, settings: Mapping, seed: int):
        """Fitted probability of a positive target."""
        told = self.weighted(settings, self.positives + self.zeros)
        return GBTClassifier(featuresCol="_features", labelCol="_label", weightCol="_weight", seed=seed, maxBins=BINS, **told).fit(self.rows)

    def share(self, settings: Mapping, seed: int) -> GBTRegressionModel:
        """Fitted share of the positive targets."""
        told = self.weighted(settings, self.positives)
        regressor = GBTRegressor(featuresCol="_features", labelCol=self.target, weightCol="_weight", seed=seed, maxBins=BINS, predictionCol="_share", **told)
        return regressor.fit(self.rows.where("_label = 1"))


def fit_hurdles(matrix: FeatureMatrix, models: Mapping[str, Mapping[str, Mapping]], seed: int = SEED) -> dict[str, "HurdleModelFitted"]:
    """Both parts of every model of ``models`` (name to settings), fitted side by side on one matrix, the longest first."""
    parts = [(name, part) for name in models for part in DEFAULTS]
    parts.sort(key=lambda p: -models[p[0]][p[1]]["maxIter"])
    fitted = side_by_side(matrix.rows.sparkSession, [lambda n=n, p=p: getattr(matrix, p)(models[n][p], seed) for n, p in parts])
    done = dict(zip(parts, fitted))
    pipeline = {n: PipelineModel([matrix.bins, matrix.assembler, done[n, "occurrence"]]) for n in models}
    return {n: HurdleModelFitted(matrix.features, n, pipeline[n], done[n, "share"]) for n in models}


class BaselineByCount(Estimator):
    """Training mean of the target per integer count."""

    def __init__(self, count: str, target: str, out: str = "baseline"):
        super().__init__()
        self.count, self.target, self.out = count, target, out

    def _fit(self, dataset: DataFrame) -> "BaselineByCountModel":
        # one row per distinct count and one overall mean
        table = materialize(mean_by_count(dataset, self.count, self.target))
        overall = dataset.agg(exact_mean(self.target)).first()[0]
        if overall is None:
            raise ValueError("baseline needs at least one training row")
        return BaselineByCountModel(self.count, self.out, table, overall)


class BaselineByCountModel(Model):
    def __init__(self, count: str, out: str, table: DataFrame, overall: float):
        super().__init__()
        self.count, self.out, self.table, self.overall = count, out, table, overall

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return predict_by_count(dataset, self.table, F.lit(self.overall), self.count, self.out)

    def save(self, path: str) -> None:
        spark = self.table.sparkSession
        self.table.write.mode("error").parquet(f"{path}/means")
        meta = [(self.count, self.out, self.overall)]
        spark.createDataFrame(meta, "count string, out string, overall double").coalesce(1).write.json(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "BaselineByCountModel":
        meta = spark.read.schema("count string, out string, overall double").json(f"{path}/meta").first()
        return cls(meta["count"], meta["out"], spark.read.parquet(f"{path}/means"), meta["overall"])


class HurdleModel(Estimator):
    """Probability of a positive target times the expected positive share."""

    def __init__(
        self, features: Sequence[str], target: str, params: Mapping[str, Mapping] | None = None,
        out: str = "hurdle", seed: int = SEED, key: Sequence[str] = (), partitions: int | None = None,
    ):
        super().__init__()
        self.features, self.target, self.out, self.seed = list(features), target, out, seed
        self.settings = {part: {**DEFAULTS[part], **(params or {}).get(part, {})} for part in DEFAULTS}
        self.key, self.partitions = list(key), partitions

    def _fit(self, dataset: DataFrame) -> "HurdleModelFitted":
        matrix = FeatureMatrix(dataset, self.features, self.target, self.key, self.partitions)
        return fit_hurdles(matrix, {self.out: self.settings}, self.seed)[self.out]


class HurdleModelFitted(Model):
    def __init__(self, features: Sequence[str], out: str, occurrence: PipelineModel, share: GBTRegressionModel):
        super().__init__()
        self.features, self.out, self.occurrence, self.share = list(features), out, occurrence, share

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return by_bins(dataset, self.occurrence.stages[0], [self.out], self.estimate)

    def estimate(self, binned: DataFrame) -> DataFrame:
        """``binned`` rows with their estimate."""
        told = binned
        for stage in self.occurrence.stages[1:]:
            told = stage.transform(told)
        chance = vector_to_array("probability")[1]
        both = self.share.transform(told)
        return both.withColumn(self.out, clip01(chance * clip01(F.col("_share")))).select(*binned.columns, self.out)

    def save(self, path: str, metadata: Mapping | None = None) -> None:
        self.occurrence.save(f"{path}/occurrence")
        self.share.save(f"{path}/share")
        meta = {"features": self.features, "out": self.out, **(metadata or {})}
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> tuple["HurdleModelFitted", dict]:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        occurrence = PipelineModel.load(f"{path}/occurrence")
        share = GBTRegressionModel.load(f"{path}/share")
        return cls(meta["features"], meta["out"], occurrence, share), meta


def refit(panel: DataFrame, estimator: Estimator, years: Sequence[int], year: str = "observation_year") -> Model:
    """Fit one fixed specification on the declared years only."""
    return estimator.fit(panel.where(F.col(year).isin([int(y) for y in years])))


def compare_candidates(
    train: DataFrame, validation: DataFrame, features: Sequence[str], target: str, key: Sequence[str], year: str,
    candidates: Mapping[str, Mapping] = CANDIDATES,
) -> DataFrame:
    """Scores of every declared configuration on the validation years, one row per model and key."""
    whole = {name: {part: {**DEFAULTS[part], **settings.get(part, {})} for part in DEFAULTS} for name, settings in candidates.items()}
    matrix = FeatureMatrix(train, features, target, key)
    models = fit_hurdles(matrix, whole).values()
    # all candidates share the bins of the matrix, so the validation rows are met and binned once for all of them
    estimates = [getattr(model, "estimate", model.transform) for model in models]  # of rows binned already
    scored = by_bins(validation, matrix.bins, list(candidates), lambda met: reduce(lambda df, told: told(df), estimates, met))
    return melt_models(scored.withColumnRenamed(target, "target"), [*dict.fromkeys([*key, year, "target"])], list(candidates))


def score(
    model: Model, matrix: DataFrame, forecast_year: int, model_id: str, method: str = "assignment_method"
) -> DataFrame:
    """Score table of one forecast year: estimate, rank, model id and status.

    A non-finite estimate or one outside [0, 1] is an error.
    """
    out = model.out
    predicted = model.transform(matrix)
    legal = F.col(out).isNotNull() & ~F.isnan(out) & F.col(out).between(0.0, 1.0)
    checked = predicted.withColumn("estimate", F.when(legal, F.col(out)).otherwise(F.raise_error(F.lit("estimate is not a share"))))
    return score_table(checked, forecast_year, model_id, method)


def score_table(predicted: DataFrame, forecast_year: int, model_id: str, method: str = "assignment_method") -> DataFrame:
    ranked = rank_pct(predicted.select("cell_id", "estimate", method), "estimate")
    return ranked.select(
        "cell_id", F.lit(forecast_year).alias("forecast_year"), F.lit(forecast_year - 1).alias("prediction_input_year"),
        "estimate", "rank_pct", method, F.lit(model_id).alias("model_id"), F.lit("published").alias("score_status"),
    )


def frozen_test(
    model: HurdleModelFitted, metadata: Mapping, held_out: DataFrame, features: Sequence[str], train_years: Sequence[int],
    year: str = "observation_year",
) -> DataFrame:
    """Predict held-out years with a stored model; never fits.

    The stored feature order and training years must be the declared ones, and no
    held-out row may come from a training year.
    """
    if list(metadata["features"]) != list(features):
        raise ValueError("stored feature order differs from the declared order")
    if list(metadata["train_years"]) != list(train_years):
        raise ValueError("stored training years differ from the declared years")
    clean = ~F.col(year).isin([int(y) for y in train_years])
    guarded = held_out.where(F.when(clean, True).otherwise(F.raise_error(F.lit("training year in held-out rows"))))
    return model.transform(guarded)


def prediction_table(pred: DataFrame, keys: Sequence[str], target: str, models: Sequence[str], year: str) -> DataFrame:
    return pred.select(*keys, (F.col(year) + 1).alias("outcome_year"), F.col(target).alias("target"), *models)


def reconcile_model_id(published: DataFrame, repeated: DataFrame, model_id: str) -> DataFrame:
    """New model id on the published scores, only if a repeated prediction is exactly equal."""
    from gridpanel.operators.compare import frame_differences

    columns = ["cell_id", "estimate"]
    if not frame_differences(published.select(*columns), repeated.select(*columns)).isEmpty():
        raise ValueError("repeated predictions differ; the model id must not change")
    return published.withColumn("model_id", F.lit(model_id))
