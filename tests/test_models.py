"""Registered model queries fit what is declared; the fits themselves are replaced, as they take long."""

import pytest
from pyspark.sql import functions as F

from gridpanel.catalog import all_queries
from gridpanel.operators import models as MD
from tests.conftest import SF


class Seen(Exception):
    pass


class Constant:
    def __init__(self, out):
        self.out = out

    def transform(self, df):
        return df.withColumn(self.out, F.lit(0.5))


@pytest.fixture
def fitted(monkeypatch):
    settings = {}

    def note(matrix, models, seed=MD.SEED):
        settings.update(models)
        if "hurdle" in models:
            raise Seen
        return {n: Constant(n) for n in models}

    monkeypatch.setattr(MD, "fit_hurdles", note)
    return settings


@pytest.mark.parametrize("name", ["m2_hurdle_model", "m5_refit", "m6_save_load_identical", "m7_score", "m8_frozen_test", "b6_annual_cycle"])
def test_all_declared_rounds(spark, fitted, name):
    with pytest.raises(Seen):
        all_queries()[name](spark, SF)
    assert fitted["hurdle"] == MD.DEFAULTS and all(s == MD.DEFAULTS for s in fitted.values())


@pytest.mark.parametrize("name", ["m4_compare_candidates", "b6_select_model"])
def test_all_declared_candidates(spark, fitted, name):
    all_queries()[name](spark, SF)
    assert fitted == {n: {part: {**MD.DEFAULTS[part], **s[part]} for part in s} for n, s in MD.CANDIDATES.items()}
    assert len(fitted) == 5


def matrix_rows(spark, n=400):
    x = F.col("id") % 20
    share = F.when(x >= 10, (x - 9) / 20.0).otherwise(0.0)
    return spark.range(n).select("id", x.cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("z"), share.alias("y"))


SMALL = {
    "one": {"occurrence": {"maxIter": 3, "maxDepth": 2, "stepSize": 0.3}, "share": {"maxIter": 4, "maxDepth": 3, "stepSize": 0.3}},
    "two": {"occurrence": {"maxIter": 5, "maxDepth": 1, "stepSize": 0.1}, "share": {"maxIter": 2, "maxDepth": 2, "stepSize": 0.5}},
}


def test_fits_side_by_side_equal_single_fits(spark):
    rows = matrix_rows(spark)
    both = MD.fit_hurdles(MD.FeatureMatrix(rows, ["x", "z"], "y", ["id"]), SMALL)
    for name, model in both.items():
        alone = MD.fit_hurdles(MD.FeatureMatrix(rows, ["x", "z"], "y", ["id"]), {name: SMALL[name]})[name]
        a, b = (sorted((r["id"], r[name]) for r in m.transform(rows).collect()) for m in (model, alone))
        assert a == b and len({v for _, v in a}) > 2
        assert all(v == 0 for i, v in a if i % 20 < 5) or max(v for i, v in a if i % 20 < 5) < min(v for i, v in a if i % 20 > 15)
        assert len(model.occurrence.stages[-1].trees) == SMALL[name]["occurrence"]["maxIter"]


def test_compared_candidates_are_long_rows(spark):
    rows = matrix_rows(spark)
    told = MD.compare_candidates(rows.withColumn("t", F.lit(1)), rows.withColumn("t", F.lit(2)), ["x", "z"], "y", ["id"], "t", SMALL)
    assert told.groupBy("model").count().collect() and {(r["model"], r["count"]) for r in told.groupBy("model").count().collect()} == {("one", 400), ("two", 400)}


def test_matrix_needs_both_kinds_of_targets(spark):
    with pytest.raises(ValueError, match="two positive"):
        MD.FeatureMatrix(matrix_rows(spark).where("y = 0"), ["x"], "y", ["id"])


def test_an_error_of_one_job_is_raised(spark):
    def bad():
        raise KeyError("no")

    assert MD.side_by_side(spark, [lambda: spark.range(3).count(), lambda: 5]) == [3, 5]
    assert MD.side_by_side(spark, []) == []
    with pytest.raises(KeyError):
        MD.side_by_side(spark, [bad, lambda: 1])


def test_equal_rows_are_one_row_with_a_weight(spark):
    """Copies of a table lengthen no fit and change no tree."""
    # squares leave no two cuts equally good
    rows = matrix_rows(spark).withColumn("y", F.col("y") * F.col("y"))
    many = rows.withColumn("id", F.explode(F.array(*[F.col("id") + 400 * i for i in range(5)])))
    one, five = (MD.FeatureMatrix(df, ["x", "z"], "y", ["id"]) for df in (rows, many))
    assert one.rows.count() == five.rows.count() == 60
    assert "not in" not in one.share(SMALL["one"]["share"], 1).toDebugString
    settings = {part: {**s, "minInstancesPerNode": 30} for part, s in SMALL["one"].items()}
    wider = {part: {**s, "minInstancesPerNode": 150} for part, s in settings.items()}
    a = MD.fit_hurdles(one, {"m": settings})["m"].transform(rows).select("id", "m").collect()
    b = MD.fit_hurdles(five, {"m": wider})["m"].transform(rows).select("id", "m").collect()
    assert {r["id"]: round(r["m"], 12) for r in a} == {r["id"]: round(r["m"], 12) for r in b}


def test_least_rows_of_a_leaf_are_counted_by_weight(spark):
    matrix = MD.FeatureMatrix(matrix_rows(spark), ["x"], "y", ["id"])
    parts = lambda least: matrix.occurrence({"maxIter": 1, "maxDepth": 5, "minInstancesPerNode": least}, 1).trees[0].numNodes
    assert parts(200) == 3 and parts(201) == 1 and parts(500) == 1


def test_bins_of_many_values_hold_equal_weight(spark):
    rows = spark.range(10_000).select((F.col("id") * 1.0).alias("x"), (F.col("id") % 7).cast("double").alias("z"), F.lit(1).alias("w"))
    bins = MD.feature_bins(rows, ["x", "z"], "w")
    sizes = [r["count"] for r in bins.transform(rows).groupBy("_bin_x").count().collect()]
    assert len(sizes) == MD.BINS and max(sizes) - min(sizes) <= 1
    assert [r["count"] for r in bins.transform(rows).groupBy("_bin_z").count().orderBy("_bin_z").collect()] == [1429] * 4 + [1428] * 3


def test_rows_of_the_same_bins_are_scored_once(spark):
    rows = matrix_rows(spark)
    matrix = MD.FeatureMatrix(rows, ["x", "z"], "y", ["id"])
    seen = []
    told = MD.by_bins(rows, matrix.bins, ["s"], lambda met: seen.append(met.count()) or met.withColumn("s", F.col("x") * 10 + F.col("z")))
    assert seen == [60] and told.columns == [*rows.columns, "s"]
    assert told.where("s <=> x * 10 + z").count() == 400
    with pytest.raises(Exception):
        MD.fit_hurdles(matrix, {"m": SMALL["one"]})["m"].transform(rows.withColumn("x", F.when(F.col("id") > 0, F.col("x")))).collect()
