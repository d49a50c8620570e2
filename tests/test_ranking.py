"""Prefix sums, ranks, quantiles and metrics on edge cases and partition counts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridpanel.operators import metrics as M
from gridpanel.operators import prefix as P
from gridpanel.operators.skew import salted_join


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_rank_pct_ties_and_partitions(spark, partitions):
    values = [10.0, 10.0, 20.0, 30.0] + [5.0] * 40 + [7.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").repartition(partitions)
    got = {r["i"]: r["rank_pct"] for r in P.rank_pct(df, "v").collect()}
    expected = pd.Series(values).rank(pct=True)
    assert all(abs(got[i] - e) < 1e-12 for i, e in enumerate(expected))


def test_rank_pct_one_row_and_nulls(spark):
    df = spark.createDataFrame([(1, 4.0), (2, None)], "i int, v double")
    assert {r["i"]: r["rank_pct"] for r in P.rank_pct(df, "v").collect()} == {1: 1.0, 2: None}


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_exact_quantiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n), 1)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    row = P.exact_quantiles(df, ["v"], {"a": 0.01, "b": 0.5, "c": 0.999}).first()
    for name, q in (("a", 0.01), ("b", 0.5), ("c", 0.999)):
        assert abs(row[name] - np.quantile(values, q)) < 1e-9


def test_nearest_rank_is_half_even(spark):
    for values, expected in (([0, 1], 0), ([0, 1, 2, 3], 2)):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        assert P.nearest_rank_quantiles(df, ["v"], {"m": 0.5}).first()["m"] == expected


def test_even_sample_matches_linspace(spark):
    df = spark.range(237)
    got = sorted(r["id"] for r in P.even_sample(df, 50, ["id"]).collect())
    assert got == sorted(set(np.linspace(0, 236, num=50, dtype=int).tolist()))
    assert P.even_sample(df, 1000, ["id"]).count() == 237


def test_stratified_sample_keeps_every_stratum(spark):
    df = spark.range(300).select(F.col("id").alias("cell"), (F.col("id") % 3).alias("year"))
    out = P.stratified_sample(df, "year", 10, ["cell", "year"], seed=1)
    assert {r["year"]: r["count"] for r in out.groupBy("year").count().collect()} == {0: 10, 1: 10, 2: 10}
    again = P.stratified_sample(df.repartition(7), "year", 10, ["cell", "year"], seed=1)
    assert out.exceptAll(again).isEmpty()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(500).select(F.when(F.col("id") < 200, 1).otherwise(F.col("id") % 40).alias("k"), "id")
    right = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain, salted = left.join(right, ["k"], how), salted_join(left, right, ["k"], how, rows_per_split=16)
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, salted.select(plain.columns).collect()), key=repr)


def scoped(spark, rows):
    return spark.createDataFrame(rows, "cell_id string, observation_year int, score double, target double").withColumn("model", F.lit("m"))


def brute_capture(rows, fraction):
    frame = pd.DataFrame(rows, columns=["c", "y", "s", "t"]).sort_values(["s", "c", "y"], ascending=[False, True, True])
    head = frame.head(int(np.ceil(fraction * len(frame))))
    return None if not (frame.t > 0).any() else (head.t > 0).sum() / (frame.t > 0).sum()


@pytest.mark.parametrize("fraction", [0.2, 0.5, 1.0])
def test_capture_and_ranking_edges(spark, fraction):
    rng = np.random.default_rng(3)
    cases = {
        "ties": [(f"c{i}", 2000, float(i % 3), float(rng.random() < 0.3)) for i in range(40)],
        "equal": [(f"c{i}", 2000 + i % 2, 1.0, float(i % 4 == 0)) for i in range(21)],
        "none": [(f"c{i}", 2000, float(i), 0.0) for i in range(9)],
        "one": [("c", 2000, 0.5, 1.0)],
    }
    for rows in cases.values():
        df = scoped(spark, rows)
        got = M.capture_at(df, fraction, ["model"], ["cell_id", "observation_year"]).first()["capture"]
        want = brute_capture(rows, fraction)
        assert (got is None and want is None) or abs(got - want) < 1e-12
        ranked = M.tie_aware_ranking(df, fraction, ["model"]).first()
        assert abs(ranked["selected_rows"] - fraction * len(rows)) < 1e-9
        if fraction == 1.0 and want is not None:
            assert abs(ranked["positive_capture"] - 1) < 1e-12 and abs(ranked["lift"] - 1) < 1e-12
        if want is None:
            assert ranked["positive_capture"] is None and ranked["lift"] is None


def test_binned_comparison_drops_repeated_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0)] * 8 + [(0.5, 1.0), (1.0, 1.0)], "s double, t double")
    rows = M.binned_comparison(df, "s", "t", bins=4).collect()
    assert sum(r["cell_count"] for r in rows) == 10 and len(rows) <= 2
