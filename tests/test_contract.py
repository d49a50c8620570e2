"""Time rules, contract gates, publication, requests and streams on small fixtures."""

import datetime

import pytest
from pyspark.sql import functions as F

from gridpanel.contract import NATIONAL_DESIGN, NATIONAL_PANEL
from gridpanel.functions import scalars as S
from gridpanel.functions import years as Y
from gridpanel.operators import climate as C
from gridpanel.operators import gates as GT
from gridpanel.operators import lookup as L
from gridpanel.sinks import publish as K
from gridpanel.streaming import streams as ST


def panel(spark, years=(2015, 2016), cells=("A", "B"), **changes):
    values = {
        "built_up_share": 0.1, "forest_shrub_share_2km": 0.5, "mean_slope_2km": 10.0, "fire_years_previous_10y_2km": 2.0,
        "warm_season_mean_2m_temperature_c": 20.0, "warm_season_total_precipitation_mm": 50.0, "warm_season_mean_soil_water_layer1": 0.2,
        "warm_season_max_monthly_2m_temperature_c": 25.0, "warm_season_min_monthly_soil_water_layer1": 0.1, "burned_share_next_year": 0.0, **changes,
    }
    rows = []
    for c in cells:
        for t in years:
            ref = 2006 if t <= 2015 else 2012
            meta = (t + 1, t - 10, t - 1, t, ref, f"r{ref}", "2020-01-01", "dem")
            rows.append((f"{c}_{t}", c, t, *meta, *[values[n] for n in [*NATIONAL_PANEL.feature_names, "burned_share_next_year"]]))
    return spark.createDataFrame(rows, NATIONAL_PANEL.schema())


def keys(spark):
    return spark.createDataFrame([(c, t) for c in "AB" for t in (2015, 2016)], "cell_id string, observation_year int")


def test_clean_panel_has_no_violations(spark):
    out = GT.gate_panel(panel(spark), NATIONAL_PANEL, NATIONAL_DESIGN, keys(spark))
    assert out.isEmpty()
    GT.enforce(out)


def test_panel_gate_reports_each_fault(spark):
    faults = {
        "above_built_up_share": panel(spark, built_up_share=1.1),
        "integral_fire_years_previous_10y_2km": panel(spark, fire_years_previous_10y_2km=1.5),
        "joint_climate_mask": panel(spark, warm_season_mean_2m_temperature_c=None),
        "duplicate_key": panel(spark).unionByName(panel(spark, years=(2015,), cells=("A",))),
        "key_set": panel(spark, cells=("A",)),
        "land_cover_year": panel(spark).withColumn("land_cover_reference_year", F.lit(2018)),
    }
    for name, df in faults.items():
        gates = {r["gate"] for r in GT.gate_panel(df, NATIONAL_PANEL, NATIONAL_DESIGN, keys(spark)).collect()}
        assert name in gates, (name, gates)
    with pytest.raises(ValueError, match="above_built_up_share"):
        GT.enforce(GT.gate_panel(faults["above_built_up_share"], NATIONAL_PANEL, NATIONAL_DESIGN, keys(spark)))


def test_range_tolerance_of_panel_and_model_gates(spark):
    df = panel(spark, built_up_share=1.0 + 5e-10)
    assert GT.gate_panel(df, NATIONAL_PANEL, NATIONAL_DESIGN, keys(spark)).isEmpty()
    strict = GT.gate_model_frame(df, NATIONAL_PANEL, NATIONAL_DESIGN, (2015, 2016)).collect()
    assert {r["gate"] for r in strict} == {"above_built_up_share"}


def test_source_years_and_references(spark):
    df = spark.createDataFrame([(t,) for t in (2010, 2014, 2015, 2016, 2019, 2023)], "t int")
    got = {r["t"]: (r["history_start_year"], r["history_end_year"], r["land_cover_reference_year"], r["outcome_year"]) for r in Y.source_years(df, "t", NATIONAL_DESIGN).collect()}
    assert got[2010] == (2000, 2009, 2006, 2011) and got[2015][2] == 2006 and got[2016][2] == 2012 and got[2019][2] == 2018
    with pytest.raises(Exception, match="outside the time design"):
        Y.source_years(spark.createDataFrame([(2009,)], "t int"), "t", NATIONAL_DESIGN).collect()


def test_forecast_years(spark):
    row = Y.forecast_years(spark.createDataFrame([(2026,)], "y int"), "y").first()
    assert (row["predictor_year"], row["latest_label_year"], row["latest_outcome_year"], row["history_start_year"], row["history_end_year"]) == (2025, 2024, 2025, 2015, 2024)


def test_season_total_of_constant_rain(spark):
    rows = [(0, 0, 2000, m, 0.001) for m in (6, 7, 8, 9)] + [(0, 1, 2000, m, None) for m in (6, 7, 8, 9)]
    rows += [(0, 2, 2000, m, None if m == 6 else 0.001) for m in (6, 7, 8, 9)]
    df = spark.createDataFrame(rows, "lat_idx int, lon_idx int, year int, month int, tp double")
    got = {r["lon_idx"]: r["mm"] for r in C.season_total(df, "tp", "mm").collect()}
    assert abs(got[0] - 122.0) < 1e-9 and got[1] is None and abs(got[2] - 92.0) < 1e-9
    nan = spark.createDataFrame([(0, 0, 2000, 6, float("nan"))], "lat_idx int, lon_idx int, year int, month int, tp double")
    assert C.clean(nan, ["tp"]).first()["tp"] is None


def test_bands_are_right_closed(spark):
    df = spark.createDataFrame([(0.50,), (0.51,), (0.80,), (0.81,)], "p double")
    assert [r["l"] for r in df.select(S.band3(F.col("p"))["label"].alias("l")).collect()] == ["lower", "intermediate", "intermediate", "higher"]


def test_requests_and_shared_edges(spark):
    cells = spark.createDataFrame([("A", 0, 0, 0.1, 0.4, 1.0), ("B", 1, 0, 0.3, 0.9, 3.0)], "cell_id string, ix int, iy int, estimate double, rank_pct double, history double")
    asked = spark.createDataFrame(
        [(1, 500.0, 500.0, "1"), (2, 10000.0, 10000.0, "1"), (3, 500.0, 500.0, "1,1"), (4, 1000.0, 500.0, "0.1"), (5, 1.0, 1.0, "0"), (6, 1.0, 1.0, "11"), (7, 1.0, 1.0, "x")],
        "event_id int, x double, y double, buffers_km string",
    )
    got = {r["event_id"]: r for r in L.lookup_job(asked, cells, 1000).collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: 200, 2: 404, 3: 422, 4: 200, 5: 422, 6: 422, 7: 422}
    assert got[1]["cell_id"] == "A" and got[1]["contexts"][0]["cell_ids"] == ["A", "B"]
    assert got[4]["cell_id"] == "A" and abs(got[4]["contexts"][0]["higher_area_share"] - 0.5) < 1e-9
    disc = got[4]["contexts"][0]["intersected_area_sq_km"]
    assert abs(disc / (3.141592653589793 * 0.01) - 0.9984) < 2e-4


def test_publish_once_reuse_refuse_replace(spark, tmp_path):
    df, path = spark.range(20).withColumn("v", F.col("id") / 3), str(tmp_path / "out")
    assert K.publish(df, path, "c")["status"] == "created"
    assert K.publish(df.repartition(3), path, "c")["status"] == "reused"
    with pytest.raises(FileExistsError):
        K.publish(df.limit(5), path, "c")
    assert K.publish(df.withColumn("v", F.col("v") + 1), path, "c", replace=True)["status"] == "created"
    assert K.verify_published(spark, path).isEmpty()
    (tmp_path / "out.manifest.json").unlink()
    with pytest.raises(FileExistsError, match="half-written"):
        K.publish(df, path, "c")


def test_recurrence_stream_ignores_repeats_and_equals_batch(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(i, i % 3, base + datetime.timedelta(hours=i)) for i in range(200)]
    df = spark.createDataFrame(rows + rows[:20], "event_id int, cell int, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    ST.write_stream(ST.recurrence_stream(stream, "cell", "event_id"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = ST.recurrence_batch(df, "cell", "event_id").where(F.col("window_start") <= F.lit(base + datetime.timedelta(hours=199) - datetime.timedelta(days=3)))
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).isEmpty()
