"""Tables whose keys have more digits than the SQL's ids: cells share a cut id there."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from gridpanel.catalog.models_lookup import FEATURES, KEY
from gridpanel.catalog.views import Views
from gridpanel.operators import models as MD
from tests.conftest import SF
from tools.check import TABLES, compare

QUERIES = [
    "p2_tile_key",
    "k5_publish_with_geometry",
    "k1_write_panel",
    "k12_year_snapshot",
    "j3_join_core",
    "j17_evaluate_published",
    "q7_national_panel",
    "q7_gate_national",
    "q5_gate_screening",
    "q4_gate_forecast",
    "q3_gate_scoring",
    "q2_gate_model_frame",
    "q13_gate_mapping",
    "q10_gate_grid",
]


@pytest.fixture(scope="module")
def long_keys(spark, tmp_path_factory):
    """Three copies of the smallest tables; the last has keys on both sides of 1,000,000 that the cut makes equal to the second's."""
    folder = tmp_path_factory.mktemp("long_keys")
    for name in TABLES:
        key = {"part": "p_partkey", "lineitem": "l_partkey"}.get(name)
        if key is None:
            (folder / f"{name}.parquet").symlink_to(Path(SF) / f"{name}.parquet")
            continue
        table = spark.read.parquet(f"{SF}/{name}.parquet")
        shifted = table.withColumn("shift", F.explode(F.array(F.lit(0), F.lit(100_000), F.lit(999_950))))
        shifted.withColumn(key, F.col(key) + F.col("shift")).drop("shift").coalesce(1).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


def compared(spark, folder, name, sql):
    from __spark_entry__ import queries

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        there = "/*.parquet" if table in ("part", "lineitem") else ""
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet{there}')")
    return compare(spark, con, name, queries()[name], sql, folder)


@pytest.mark.parametrize("name", QUERIES)
def test_cells_that_share_a_cut_id(spark, long_keys, name):
    from __spark_entry__ import oracle_sql

    ok, detail = compared(spark, long_keys, name, oracle_sql()[name])
    assert ok, detail


def test_cells_that_share_a_cut_id_are_built_once_each(spark, long_keys):
    """Joined by cut ids their rows multiplied; the truth is the SQL with whole ids, cut in its result."""
    from __spark_entry__ import oracle_sql

    cut = "LPAD(CAST(p_partkey AS VARCHAR), 6, '0')"
    sql = oracle_sql()["b1_build_panel"]
    assert sql.count(cut) == 1
    whole = sql.replace(cut, "LPAD(CAST(p_partkey AS VARCHAR), GREATEST(6, LENGTH(CAST(p_partkey AS VARCHAR)))::INT, '0')")
    ok, detail = compared(spark, long_keys, "b1_build_panel", f"SELECT * REPLACE (LEFT(cell_id, 11) AS cell_id) FROM ({whole})")
    assert ok, detail


def test_the_panel_is_never_broadcast(spark):
    plan = Views(spark, SF).panel()._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 4


def test_candidates_meet_the_bins_once(spark, monkeypatch):
    """Every candidate used to bin, group and join the combinations again, each with a broadcast of its own."""
    rows = spark.range(400).select(
        F.col("id").cast("string").alias("cell_id"), F.lit(1998).alias("observation_year"), (F.col("id") % 7).alias("n_items"),
        (F.col("id") % 5).alias("size"), (F.col("id") % 11).alias("price"), (F.col("id") % 3).alias("events"),
        F.when(F.col("id") % 4 == 0, (F.col("id") % 9 + 1) / 10).otherwise(0.0).alias("target"),
    )
    settings = {"occurrence": {"maxIter": 2, "minInstancesPerNode": 2}, "share": {"maxIter": 2, "minInstancesPerNode": 2}}
    other = {part: {**s, "maxIter": 3} for part, s in settings.items()}
    called = []
    once = MD.by_bins
    monkeypatch.setattr(MD, "by_bins", lambda *args: called.append(1) or once(*args))
    found = MD.compare_candidates(rows, rows, FEATURES, "target", KEY, "observation_year", {"a": settings, "b": other, "c": settings})
    scores = {(r["cell_id"], r["model"]): r["score"] for r in found.collect()}
    assert called == [1] and len(scores) == 1200
    assert all(scores[str(i), "a"] == scores[str(i), "c"] for i in range(400)) and any(scores[str(i), "a"] != scores[str(i), "b"] for i in range(400))


def test_the_cells_of_the_climate_grid_are_never_broadcast(spark):
    assert "Broadcast" not in Views(spark, SF).clim()._jdf.queryExecution().executedPlan().toString()
