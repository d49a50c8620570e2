"""What must be refused or reported: lost rows, broken inputs, disorder; and kernels on executors."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridpanel.operators import climate as C
from gridpanel.operators import nearest as N
from gridpanel.operators.prefix import order_violations
from gridpanel.operators.screening import screening_core
from gridpanel.plans.panel import component_tables
from gridpanel.sinks.publish import scratch_path, write_report_tables
from gridpanel.sources import tables as TB
from tests.conftest import SF


def test_unparsed_years_are_errors(spark):
    layer = spark.createDataFrame([(1, "1997"), (2, "19x7")], "poly_id int, Ano string")
    with pytest.raises(PySparkException, match="no year"):
        TB.split_archive_by_year(layer, "Ano").collect()
    assert TB.split_archive_by_year(layer.where("poly_id = 1"), "Ano", 1997).count() == 1


def test_boundaries_are_unique(spark):
    rows = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "z")], "level string, unit string")
    with pytest.raises(ValueError, match="exactly one"):
        TB.boundary_select(rows, "level", "A", "unit")
    with pytest.raises(ValueError, match="exactly one"):
        TB.boundary_select(rows, "level", "C", "unit")
    with pytest.raises(ValueError, match="several rows"):
        TB.boundary_select(rows.union(rows.where("unit = 'x'")), "level", "B", "unit")
    chosen, units = TB.boundary_select(rows, "level", "B", "unit")
    assert chosen.count() == 1 and units.count() == 3


def test_disorder_across_partitions(spark):
    one = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key int").coalesce(1)
    assert order_violations(one(5, 6).union(one(1, 2)), "key").count() == 1
    assert order_violations(one(1, 2).union(one(2, 3)), "key").count() == 1
    assert order_violations(one(1, 2).union(one(3, 4)).union(one(5)), "key").count() == 0


def test_other_months_are_not_ready(spark):
    def table(months):
        rows = [(0, i, 2000, m, 1.0) for i in (0, 1) for m in months]
        return spark.createDataFrame(rows, "lat_idx int, lon_idx int, year int, month int, t double")

    ready = lambda months: [r["ready"] for r in C.climate_contract(table(months), ["t"]).collect()]
    assert ready((6, 7, 8, 9)) == [True] and ready((1, 2, 3, 4)) == [False] and ready((6, 7, 8)) == [False]


def test_source_masked_in_part(spark):
    cells = spark.createDataFrame([("a", 1, 2000), ("b", 2, 2000), ("c", 3, 2000)], "cell_id string, sid int, year int")
    mapping = spark.createDataFrame([("b", 1)], "cell_id string, fallback_sid int")
    climate = spark.createDataFrame([(1, 2000, 1.0, 2.0), (2, 2000, None, None)], "sid int, year int, t double, p double")
    told = {r["cell_id"]: (r["t"], r["assignment_method"]) for r in N.fill_from_mapping(cells, climate, mapping, ["t", "p"]).collect()}
    assert told == {"a": (1.0, "containing_source"), "b": (1.0, "nearest_valid_source"), "c": (None, "unassigned")}
    half = climate.withColumn("p", F.when(F.col("sid") == 1, None).otherwise(F.col("p")))
    with pytest.raises(PySparkException, match="masked in part"):
        N.fill_from_mapping(cells, half, mapping, ["t", "p"]).collect()


def test_lacking_component(spark):
    part = lambda name, *keys: spark.createDataFrame([(k, 1) for k in keys], f"cell_id string, {name} int")
    area = spark.createDataFrame([("a",), ("b",)], "cell_id string")
    assert screening_core(part("r", "a", "b"), part("c", "a", "b"), part("s", "a", "b"), area).count() == 2
    with pytest.raises(PySparkException, match="lacks land cover"):
        screening_core(part("r", "a", "b"), part("c", "a"), part("s", "a", "b"), area).collect()


def test_folder_without_manifest_is_refused(spark):
    df = spark.range(5)
    folder = scratch_path(spark, "guarded")
    df.write.parquet(f"{folder}/x")
    with pytest.raises(FileExistsError):
        component_tables({"x": df}, folder)
    other = scratch_path(spark, "guarded")
    assert component_tables({"x": df}, other)["x"]["status"] == "created"
    spark.range(9).write.mode("overwrite").parquet(f"{other}/x")
    with pytest.raises(ValueError, match="manifest"):
        component_tables({"x": df}, other)


def test_large_reports_are_refused(spark):
    with pytest.raises(ValueError, match="more than"):
        write_report_tables({"big": spark.range(11)}, scratch_path(spark, "report"), max_rows=10)


def test_kernels_reach_workers_from_elsewhere(tmp_path):
    """Queries with Python kernels, started in another folder and without an import path."""
    root = Path(__file__).resolve().parent.parent
    code = (
        "import importlib.util, sys\n"
        f"spec = importlib.util.spec_from_file_location('entry', {str(root / '__spark_entry__.py')!r})\n"
        "entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"print('rows', [entry.queries()[n](spark, {SF!r}).count() for n in ('g3_repair_polygons', 'g8_union_area')])\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows [" in done.stdout, done.stderr[-2000:]
