"""Tables whose keys have seven digits, where the SQL's cut ``cell_id`` is shared by several cells."""

import pytest
from pyspark.sql import functions as F

from gridpanel.catalog import all_queries
from gridpanel.catalog.views import Views, cut_id
from gridpanel.operators import compare as CM
from gridpanel.operators import models as MD
from tests.conftest import SF


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Two copies of the smallest tables; cells 100000 to 100019 share their ids with cells 1000000 to 1000199."""
    folder = tmp_path_factory.mktemp("wide")
    for name, key in (("part", "p_partkey"), ("lineitem", "l_partkey")):
        table = spark.read.parquet(f"{SF}/{name}.parquet")
        parts = [table.withColumn(key, (F.col(key) + shift).cast(table.schema[key].dataType)) for shift in (99_999, 999_999)]
        parts[0].unionByName(parts[1]).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_uncut_ids_are_unique_and_cut_back(spark, wide):
    cut, uncut = Views(spark, wide).cell(), Views(spark, wide, uncut=True).cell()
    assert cut.select("cell_id").distinct().count() < cut.count() == uncut.select("cell_id").distinct().count()
    back = uncut.withColumn("cell_id", cut_id()).select("k", "cell_id")
    assert back.exceptAll(cut.select("k", "cell_id")).isEmpty()
    assert Views(spark, SF, uncut=True).cell().exceptAll(Views(spark, SF).cell()).isEmpty()


def test_replaced_columns_keep_the_rows(spark, wide):
    pred = Views(spark, wide).pred()
    out = all_queries()["p24_replace_columns"](spark, wide)
    want = pred.withColumn("score_a", F.when(F.col("target") > 0, 2.0).otherwise(F.col("score_a"))).withColumn("touched", F.lit(0).cast("bigint"))
    assert out.count() == pred.count()
    assert CM.frame_differences(want.select(*out.columns), out).isEmpty()


def test_a_key_repeated_in_a_patch_is_an_error(spark):
    base = spark.createDataFrame([(1, 1.0), (2, 2.0), (None, 3.0)], "k int, v double")
    whole = CM.replace_columns(base, spark.createDataFrame([(2, 9.0), (None, 8.0), (None, 7.0)], "k int, v double"), ["k"], ["v"])
    assert sorted(r["v"] for r in whole.collect()) == [1.0, 3.0, 9.0]
    with pytest.raises(Exception, match="key repeated in the patch: 2"):
        CM.replace_columns(base, spark.createDataFrame([(2, 9.0), (2, 9.0)], "k int, v double"), ["k"], ["v"]).collect()


def test_the_annual_cycle_passes_its_gates(spark, wide, monkeypatch):
    """Cut ids stopped the cycle at the gate on repeated keys."""
    class Half:
        out = "hurdle"

        def transform(self, df):
            return df.withColumn("hurdle", F.lit(0.5))

    monkeypatch.setattr(MD, "fit_hurdles", lambda matrix, models, seed=0: {n: Half() for n in models})
    told = all_queries()["b6_annual_cycle"](spark, wide).first()
    assert told["violations"] == 0 and told["rows"] == told["ranked"] == 400
