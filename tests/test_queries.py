"""Registered queries beside their SQL at the smallest scale; the check tool runs all of them."""

import pytest

from gridpanel.catalog import all_queries, all_sql
from tests.conftest import SF
from tools.check import compare

FAST = [
    "p2_tile_key", "p6_assign_reference", "a1_recurrence", "w1_rank_pct", "w8_even_sample", "a17_recurrence_thresholds",
    "a20_regression_metrics", "a21_capture_at", "a22_tie_aware_ranking", "a7_zonal_mode", "a5_season_total", "g17_terrain_slope",
    "a2_burn_share", "j5_spatial_join", "j7_knn_nearest", "x4_frames_close", "s3_access_audit", "k1_write_panel", "t2_recurrence_stream",
]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, duck, name):
    ok, detail = compare(spark, duck, name, all_queries()[name], all_sql()[name], SF)
    assert ok, detail


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
