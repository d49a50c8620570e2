"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Every query
runs in full; its rows are consumed by Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "b0_recurrence_ranking",
    "a1_recurrence",
    "j15_target_shift",
    "a10_describe",
    "a20_regression_metrics",
    "a22_tie_aware_ranking",
    "w1_rank_pct",
    "a7_zonal_mode",
    "a6_zonal_mean",
    "g17_terrain_slope",
    "g6_clip_to_cell",
    "a2_burn_share",
    "j5_spatial_join",
    "j7_knn_nearest",
    "j9_fill_from_mapping",
    "j16_lookup_job",
    "b5_screening",
    "q1_gate_panel",
)


def main() -> None:
    from gridpanel.catalog import all_queries
    from gridpanel.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, max(8, int(cpus)) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, spent = all_queries(), {}
    # start the Python workers and the JVM once, outside the timings
    spark.range(64).repartition(8).mapInPandas(lambda batches: batches, "id long").count()
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)
        print(name, spent[name], file=sys.stderr, flush=True)
    total = round(sum(spent.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": spent, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
