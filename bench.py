"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from segspark import get_spark, plans  # noqa: E402

HEADLINE = [
    "theil_decomposition", "theil_decomposition_open_groups", "theil_focal_split", "metro_decomposition_rolled",
    "nested_hierarchy", "seg_explained", "age_nested_hierarchy", "change_from_baseline", "local_entropy",
    "erasure_creation", "density_curve", "binomial_counts", "metro_model_frame", "paired_cells",
    "overlay_join", "overlay_area_rings", "largest_overlap_assign", "queen_adjacency", "win_share", "row_id",
    "layout_check", "ols_multi", "quantiles_by_group", "permutation_null", "permutation_null_stratified",
    "permutation_null_drawn", "permutation_null_drawn_stratified",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file:{tempfile.mkdtemp(prefix='bench-')}"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = plans.load()
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority").count().collect()
    # One whole query first, so that no timing below pays for starting up.
    queries["theil_h"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
