"""Time the headline queries and print one JSON line.

Every query is computed in full (written to a sink that drops the rows) and starts with an empty
cache, so intermediates shared inside one query are never carried over to the next.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from quaymart.queries import QUERIES  # noqa: E402
from quaymart.session import local_session  # noqa: E402

HEADLINE = [
    "a1_daily_demand", "a5_lead_time_stats", "a7_vendor_profile", "a12_linear_trend", "a13_demand_class", "a18_profile_with_copies",
    "w1_trend_momentum", "w7_autocorrelation", "w13_customer_order_gaps", "c10_row_ids", "j9_latest_record",
    "x2_outlier_rows", "x7_correlation_pairs", "x15_master_set", "b0_behaviour_pack", "b6_item_day_panel", "b8_promotion_sensitivity",
    "f1_forecast_accuracy", "f3_seasonal_baseline", "k3_reorder_point", "k7_vendor_scores", "k10_purchase_orders",
    "d4_index_score", "d10_quadrants", "d16_traction_friction", "m2_threshold_search", "m4_auc",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_PARTITIONS", cpus if cpus.isdigit() else "8")))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["s4_parquet_scan"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        spark.catalog.clearCache()
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
