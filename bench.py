"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]

Every query is run once; its rows are consumed by a no-op sink, so the whole result is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from millrace import build_session
from millrace.plans.catalogue import QUERIES

HEADLINE = [
    "join_chain", "join_outer", "join_null_keys", "sql_groupby", "sql_window", "sql_cube", "sql_asof",
    "clean_dedupe_sentinels", "clean_casts", "clean_full", "impute_trend", "impute_median_mode", "bins_quantile",
    "smooth_keyed", "smooth_global", "row_index", "filters", "diff_std_pct", "latest_per_entity", "last_n_per_entity",
    "trend_slope", "resample_days", "first_seen_texts", "column_profile",
    "kpi_sales_forecasting", "kpi_predictive_maintenance", "loc_to_loc", "time_to_time", "money_impact_plant", "star_fact",
    "features_predictive_maintenance", "features_sales_forecasting", "board_share", "board_pareto", "board_hist", "board_corr",
    "duplicate_rows", "quality_outliers", "quantiles", "quality_jumps", "quality_physics", "assoc_highs",
    "itemsets", "rules", "kmeans", "pca", "iforest_summary", "dbscan_summary", "knn_join", "iterative_impute", "forecast",
    "model_LinearRegression", "model_DecisionTreeClassifier", "model_XGBClassifier", "model_LGBMRegressor", "knn_outliers", "forecast_seasonal_by_series",
    "keyword_topk", "keyword_topk_many", "cosine_topk", "register_decode", "live_latest_stream", "live_alerts_stream",
    "weekly_briefs", "top3_actions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM side before the first measured query.
    spark.read.parquet(f"{folder}/nation.parquet").groupBy("n_regionkey").count().collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
