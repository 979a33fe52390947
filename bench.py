"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (names,
comma separated).  Each query is timed to its last row; results are not reused between queries.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tidemark.plans import load_all
from tidemark.plans.registry import PLANS

HEADLINE = (
    "quarter_end_date schema_contract audit_issues infer_frequency summary_stats fill_edges lag_features "
    "rolling_mean decompose_resid hp_filter regression_report two_phase_protocol arima_evaluate arima_grid "
    "sarima_evaluate arimax_evaluate window_regressor_evaluate garch_fit trend_fourier_evaluate acf ljung_box "
    "lag_gradient_boosting arena_leaderboard"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    spark.read.parquet(f"{folder}/nation.parquet").count()
    seconds = {}
    for name in names:
        begun = time.perf_counter()
        PLANS[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
