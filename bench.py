"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from spendframe.plans import catalog  # noqa: E402
from spendframe.session import build_session  # noqa: E402

HEADLINE = [
    "Q1_cost_page", "Q2_summary_provider", "Q2_summary_service", "Q3_daily_trend", "Q4_monthly_trend", "Q5_comparison",
    "Q6_top_resources", "Q7_filter_options", "Q9_auto_trend", "Q14_monthly_detail", "Q15_utilisation", "Q17_executive_overview",
    "Q22_category_daily", "G1_normalize", "P2_validation", "P17_corrections", "P19_high_cost", "S1_azure_csv", "S2_generic_csv",
    "S9_cost_table", "W123_features", "A5_forest_scores", "A6_A8_model_detection", "A12_alert_selection", "F1_F8_resample_daily",
    "F4_linear_forecast", "F6_additive_forecast", "F13_backtest", "B3_J3_budget_spend", "B4_budget_projection",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g", spark__sql__files__maxPartitionBytes="4m",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    queries = catalog.queries()
    queries["Q10_totals"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's engines
    times = {}
    for name in names:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(Path(sf_dir).name.removeprefix("sf") or 0),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
