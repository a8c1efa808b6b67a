"""Plan shapes that keep the queries scalable."""

import re
from datetime import datetime

import pytest
from conftest import SF
from pyspark.sql import functions as F

from spendframe.operators import features, filters, trends
from spendframe.plans import catalog
from spendframe.schema import COST_SCHEMA
from spendframe.sources import csv_headers, store


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in catalog.queries() if n[0] in "QPW" or n.startswith("J")))
def test_no_cartesian_products(spark, name):
    plan = _plan(catalog.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan
    if name != "P8_reject_report":  # puts a one-row count next to at most five rows
        assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["Q1_cost_page", "Q6_top_resources", "J5_top_services_costs", "Q12_anomaly_list"])
def test_top_rows_are_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in _plan(catalog.queries()[name](spark, SF))


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(catalog.queries()["P14_month_filter"](spark, SF))
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan
    assert "l_partkey" not in plan and "p_type" not in plan


def test_no_python_in_sql_queries(spark):
    for name in ("Q2_summary_service", "Q9_auto_trend", "Q22_category_daily", "P2_validation", "S2_generic_csv", "A6_A8_spike_rule"):
        plan = _plan(catalog.queries()[name](spark, SF))
        assert "Python" not in plan and "Pandas" not in plan


def _stored_costs(spark, path, months=12):
    rows = [(m % 3, float(m), datetime(2024 + (m - 1) // 12, (m - 1) % 12 + 1, 5)) for m in range(1, months + 1)]
    costs = spark.createDataFrame(rows, "user_id bigint, cost double, usage_start_date timestamp_ntz")
    for field in COST_SCHEMA:
        if field.name not in costs.columns:
            costs = costs.withColumn(field.name, F.lit(None).cast(field.dataType))
    store.append_costs(costs.withColumn("billing_period", F.lit(None).cast("string")), path)
    return store.read_costs(spark, path)


def _partition_filters(frame):
    return frame._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_date_filters_prune_months(spark, tmp_path):
    stored = _stored_costs(spark, str(tmp_path / "costs"))
    for rows, n in ((filters.in_month(stored, "2024-03"), 1), (filters.between_dates(stored, "2024-02-05", "2024-04-04"), 2),
                    (filters.last_days(stored, "2024-06-05", 31), 2), (filters.in_year(stored, "2024-06-05"), 12), (filters.this_month(stored, "2024-06-05"), 1),
                    (filters.in_month(stored, "2024-03", days_before=30), 2)):
        assert rows.count() == n and "billing_period" in _partition_filters(rows)
    trend = trends.auto_trend(stored, month="2024-03")
    assert trend.count() == 1 and "billing_period" in _partition_filters(trend)
    daily = trends.category_daily(stored, "2024-03")
    assert daily.count() == 1 and "billing_period" in _partition_filters(daily)


def test_other_periods_lose_no_rows(spark):
    """A period that is missing or not the start date's month bounds nothing."""
    rows = [(1, 1.0, datetime(2024, 3, 5), p) for p in (None, "2024-03", "2023-01", "2025-01")]
    costs = spark.createDataFrame(rows, "user_id int, cost double, usage_start_date timestamp_ntz, billing_period string")
    assert [frame.count() for frame in (
        filters.in_month(costs, "2024-03"), filters.between_dates(costs, "2024-03-01", "2024-03-31"), filters.last_days(costs, "2024-03-20", 30),
        filters.in_year(costs, "2024-03-20"), filters.this_month(costs, "2024-03-20"))] == [4] * 5


def test_detection_reads_the_last_months(spark, tmp_path):
    stored = _stored_costs(spark, str(tmp_path / "costs"), 24)
    assert features.months_with_history(stored, 90) == ["2025-07", "2025-08", "2025-09", "2025-10", "2025-11", "2025-12"]
    current = stored.where("user_id = 0")
    series = features.detection_series(current)
    assert len(re.findall(r"\d{4}-\d\d", _partition_filters(series))) <= 5 and series.count() == 0
    every = features.daily_series(stored)
    assert every.count() == 24


def test_headers_are_found_without_a_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text("service,cost,date\nEC2,1,2024-01-01\n")
    plan = csv_headers.header_groups(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "FileScan csv" not in plan and "content" not in plan.split("FileScan binaryFile")[1].split("]")[0]


def test_one_scan_for_top_services_and_their_totals(spark):
    frame = catalog.queries()["J5_top_services_costs"](spark, SF)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.count("FileScan parquet") - final.count("part.parquet") - final.count("orders.parquet") <= 1 and "Reused" in final


def test_month_report_scans_the_costs_once(spark):
    plan = _plan(catalog.queries()["Q14_monthly_detail"](spark, SF))
    assert "lineitem.parquet" not in plan
