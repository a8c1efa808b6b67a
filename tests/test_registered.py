"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from conftest import SF
from oracle import compare, duck

from spendframe.plans import catalog

MAY_BE_EMPTY_ON_SMALL_TABLES = {
    "A6_A8_spike_rule", "J2_A10_new_anomalies", "A10_purge", "Q12_anomaly_list", "Q13_status_changes", "Q16_anomaly_log",
    "Q21_anomaly_count", "A6_A8_model_detection", "A7_spike_and_drop_flags", "P13_forecast_filter", "P12_trend_filter",
    "P11_cost_filter", "A1_detection_series", "W123_features", "A10_detect_and_store", "A10_store_batches", "A12_alerts_of_anomalies", "A1_series_of_stored_costs",
}


@pytest.fixture(scope="module")
def database():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, database, name):
    frame = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        count, problems = frame.count(), []
    else:
        count, problems = compare(frame, database, sql)
    assert not problems
    assert count or name in MAY_BE_EMPTY_ON_SMALL_TABLES


def test_entry_and_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 40
    assert set(contract.oracle_sql()) <= set(contract.queries())
