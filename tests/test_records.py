from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spendframe.functions.numeric import exact_sum, fixed, money
from spendframe.operators import filters, records
from spendframe.operators.quantiles import grouped_quantile

GOOD = {
    "provider": "aws", "service_name": "Amazon EC2", "cost": "1.5", "usage_start_date": "2024-01-01",
    "usage_end_date": "2024-01-02", "usage_quantity": None, "currency": None,
}
SCHEMA = ", ".join(f"{name} string" for name in GOOD)


def _error(spark, **changes):
    frame = spark.createDataFrame([tuple({**GOOD, **changes}.values())], SCHEMA)
    return records.with_validation(frame).first().error


@pytest.mark.parametrize("changes, expected", [
    ({}, None),
    ({"provider": ""}, "Field 'provider' is required"),
    ({"service_name": None, "cost": ""}, "Field 'service_name' is required"),
    ({"usage_end_date": None}, "Field 'usage_end_date' is required"),
    ({"provider": "Oracle", "cost": "x"}, "Provider must be one of: AWS, Azure, GCP, Other"),
    ({"provider": " AZURE "}, None),
    ({"cost": "x"}, "Cost must be a valid number"),
    ({"cost": "NaN"}, "Cost must be a valid number"),
    ({"cost": "inf"}, "Cost must be a valid number"),
    ({"cost": "500000000000"}, None),
    ({"cost": "-0.01"}, "Cost must be greater than or equal to 0"),
    ({"cost": "0"}, None),
    ({"usage_quantity": "many"}, "Usage quantity must be a valid number"),
    ({"usage_quantity": "-1"}, "Usage quantity must be greater than or equal to 0"),
    ({"usage_start_date": "01/01/2024"}, "Invalid date format. Use ISO 8601 format (YYYY-MM-DDTHH:MM:SS)"),
    ({"usage_start_date": "2024-01-03"}, "usage_start_date must be before or equal to usage_end_date"),
    ({"usage_start_date": "2024-01-02T01:00:00+02:00"}, None),  # 23:00 of the day before in UTC
    ({"currency": "usd"}, "Currency must be one of: USD, EUR, GBP, INR, JPY, CNY"),
    ({"service_name": "   "}, "Service name cannot be empty"),
    ({"service_name": "s" * 200}, None),
    ({"service_name": "s" * 201}, "Service name is too long (max 200 characters)"),
])
def test_first_failing_rule(spark, changes, expected):
    assert _error(spark, **changes) == expected


def test_built_record_defaults(spark):
    frame = spark.createDataFrame([tuple({**GOOD, "service_name": " EC2 ", "provider": " gcp"}.values())], SCHEMA)
    good, rejects = records.ingest(frame, "2024-02-01")
    row = good.first()
    assert (row.provider, row.service_name, row.region, row.currency, row.usage_quantity) == ("GCP", "EC2", "us-east-1", "USD", 0.0)
    assert (row.cloud_account_id, row.billing_period, row.tags) == ("", "2024-01", {})
    assert row.created_at == datetime(2024, 2, 1) and rejects.count() == 0


def test_corrections_keep_rejected_rows(spark):
    costs = spark.createDataFrame(
        [("a", 1, "AWS", "S3", 5.0, datetime(2024, 1, 5), datetime(2024, 1, 5), "2024-01"),
         ("b", 1, "AWS", "S3", 6.0, datetime(2024, 1, 5), datetime(2024, 1, 5), "2024-01")],
        "cost_id string, user_id bigint, provider string, service_name string, cost double, "
        "usage_start_date timestamp_ntz, usage_end_date timestamp_ntz, billing_period string")
    updates = spark.createDataFrame(
        [("a", 1, 7.0, datetime(2024, 2, 1), datetime(2024, 2, 1)), ("b", 1, -1.0, None, None)],
        "cost_id string, user_id bigint, cost double, usage_start_date timestamp_ntz, usage_end_date timestamp_ntz")
    snapshot, rejected = records.apply_corrections(costs, updates, "2024-03-01")
    assert [(r.cost_id, r.cost, r.billing_period) for r in snapshot.orderBy("cost_id").collect()] == [("a", 7.0, "2024-02"), ("b", 6.0, "2024-01")]
    assert [r.cost_id for r in rejected.collect()] == ["b"]
    twice = spark.createDataFrame([("a", 1, 7.0, 1), ("a", 1, 9.0, 2), ("a", 1, 8.0, None)], "cost_id string, user_id bigint, cost double, version int")
    snapshot, rejected = records.apply_corrections(costs, twice, "2024-03-01", order_by="version")
    assert [(r.cost_id, r.cost) for r in snapshot.orderBy("cost_id").collect()] == [("a", 9.0), ("b", 6.0)]
    assert [r.error for r in rejected.collect()] == [records.SUPERSEDED] * 2


def test_exact_sum_ignores_order_and_scale(spark):
    frame = spark.range(0, 100_000, 1, 16).select((F.col("id") % 7 * F.lit(0.1)).alias("cost"))
    big = frame.unionByName(spark.createDataFrame([(1e9,), (0.00000001,)], "cost double"))
    first = big.agg(exact_sum("cost")).first()[0]
    again = big.orderBy(F.desc("cost")).agg(exact_sum("cost")).first()[0]
    expected = sum((i % 7) * 10_000_000 for i in range(100_000)) + 10**17 + 1
    assert int(first.scaleb(8)) == expected and first == again
    huge = spark.createDataFrame([(8e13,), (8e13,), (0.01,), (3e11,)], "cost double")
    assert int(huge.agg(exact_sum("cost")).first()[0].scaleb(8)) == 16 * 10**21 + 10**6 + 3 * 10**19
    assert spark.createDataFrame([(-1.25,), (-2.5,)], "cost double").agg(money(exact_sum("cost"))).first()[0] == -3.75
    assert spark.createDataFrame([(2.675,), (1.005,)], "x double").select(fixed("x", 1)).collect()[0][0] == 2.7


def test_quantile_matches_brute_force(spark):
    import random

    random.seed(3)
    values = [(u, random.choice([0.0, 5.5, random.random() * 10, random.random() * 1e7])) for u in (1, 1, 1, 2) for _ in range(500)]
    values.append((3, 9.25))
    frame = spark.createDataFrame(values, "user_id int, cost double").repartition(7)
    for q in (0.1, 0.5, 0.9, 1.0):
        got = {r.user_id: r.quantile_value for r in grouped_quantile(frame, ["user_id"], "cost", q).collect()}
        for user in (1, 2, 3):
            ordered = sorted(c for u, c in values if u == user)
            rank = max(1, -(-int(round(q * 1000)) * len(ordered) // 1000))
            assert got[user] == ordered[rank - 1]


def test_amounts_are_not_capped(spark):
    tiny = spark.range(0, 1_000_000, 1, 8).select(F.lit(2.1e-9).alias("cost"))
    assert str(tiny.agg(exact_sum("cost")).first()[0]) == "0.00210000"
    rows = spark.createDataFrame([(1, 1e14 * k) for k in range(10)] + [(1, 1e22)], "user_id int, cost double")
    assert int(rows.agg(exact_sum("cost")).first()[0]) == 45 * 10**14 + 10**22
    assert sorted(r.cost for r in filters.high_cost(rows, 0.9).collect()) == [9e14, 1e22]


def test_month_filter(spark):
    frame = spark.sql("select timestamp_ntz'2024-12-31 23:59:59' as usage_start_date union all select timestamp_ntz'2025-01-01'")
    assert filters.in_month(frame, "2024-12").count() == 1
    assert filters.in_month(frame, "2024-13").count() == 2 and filters.in_month(frame, None).count() == 2


def test_amounts_that_sums_cannot_hold(spark):
    """Costs above the limit are rejects; as many of the greatest as fit a table still have an exact sum."""
    from spendframe.functions.numeric import exact_sum

    day = "2024-01-01T00:00:00"
    rows = [("AWS", "EC2", cost, day, day) for cost in ("1e18", "1e25", "inf", "-1e25", "5")]
    checked = records.with_validation(spark.createDataFrame(rows, "provider string, service_name string, cost string, usage_start_date string, usage_end_date string"))
    assert {r.cost: r.error for r in checked.collect()} == {
        "1e18": None, "1e25": "Cost must be a valid number", "inf": "Cost must be a valid number", "-1e25": "Cost must be a valid number", "5": None}
    total = spark.range(200_000).select(F.lit(1e18).alias("cost")).agg(exact_sum("cost").alias("t")).first().t
    assert total == 200_000 * 10**18
