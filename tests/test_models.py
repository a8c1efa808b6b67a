import math
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendframe.operators import alerts, anomalies, budgets, features, forecast, forest, insights, trends
from spendframe.plans import ingesting

DAY0 = date(2024, 1, 1)


def _series(spark, values, name="s", value="total"):
    data = [(1, name, DAY0 + timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, f"user_id bigint, series string, {'day' if value == 'total' else 'date'} date, {value} double")


def _costs(spark, rows):
    return spark.createDataFrame(rows, "user_id bigint, service_name string, cost double, usage_start_date timestamp_ntz, usage_end_date timestamp_ntz, billing_period string")


# --- features and rules ----------------------------------------------------------

def test_features_are_row_based(spark):
    rows = [(1, "a", DAY0 + timedelta(days=2 * i), float(i + 1)) for i in range(9)]
    frame = spark.createDataFrame(rows, "user_id bigint, service_name string, date date, total double")
    got = features.with_features(frame, ["user_id", "service_name"]).orderBy("date").collect()
    assert [(r.cost, r.lag_1, r.lag_7, r.rolling_mean_7) for r in got] == [(8.0, 7.0, 1.0, 4.0), (9.0, 8.0, 2.0, 5.0)]
    assert got[0].rolling_std_7 == pytest.approx(np.std(range(1, 8), ddof=1))
    assert got[0].cost_ratio_7 == pytest.approx(8 / 4.00001)
    assert [r.is_weekend for r in got] == [0.0, 0.0]  # Monday, Wednesday


def test_short_series_are_skipped(spark):
    start = datetime(2024, 1, 1)
    rows = [(1, "short", 5.0, start + timedelta(days=i), start, "2024-01") for i in range(7)]
    rows += [(1, "long", 5.0, start + timedelta(days=i), start, "2024-01") for i in range(8)]
    got = features.detection_series(_costs(spark, rows))
    assert {r.service_name for r in got.collect()} == {"long"}


def _flagged(spark, *rows):
    data = [(1, "EC2", "Compute", "aws", DAY0, DAY0 + timedelta(days=back), float(c), float(m), bool(f)) for back, c, m, f in rows]
    return spark.createDataFrame(data, "user_id int, service_name string, category string, provider string, date date, latest date, cost double, rolling_mean_7 double, flagged boolean")


def test_report_rules(spark):
    rows = _flagged(spark, (0, 10, 5, True), (0, 10, 5, False), (8, 10, 5, True), (7, 30, 10, True), (0, 0.9, 0.1, True),
                    (0, 11, 10, True), (0, 12.5, 10, True), (0, 5, 0, True), (0, 2, 10, True))
    got = {(r.detected_value, r.deviation_percentage, r.severity) for r in anomalies.reportable(rows).collect()}
    assert got == {(10.0, 100.0, "medium"), (30.0, 200.0, "high"), (12.5, 25.0, "medium"), (5.0, 100.0, "medium")}
    drops = anomalies.reportable(rows, include_drops=True).where("detected_value < expected_value").collect()
    assert [(r.detected_value, r.message) for r in drops] == [(2.0, "Drop detected in Compute (aws): 80% deviation")]
    message = anomalies.reportable(_flagged(spark, (0, 10, 5, True))).first().message
    assert message == "Spike detected: based on Compute patterns (100% above expected)"


def test_rule_flags(spark):
    frame = spark.createDataFrame([(5.0, False), (4.99, False), (0.15, False), (1.0, True)], "cost_ratio_7 double, m boolean")
    plain = [r.flagged for r in anomalies.with_rule_flag(frame, F.col("m")).collect()]
    drops = [r.flagged for r in anomalies.with_rule_flag(frame, F.col("m"), include_drops=True).collect()]
    assert plain == [True, False, False, True] and drops == [True, False, True, True]


# --- forest ------------------------------------------------------------------------

def _scaled(spark, n=400, outlier=True, partitions=1):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(n, len(features.FEATURES)))
    if outlier:
        points[0] = 12.0
    rows = [("Compute", DAY0 + timedelta(days=i), n, *map(float, p)) for i, p in enumerate(points)]
    columns = ", ".join(f"{z} double" for z in forest.Z_FEATURES)
    return spark.createDataFrame(rows, f"category string, date date, train_rows bigint, {columns}").repartition(partitions)


def test_forest_finds_the_outlier_and_ignores_partitions(spark):
    results = []
    for partitions in (1, 8):
        frame = _scaled(spark, partitions=partitions)
        trees = forest.train_trees(frame, trees=60)
        scored = forest.score(frame, trees, spread=partitions)
        limits = forest.offsets(scored)
        decided = forest.decide(scored, limits).orderBy("date").collect()
        results.append([(r.date, r.score, r.model_flag) for r in decided])
        by_key = forest.score(frame, trees, spread=partitions, sent_nodes=0)
        assert sorted((r.date, r.score) for r in by_key.collect()) == sorted((d, s) for d, s, _ in results[-1])
    assert results[0] == results[1]
    scores = results[0]
    assert min(scores, key=lambda r: r[1])[0] == DAY0
    share = sum(flag for *_, flag in scores) / len(scores)
    assert abs(share - 0.05) < 0.011
    assert all(-1 <= s < 0 for _, s, _ in scores)


def test_trees_isolate_every_sample(spark):
    rng = np.random.default_rng(0)
    tree = forest.grow_tree(rng.normal(size=(64, 3)), np.random.default_rng(5))
    inner = [i for i, f in enumerate(tree["feature"]) if f >= 0]
    assert len(tree["feature"]) == 2 * len(inner) + 1
    assert all(0 < tree["left"][i] < len(tree["feature"]) and 0 < tree["right"][i] for i in inner)
    constant = forest.grow_tree(np.ones((10, 3)), np.random.default_rng(5))
    assert constant["feature"] == [-1]
    assert float(forest.mean_path(256)) == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_detection_flow_reports_planted_spike(spark):
    start = datetime(2024, 1, 1)
    rows = []
    for service in ("Amazon EC2", "Amazon S3"):
        for i in range(120):
            cost = 100.0 + (i * 37 % 11)
            if service == "Amazon EC2" and i == 119:
                cost *= 10
            at = start + timedelta(days=i)
            rows.append((1, service, cost, at, at, at.strftime("%Y-%m")))
    costs = _costs(spark, rows)
    training = costs.select(F.col("usage_start_date").alias("date"), F.col("service_name").alias("service"), "cost")
    model = ingesting.train_model(training, trees=50)
    found = ingesting.detect_service_anomalies(costs, model, spread=2).collect()
    assert [(r.service_name, r.detected_at, r.severity) for r in found] == [("Amazon EC2", date(2024, 4, 29), "high")]


# --- forecast ----------------------------------------------------------------------

def test_resample_fills_gaps_and_labels_buckets(spark):
    frame = spark.createDataFrame([(1, "s", date(2024, 1, 3), 2.0), (1, "s", date(2024, 1, 9), 3.0)], "user_id bigint, series string, day date, total double")
    daily = forecast.resample(frame, "daily").orderBy("date").collect()
    assert [r.cost for r in daily] == [2.0, 0, 0, 0, 0, 0, 3.0]
    weekly = forecast.resample(frame, "weekly").orderBy("date").collect()
    assert [(r.date, r.cost) for r in weekly] == [(date(2024, 1, 7), 2.0), (date(2024, 1, 14), 3.0)]
    assert forecast.resample(frame, "monthly").count() == 0  # one month is too short
    assert forecast.resample(frame, "daily", "2024-01-09").count() == 6


def _fit(spark, values, periods=14, model="linear", **options):
    points = _series(spark, values, value="cost")
    return forecast.forecast(points, periods, "daily", model, **options)


def test_linear_recovers_line_and_week(spark):
    line = [10 + 2 * i for i in range(60)]
    got = _fit(spark, line).orderBy("step").collect()
    assert [r.prediction for r in got] == pytest.approx([10 + 2 * i for i in range(60, 74)], rel=1e-6)
    totals = forecast.forecast_totals(_fit(spark, line)).first()
    assert totals.trend == "increasing" and totals.confidence_score == 100.0
    wave = [50 + 10 * math.sin(2 * math.pi * i / 7) for i in range(70)]
    got = _fit(spark, wave).orderBy("step").collect()
    assert [r.prediction for r in got] == pytest.approx([50 + 10 * math.sin(2 * math.pi * i / 7) for i in range(70, 84)], abs=1e-5)


def test_linear_on_degenerate_series(spark):
    zeros = _fit(spark, [0] * 20).collect()
    assert all(r.prediction == 0 and r.confidence == 0 for r in zeros)
    assert forecast.forecast_totals(_fit(spark, [5] * 20)).first().trend == "stable"
    assert all(r.prediction >= 0 for r in _fit(spark, [100 - 10 * i for i in range(11)]).collect())
    assert _fit(spark, [1, 2]).count() == 14


@pytest.mark.parametrize("granularity, sizes", [("daily", [2, 3, 5, 6, 7, 8, 30, 400]), ("weekly", [2, 4, 7, 60]), ("monthly", [2, 3, 6, 7, 24])])
def test_linear_equals_least_squares(spark, granularity, sizes):
    """Also the smallest solution of short series; numpy's, on the same design."""
    rng = np.random.default_rng(len(sizes))
    step = {"daily": 1, "weekly": 7, "monthly": 30.4375}[granularity]
    rows, expected = [], {}
    for n in sizes:
        days = [DAY0 + timedelta(days=int(i * step)) for i in range(n)]
        if granularity == "monthly":
            days = [(pd.Timestamp(d) + pd.offsets.MonthEnd(0)).date() for d in days]
            days = sorted(set(days))
        cost = np.abs(rng.normal(100, 30, len(days)))
        rows += [(n, "s", d, float(c)) for d, c in zip(days, cost)]
        later = [pd.Timestamp(days[-1]) + pd.Timedelta(days=int(step) * k) for k in (1, 2, 3)] if granularity != "monthly" else list(
            pd.date_range(pd.Timestamp(days[-1]) + pd.Timedelta(days=1), periods=3, freq="ME"))
        y = cost
        if len(y) >= 10:
            low, high = np.percentile(y, [25, 75])
            y = np.clip(y, low - 1.5 * (high - low), high + 1.5 * (high - low))

        def design(days, first=days[0]):
            t = np.array([(pd.Timestamp(d) - pd.Timestamp(first)).days for d in days], float)
            angle = 2 * np.pi * t / {"daily": 7, "weekly": 52, "monthly": 12}[granularity]
            return np.column_stack([t, t * t, np.sin(angle), np.cos(angle), np.sin(2 * angle), np.cos(2 * angle)])

        x = design(days)
        weights = np.linalg.lstsq(x - x.mean(axis=0), y - y.mean(), rcond=None)[0]
        left = y - ((x - x.mean(axis=0)) @ weights + y.mean())
        ahead = np.maximum(0, (design(later) - x.mean(axis=0)) @ weights + y.mean())
        margin = 1.64 * (np.std(left) if len(y) > 2 else 0) * np.sqrt(1 + np.arange(1, 4) / len(y))
        expected[n] = [(str(d.date()), p, max(0, p - m), p + m) for d, p, m in zip(later, ahead, margin)]
    points = spark.createDataFrame(rows, "user_id bigint, series string, date date, cost double")
    got = forecast.forecast(points, 3, granularity).orderBy("user_id", "step").collect()
    for n in sizes:
        mine = [(str(r.date), r.prediction, r.lower, r.upper) for r in got if r.user_id == n]
        assert [m[0] for m in mine] == [e[0] for e in expected[n]]
        assert [v for m in mine for v in m[1:]] == pytest.approx([v for e in expected[n] for v in e[1:]], rel=1e-6, abs=1e-4)


def test_linear_forecast_needs_no_python(spark):
    plan = _fit(spark, range(20))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_equal_vectors_are_scored_once(spark):
    """Nine tenths of a model's rows with one feature vector: scored by key as in place, in groups of bounded size."""
    from spendframe.operators import features, forest

    rng = np.random.default_rng(3)
    values = [[0.0] * 8 if i % 10 else rng.normal(size=8).tolist() for i in range(4000)]
    rows = spark.createDataFrame(
        [(f"m{i % 2}", DAY0 + timedelta(days=i), *v) for i, v in enumerate(values)], f"category string, date date, {', '.join(f'{z} double' for z in forest.Z_FEATURES)}")
    trees = forest.train_trees(rows.withColumn("train_rows", F.lit(2000)), trees=10)
    near, far = forest.score(rows, trees), forest._score_by_key(rows, trees, "category", 50)
    assert far.columns == [*rows.columns, "score"]
    assert {(r.category, r.date): r.score for r in near.collect()} == pytest.approx({(r.category, r.date): r.score for r in far.collect()})
    assert far.count() == 4000 and features.RECENT_DAYS == 7


def test_additive_follows_trend_and_season(spark):
    rng = np.random.default_rng(2)
    values = [100 + 0.5 * i + 20 * math.sin(2 * math.pi * i / 7) + rng.normal(0, 1) for i in range(200)]
    got = _fit(spark, values, 28, "additive").orderBy("step").collect()
    truth = [100 + 0.5 * i + 20 * math.sin(2 * math.pi * i / 7) for i in range(200, 228)]
    assert max(abs(r.prediction - t) / t for r, t in zip(got, truth)) < 0.06
    assert all(r.lower <= r.prediction <= r.upper for r in got)
    again = _fit(spark, values, 28, "additive").orderBy("step").collect()
    assert [r.lower for r in got] == [r.lower for r in again]


def test_growth_badges(spark):
    growth = spark.createDataFrame(
        [(1, "__all__", 300.0, 30, 90.0, "increasing", 8.0, 10.0, 25.0), (2, "__all__", 1.0, 1, 90.0, "stable", 1.0, 1.0, -6.0),
         (3, "__all__", 1.0, 1, 90.0, "stable", 1.0, 1.0, 5.0), (1, "s", 1.0, 1, 90.0, "stable", 1.0, 1.0, 15.5)],
        "user_id int, series string, total_predicted_cost double, periods bigint, confidence_score double, trend string, current_avg double, predicted_avg double, growth double")
    got = forecast.executive_summary(growth).orderBy("user_id").collect()
    assert [(r.status_badge, r.risk, r.period_label) for r in got] == [
        ("Critical", "Significant cost increase of 25.0% expected", "Next 30 Days"),
        ("Good", "Cost saving of 6.0% expected", "Next 1 Day"), ("Stable", None, "Next 1 Day"),
    ]
    assert forecast.service_outlook(growth).first().status == "Increasing"
    card = forecast.card_values(forecast.executive_summary(growth)).where("user_id = 1").first()
    assert (card.projected_monthly, card.days_to_exhaustion) == (300.0, 24)


# --- budgets -----------------------------------------------------------------------

BUDGET = "budget_id bigint, user_id bigint, name string, amount double, period string, scope struct<type:string,value:string>, thresholds array<double>"


@pytest.mark.parametrize("period, as_of, expected", [
    ("monthly", "2024-02-10", ("2024-02-01", "2024-02-29", 29, 10, 19)),
    ("quarterly", "2023-11-30", ("2023-10-01", "2023-12-31", 92, 61, 31)),
    ("annual", "2024-12-31", ("2024-01-01", "2024-12-31", 366, 366, 0)),
])
def test_period_bounds(spark, period, as_of, expected):
    frame = spark.createDataFrame([(1, 1, "b", 10.0, period, None, None)], BUDGET)
    row = budgets.with_period(budgets.valid_budgets(frame), as_of).first()
    assert (str(row.period_start), str(row.period_end), row.days_in_period, row.days_passed, row.days_remaining) == expected
    assert row.thresholds == [50.0, 80.0, 100.0] and row.scope.type == "global"


def _status(spark, actual, amount=100.0, thresholds=(50.0, 80.0, 100.0), projected=0.0):
    frame = spark.createDataFrame([(1, 1, "b", amount, "monthly", ("global", None), list(thresholds))], BUDGET)
    spent = budgets.with_period(budgets.valid_budgets(frame), "2024-01-10").select(
        "*", F.lit("global").alias("scope_type"), F.lit("").alias("scope_value"), F.lit(actual).alias("actual_spend"),
        F.lit(projected).alias("forecasted_remaining"),
    )
    row = budgets.budget_status(spent).first()
    return row.status, row.alerts, row.pct_consumed, row.pct_projected


def test_budget_status(spark):
    assert _status(spark, 10.0) == ("Safe", [], 10.0, 10.0)
    assert _status(spark, 85.0) == ("Warning", ["Exceeded 50% threshold (85.0%)", "Exceeded 80% threshold (85.0%)"], 85.0, 85.0)
    assert _status(spark, 10.0, projected=95.5) == ("Warning", ["Forecasted to exceed budget by $5.50"], 10.0, 105.5)
    status, found, *_ = _status(spark, 120.0, thresholds=(100.0, 90.5, 25.0))
    assert status == "Critical"
    assert found == ["Exceeded 25% threshold (120.0%)", "Exceeded 90.5% threshold (120.0%)", "Exceeded 100% threshold (120.0%)", "Forecasted to exceed budget by $20.00"]
    assert _status(spark, 30.0, thresholds=(20.0,))[0] == "Safe"


def test_projection_uses_the_scope(spark):
    start = datetime(2024, 1, 1)
    rows = [(1, s, c, start + timedelta(days=i), {"resource_group": g}) for i in range(20) for s, c, g in (("a", 10.0, "x"), ("b", 1.0, "y"))]
    costs = spark.createDataFrame(rows, "user_id bigint, service_name string, cost double, usage_start_date timestamp_ntz, tags map<string,string>")
    requests = spark.createDataFrame(
        [(1, 1, "all", 1e4, "monthly", ("global", None), None), (2, 1, "a", 1e4, "monthly", ("service", "a"), None),
         (3, 1, "y", 1e4, "monthly", ("resource_group", "y"), None), (4, 1, "none", 1e4, "monthly", ("service", "zzz"), None)], BUDGET)
    from spendframe.plans.forecasting import track_budgets

    got = {r.budget_id: (r.actual_spend, r.forecasted_remaining) for r in track_budgets(requests, costs, "2024-01-20").collect()}
    assert got == {1: (220.0, 121.0), 2: (200.0, 110.0), 3: (20.0, 11.0), 4: (0.0, 0.0)}


# --- alerts, trends, insights ---------------------------------------------------------

def _alerts(spark, minutes, cooldown=10, **settings):
    start = datetime(2024, 1, 1, 23, 30)
    fired = spark.createDataFrame([(1, "EC2", start + timedelta(minutes=m)) for m in minutes], "user_id bigint, service_name string, alert_at timestamp_ntz")
    user = {"user_id": 1, "email": "x@y", "email_alerts_enabled": True, "email_notifications": None, "email_alert_cooldown_minutes": cooldown, **settings}
    users = spark.createDataFrame([tuple(user.values())], "user_id bigint, email string, email_alerts_enabled boolean, email_notifications boolean, email_alert_cooldown_minutes int")
    sent = alerts.select_alerts(fired, users).orderBy("alert_at").collect()
    return [int((r.alert_at - start).total_seconds() // 60) for r in sent]


def test_cooldown_matches_brute_force(spark):
    import random

    random.seed(5)
    minutes = sorted(random.sample(range(4000), 700)) + [3999, 3999]
    expected, last = [], None
    for m in sorted(set(minutes)):
        if last is None or m - last >= 10:
            expected.append(m)
            last = m
    assert _alerts(spark, minutes) == expected


def test_alert_settings(spark):
    assert _alerts(spark, [0, 9, 10, 19, 20], cooldown=0) == [0, 10, 20]  # 0 falls back to 10 minutes
    assert _alerts(spark, [0], email=None) == [] and _alerts(spark, [0], email_alerts_enabled=False) == []
    assert _alerts(spark, [0], email_alerts_enabled=None) == []
    assert _alerts(spark, [0], email_alerts_enabled=None, email_notifications=True) == [0]


def test_auto_trend_picks_granularity_per_tenant(spark):
    def row(user, service, cost, day):
        at = datetime.fromisoformat(day)
        return user, service, float(cost), at, at + timedelta(days=1), day[:7]

    costs = _costs(spark, [
        row(1, "a", 1, "2024-01-01"), row(1, "b", 3, "2024-01-01"), row(1, "a", 0, "2024-02-01"), row(1, "a", 2, "2024-03-01"),
        row(2, "a", 1, "2024-01-01"), row(2, "a", 5, "2024-06-30"), row(2, "b", 1, "2024-06-01"),
    ])
    got = trends.auto_trend(costs).orderBy("user_id", "period").collect()
    assert [(r.user_id, r.period, r.total_cost, r.change_percentage) for r in got] == [
        (1, "2024-01-01", 4.0, None), (1, "2024-02-01", 0.0, -100.0), (1, "2024-03-01", 2.0, 0.0),
        (2, "2024-01", 1.0, None), (2, "2024-06", 6.0, 500.0),
    ]
    assert got[0].start == "2024-01-01" and got[0].end == "2024-01-02"
    nested = trends.nest_breakdown(trends.auto_trend(costs), trends.auto_trend_breakdown(costs)).where("user_id = 1 and period = '2024-01-01'").first()
    assert [(e.service_name, e.cost) for e in nested.breakdown] == [("b", 3.0), ("a", 1.0)]
    latest = trends.auto_trend(costs, latest_month=True).orderBy("user_id", "period").collect()
    assert [(r.user_id, r.period) for r in latest] == [(1, "2024-03-01"), (2, "2024-06-01"), (2, "2024-06-30")]
    assert trends.auto_trend(costs, month="2024-06").count() == 2


def test_comparison_branches(spark):
    def row(service, cost, day):
        at = datetime.fromisoformat(day)
        return 1, service, float(cost), at, at, day[:7]

    costs = _costs(spark, [row("new", 5, "2024-02-02"), row("gone", 8, "2024-01-02"), row("up", 1, "2024-01-02"), row("up", 2, "2024-02-02"),
                           row("zero", 0, "2024-01-03"), row("outside", 9, "2023-01-01")])
    got = insights.compare_periods(costs, ("2024-02-01", "2024-02-29"), ("2024-01-01", "2024-01-31")).collect()
    assert [(r.service_name, r.difference, r.change_percentage, r.status) for r in got] == [
        ("gone", -8.0, -100.0, "decreased"), ("new", 5.0, 100.0, "increased"), ("up", 1.0, 100.0, "increased"), ("zero", 0.0, 0.0, "stable"),
    ]


def test_pandas_free_of_series_order(spark):
    values = [10 + (i % 5) for i in range(30)]
    shuffled = _series(spark, values, value="cost").orderBy(F.rand(1))
    a = forecast.forecast(shuffled, 5).orderBy("step").toPandas()
    b = _fit(spark, values, 5).orderBy("step").toPandas()
    pd.testing.assert_frame_equal(a, b)
