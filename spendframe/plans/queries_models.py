"""Registered queries for features, anomalies, forecasts, budgets, reports and alerts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions.category import category_sql
from ..functions.numeric import exact_sum, fixed as fixed_col, money as money_col
from ..operators import alerts, anomalies, budgets, features, forecast, forest, insights, records, reports
from ..session import cut_lineage, shared_dir
from ..sources import anomaly_store, store
from ..sources.tables import SERVICE_OF_TYPE, customer_budgets, dealt, event_costs, lineitem_costs, table
from . import forecasting, ingesting
from .linear_sql import MONTH_ENDS, linear_forecast_sql
from .registry import AS_OF, COSTS, EVENTS, SPIKED, change, fixed, money, query, share, total

SERIES_FIELDS = ["user_id", "service_name", "cost", "usage_start_date"]


def _spiked(spark, sf_dir) -> DataFrame:
    costs = lineitem_costs(spark, sf_dir, SERIES_FIELDS, planted_spikes=True)
    return costs.where(F.col("usage_start_date") <= F.lit(AS_OF).cast("timestamp_ntz"))


# --- features ------------------------------------------------------------------

_SERIES_SQL = f"""daily AS (SELECT user_id, service_name, CAST(usage_start_date AS DATE) AS date, {total('cost')} AS t FROM costs
    WHERE usage_start_date <= TIMESTAMP '{AS_OF}' GROUP BY 1, 2, 3),
recent AS (SELECT * FROM (SELECT *, max(date) OVER (PARTITION BY user_id) AS latest FROM daily) WHERE date >= latest - 90),
series AS (SELECT * FROM recent QUALIFY count(*) OVER (PARTITION BY user_id, service_name) >= 8)"""


def _features_sql(source: str, keys: str) -> str:
    return f"""lags AS (SELECT *, CAST(t AS DOUBLE) AS cost, CAST(lag(t, 1) OVER w AS DOUBLE) AS lag_1, CAST(lag(t, 7) OVER w AS DOUBLE) AS lag_7,
    CAST(sum(t) OVER b AS DOUBLE) / 7 AS rolling_mean_7, stddev_samp(CAST(t AS DOUBLE)) OVER b AS rolling_std_7 FROM {source}
    WINDOW w AS (PARTITION BY {keys} ORDER BY date), b AS (PARTITION BY {keys} ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
features AS (SELECT *, cost / (lag_1 + 0.00001::DOUBLE) AS cost_ratio_1, cost / (rolling_mean_7 + 0.00001::DOUBLE) AS cost_ratio_7,
    CASE WHEN isodow(date) >= 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_weekend FROM lags WHERE lag_7 IS NOT NULL)"""


_FEATURES = _features_sql("series", "user_id, service_name")
_FEATURE_COLUMNS = ", ".join(f"{fixed(name)} AS {name}" for name in features.FEATURES)


def _rounded(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(
        *keys, F.date_format("date", "yyyy-MM-dd").alias("date"), *[fixed_col(n).alias(n) for n in features.FEATURES]
    )


@query("A1_detection_series", f"""WITH {SPIKED}, {_SERIES_SQL}
SELECT user_id, service_name, strftime(date, '%Y-%m-%d') AS date, {money('t')} AS cost, strftime(latest, '%Y-%m-%d') AS latest FROM series""")
def a1_series(spark, sf_dir):
    return features.detection_series(_spiked(spark, sf_dir)).select(
        "user_id", "service_name", F.date_format("date", "yyyy-MM-dd").alias("date"), money_col("total").alias("cost"),
        F.date_format("latest", "yyyy-MM-dd").alias("latest"),
    )


@query("A1_series_of_stored_costs", f"""WITH {SPIKED}, {_SERIES_SQL}
SELECT user_id, service_name, strftime(date, '%Y-%m-%d') AS date, {money('t')} AS cost, strftime(latest, '%Y-%m-%d') AS latest FROM series""")
def a1_stored(spark, sf_dir):
    """From the cost table, of which only the months that hold the last 90 days of some tenant are read."""
    path = f"{shared_dir(spark)}/costs-{uuid.uuid4().hex}"
    rows = lineitem_costs(spark, sf_dir, planted_spikes=True).where(F.col("usage_start_date") <= F.lit(AS_OF).cast("timestamp_ntz"))
    good, _ = records.ingest(dealt(rows), AS_OF)
    store.append_costs(good, path)
    return features.detection_series(store.read_costs(spark, path)).select(
        "user_id", "service_name", F.date_format("date", "yyyy-MM-dd").alias("date"), money_col("total").alias("cost"),
        F.date_format("latest", "yyyy-MM-dd").alias("latest"),
    )


@query("W123_features", f"""WITH {SPIKED}, {_SERIES_SQL}, {_FEATURES}
SELECT user_id, service_name, strftime(date, '%Y-%m-%d') AS date, {_FEATURE_COLUMNS} FROM features""")
def w123_features(spark, sf_dir):
    series = features.detection_series(_spiked(spark, sf_dir))
    return _rounded(features.with_features(series, ["user_id", "service_name"]), "user_id", "service_name")


@query("W123_features_events", f"""WITH {EVENTS}, series AS (
    SELECT service_name, CAST(usage_start_date AS DATE) AS date, {total('cost')} AS t FROM costs GROUP BY 1, 2),
{_features_sql('series', 'service_name')} SELECT service_name, strftime(date, '%Y-%m-%d') AS date, {_FEATURE_COLUMNS} FROM features""")
def w123_events(spark, sf_dir):
    series = features.daily_series(event_costs(spark, sf_dir), ("service_name",))
    return _rounded(features.with_features(series, ["service_name"]), "service_name")


@query("W7_recent_days", f"""WITH {COSTS}, d AS (
    SELECT user_id, CAST(usage_start_date AS DATE) AS date, {total('cost')} AS t FROM costs GROUP BY 1, 2)
SELECT user_id, strftime(date, '%Y-%m-%d') AS date, {money('t')} AS cost FROM d
QUALIFY date >= max(date) OVER (PARTITION BY user_id) - 7""")
def w7_recent(spark, sf_dir):
    daily = features.daily_series(lineitem_costs(spark, sf_dir, SERIES_FIELDS), ("user_id",))
    return features.recent_days(daily).select("user_id", F.date_format("date", "yyyy-MM-dd").alias("date"), money_col("total").alias("cost"))


def _training(spark, sf_dir) -> DataFrame:
    return lineitem_costs(spark, sf_dir, ["service_name", "cost", "usage_start_date"]).select(
        F.col("usage_start_date").alias("date"), F.col("service_name").alias("service"), "cost"
    )


_TRAINING = f"""series AS (SELECT * FROM (SELECT {category_sql('service_name')} AS category, CAST(usage_start_date AS DATE) AS date,
    {total('cost')} AS t FROM costs GROUP BY 1, 2) QUALIFY count(*) OVER (PARTITION BY category) >= 14),
{_features_sql('series', 'category')}, held AS (SELECT * FROM features QUALIFY date < max(date) OVER (PARTITION BY category) - 7),
train AS (SELECT * FROM held QUALIFY count(*) OVER (PARTITION BY category) >= 10)"""


@query("A2_training_features", f"""WITH {COSTS}, {_TRAINING}
SELECT category, strftime(date, '%Y-%m-%d') AS date, {_FEATURE_COLUMNS} FROM train""")
def a2_training(spark, sf_dir):
    return _rounded(features.training_features(_training(spark, sf_dir)), "category")


_SCALER = ", ".join(
    f"{fixed(f'avg({n})')} AS mean_{n}, {fixed(f'stddev_pop({n})')} AS std_{n}" for n in features.FEATURES
)


@query("A3_scaler", f"WITH {COSTS}, {_TRAINING} SELECT category, count(*) AS train_rows, {_SCALER} FROM train GROUP BY category")
def a3_scaler(spark, sf_dir):
    scaler = features.scaler(features.training_features(_training(spark, sf_dir)))
    rounded = [fixed_col(c).alias(c) for c in scaler.columns if c not in ("category", "train_rows")]
    return scaler.select("category", "train_rows", *rounded)


# --- forest --------------------------------------------------------------------

@query("A4_forest_trees")
def a4_trees(spark, sf_dir):
    rows = features.training_features(_training(spark, sf_dir))
    trees = forest.train_trees(features.scale(rows, features.scaler(rows)))
    return trees.select(
        "model_key", "tree", "sample_rows", F.size("feature").alias("nodes"),
        F.size(F.filter("feature", lambda f: f < 0)).alias("leaves"), F.array_max("path").alias("longest_path"),
    )


@query("A4_forest_shape", f"""WITH {COSTS}, {_TRAINING}
SELECT category AS model_key, CAST(20 AS BIGINT) AS trees, CAST(least(256, count(*)) AS INTEGER) AS sample_rows, true AS binary, true AS bounded FROM train GROUP BY 1""")
def a4_shape(spark, sf_dir):
    """What holds for every tree: the sample's size, two children for each inner node, and paths no longer than the depth limit allows."""
    rows = features.training_features(_training(spark, sf_dir))
    trees = forest.train_trees(features.scale(rows, features.scaler(rows)), trees=20)
    leaves = F.size(F.filter("feature", lambda f: f < 0))
    longest = F.ceil(F.log2("sample_rows")) + F.lit(float(forest.mean_path(256)))
    return trees.groupBy("model_key").agg(
        F.count(F.lit(1)).alias("trees"), F.min("sample_rows").alias("sample_rows"), F.every(F.size("feature") == 2 * leaves - 1).alias("binary"),
        F.every(F.array_max("path") <= longest).alias("bounded"))


# two trees drawn by hand: (feature, threshold, left, right, path) of each node, and the sample they stand for
_DRAWN = [
    (8, [(0, 0.5, 1, 2, 0.0), (-1, 0.0, -1, -1, 3.0), (6, 1.0, 3, 4, 0.0), (-1, 0.0, -1, -1, 2.5), (-1, 0.0, -1, -1, 1.0)]),
    (16, [(7, 0.0, 1, 2, 0.0), (-1, 0.0, -1, -1, 4.0), (-1, 0.0, -1, -1, 2.0)])]
_TYPICAL = float(sum(forest.mean_path(size) for size, _ in _DRAWN))


@query("A5_scores_of_drawn_trees", f"""WITH {COSTS}, {_TRAINING}, z AS (SELECT category, date,
    (cost - avg(cost) OVER w) / stddev_pop(cost) OVER w AS z_cost, (cost_ratio_7 - avg(cost_ratio_7) OVER w) / stddev_pop(cost_ratio_7) OVER w AS z_ratio, is_weekend
    FROM train WINDOW w AS (PARTITION BY category)),
paths AS (SELECT *, CASE WHEN z_cost <= 0.5 THEN 3.0 WHEN z_ratio <= 1.0 THEN 2.5 ELSE 1.0 END + CASE WHEN is_weekend = 1 THEN 2.0 ELSE 4.0 END AS path FROM z)
SELECT category, strftime(date, '%Y-%m-%d') AS date, {fixed(f'-power(2.0::DOUBLE, -path / {_TYPICAL!r}::DOUBLE)', 6)} AS score FROM paths""")
def a5_drawn(spark, sf_dir):
    rows = cut_lineage(features.training_features(_training(spark, sf_dir)))
    table = features.scaler(rows)
    drawn = [(i, size, *[[node[k] for node in nodes] for k in range(5)]) for i, (size, nodes) in enumerate(_DRAWN)]
    trees = spark.createDataFrame(drawn, forest.TREE_SCHEMA.replace("model_key string, ", "")).crossJoin(F.broadcast(table.select(F.col("category").alias("model_key"))))
    scaled = features.scale(rows, table)
    both = [forest.score(scaled, trees), forest.score(scaled, trees, sent_nodes=0)]  # in place, and by key
    half = F.pmod(F.xxhash64("date"), F.lit(2))
    return both[0].where(half == 0).unionByName(both[1].where(half == 1)).select("category", F.date_format("date", "yyyy-MM-dd").alias("date"), fixed_col("score", 6).alias("score"))


@query("A5_forest_scores")
def a5_scores(spark, sf_dir):
    model = ingesting.train_model(_training(spark, sf_dir))
    rows = features.training_features(_training(spark, sf_dir)).drop("train_rows")
    scored = ingesting.score_series(rows, model)
    return scored.select(
        "category", F.date_format("date", "yyyy-MM-dd").alias("date"), fixed_col("score", 6).alias("score"),
        fixed_col("decision", 6).alias("decision"), "model_flag",
    )


@query("J4_series_model_lookup", f"""WITH {COSTS}, {_TRAINING}, models AS (SELECT DISTINCT category FROM train),
services AS (SELECT DISTINCT user_id, service_name, {category_sql('service_name')} AS category FROM costs)
SELECT user_id, service_name, category, category AS model_key FROM services WHERE category IN (SELECT category FROM models)""")
def j4_lookup(spark, sf_dir):
    scaler = features.scaler(features.training_features(_training(spark, sf_dir)))
    services = lineitem_costs(spark, sf_dir, ["user_id", "service_name"]).distinct()
    return store.preferred_model_key(
        features.with_category(services), scaler.select(F.col("category").alias("model_key"))
    ).select("user_id", "service_name", "category", "model_key")


@query("S13_model_store")
def s13_model_store(spark, sf_dir):
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    store.write_model(ingesting.train_model(_training(spark, sf_dir), trees=50), path)
    model = store.read_model(spark, path)
    trees = model["trees"].groupBy(F.col("model_key").alias("category")).agg(F.count(F.lit(1)).alias("trees"))
    return trees.join(model["offsets"], "category").join(model["scaler"].select("category", "train_rows"), "category").select(
        "category", "trees", "train_rows", fixed_col("contamination", 4).alias("contamination"), fixed_col("offset", 6).alias("offset")
    )


_OWN = f"""{_TRAINING}, own_days AS (SELECT user_id, {category_sql('service_name')} AS category, CAST(usage_start_date AS DATE) AS date, {total('cost')} AS t
    FROM costs WHERE user_id % 2 = 0 GROUP BY 1, 2, 3 QUALIFY count(*) OVER (PARTITION BY user_id, category) >= 14),
{_features_sql('own_days', 'user_id, category').replace('lags AS', 'o_lags AS').replace('FROM lags', 'FROM o_lags').replace('features AS', 'o_features AS')},
o_held AS (SELECT * FROM o_features QUALIFY date < max(date) OVER (PARTITION BY user_id, category) - 7),
o_train AS (SELECT * FROM o_held QUALIFY count(*) OVER (PARTITION BY user_id, category) >= 10),
models AS (SELECT category AS model_key, cost FROM train UNION ALL SELECT user_id || '_' || category, cost FROM o_train),
tables AS (SELECT model_key, CAST(5 AS BIGINT) AS trees, count(*) AS train_rows, {fixed('avg(cost)')} AS mean_cost, {fixed('least(0.15, greatest(0.05, 2.0 / count(*)))', 4)} AS contamination
    FROM models GROUP BY 1)"""


@query("S13_J4_own_then_shared", f"""WITH {COSTS}, {_OWN}, services AS (SELECT DISTINCT user_id, service_name, {category_sql('service_name')} AS category FROM costs)
SELECT s.user_id, service_name, category, coalesce(o.model_key, h.model_key) AS model_key, coalesce(o.trees, h.trees) AS trees, coalesce(o.train_rows, h.train_rows) AS train_rows,
    coalesce(o.mean_cost, h.mean_cost) AS mean_cost, coalesce(o.contamination, h.contamination) AS contamination
FROM services s LEFT JOIN tables o ON o.model_key = s.user_id || '_' || category LEFT JOIN tables h ON h.model_key = category
WHERE coalesce(o.model_key, h.model_key) IS NOT NULL""")
def s13_own(spark, sf_dir):
    """Models of all categories and of even tenants' own, stored, read back and resolved for every tenant's services."""
    training = lineitem_costs(spark, sf_dir, ["user_id", "service_name", "cost", "usage_start_date"]).select(
        "user_id", F.col("usage_start_date").alias("date"), F.col("service_name").alias("service"), "cost")
    owners = training.select("user_id").distinct().where(F.col("user_id") % 2 == 0)
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    store.write_model(ingesting.train_own_models(training, owners, trees=5), path)
    model = store.read_model(spark, path)
    services = features.with_category(lineitem_costs(spark, sf_dir, ["user_id", "service_name"]).distinct())
    trees = model["trees"].groupBy("model_key").agg(F.count(F.lit(1)).alias("trees"))
    resolved = store.preferred_model_key(services, model["scaler"])
    return resolved.join(model["scaler"].select("model_key", "train_rows", "mean_cost"), "model_key").join(model["offsets"], "model_key").join(trees, "model_key").select(
        "user_id", "service_name", "category", "model_key", "trees", "train_rows", fixed_col("mean_cost").alias("mean_cost"), fixed_col("contamination", 4).alias("contamination"))


# --- anomaly rules -------------------------------------------------------------

def _rules(days: int = 7) -> str:
    return f"""named AS (SELECT *, {category_sql('service_name')} AS category,
    CASE WHEN rolling_mean_7 > 0 THEN (cost - rolling_mean_7) / rolling_mean_7 * 100 WHEN cost > 0 THEN 100 ELSE 0 END AS dev FROM features),
found AS (SELECT user_id, service_name, cost AS detected_value, rolling_mean_7 AS expected_value, rolling_mean_7 AS threshold,
    {fixed('dev')} AS deviation_percentage, CASE WHEN abs(dev) > 100 THEN 'high' ELSE 'medium' END AS severity,
    'Spike detected: based on ' || category || ' patterns (' || CAST(CAST(floor(abs(dev) + 0.5) AS BIGINT) AS VARCHAR) || '% above expected)' AS message,
    date AS detected_at FROM named WHERE cost_ratio_7 >= 5 AND date >= latest - {days} AND cost >= 1 AND cost > rolling_mean_7 AND abs(dev) >= 25)"""


_RULES = _rules()
BACKFILL_DAYS = 90


def _rule_anomalies(spark, sf_dir, days: int = features.RECENT_DAYS) -> DataFrame:
    """Spikes found by the ratio rule alone, without a model."""
    rows = features.with_features(features.detection_series(_spiked(spark, sf_dir)), ["user_id", "service_name"])
    flagged = anomalies.with_rule_flag(features.with_category(rows), F.lit(False))
    return anomalies.reportable(flagged, days=days)


_ANOMALY_OUT = f"""user_id, service_name, {fixed('detected_value')} AS detected_value, {fixed('expected_value')} AS expected_value,
    deviation_percentage, severity, message, strftime(detected_at, '%Y-%m-%d') AS detected_at"""


def _anomaly_out(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.select(
        "user_id", "service_name", fixed_col("detected_value").alias("detected_value"),
        fixed_col("expected_value").alias("expected_value"), "deviation_percentage", "severity", "message",
        F.date_format("detected_at", "yyyy-MM-dd").alias("detected_at"), *extra,
    )


@query("A6_A8_spike_rule", f"WITH {SPIKED}, {_SERIES_SQL}, {_FEATURES}, {_RULES} SELECT {_ANOMALY_OUT} FROM found")
def a6_spikes(spark, sf_dir):
    return _anomaly_out(_rule_anomalies(spark, sf_dir))


@query("A7_spike_and_drop_flags", f"""WITH {SPIKED}, {_SERIES_SQL}, {_FEATURES}
SELECT user_id, service_name, strftime(date, '%Y-%m-%d') AS date, cost_ratio_7 >= 5 AS spike, cost_ratio_7 <= 0.15 AS low
FROM features WHERE cost_ratio_7 >= 5 OR cost_ratio_7 <= 0.15""")
def a7_drops(spark, sf_dir):
    rows = features.with_features(features.detection_series(_spiked(spark, sf_dir)), ["user_id", "service_name"])
    return anomalies.with_rule_flag(rows, F.lit(False), include_drops=True).where("flagged").select(
        "user_id", "service_name", F.date_format("date", "yyyy-MM-dd").alias("date"),
        (F.col("cost_ratio_7") >= anomalies.SPIKE_RATIO).alias("spike"), (F.col("cost_ratio_7") <= anomalies.DROP_RATIO).alias("low"),
    )


@query("A6_A8_model_detection")
def a68_model(spark, sf_dir):
    model = ingesting.train_model(_training(spark, sf_dir))
    found = ingesting.detect_service_anomalies(_spiked(spark, sf_dir), model)
    return _anomaly_out(found.withColumn("anomaly_score", fixed_col("anomaly_score", 6)), "anomaly_score")


def _category_costs(spark, sf_dir) -> DataFrame:
    raw = lineitem_costs(spark, sf_dir, [*SERIES_FIELDS, "provider"], planted_spikes=True).select(
        "user_id", F.col("usage_start_date").alias("date"), F.col("service_name").alias("service"), "cost",
        F.lower("provider").alias("provider"),
    )
    return features.normalize_costs(raw, ("user_id",))


@query("A9_category_detection")
def a9_category(spark, sf_dir):
    return _anomaly_out(ingesting.detect_category_anomalies(_category_costs(spark, sf_dir), ingesting.train_model(_training(spark, sf_dir))))


def _silent(model: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A model that flags nothing: scores lie between -1 and 0."""
    return {**model, "offsets": model["offsets"].withColumn("offset", F.lit(-1.0))}


_CATEGORY_SPIKES = f"""days AS (SELECT user_id, lower(provider) AS provider, {category_sql('service_name')} AS category, CAST(usage_start_date AS DATE) AS date,
    CAST({total('cost')} AS DOUBLE) AS t FROM spiked GROUP BY 1, 2, 3, 4),
dated AS (SELECT *, max(date) OVER (PARTITION BY user_id, provider) AS latest FROM days),
{_features_sql('dated', 'user_id, provider, category').replace('lags AS', 'c_lags AS').replace('FROM lags', 'FROM c_lags').replace('features AS', 'c_features AS')},
c_found AS (SELECT *, CASE WHEN rolling_mean_7 > 0 THEN (cost - rolling_mean_7) / rolling_mean_7 * 100 WHEN cost > 0 THEN 100 ELSE 0 END AS dev FROM c_features
    WHERE (cost_ratio_7 >= 5 OR cost_ratio_7 <= 0.15) AND date >= latest - 7 AND cost >= 1 AND category IN (SELECT category FROM train)),
c_reported AS (SELECT user_id, category AS service_name, cost AS detected_value, rolling_mean_7 AS expected_value, rolling_mean_7 AS threshold,
    {fixed('dev')} AS deviation_percentage, CASE WHEN abs(dev) > 100 THEN 'high' ELSE 'medium' END AS severity,
    CASE WHEN cost > rolling_mean_7 THEN 'Spike' ELSE 'Drop' END || ' detected in ' || category || ' (' || provider || '): '
        || CAST(CAST(floor(abs(dev) + 0.5) AS BIGINT) AS VARCHAR) || '% deviation' AS message, date AS detected_at FROM c_found WHERE abs(dev) >= 25)"""


@query("A9_spikes_and_drops", f"""WITH {COSTS}, {_TRAINING}, {SPIKED.replace('costs AS', 'spiked AS', 1)}, {_CATEGORY_SPIKES}
SELECT {_ANOMALY_OUT} FROM c_reported""")
def a9_rules(spark, sf_dir):
    """The whole category job with forests that flag nothing, so the rules alone decide."""
    model = _silent(ingesting.train_model(_training(spark, sf_dir), trees=5))
    return _anomaly_out(ingesting.detect_category_anomalies(_category_costs(spark, sf_dir), model))


def _stored(found: DataFrame) -> DataFrame:
    """A stored table holding every second found anomaly and, for each, an older decrease."""
    known = found.where(F.col("user_id") % 2 == 0)
    older = known.withColumn("detected_at", F.date_sub("detected_at", 30)).withColumn(
        "detected_value", F.col("expected_value") / 2
    )
    return (
        known.unionByName(older).withColumn("type", F.lit(anomalies.STORED_TYPE)).withColumn("status", F.lit("new"))
        .withColumn("acknowledged_at", F.lit(None).cast("timestamp_ntz"))
        .withColumn("resolved_at", F.lit(None).cast("timestamp_ntz"))
    )


@query("J2_A10_new_anomalies", f"""WITH {SPIKED}, {_SERIES_SQL}, {_FEATURES}, {_rules(BACKFILL_DAYS)}
SELECT {_ANOMALY_OUT}, 'ml_pattern' AS type, 'new' AS status, 'Investigate anomalous spending pattern detected by ML.' AS recommendation
FROM found WHERE user_id % 2 = 1""")
def a10_new(spark, sf_dir):
    found = _rule_anomalies(spark, sf_dir, BACKFILL_DAYS)
    fresh = anomalies.new_anomalies(found.unionByName(found), _stored(found))
    return _anomaly_out(fresh, "type", "status", "recommendation")


@query("A10_store_batches", f"""WITH {SPIKED}, {_SERIES_SQL}, {_FEATURES}, {_rules(BACKFILL_DAYS)}
SELECT {_ANOMALY_OUT}, 'ml_pattern' AS type, 'new' AS status, CASE WHEN user_id % 2 = 0 THEN 'first' ELSE 'second' END AS batch_id FROM found""")
def a10_store(spark, sf_dir):
    """Even tenants are stored by one batch, the rest by a second one that runs twice; old decreases are purged."""
    path = f"{shared_dir(spark)}/anomalies-{uuid.uuid4().hex}"
    found = cut_lineage(_rule_anomalies(spark, sf_dir, BACKFILL_DAYS))
    old = _stored(found).where("detected_value <= expected_value")
    anomaly_store.write_batch(old, path, "old")
    ingesting.store_new_anomalies(found.where(F.col("user_id") % 2 == 0), path, "first")
    for _ in range(2):
        ingesting.store_new_anomalies(found.unionByName(found), path, "second")
    return _anomaly_out(anomaly_store.read_anomalies(spark, path), "type", "status", "batch_id")


@query("A10_detect_and_store", f"""WITH {SPIKED}, {_SERIES_SQL}, {_FEATURES}, {_RULES}, {_TRAINING.replace('series AS', 'm_series AS', 1).replace('FROM series', 'FROM m_series').replace('lags AS', 'm_lags AS').replace('FROM lags', 'FROM m_lags').replace('features AS', 'm_features AS').replace('FROM features', 'FROM m_features')}
SELECT {_ANOMALY_OUT} FROM found WHERE {category_sql('service_name')} IN (SELECT category FROM train)""")
def a10_job(spark, sf_dir):
    """The job for all tenants, twice under one batch id, with forests that flag nothing."""
    path = f"{shared_dir(spark)}/anomalies-{uuid.uuid4().hex}"
    model = _silent(ingesting.train_model(_training(spark, sf_dir), trees=5))
    for _ in range(2):
        ingesting.detect_and_store(_spiked(spark, sf_dir), model, path, batch_id="today")
    return _anomaly_out(anomaly_store.read_anomalies(spark, path))


_STORED = """stored AS (SELECT *, 'new' AS status FROM found WHERE user_id % 2 = 0 UNION ALL
    SELECT user_id, service_name, expected_value / 2, expected_value, threshold, deviation_percentage, severity, message,
           detected_at - 30, 'new' FROM found WHERE user_id % 2 = 0)"""


@query("A10_purge", f"""WITH {SPIKED}, {_SERIES_SQL}, {_FEATURES}, {_rules(BACKFILL_DAYS)}, {_STORED}
SELECT {_ANOMALY_OUT} FROM stored WHERE detected_value > expected_value""")
def a10_purge(spark, sf_dir):
    return _anomaly_out(anomalies.purge_decreases(_stored(_rule_anomalies(spark, sf_dir, BACKFILL_DAYS))))


@query("Q12_anomaly_list", f"""WITH {SPIKED}, {_SERIES_SQL}, {_FEATURES}, {_rules(BACKFILL_DAYS)}, {_STORED}
SELECT {_ANOMALY_OUT}, CAST(row_number() OVER (PARTITION BY user_id ORDER BY detected_at DESC, service_name) AS BIGINT) AS position
FROM stored WHERE detected_value > expected_value AND severity = 'high' AND status = 'new'""")
def q12_list(spark, sf_dir):
    listed = anomalies.list_anomalies(_stored(_rule_anomalies(spark, sf_dir, BACKFILL_DAYS)), "new", "high")
    return _anomaly_out(listed.withColumn("position", F.col("position").cast("bigint")), "position")


@query("Q13_status_changes", f"""WITH {SPIKED}, {_SERIES_SQL}, {_FEATURES}, {_rules(BACKFILL_DAYS)}
SELECT user_id, service_name, strftime(detected_at, '%Y-%m-%d') AS detected_at,
       CASE user_id % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'acknowledged' ELSE 'new' END AS status,
       CASE WHEN user_id % 3 < 2 THEN '2001-06-16' END AS acknowledged, CASE WHEN user_id % 3 = 0 THEN '2001-06-18' END AS resolved FROM found""")
def q13_status(spark, sf_dir):
    keys = ["user_id", "service_name", "detected_at"]
    found = _rule_anomalies(spark, sf_dir, BACKFILL_DAYS).withColumn("status", F.lit("new")).withColumn(
        "acknowledged_at", F.lit(None).cast("timestamp_ntz")
    ).withColumn("resolved_at", F.lit(None).cast("timestamp_ntz"))
    seen = found.where(F.col("user_id") % 3 < 2).select(*keys, F.lit("acknowledged").alias("status"), F.lit("2001-06-16 08:00:00").cast("timestamp_ntz").alias("changed_at"))
    done = found.where(F.col("user_id") % 3 == 0).select(*keys, F.lit("resolved").alias("status"), F.lit("2001-06-18 08:00:00").cast("timestamp_ntz").alias("changed_at"))
    updated = anomalies.apply_status(found, seen.unionByName(done), keys)
    return updated.select(
        "user_id", "service_name", F.date_format("detected_at", "yyyy-MM-dd").alias("detected_at"), "status",
        F.date_format("acknowledged_at", "yyyy-MM-dd").alias("acknowledged"),
        F.date_format("resolved_at", "yyyy-MM-dd").alias("resolved"),
    )


@query("Q21_anomaly_count", f"""WITH {SPIKED}, {_SERIES_SQL}, {_FEATURES}, {_rules(BACKFILL_DAYS)}
SELECT user_id, count(*) AS anomaly_count FROM found WHERE detected_value > expected_value GROUP BY user_id""")
def q21_count(spark, sf_dir):
    return insights.anomaly_count(_rule_anomalies(spark, sf_dir, BACKFILL_DAYS))


def _ingested(spark, sf_dir) -> DataFrame:
    raw = lineitem_costs(spark, sf_dir, ["service_name", "cost", "usage_start_date", "provider"], planted_spikes=True).select(
        F.col("usage_start_date").alias("date"), F.col("service_name").alias("service"), "cost", F.lower("provider").alias("provider")
    )
    return features.normalize_costs(raw)


@query("A11_ingest_and_detect")
def a11_job(spark, sf_dir):
    folder = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    model = ingesting.train_model(_training(spark, sf_dir))
    return ingesting.ingest_and_detect(_ingested(spark, sf_dir), 1, model, f"{folder}/costs", f"{folder}/anomalies", AS_OF)


@query("A11_ingest_twice", f"""WITH {COSTS}, {_TRAINING}, {SPIKED.replace('costs AS', 'spiked_costs AS', 1)}, spiked AS (SELECT * REPLACE (1 AS user_id) FROM spiked_costs), {_CATEGORY_SPIKES},
first_of AS (SELECT * FROM c_reported QUALIFY row_number() OVER (PARTITION BY service_name, detected_at ORDER BY detected_value DESC) = 1),
records AS (SELECT count(*) AS n FROM days)
SELECT CAST(n AS BIGINT) AS success_count, CAST(0 AS BIGINT) AS error_count, CAST((SELECT count(*) FROM c_reported) AS BIGINT) AS detected,
    CAST((SELECT count(*) FROM first_of) AS BIGINT) AS stored, CAST(n AS BIGINT) AS cost_rows, CAST((SELECT count(*) FROM first_of WHERE detected_value > expected_value) AS BIGINT) AS listed
FROM records""")
def a11_twice(spark, sf_dir):
    """The job run twice under one batch id, with forests that flag nothing: counts, and what the tables hold afterwards."""
    folder = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    model = _silent(ingesting.train_model(_training(spark, sf_dir), trees=5))
    rows = _ingested(spark, sf_dir)
    for _ in range(2):
        counts = ingesting.ingest_and_detect(rows, 1, model, f"{folder}/costs", f"{folder}/anomalies", AS_OF, "batch")
    held = store.read_costs(spark, f"{folder}/costs").agg(F.count(F.lit(1)).alias("cost_rows"))
    listed = anomaly_store.read_anomalies(spark, f"{folder}/anomalies").agg(F.count(F.lit(1)).alias("listed"))
    return counts.join(F.broadcast(held), F.lit(True)).join(F.broadcast(listed), F.lit(True))


# --- alerts --------------------------------------------------------------------

def alert_users(spark, sf_dir) -> DataFrame:
    """``customer`` as users with alert settings of every kind."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("user_id"), F.when(key % 11 != 0, F.concat(F.col("c_name"), F.lit("@example.com"))).alias("email"),
        F.when(key % 3 == 0, True).when(key % 3 == 1, False).alias("email_alerts_enabled"),
        (key % 2 == 0).alias("email_notifications"),
        F.when(key % 5 != 0, (key % 7) * 1440).cast("int").alias("email_alert_cooldown_minutes"),
    )


A12_SQL = """WITH users AS (SELECT c_custkey AS user_id,
    CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN c_custkey % 7 * 1440 ELSE 10 END * 60000000 AS pause FROM customer
    WHERE c_custkey % 11 <> 0 AND (c_custkey % 3 = 0 OR (c_custkey % 3 = 2 AND c_custkey % 2 = 0))),
lists AS (SELECT user_id, event_type AS service_name, pause, list_sort(list(DISTINCT epoch_us(ts))) AS times
    FROM events JOIN users USING (user_id) GROUP BY ALL),
folded AS (SELECT user_id, service_name, list_reduce(list_transform(times, lambda t: [t]),
    lambda sent, t: CASE WHEN t[1] - sent[-1] >= pause THEN list_concat(sent, t) ELSE sent END) AS sent FROM lists),
flat AS (SELECT user_id, service_name, unnest(sent) AS us FROM folded)
SELECT user_id, service_name, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S') AS alert_at FROM flat"""


@query("A12_alert_selection", A12_SQL)
def a12_alerts(spark, sf_dir):
    fired = table(spark, sf_dir, "events").select(
        "user_id", F.col("event_type").alias("service_name"), F.col("ts").alias("alert_at")
    )
    return alerts.select_alerts(fired, alert_users(spark, sf_dir)).withColumn(
        "alert_at", F.date_format("alert_at", "yyyy-MM-dd HH:mm:ss")
    )


A12_OF_FOUND = A12_SQL.replace("event_type AS service_name", "service_name").replace("epoch_us(ts)", "epoch_us(CAST(detected_at AS TIMESTAMP))").replace("FROM events JOIN users", "FROM found JOIN users")


@query("A12_alerts_of_anomalies", f"""WITH {SPIKED}, {_SERIES_SQL}, {_FEATURES}, {_rules(BACKFILL_DAYS)}, {A12_OF_FOUND.replace('WITH users AS', 'users AS', 1)}""")
def a12_of_anomalies(spark, sf_dir):
    """Alerts for newly stored anomalies, of users who want them and within their cooldown."""
    path = f"{shared_dir(spark)}/anomalies-{uuid.uuid4().hex}"
    fresh, _ = ingesting.store_new_anomalies(_rule_anomalies(spark, sf_dir, BACKFILL_DAYS), path, "one")
    fired = fresh.select("user_id", "service_name", F.col("detected_at").cast("timestamp_ntz").alias("alert_at"))
    return alerts.select_alerts(fired, alert_users(spark, sf_dir)).withColumn("alert_at", F.date_format("alert_at", "yyyy-MM-dd HH:mm:ss"))


# --- forecasts -----------------------------------------------------------------

def _forecast_costs(spark, sf_dir) -> DataFrame:
    return lineitem_costs(spark, sf_dir, SERIES_FIELDS)


_SERIES_DAILY = f"""base AS (SELECT user_id, service_name, CAST(usage_start_date AS DATE) AS day, {total('cost')} AS t FROM costs GROUP BY 1, 2, 3),
daily AS (SELECT user_id, service_name AS series, day, t FROM base UNION ALL
    SELECT user_id, '__all__', day, sum(t) FROM base GROUP BY user_id, day)"""


def _resample_sql(label: str, grid: str, cut: str = "") -> str:
    return f"""{_SERIES_DAILY}, sums AS (SELECT user_id, series, {label} AS date, sum(t) AS t FROM daily GROUP BY 1, 2, 3),
bounds AS (SELECT user_id, series, min(date) AS a, max(date) AS z FROM sums GROUP BY 1, 2),
spine AS (SELECT user_id, series, {grid} AS date FROM bounds),
points AS (SELECT user_id, series, date, coalesce(CAST(t AS DOUBLE), 0) AS cost FROM spine LEFT JOIN sums USING (user_id, series, date) {cut})"""


_DAYS = "CAST(unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 DAY)) AS DATE)"
_RESAMPLED = {
    "daily": _resample_sql("day", _DAYS, f"WHERE date < DATE '{AS_OF}'"),
    "weekly": _resample_sql("day + CAST(7 - isodow(day) AS INTEGER)", "CAST(unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 7 DAY)) AS DATE)"),
    "monthly": _resample_sql(
        "last_day(day)", "last_day(CAST(unnest(generate_series(date_trunc('month', a)::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE))"
    ),
}
_UNTIL = f"costs AS (SELECT * FROM all_costs WHERE usage_start_date < TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY)"
_ALL_COSTS = COSTS.replace("costs AS (", "all_costs AS (", 1)


def _until(costs: DataFrame) -> DataFrame:
    """Costs known on the evaluation day, that day included."""
    return costs.where(F.col("usage_start_date") < F.lit("2001-06-16").cast("timestamp_ntz"))


def _points(spark, sf_dir, granularity: str, top: int | None = None) -> DataFrame:
    series = forecast.forecast_series(_until(_forecast_costs(spark, sf_dir)), top)
    return forecast.resample(series, granularity, AS_OF)


def _f1(granularity: str):
    sql = f"""WITH {_ALL_COSTS}, {_UNTIL}, {_RESAMPLED[granularity]}
SELECT user_id, series, strftime(date, '%Y-%m-%d') AS date, {fixed('cost')} AS actual_cost FROM points"""

    def run(spark, sf_dir):
        return forecast.history_output(_points(spark, sf_dir, granularity))

    query(f"F1_F8_resample_{granularity}", sql)(run)
    return run


f1_daily = _f1("daily")
f1_weekly = _f1("weekly")
f1_monthly = _f1("monthly")


@query("F2_clip_outliers", f"""WITH {_ALL_COSTS}, {_UNTIL}, {_RESAMPLED['weekly']},
q AS (SELECT user_id, series, quantile_cont(cost, 0.25) AS q1, quantile_cont(cost, 0.75) AS q3, count(*) AS n FROM points GROUP BY 1, 2)
SELECT user_id, series, strftime(date, '%Y-%m-%d') AS date, {fixed('cost', 1)} AS cost,
       {fixed('CASE WHEN n >= 10 THEN greatest(least(cost, q3 + (q3 - q1) * 1.5), q1 - (q3 - q1) * 1.5) ELSE cost END', 1)} AS clipped
FROM points JOIN q USING (user_id, series)""")
def f2_clip(spark, sf_dir):
    clipped = forecast.clip_outliers(_points(spark, sf_dir, "weekly"))
    return clipped.select(
        "user_id", "series", F.date_format("date", "yyyy-MM-dd").alias("date"),
        fixed_col("cost", 1).alias("cost"), fixed_col("clipped", 1).alias("clipped"),
    )


@query("F3_time_features", f"""WITH {_ALL_COSTS}, {_UNTIL}, {_RESAMPLED['monthly']},
x AS (SELECT *, CAST(date - min(date) OVER (PARTITION BY user_id, series) AS DOUBLE) AS t FROM points)
SELECT user_id, series, strftime(date, '%Y-%m-%d') AS date, t, t * t AS t2, {fixed('sin(2 * pi() * t / 12)', 6)} AS sin1,
       {fixed('cos(2 * pi() * t / 12)', 6)} AS cos1, {fixed('sin(4 * pi() * t / 12)', 6)} AS sin2, {fixed('cos(4 * pi() * t / 12)', 6)} AS cos2 FROM x""")
def f3_features(spark, sf_dir):
    rows = forecast.time_features(_points(spark, sf_dir, "monthly"), "monthly")
    return rows.select(
        "user_id", "series", F.date_format("date", "yyyy-MM-dd").alias("date"), "t", "t2",
        *[fixed_col(name, 6).alias(name) for name in ("sin1", "cos1", "sin2", "cos2")],
    )


def _f7(granularity: str, step: str):
    sql = f"""WITH {_ALL_COSTS}, {_UNTIL}, {_RESAMPLED[granularity]}, last AS (SELECT user_id, series, max(date) AS z FROM points GROUP BY 1, 2),
    steps AS (SELECT unnest(range(1, 13)) AS step)
    SELECT user_id, series, CAST(step AS INTEGER) AS step, strftime({step}, '%Y-%m-%d') AS date FROM last, steps"""

    def run(spark, sf_dir):
        return forecast.future_dates(_points(spark, sf_dir, granularity), granularity, 12).withColumn(
            "date", F.date_format("date", "yyyy-MM-dd")
        ).drop("series_start")

    query(f"F7_future_dates_{granularity}", sql)(run)
    return run


f7_daily = _f7("daily", "z + CAST(step AS INTEGER)")
f7_weekly = _f7("weekly", "z + CAST(step * 7 AS INTEGER)")
f7_monthly = _f7("monthly", "last_day(CAST(date_trunc('month', z) AS DATE) + to_months(CAST(step AS INTEGER)))")


_PREDICTED = f"""user_id, series, strftime(date, '%Y-%m-%d') AS date, {fixed('prediction', 0)} AS predicted_cost, {fixed('lower', 0)} AS lower_bound,
    {fixed('upper', 0)} AS upper_bound"""


def _whole(output: DataFrame) -> DataFrame:
    """Forecasts in whole currency units: sums of doubles differ in their last digits from run to run."""
    return output.select("user_id", "series", F.date_format("date", "yyyy-MM-dd").alias("date"), *[
        fixed_col(c, 0).alias(name) for c, name in (("prediction", "predicted_cost"), ("lower", "lower_bound"), ("upper", "upper_bound"))])


@query("F4_linear_forecast", f"""WITH {_ALL_COSTS}, {_UNTIL}, {_RESAMPLED['daily']}, {linear_forecast_sql('user_id, series', 7, 30)}
SELECT {_PREDICTED} FROM predictions""")
def f4_linear(spark, sf_dir):
    return _whole(forecast.forecast(cut_lineage(_points(spark, sf_dir, "daily")), 30))


@query("F4_linear_forecast_weekly", f"""WITH {_ALL_COSTS}, {_UNTIL}, {_RESAMPLED['weekly']}, {linear_forecast_sql('user_id, series', 52, 12, 7)}
SELECT {_PREDICTED}, {fixed('confidence', 1)} AS confidence FROM predictions""")
def f4_weekly(spark, sf_dir):
    found = forecast.forecast(cut_lineage(_points(spark, sf_dir, "weekly")), 12, "weekly")
    return _whole(found).join(found.select("user_id", "series", F.date_format("date", "yyyy-MM-dd").alias("date"), fixed_col("confidence", 1).alias("confidence")), ["user_id", "series", "date"])


_FEW = """points AS (SELECT user_id, series, date, cost FROM (SELECT *, row_number() OVER (PARTITION BY user_id, series ORDER BY date) AS nth FROM all_points) WHERE nth <= 2 + user_id % 6)"""


@query("F4_short_series", f"""WITH {_ALL_COSTS}, {_UNTIL}, {_RESAMPLED['weekly'].replace('points AS', 'all_points AS')}, {_FEW},
{linear_forecast_sql('user_id, series', 52, 4, 7)} SELECT {_PREDICTED} FROM predictions""")
def f4_short(spark, sf_dir):
    """Series of 2 to 7 points: fewer points than terms have the smallest solution."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id", "series").orderBy("date"))
    few = _points(spark, sf_dir, "weekly").withColumn("nth", nth).where(F.col("nth") <= 2 + F.col("user_id") % 6).drop("nth")
    return _whole(forecast.forecast(cut_lineage(few), 4, "weekly"))


_MONTHLY = f"""{_RESAMPLED['monthly']}, {linear_forecast_sql('user_id, series', 12, 6, MONTH_ENDS)}"""


@query("F5_trend_labels", f"""WITH {_ALL_COSTS}, {_UNTIL}, {_MONTHLY}, t AS (SELECT user_id, series, {fixed('sum(CAST(prediction AS DECIMAL(30,8)))')} AS total,
    count(*) AS periods, {fixed('min_by(prediction, step)')} AS f, {fixed('max_by(prediction, step)')} AS l, {fixed('any_value(confidence)', 1)} AS confidence_score FROM predictions GROUP BY 1, 2)
SELECT user_id, series, {fixed('total', 0)} AS total_predicted_cost, periods, confidence_score,
    CASE WHEN f > 0 AND l > f * 1.05::DOUBLE THEN 'increasing' WHEN f > 0 AND l < f * 0.95::DOUBLE THEN 'decreasing' ELSE 'stable' END AS trend FROM t""")
def f5_trend(spark, sf_dir):
    totals = forecast.forecast_totals(forecast.forecast(cut_lineage(_points(spark, sf_dir, "monthly")), 6, "monthly"))
    return totals.withColumn("total_predicted_cost", fixed_col("total_predicted_cost", 0))


@query("F6_additive_forecast")
def f6_additive(spark, sf_dir):
    return forecast.forecast_output(forecast.forecast(_points(spark, sf_dir, "daily"), 30, model="additive"))


def _detailed(spark, sf_dir, granularity: str = "daily", periods: int = 30) -> dict[str, DataFrame]:
    return forecasting.detailed_forecast(_until(_forecast_costs(spark, sf_dir)), AS_OF, periods, granularity)


CUT = "2001-05-16"


def _repeat_forecast(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(predictions, history): the last 30 days stand in as the forecast of the history before them."""
    points = _points(spark, sf_dir, "daily")
    cut = F.lit(CUT).cast("date")
    predictions = points.where(F.col("date") >= cut).select(
        "user_id", "series", (F.datediff("date", cut) + 1).alias("step"), "date", F.col("cost").alias("prediction"),
        (F.col("cost") * 0.8).alias("lower"), (F.col("cost") * 1.2).alias("upper"),
        fixed_col("cost").alias("trend_value"), F.lit(87.5).alias("confidence"),
    )
    return predictions, points.where(F.col("date") < cut)


_REPEAT = f"""{_RESAMPLED['daily']}, ahead AS (SELECT user_id, series, {total('cost')} AS tp, count(*) AS periods,
    {fixed('min_by(cost, date)')} AS f, {fixed('max_by(cost, date)')} AS l FROM points WHERE date >= DATE '{CUT}' GROUP BY 1, 2),
past AS (SELECT user_id, series, CAST({total(fixed('cost'))} AS DOUBLE) / count(*) AS c FROM points WHERE date < DATE '{CUT}' GROUP BY 1, 2),
growth AS (SELECT *, {fixed('tp')} AS total_predicted_cost, {fixed('tp')} / periods AS p,
    CASE WHEN f > 0 AND l > f * 1.05::DOUBLE THEN 'increasing' WHEN f > 0 AND l < f * 0.95::DOUBLE THEN 'decreasing' ELSE 'stable' END AS trend
    FROM ahead JOIN past USING (user_id, series)),
g AS (SELECT *, coalesce(CASE WHEN c > 0 THEN (p - c) / c * 100 END, 0) AS g FROM growth)"""


@query("F5_trend_of_repeat", f"""WITH {_ALL_COSTS}, {_UNTIL}, {_REPEAT}
SELECT user_id, series, total_predicted_cost, periods, 87.5::DOUBLE AS confidence_score, trend FROM growth""")
def f5_repeat(spark, sf_dir):
    return forecast.forecast_totals(_repeat_forecast(spark, sf_dir)[0])


@query("F10_summary_of_repeat", f"""WITH {_ALL_COSTS}, {_UNTIL}, {_REPEAT}
SELECT user_id, total_predicted_cost, {fixed('g', 1)} AS growth_percentage,
    CASE WHEN g > 20 THEN 'Critical' WHEN g > 5 THEN 'Warning' WHEN g < -5 THEN 'Good' ELSE 'Stable' END AS status_badge,
    'Next ' || periods || ' Days' AS period_label, 'Day' AS period_unit, trend, 87.5::DOUBLE AS confidence_score,
    {fixed('c')} AS current_period_avg, {fixed('p')} AS predicted_period_avg FROM g WHERE series = '__all__'""")
def f10_repeat(spark, sf_dir):
    return forecast.executive_summary(forecast.series_growth(*_repeat_forecast(spark, sf_dir))).drop("risk")


@query("F11_outlook_of_repeat", f"""WITH {_ALL_COSTS}, {_UNTIL}, {_REPEAT}
SELECT user_id, series AS service_name, total_predicted_cost, trend, {fixed('g', 1)} AS growth_pct,
    CASE WHEN g > 15 THEN 'Increasing' WHEN g < -5 THEN 'Decreasing' ELSE 'Stable' END AS status,
    CASE WHEN g > 15 THEN 'Review resource allocation and scaling policies.' WHEN g < -5 THEN 'Validate if meaningful services were turned off.'
         ELSE 'Monitor for unexpected spikes.' END AS action_item FROM g WHERE series <> '__all__'""")
def f11_repeat(spark, sf_dir):
    return forecast.service_outlook(forecast.series_growth(*_repeat_forecast(spark, sf_dir)))


@query("Q26_pivot_of_repeat", f"""WITH {_ALL_COSTS}, {_UNTIL}, {_RESAMPLED['daily']}
SELECT user_id, strftime(date, '%Y-%m-%d') AS date, {', '.join(f"max(CASE WHEN series = '{name}' THEN {fixed('cost')} END) AS " + chr(34) + name + chr(34) for name in SERVICE_OF_TYPE.values())}
FROM points WHERE date >= DATE '{CUT}' AND series <> '__all__' GROUP BY 1, 2""")
def q26_repeat(spark, sf_dir):
    output = forecast.forecast_output(_repeat_forecast(spark, sf_dir)[0])
    return forecast.pivot_forecast(output, list(SERVICE_OF_TYPE.values()))


_TOP_SERIES = f"""top AS (SELECT user_id, service_name AS series FROM base WHERE service_name IS NOT NULL GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sum(t) DESC, service_name) <= 5),
points AS (SELECT * FROM all_points WHERE series = '__all__' OR (user_id, series) IN (SELECT user_id, series FROM top))"""
_DETAILED = f"""{_RESAMPLED['daily'].replace('points AS', 'all_points AS')}, {_TOP_SERIES}, {linear_forecast_sql('user_id, series', 7, 30)}"""


@query("F9_detailed_forecast", f"""WITH {_ALL_COSTS}, {_UNTIL}, {_DETAILED}
SELECT user_id, series, strftime(date, '%Y-%m-%d') AS date, {fixed(fixed('prediction'), 0)} AS predicted_cost, {fixed(fixed('upper'), 0)} AS upper_bound FROM predictions""")
def f9_detailed(spark, sf_dir):
    points = _detailed(spark, sf_dir)["forecast"]
    return points.select("user_id", "series", "date", fixed_col("predicted_cost", 0).alias("predicted_cost"), fixed_col("upper_bound", 0).alias("upper_bound"))


def _outlook_sql(predictions: str) -> str:
    """Growth of every series from its points and predictions."""
    return f"""{predictions}, f_ahead AS (SELECT user_id, series, sum(CAST(prediction AS DECIMAL(30,8))) AS tp, count(*) AS periods,
    {fixed('min_by(prediction, step)')} AS f, {fixed('max_by(prediction, step)')} AS l, {fixed('any_value(confidence)', 1)} AS confidence FROM predictions GROUP BY 1, 2),
f_past AS (SELECT user_id, series, CAST({total(fixed('cost'))} AS DOUBLE) / count(*) AS c FROM points GROUP BY 1, 2),
f_growth AS (SELECT *, {fixed('tp')} AS total_cost, {fixed('tp')} / periods AS p,
    CASE WHEN f > 0 AND l > f * 1.05::DOUBLE THEN 'increasing' WHEN f > 0 AND l < f * 0.95::DOUBLE THEN 'decreasing' ELSE 'stable' END AS trend
    FROM f_ahead JOIN f_past USING (user_id, series)),
f_g AS (SELECT *, coalesce(CASE WHEN c > 0 THEN (p - c) / c * 100 END, 0) AS g FROM f_growth)"""


_OUTLOOK = _outlook_sql(_DETAILED)


@query("F11_service_outlook", f"""WITH {_ALL_COSTS}, {_UNTIL}, {_OUTLOOK}
SELECT user_id, series AS service_name, {fixed('total_cost', 0)} AS total_predicted_cost, trend, {fixed('g', 1)} AS growth_pct,
    CASE WHEN g > 15 THEN 'Increasing' WHEN g < -5 THEN 'Decreasing' ELSE 'Stable' END AS status FROM f_g WHERE series <> '__all__'""")
def f11_outlook(spark, sf_dir):
    return _detailed(spark, sf_dir)["services"].drop("action_item").withColumn("total_predicted_cost", fixed_col("total_predicted_cost", 0))


_WEEKLY = f"""{_RESAMPLED['weekly'].replace('points AS', 'all_points AS')}, {_TOP_SERIES}, {linear_forecast_sql('user_id, series', 52, 12, 7)}"""


@query("F10_executive_summary", f"""WITH {_ALL_COSTS}, {_UNTIL}, {_outlook_sql(_WEEKLY)}
SELECT user_id, {fixed('total_cost', 0)} AS total_predicted_cost, {fixed('g', 1)} AS growth_percentage,
    CASE WHEN g > 20 THEN 'Critical' WHEN g > 5 THEN 'Warning' WHEN g < -5 THEN 'Good' ELSE 'Stable' END AS status_badge,
    'Next ' || periods || ' Weeks' AS period_label, trend, confidence AS confidence_score, {fixed(fixed('c'), 0)} AS current_period_avg FROM f_g WHERE series = '__all__'""")
def f10_summary(spark, sf_dir):
    return _detailed(spark, sf_dir, "weekly", 12)["summary"].select(
        "user_id", fixed_col("total_predicted_cost", 0).alias("total_predicted_cost"), "growth_percentage", "status_badge", "period_label", "trend", "confidence_score",
        fixed_col("current_period_avg", 0).alias("current_period_avg"))


@query("F10_summary_of_forecast", f"""WITH {_ALL_COSTS}, {_UNTIL}, {_OUTLOOK}
SELECT user_id, {fixed('total_cost', 0)} AS total_predicted_cost, {fixed('g', 1)} AS growth_percentage,
    CASE WHEN g > 20 THEN 'Critical' WHEN g > 5 THEN 'Warning' WHEN g < -5 THEN 'Good' ELSE 'Stable' END AS status_badge,
    CASE WHEN g > 20 THEN 'Significant cost increase of ' || printf('%.1f', abs(g)) || '% expected' WHEN g > 5 THEN 'Moderate cost increase of ' || printf('%.1f', abs(g)) || '% expected'
        WHEN g < -5 THEN 'Cost saving of ' || printf('%.1f', abs(g)) || '% expected' END AS risk,
    'Next ' || periods || ' Days' AS period_label, trend, confidence AS confidence_score FROM f_g WHERE series = '__all__'""")
def f10_of_forecast(spark, sf_dir):
    return _detailed(spark, sf_dir)["summary"].select(
        "user_id", fixed_col("total_predicted_cost", 0).alias("total_predicted_cost"), "growth_percentage", "status_badge", "risk", "period_label", "trend", "confidence_score")


_GROWTH = f"""weeks AS (SELECT user_id, CAST(usage_start_date AS DATE) AS day, {total('cost')} AS t FROM costs GROUP BY 1, 2),
avgs AS (SELECT user_id, {fixed("CAST(sum(CASE WHEN day >= DATE '2001-05-16' THEN t END) AS DOUBLE) / 30")} AS p,
    {fixed("CAST(sum(CASE WHEN day < DATE '2001-05-16' THEN t END) AS DOUBLE) / 30")} AS c
    FROM weeks WHERE day >= DATE '2001-04-16' AND day < DATE '2001-06-15' GROUP BY 1),
summary AS (SELECT user_id, p, {fixed(change('p', 'c'), 1)} AS g FROM avgs)"""


@query("F12_card_values", f"""WITH {COSTS}, {_GROWTH}
SELECT user_id, {fixed('p * 30')} AS projected_monthly, CASE WHEN g > 0 AND p > 0 THEN CAST(floor(30 / (1 + g / 100) + 0.5) AS BIGINT) END AS days_to_exhaustion,
       CASE WHEN g > 20 THEN 'Immediate attention needed' WHEN g > 5 THEN 'Monitor closely' ELSE 'Within normal range' END AS risk_note FROM summary""")
def f12_cards(spark, sf_dir):
    from ..functions.numeric import change_pct

    def mean(first: str, after: str):
        inside = (F.col("day") >= F.lit(first).cast("date")) & (F.col("day") < F.lit(after).cast("date"))
        return fixed_col(F.sum(F.when(inside, F.col("total"))).cast("double") / F.lit(30.0))

    days = _forecast_costs(spark, sf_dir).groupBy("user_id", F.to_date("usage_start_date").alias("day")).agg(exact_sum("cost").alias("total"))
    averages = days.where(F.col("day").between(F.lit("2001-04-16").cast("date"), F.lit("2001-06-14").cast("date"))).groupBy("user_id").agg(
        mean("2001-05-16", "2001-06-15").alias("predicted_period_avg"), mean("2001-04-16", "2001-05-16").alias("before")
    )
    summary = averages.withColumn("period_unit", F.lit("Day")).withColumn(
        "growth_percentage", fixed_col(change_pct(F.col("predicted_period_avg"), F.col("before")), 1)
    )
    return forecast.card_values(summary)


@query("F12_cards_of_forecast", f"""WITH {_ALL_COSTS}, {_UNTIL}, {_OUTLOOK}, s AS (SELECT user_id, {fixed('p')} AS p, {fixed('g', 1)} AS g FROM f_g WHERE series = '__all__')
SELECT user_id, {fixed(fixed('p * 30'), 0)} AS projected_monthly, CASE WHEN g > 0 AND p > 0 THEN CAST(floor(30 / (1 + g / 100) + 0.5) AS BIGINT) END AS days_to_exhaustion,
    CASE WHEN g > 20 THEN 'Immediate attention needed' WHEN g > 5 THEN 'Monitor closely' ELSE 'Within normal range' END AS risk_note FROM s""")
def f12_of_forecast(spark, sf_dir):
    return _detailed(spark, sf_dir)["cards"].withColumn("projected_monthly", fixed_col("projected_monthly", 0))


@query("F13_metrics_seasonal_naive", f"""WITH {_ALL_COSTS}, {_UNTIL}, {_RESAMPLED['daily']},
j AS (SELECT user_id, series, cost AS actual, lag(cost, 7) OVER (PARTITION BY user_id, series ORDER BY date) AS predicted FROM points),
k AS (SELECT *, predicted * 0.8::DOUBLE AS lower, predicted * 1.2::DOUBLE AS upper FROM j WHERE predicted IS NOT NULL)
SELECT user_id, series, count(*) AS points, {fixed('avg(abs(predicted - actual))', 2)} AS mae,
       {fixed('sqrt(avg((predicted - actual) * (predicted - actual)))', 2)} AS rmse,
       {fixed('avg(CASE WHEN actual <> 0 THEN abs((predicted - actual) / actual) END) * 100', 2)} AS mape,
       {fixed('sum(predicted - actual) / sum(actual) * 100', 2)} AS bias_pct,
       {fixed('avg(CASE WHEN actual BETWEEN lower AND upper THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100', 2)} AS coverage_pct
FROM k GROUP BY 1, 2""")
def f13_metrics(spark, sf_dir):
    return forecast.forecast_metrics(forecast.seasonal_naive(_points(spark, sf_dir, "daily")), forecast.SERIES)


_FOLDS = f"""points AS (SELECT user_id, series, DATE '{AS_OF}' - CAST(back AS INTEGER) AS origin, date, cost FROM all_points, (SELECT unnest([90, 60, 30]) AS back)
    WHERE date < DATE '{AS_OF}' - CAST(back AS INTEGER))"""


@query("F13_backtest", f"""WITH {_ALL_COSTS}, {_UNTIL}, {_RESAMPLED['daily'].replace('points AS', 'all_points AS')}, {_FOLDS}, {linear_forecast_sql('user_id, series, origin', 7, 30)},
j AS (SELECT p.user_id, p.series, a.cost AS actual, p.prediction AS predicted, p.lower, p.upper FROM predictions p
    JOIN all_points a ON p.user_id = a.user_id AND p.series = a.series AND p.date = a.date)
SELECT user_id, series, count(*) AS points, {fixed(fixed('avg(abs(predicted - actual))'), 0)} AS mae, {fixed(fixed('sqrt(avg((predicted - actual) * (predicted - actual)))'), 0)} AS rmse,
    {fixed(fixed('sum(predicted - actual) / sum(actual) * 100'), 1)} AS bias_pct,
    {fixed(fixed('avg(CASE WHEN actual BETWEEN lower AND upper THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100'), 1)} AS coverage_pct FROM j GROUP BY 1, 2""")
def f13_backtest(spark, sf_dir):
    found = forecast.backtest(cut_lineage(_points(spark, sf_dir, "daily")), AS_OF)
    return found.select("user_id", "series", "points", *[
        fixed_col(c, digits).alias(c) for c, digits in (("mae", 0), ("rmse", 0), ("bias_pct", 1), ("coverage_pct", 1))])


@query("Q26_forecast_pivot", f"""WITH {_ALL_COSTS}, {_UNTIL}, {_DETAILED}
SELECT user_id, strftime(date, '%Y-%m-%d') AS date, {', '.join(f"max(CASE WHEN series = '{name}' THEN {fixed(fixed('prediction'), 0)} END) AS " + chr(34) + name + chr(34) for name in SERVICE_OF_TYPE.values())}
FROM predictions WHERE series <> '__all__' GROUP BY 1, 2""")
def q26_pivot(spark, sf_dir):
    services = list(SERVICE_OF_TYPE.values())
    wide = forecast.pivot_forecast(_detailed(spark, sf_dir)["forecast"], services)
    return wide.select("user_id", "date", *[fixed_col(name, 0).alias(name) for name in services])


# --- budgets -------------------------------------------------------------------

_SERVICES = list(SERVICE_OF_TYPE.values())
_BUDGETS = f"""requests AS (SELECT c_custkey AS budget_id, c_custkey % 10 AS user_id, c_name AS name, c_acctbal * 100 AS amount,
    (['monthly','quarterly','annual','monthly','annual','weekly','quarterly'])[CAST(c_custkey % 7 AS INTEGER) + 1] AS period,
    (['global','service','resource_group','global'])[CAST(c_custkey % 4 AS INTEGER) + 1] AS scope_type,
    CASE c_custkey % 4 WHEN 1 THEN ({_SERVICES})[c_nationkey % 6 + 1]
        WHEN 2 THEN 'Brand#' || CAST(c_custkey % 5 + 1 AS VARCHAR) || CAST(c_nationkey % 5 + 1 AS VARCHAR) ELSE '' END AS scope_value,
    c_custkey % 2 = 0 AS own_limits FROM customer),
checked AS (SELECT *, CASE WHEN amount <= 0 THEN 'Budget amount must be greater than 0' WHEN period = 'weekly' THEN 'Invalid budget period' END AS error FROM requests),
valid AS (SELECT * FROM checked WHERE error IS NULL),
budgets AS (SELECT *, CASE period WHEN 'monthly' THEN DATE '2001-06-01' WHEN 'quarterly' THEN DATE '2001-04-01' ELSE DATE '2001-01-01' END AS a,
    CASE period WHEN 'annual' THEN DATE '2001-12-31' ELSE DATE '2001-06-30' END AS z FROM valid)"""
_SPEND = f"""scoped AS (SELECT user_id, CAST(usage_start_date AS DATE) AS day, cost, 'global' AS scope_type, '' AS scope_value FROM costs
    UNION ALL SELECT user_id, CAST(usage_start_date AS DATE), cost, 'service', service_name FROM costs
    UNION ALL SELECT user_id, CAST(usage_start_date AS DATE), cost, 'resource_group', resource_group FROM costs),
spend AS (SELECT budget_id, {total('cost')} AS s FROM budgets b JOIN scoped c USING (user_id, scope_type, scope_value) WHERE day BETWEEN a AND z GROUP BY 1),
spent AS (SELECT *, coalesce(CAST(s AS DOUBLE), 0) AS actual FROM budgets LEFT JOIN spend USING (budget_id))"""
_BUDGET_FIELDS = ["user_id", "service_name", "tags", "cost", "usage_start_date"]


@query("B1_budget_validation", f"""WITH {_BUDGETS}
SELECT budget_id, period, scope_type, CASE WHEN own_limits THEN '90.0,25.0,60.0' ELSE '50.0,80.0,100.0' END AS thresholds, error FROM checked""")
def b1_validation(spark, sf_dir):
    return budgets.with_budget_validation(customer_budgets(spark, sf_dir)).select(
        "budget_id", "period", F.col("scope.type").alias("scope_type"),
        F.array_join(F.transform("thresholds", lambda t: t.cast("string")), ",").alias("thresholds"), "error",
    )


@query("B2_period_bounds", f"""WITH {_BUDGETS}
SELECT budget_id, strftime(a, '%Y-%m-%d') AS period_start, strftime(z, '%Y-%m-%d') AS period_end, CAST(z - a + 1 AS INTEGER) AS days_in_period,
       CAST(DATE '{AS_OF}' - a + 1 AS INTEGER) AS days_passed, CAST(z - DATE '{AS_OF}' AS INTEGER) AS days_remaining FROM budgets""")
def b2_bounds(spark, sf_dir):
    bounded = budgets.with_period(budgets.valid_budgets(customer_budgets(spark, sf_dir)), AS_OF)
    return bounded.select(
        "budget_id", F.date_format("period_start", "yyyy-MM-dd").alias("period_start"),
        F.date_format("period_end", "yyyy-MM-dd").alias("period_end"), "days_in_period", "days_passed", "days_remaining",
    )


@query("B3_J3_budget_spend", f"""WITH {COSTS}, {_BUDGETS}, {_SPEND}
SELECT budget_id, user_id, scope_type, scope_value, {fixed('actual')} AS actual_spend FROM spent""")
def b3_spend(spark, sf_dir):
    tracked = budgets.with_period(budgets.valid_budgets(customer_budgets(spark, sf_dir)), AS_OF)
    spent = budgets.budget_spend(tracked, budgets.scope_daily(lineitem_costs(spark, sf_dir, _BUDGET_FIELDS)), AS_OF)
    return spent.select("budget_id", "user_id", "scope_type", "scope_value", fixed_col("actual_spend").alias("actual_spend"))


_REACHED = "list_sort(list_filter(CASE WHEN own_limits THEN [90, 25, 60] ELSE [50, 80, 100] END, lambda t: pct >= t))"


@query("B5_budget_status", f"""WITH {COSTS}, {_BUDGETS}, {_SPEND}, p AS (SELECT *, actual / amount * 100 AS pct FROM spent),
r AS (SELECT *, {_REACHED} AS reached, CAST(floor(pct * 10 + 0.5) AS BIGINT) AS tenths, CAST(floor((actual - amount) * 100 + 0.5) AS BIGINT) AS cents FROM p)
SELECT budget_id, {fixed('pct', 1)} AS pct_consumed, {fixed('amount - actual')} AS remaining_amount,
    CASE WHEN len(list_filter(reached, lambda t: t >= 90)) > 0 THEN 'Critical'
         WHEN len(list_filter(reached, lambda t: t >= 50)) > 0 OR actual > amount THEN 'Warning' ELSE 'Safe' END AS status,
    list_aggregate(list_concat(list_transform(reached, lambda t: 'Exceeded ' || t || '% threshold (' || (tenths // 10) || '.' || (tenths % 10) || '%)'),
        CASE WHEN actual > amount THEN ['Forecasted to exceed budget by $' || (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0')] ELSE [] END),
        'string_agg', '; ') AS alerts
FROM r""")
def b5_status(spark, sf_dir):
    status = forecasting.track_budgets(
        customer_budgets(spark, sf_dir), lineitem_costs(spark, sf_dir, _BUDGET_FIELDS), AS_OF, model=None
    )
    text = F.array_join("alerts", "; ")
    return status.select("budget_id", "pct_consumed", "remaining_amount", "status", F.when(text != "", text).alias("alerts"))


_LEFT = {"monthly": 15, "quarterly": 15, "annual": 199}  # days after the evaluation day
_PROJECTION = f"""costs AS (SELECT * FROM all_costs WHERE usage_start_date < TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY), {_BUDGETS}, {_SPEND},
wanted AS (SELECT DISTINCT user_id, scope_type, scope_value FROM budgets),
b_sums AS (SELECT user_id, scope_type, scope_value, day AS date, {total('cost')} AS t FROM scoped SEMI JOIN wanted USING (user_id, scope_type, scope_value)
    WHERE day < DATE '{AS_OF}' GROUP BY 1, 2, 3, 4),
b_bounds AS (SELECT user_id, scope_type, scope_value, min(date) AS a, max(date) AS z FROM b_sums GROUP BY 1, 2, 3),
b_spine AS (SELECT user_id, scope_type, scope_value, {_DAYS} AS date FROM b_bounds),
points AS (SELECT user_id, scope_type, scope_value, date, coalesce(CAST(t AS DOUBLE), 0) AS cost FROM b_spine LEFT JOIN b_sums USING (user_id, scope_type, scope_value, date)),
{linear_forecast_sql('user_id, scope_type, scope_value', 7, 199, 1, '2001-06-14')},
remaining AS (SELECT user_id, scope_type, scope_value, period, round(sum(CAST(prediction AS DECIMAL(30,8))), 2)::DOUBLE AS r
    FROM predictions, (VALUES {', '.join(f"('{p}', {n})" for p, n in _LEFT.items())}) AS p(period, days_left) WHERE step <= days_left GROUP BY 1, 2, 3, 4)"""


@query("B4_budget_projection", f"""WITH {_ALL_COSTS}, {_PROJECTION}
SELECT budget_id, {fixed('actual')} AS actual_spend, {fixed(fixed('coalesce(r, 0)'), 0)} AS forecasted_remaining,
    {fixed(fixed('(actual + coalesce(r, 0)) / amount * 100', 1), 0)} AS pct_projected
FROM spent LEFT JOIN remaining USING (user_id, scope_type, scope_value, period)""")
def b4_projection(spark, sf_dir):
    tracked = forecasting.track_budgets(customer_budgets(spark, sf_dir), _until(lineitem_costs(spark, sf_dir, _BUDGET_FIELDS)), AS_OF)
    return tracked.select(
        "budget_id", "actual_spend", fixed_col("forecasted_remaining", 0).alias("forecasted_remaining"), fixed_col("pct_projected", 0).alias("pct_projected"))


# --- reports -------------------------------------------------------------------

@query("Q14_monthly_detail", f"""WITH {COSTS}, m AS (SELECT * FROM costs WHERE billing_period = '2001-05')
SELECT user_id, CAST(0 AS INTEGER) AS section, strftime(usage_start_date, '%Y-%m-%d') AS date, service_name, {category_sql('service_name')} AS category,
       region, {fixed('cost')} AS cost, currency, provider, resource_id FROM m
UNION ALL SELECT user_id, 1, 'TOTAL', '', '', '', {money(total('cost'))}, '', '', '' FROM m GROUP BY user_id""")
def q14_detail(spark, sf_dir):
    return reports.monthly_detail(lineitem_costs(spark, sf_dir), "2001-05")


@query("Q15_utilisation", f"""WITH {COSTS}, g AS (
    SELECT user_id, service_name, {category_sql('service_name')} AS category, min(provider) AS provider, {total('cost')} AS t, count(*) AS n FROM costs GROUP BY 1, 2, 3)
SELECT user_id, CAST(0 AS INTEGER) AS section, service_name, category, provider, {money('t')} AS total_cost, CAST(n AS BIGINT) AS record_count,
       {fixed('CAST(t AS DOUBLE) / n')} AS average_cost FROM g
UNION ALL SELECT user_id, 1, 'TOTAL', '', '', {money('sum(t)')}, CAST(sum(n) AS BIGINT), NULL FROM g GROUP BY user_id""")
def q15_utilisation(spark, sf_dir):
    return reports.utilisation(lineitem_costs(spark, sf_dir, ["user_id", "service_name", "provider", "cost"]))


@query("Q16_anomaly_log", f"""WITH {SPIKED}, {_SERIES_SQL}, {_FEATURES}, {_rules(BACKFILL_DAYS)}, {_STORED}
SELECT user_id, strftime(detected_at, '%Y-%m-%d') AS detected_at, strftime(detected_at, '%Y-%m-%d') AS date, service_name,
       {category_sql('service_name')} AS category, {fixed('detected_value')} AS actual_cost, {fixed('expected_value')} AS expected_cost,
       {fixed('deviation_percentage', 1)} AS deviation_pct, severity, status FROM stored""")
def q16_log(spark, sf_dir):
    return reports.anomaly_log(_stored(_rule_anomalies(spark, sf_dir, BACKFILL_DAYS)))


@query("Q17_executive_overview", f"""WITH {COSTS}, b AS (SELECT *, {category_sql('service_name')} AS category FROM costs
    WHERE usage_start_date >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY AND usage_start_date <= TIMESTAMP '{AS_OF}'),
g AS (SELECT user_id, 'total' AS section, 'TOTAL' AS name, {total('cost')} AS t, count(*) AS n FROM b GROUP BY 1
    UNION ALL SELECT user_id, 'provider', provider, {total('cost')}, count(*) FROM b GROUP BY user_id, provider
    UNION ALL SELECT user_id, 'category', category, {total('cost')}, count(*) FROM b GROUP BY user_id, category),
w AS (SELECT *, max(CASE WHEN section = 'total' THEN t END) OVER (PARTITION BY user_id) AS whole FROM g)
SELECT user_id, section, name, {money('t')} AS total_cost, CAST(n AS BIGINT) AS record_count, {share('t', 'whole', 1)} AS percentage FROM w""")
def q17_overview(spark, sf_dir):
    return reports.executive_overview(lineitem_costs(spark, sf_dir, [*SERIES_FIELDS, "provider"]), AS_OF)


@query("S12_report_csv", f"""WITH {COSTS}, g AS (SELECT user_id, service_name, {category_sql('service_name')} AS category, min(provider) AS provider, {total('cost')} AS t, count(*) AS n FROM costs GROUP BY 1, 2, 3)
SELECT CAST(user_id AS VARCHAR) AS user_id, '0' AS section, service_name, category, provider, {money('t')} AS total_cost, CAST(CAST(n AS BIGINT) AS VARCHAR) AS record_count, {fixed('CAST(t AS DOUBLE) / n')} AS average_cost FROM g
UNION ALL SELECT CAST(user_id AS VARCHAR), '1', 'TOTAL', NULL, NULL, {money('sum(t)')}, CAST(CAST(sum(n) AS BIGINT) AS VARCHAR), NULL FROM g GROUP BY user_id""")
def s12_csv(spark, sf_dir):
    """All columns of a report, written as CSV and read back; amounts as numbers again, empty texts as nulls."""
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    store.write_report_csv(reports.utilisation(lineitem_costs(spark, sf_dir, ["user_id", "service_name", "provider", "cost"])), path)
    read = spark.read.option("header", True).option("emptyValue", "").csv(path)
    text = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return read.select(
        "user_id", "section", "service_name", text("category"), text("provider"), F.col("total_cost").cast("double").alias("total_cost"), "record_count",
        F.col("average_cost").cast("double").alias("average_cost"))


@query("S9_cost_table", f"""WITH {COSTS}
SELECT user_id, billing_period, count(*) AS record_count, {money(total('cost'))} AS total_cost FROM costs
WHERE usage_start_date >= TIMESTAMP '1999-03-15' AND usage_start_date <= TIMESTAMP '2000-02-10' GROUP BY 1, 2""")
def s9_cost_table(spark, sf_dir):
    path = f"{shared_dir(spark)}/costs-{uuid.uuid4().hex}"
    good, _ = records.ingest(dealt(lineitem_costs(spark, sf_dir)), AS_OF)
    store.append_costs(good, path)
    stored = store.read_costs(spark, path, "1999-03-15", "2000-02-10")
    return stored.groupBy("user_id", "billing_period").agg(
        F.count(F.lit(1)).alias("record_count"), money_col(exact_sum("cost")).alias("total_cost")
    )
