"""Ingest jobs: read, normalise, validate, store, detect."""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import alerts, anomalies, features, forest, records
from ..session import cut_counted, cut_lineage
from ..sources import anomaly_store, store
from ..sources import billing_exports as exports

API_MAPPERS = {"azure": exports.map_azure_rows, "aws": exports.map_aws_response}


def default_range(as_of: str) -> tuple[str, str]:
    """First day of the month and the day after ``as_of`` (exclusive end)."""
    day = date.fromisoformat(str(as_of)[:10])
    return str(day.replace(day=1)), str(day + timedelta(days=1))


def fetch(
    spark: SparkSession, source_type: str, provider: str, source, as_of: str,
    start: str | None = None, end: str | None = None, encoding: str = "UTF-8", multiline: bool = False,
) -> DataFrame:
    """Normalised (date, category, provider, cost) of one source.

    ``source_type`` 'file': ``source`` is a CSV path. 'api': ``source`` is a
    landed API result as DataFrame; landed rows are cut to [start, end).
    """
    kind, key = (source_type or "").strip().lower(), (provider or "").strip().lower()
    if kind not in ("api", "file"):
        raise ValueError(f"source_type must be 'api' or 'file', got {source_type!r}")
    if key not in exports.PROVIDER_KEYS:
        raise ValueError(f"provider must be one of {exports.PROVIDER_KEYS}, got {provider!r}")
    first, after = default_range(as_of)
    start, end = start or first, end or after
    for bound in (start, end):
        date.fromisoformat(bound)
    if kind == "file":
        raw = exports.read_export(spark, source, key, encoding, multiline)
    elif key == "gcp":
        raw = exports.map_gcp_export(source, start, end)
    else:
        raw = API_MAPPERS[key](source).where(
            (F.col("date") >= F.lit(start).cast("timestamp_ntz")) & (F.col("date") < F.lit(end).cast("timestamp_ntz"))
        )
    return features.normalize_costs(raw.na.drop(subset=["date", "cost"]))


def _fitted(rows: DataFrame, key: str, trees: int, seed: int, spread: int) -> dict[str, DataFrame]:
    # one small row set per model and day feeds scaler, trees and offsets: read the costs once
    rows = cut_lineage(rows)
    table = features.scaler(rows, key)
    scaled = features.scale(rows, table, key)
    # the trees feed the offsets and every later scoring: grow them once
    grown = cut_lineage(forest.train_trees(scaled, key, trees=trees, seed=seed))
    limits = forest.offsets(forest.score(scaled, grown, key, spread=spread), key)
    return {"trees": grown, "scaler": table, "offsets": limits}


def train_model(training: DataFrame, trees: int = forest.TREES, seed: int = forest.SEED, spread: int = 1) -> dict[str, DataFrame]:
    """Forest of every category from (date, service, cost) rows: trees, scaler and offsets."""
    return _fitted(features.training_features(training), "category", trees, seed, spread)


def train_own_models(
    training: DataFrame, tenants: DataFrame | None = None, trees: int = forest.TREES, seed: int = forest.SEED, spread: int = 1,
) -> dict[str, DataFrame]:
    """Forests of every category and of every category of each tenant, in one grouped job.

    ``training`` also has user_id. The tables are keyed by ``model_key``; scoring with them
    takes the tenant's own model if there is one, else the shared one.
    """
    return _fitted(features.own_and_shared_features(training, tenants), "model_key", trees, seed, spread)


def score_series(rows: DataFrame, model: dict[str, DataFrame], key: str = "category", spread: int = 8) -> DataFrame:
    """Feature rows with score, decision and model flag; series without a model are dropped.

    Models keyed by ``model_key`` are resolved first, own before shared.
    """
    if "model_key" in model["scaler"].columns:
        rows, key = store.preferred_model_key(rows, model["scaler"], name=key), "model_key"

    def keyed(frame: DataFrame) -> DataFrame:
        return frame if key in frame.columns else frame.withColumnRenamed("category", key)

    scaled = features.scale(rows, keyed(model["scaler"]), key)
    scored = forest.score(scaled, model["trees"], key, spread)
    return forest.decide(scored, keyed(model["offsets"]), key)


def detect_service_anomalies(costs: DataFrame, model: dict[str, DataFrame], spread: int = 8) -> DataFrame:
    """Increases in the tenants' service series of the last 90 days, found by model or spike rule."""
    series = features.detection_series(costs)
    rows = features.with_category(features.with_features(series, ["user_id", "service_name"]))
    recent = rows.where(F.col("date") >= F.date_sub("latest", features.RECENT_DAYS))
    scored = score_series(recent, model, spread=spread)
    return anomalies.reportable(anomalies.with_rule_flag(scored, F.col("model_flag")), score="decision")


def detect_category_anomalies(normalized: DataFrame, model: dict[str, DataFrame], spread: int = 8) -> DataFrame:
    """Spikes and drops in normalised category series (user_id, date, category, provider, cost)."""
    keys = ["user_id", "provider", "category"]
    # categories and days bound what one tenant and provider have
    dated = normalized.withColumn("latest", F.max("date").over(Window.partitionBy("user_id", "provider")))
    rows = features.with_features(dated.withColumnRenamed("cost", "value"), keys, value="value").drop("value")
    recent = rows.where(F.col("date") >= F.date_sub("latest", features.RECENT_DAYS)).withColumn("service_name", F.col("category"))
    scored = score_series(recent, model, spread=spread)
    flagged = anomalies.with_rule_flag(scored, F.col("model_flag"), include_drops=True)
    return anomalies.reportable(flagged, include_drops=True, score="decision")


def store_new_anomalies(
    detected: DataFrame, path: str, batch_id: str | None = None, kind: str = anomalies.STORED_TYPE, match_type: bool = True,
) -> tuple[DataFrame, dict]:
    """Store the detected anomalies that no other batch holds, purge decreases, and return them with the counts.

    ``detected`` is written once; its earliest day cuts what is read of the store. A batch
    is compared with all others and then replaces itself, so repeating it changes nothing.
    """
    spark = detected.sparkSession
    batch = batch_id or uuid.uuid4().hex
    found, seen = cut_counted(detected, total_detected=F.count(F.lit(1)), earliest=F.min(F.to_date("detected_at")))
    since = seen["earliest"] and seen["earliest"] - timedelta(days=1)
    stored = anomaly_store.read_anomalies(spark, path, since, batch, purged=match_type)
    fresh, kept = cut_counted(anomalies.new_anomalies(found, stored, kind, match_type), stored=F.count(F.lit(1)))
    anomaly_store.write_batch(fresh, path, batch)
    return fresh, {"total_detected": seen["total_detected"], "stored": kept["stored"]}


def detect_and_store(
    costs: DataFrame, model: dict[str, DataFrame], path: str, users: DataFrame | None = None, batch_id: str | None = None, spread: int = 8,
) -> dict:
    """Detect increases for all tenants, store the new ones and select the alerts to send for them.

    Returns the counts, the stored rows and, with ``users``, the alerts.
    """
    fresh, counts = store_new_anomalies(detect_service_anomalies(costs, model, spread), path, batch_id)
    sent = None if users is None else alerts.select_alerts(fresh.withColumn("alert_at", F.col("detected_at").cast("timestamp_ntz")), users)
    return {**counts, "new": fresh, "alerts": sent}


def ingest_and_detect(
    normalized: DataFrame, user_id, model: dict[str, DataFrame], cost_path: str, anomaly_path: str, ingested_at: str, batch_id: str | None = None,
) -> DataFrame:
    """Store a normalised ingest, detect on it, store the new anomalies; returns the counts.

    A run that failed is repeated under the same ``batch_id``: its costs and its anomalies
    replace themselves. Everything is counted in the passes that write it.
    """
    spark = normalized.sparkSession
    kept = cut_lineage(normalized)
    checked = records.with_validation(records.normalized_to_records(kept, F.lit(user_id), ingested_at))
    written, seen = cut_counted(
        checked, success_count=F.count(F.when(F.col("error").isNull(), 1)), error_count=F.count("error"))
    store.append_costs(records.build_records(written.where("error is null").drop("error"), ingested_at), cost_path, batch_id)
    detected = detect_category_anomalies(kept.withColumn("user_id", F.lit(user_id)), model)
    _, counts = store_new_anomalies(detected, anomaly_path, batch_id, anomalies.INGEST_TYPE, match_type=False)
    row = (seen["success_count"], seen["error_count"], counts["total_detected"], counts["stored"])
    return spark.createDataFrame([row], "success_count bigint, error_count bigint, detected bigint, stored bigint")
