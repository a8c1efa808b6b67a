"""Registered queries with their DuckDB twins, and the SQL pieces the twins share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import SERVICE_OF_TYPE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2001-06-15"  # fixed instant inside the tables


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function under ``name``."""
    def add(function):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def total(cost: str) -> str:
    return f"sum(CAST({cost} AS DECIMAL(20,4)))"


def money(value: str) -> str:
    return f"CAST(round({value}, 2) AS DOUBLE)"


def fixed(value: str, digits: int = 2) -> str:
    scale = 10 ** digits
    return f"(floor(CAST({value} AS DOUBLE) * {scale} + 0.5) / {scale})"


def change(current: str, previous: str) -> str:
    now, before = f"CAST({current} AS DOUBLE)", f"CAST({previous} AS DOUBLE)"
    return f"CASE WHEN {before} > 0 THEN ({now} - {before}) / {before} * 100 END"


def share(part: str, whole: str, digits: int = 2) -> str:
    inner = fixed(f"CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100", digits)
    return f"CASE WHEN {whole} > 0 THEN {inner} ELSE 0.0::DOUBLE END"


_SERVICE = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SERVICE_OF_TYPE.items()) + " END"

COSTS_FROM = """
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey"""


def costs_cte(name: str = "costs", spikes: bool = False) -> str:
    factor = " * CASE WHEN (l_orderkey * 31 + l_linenumber) % 29 = 0 THEN 20 ELSE 1 END" if spikes else ""
    return f"""{name} AS (SELECT
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS cost_id,
    o_custkey % 10 AS user_id,
    CASE l_suppkey % 4 WHEN 0 THEN 'AWS' WHEN 1 THEN 'Azure' WHEN 2 THEN 'GCP' ELSE 'Other' END AS provider,
    'acct-' || l_suppkey AS cloud_account_id,
    {_SERVICE} AS service_name,
    CASE WHEN l_partkey % 50 = 0 THEN '' ELSE 'part-' || l_partkey END AS resource_id,
    r_name AS region, l_quantity AS usage_quantity, 'unit' AS usage_unit,
    l_extendedprice * (1 - l_discount){factor} AS cost, 'USD' AS currency,
    l_shipdate AS usage_start_date, l_shipdate + to_days(l_linenumber - 1) AS usage_end_date,
    strftime(l_shipdate, '%Y-%m') AS billing_period,
    CASE l_linenumber % 3 WHEN 0 THEN 'production' WHEN 1 THEN 'staging' ELSE 'development' END AS environment,
    p_brand AS resource_group, l_linenumber, l_orderkey, l_partkey{COSTS_FROM})"""


COSTS = costs_cte()
SPIKED = costs_cte(spikes=True)
EVENTS = """costs AS (SELECT user_id, 'Other' AS provider, event_type AS service_name, value AS cost,
    ts AS usage_start_date, ts AS usage_end_date, strftime(ts, '%Y-%m') AS billing_period FROM events)"""
