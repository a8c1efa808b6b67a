"""The provided tables as cost records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import prepare

SERVICE_OF_TYPE = {
    "ECONOMY": "Amazon EC2",
    "PROMO": "Amazon S3",
    "MEDIUM": "Azure SQL Database",
    "SMALL": "Cloud CDN",
    "STANDARD": "Azure Monitor",
    "LARGE": "Key Vault",
}
COST_FIELDS = [
    "cost_id", "user_id", "provider", "cloud_account_id", "service_name", "resource_id", "region",
    "usage_quantity", "usage_unit", "cost", "currency", "usage_start_date", "usage_end_date",
    "billing_period", "tags",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _choice(key: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(value) for value in values]), (key + 1).cast("int"))


def lineitem_costs(
    spark: SparkSession, sf_dir: str, fields: list[str] | None = None, planted_spikes: bool = False, sorted_joins: bool = False
) -> DataFrame:
    """``lineitem`` as cost records, joining only the tables the wanted fields need.

    ``sorted_joins`` never makes a hash table of orders or parts: Spark tells a table's size from its
    packed files, and every task holds the hash table, which is many times larger.
    """
    def met(rows: DataFrame) -> DataFrame:
        return rows.hint("merge") if sorted_joins else rows

    fields = fields or COST_FIELDS
    wanted = set(fields)
    costs = table(spark, sf_dir, "lineitem")
    if "user_id" in wanted:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        costs = costs.join(met(orders), F.col("l_orderkey") == F.col("o_orderkey"))
    if wanted & {"service_name", "tags"}:
        part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
        costs = costs.join(met(part), F.col("l_partkey") == F.col("p_partkey"))
    if "region" in wanted:
        # nation and region are fixed 25- and 5-row tables
        place = (
            table(spark, sf_dir, "nation")
            .join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", "r_name")
        )
        supplier = (
            table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
            .join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey"))
            .select("s_suppkey", "r_name")
        )
        costs = costs.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))

    service = F.lit(None).cast("string")
    for kind, name in SERVICE_OF_TYPE.items():
        service = F.when(F.col("p_type") == kind, name).otherwise(service)
    cost = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    if planted_spikes:
        hit = (F.col("l_orderkey") * 31 + F.col("l_linenumber")) % 29 == 0
        cost = cost * F.when(hit, F.lit(20.0)).otherwise(F.lit(1.0))
    start = F.col("l_shipdate")
    expressions = {
        "cost_id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        "user_id": F.col("o_custkey") % 10 if "user_id" in wanted else None,
        "provider": _choice(F.col("l_suppkey") % 4, ["AWS", "Azure", "GCP", "Other"]),
        "cloud_account_id": F.concat(F.lit("acct-"), F.col("l_suppkey")),
        "service_name": service,
        "resource_id": F.when(F.col("l_partkey") % 50 == 0, "").otherwise(F.concat(F.lit("part-"), F.col("l_partkey"))),
        "region": F.col("r_name"),
        "usage_quantity": F.col("l_quantity"),
        "usage_unit": F.lit("unit"),
        "cost": cost,
        "currency": F.lit("USD"),
        "usage_start_date": start,
        "usage_end_date": start + F.make_dt_interval(F.col("l_linenumber") - 1),
        "billing_period": F.date_format(start, "yyyy-MM"),
        "tags": F.create_map(
            F.lit("environment"),
            _choice(F.col("l_linenumber") % 3, ["production", "staging", "development"]),
            F.lit("resource_group"), F.col("p_brand"),
        ),
    }
    return costs.select(*[expressions[field].alias(field) for field in fields])


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of the given tables spread over all cores, for queries that work hard on each: a table may be one row group.

    Adaptive execution sizes the partitions, so more rows make more of them and not larger ones.
    """
    return rows.hint("rebalance")


def event_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as cost records of provider Other."""
    return table(spark, sf_dir, "events").select(
        "user_id",
        F.lit("Other").alias("provider"),
        F.col("event_type").alias("service_name"),
        F.col("value").alias("cost"),
        F.col("ts").alias("usage_start_date"),
        F.col("ts").alias("usage_end_date"),
        F.date_format("ts", "yyyy-MM").alias("billing_period"),
        F.from_json("props", "map<string,string>").alias("tags"),
    )


def customer_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as budget requests, valid and invalid ones."""
    key = F.col("c_custkey")
    services = list(SERVICE_OF_TYPE.values())
    scope_type = _choice(key % 4, ["global", "service", "resource_group", "global"])
    scope_value = (
        F.when(key % 4 == 1, _choice(F.col("c_nationkey") % 6, services))
        .when(key % 4 == 2, F.concat(F.lit("Brand#"), (key % 5 + 1).cast("string"), (F.col("c_nationkey") % 5 + 1).cast("string")))
    )
    return table(spark, sf_dir, "customer").select(
        key.alias("budget_id"),
        (key % 10).alias("user_id"),
        F.col("c_name").alias("name"),
        (F.col("c_acctbal") * F.lit(100.0)).alias("amount"),
        _choice(key % 7, ["monthly", "quarterly", "annual", "monthly", "annual", "weekly", "quarterly"]).alias("period"),
        F.struct(scope_type.alias("type"), scope_value.alias("value")).alias("scope"),
        F.when(key % 2 == 0, F.array(F.lit(90.0), F.lit(25.0), F.lit(60.0))).alias("thresholds"),
    )
