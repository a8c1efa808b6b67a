"""Registered queries for sources, validation, parsing, categories and corrections.

Billing files are derived from the provided tables: values are rendered as the
text a provider export would hold, broken in places, and read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import parsing
from ..functions.category import CATEGORY_RULES, category_sql, with_category
from ..functions.numeric import exact_sum, fixed as fixed_col, money as money_col
from ..operators import features, records, summaries
from ..session import cut_lineage, shared_dir
from ..sources import billing_exports as exports
from ..sources import generic_csv
from ..sources.tables import dealt, lineitem_costs, table
from . import ingesting
from .registry import AS_OF, COSTS, fixed, money, query, total

LINE_KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def _by_day(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy(F.date_format("date", "yyyy-MM-dd").alias("date"), "service", "provider").agg(
        F.count(F.lit(1)).alias("row_count"), money_col(exact_sum("cost")).alias("total_cost")
    )


def _by_day_sql(rows: str, provider: str) -> str:
    return f"""WITH {COSTS}, rows AS ({rows})
SELECT strftime(d, '%Y-%m-%d') AS date, service, '{provider}' AS provider, count(*) AS row_count, {money(total('cost'))} AS total_cost
FROM rows GROUP BY 1, 2"""


# --- provider exports ----------------------------------------------------------

def _azure_export(spark, sf_dir) -> DataFrame:
    line = F.col("l_linenumber")
    start = F.col("usage_start_date")
    return _lines(spark, sf_dir, ["usage_start_date", "service_name", "cost"]).select(
        F.when(line == 1, F.lit("not a date")).when(line == 2, F.date_format(start, "MM/dd/yyyy"))
        .when(line == 3, F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .otherwise(F.date_format(start, "yyyy-MM-dd")).alias("Usage Date Time"),
        F.concat(F.lit("  "), F.col("service_name"), F.lit(" ")).alias("Meter Category"),
        F.lit("west").alias("Location"),
        F.col("service_name").alias("MeterCategory"),
        F.when(line == 7, F.lit("n/a")).otherwise(F.col("cost").cast("string")).alias("Cost"),
    ).drop("Meter Category").withColumnRenamed("Usage Date Time", "usage-date")


def _lines(spark, sf_dir, fields: list[str]) -> DataFrame:
    """Cost fields plus the line number that decides how a value is rendered."""
    costs = dealt(lineitem_costs(spark, sf_dir, ["cost_id", *fields]))
    return costs.withColumn("l_linenumber", F.split("cost_id", "-")[1].cast("int"))


@query("S1_azure_csv", _by_day_sql("""SELECT CASE WHEN l_linenumber = 3 THEN usage_start_date - INTERVAL 2 HOUR ELSE usage_start_date END AS d,
    service_name AS service, cost FROM costs WHERE l_linenumber NOT IN (1, 7)""", "azure"))
def s1_azure(spark, sf_dir):
    return _by_day(exports.map_export(_azure_export(spark, sf_dir), "azure"))


@query("S1_aws_csv", _by_day_sql("SELECT usage_start_date AS d, service_name AS service, cost FROM costs WHERE l_linenumber <> 4", "aws"))
def s1_aws(spark, sf_dir):
    line = F.col("l_linenumber")
    raw = _lines(spark, sf_dir, ["usage_start_date", "service_name", "cost"]).select(
        F.date_format("usage_start_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("lineItem/UsageStartDate"),
        F.col("service_name").alias("product/ProductName"),
        F.when(line == 4, F.lit("NaN")).otherwise(F.col("cost").cast("string")).alias("lineItem/UnblendedCost"),
        F.lit("0").alias("lineItem/BlendedCost"),
    )
    return _by_day(exports.map_export(raw, "AWS"))


@query("S4_training_union", f"""WITH {COSTS}
SELECT strftime(usage_start_date, '%Y-%m-%d') AS date, service_name AS service, count(*) AS row_count, {money(total('cost'))} AS total_cost
FROM costs GROUP BY 1, 2""")
def s4_training(spark, sf_dir):
    costs = lineitem_costs(spark, sf_dir, ["usage_start_date", "service_name", "cost", "provider"])
    headers = {
        "AWS": ("lineItem/UsageStartDate", "product/ProductName", "lineItem/UnblendedCost"),
        "Azure": ("Date", "MeterCategory", "CostInBillingCurrency"),
        "GCP": ("usage_start_time", "service.description", "cost"),
        "Other": ("start_time", "service_description", "cost"),
    }
    merged = None
    for provider, (date, service, cost) in headers.items():
        part = costs.where(F.col("provider") == provider).select(
            F.date_format("usage_start_date", "yyyy-MM-dd").alias(date), F.col("service_name").alias(service),
            F.col("cost").cast("string").alias(cost),
        )
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    mapped = exports.map_training(merged)
    return mapped.groupBy(F.date_format("date", "yyyy-MM-dd").alias("date"), "service").agg(
        F.count(F.lit(1)).alias("row_count"), money_col(exact_sum("cost")).alias("total_cost")
    )


# --- the same exports as files ---------------------------------------------------

def _landed(df: DataFrame, encoding: str = "UTF-8", folder: str | None = None) -> str:
    """Write rows as CSV files with a header into the shared folder; the folder."""
    path = folder or f"{shared_dir(df.sparkSession)}/landed-{uuid.uuid4().hex}"
    df.write.mode("append").option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"').csv(path)
    return path


@query("S1_azure_csv_files", _by_day_sql("""SELECT CASE WHEN l_linenumber = 3 THEN usage_start_date - INTERVAL 2 HOUR ELSE usage_start_date END AS d,
    service_name AS service, cost FROM costs WHERE l_linenumber NOT IN (1, 7)""", "azure"))
def s1_azure_files(spark, sf_dir):
    """Two files of different column order in one folder."""
    rows = _azure_export(spark, sf_dir)
    first = F.pmod(F.xxhash64("usage-date", "Cost"), F.lit(2)) == 0
    folder = _landed(rows.where(first))
    _landed(rows.where(~first).select("Cost", "MeterCategory", "usage-date", "Location"), folder=folder)
    return _by_day(exports.read_export(spark, folder, "azure"))


@query("S1_gcp_csv_files", _by_day_sql("SELECT usage_start_date AS d, 'Größe ' || service_name AS service, cost FROM costs", "gcp"))
def s1_gcp_files(spark, sf_dir):
    """Latin-1 files with line breaks inside quotes (S3)."""
    rows = lineitem_costs(spark, sf_dir, ["usage_start_date", "service_name", "cost"]).select(
        F.lit("two\nlines").alias("sku.description"), F.date_format("usage_start_date", "yyyy-MM-dd").alias("usage_start_time"),
        F.concat(F.lit("Größe "), F.col("service_name")).alias("service.description"), F.col("cost").cast("string").alias("cost"))
    return _by_day(exports.read_export(spark, _landed(rows, "ISO-8859-1"), "gcp", "ISO-8859-1", multiline=True))


@query("S4_training_files", f"""WITH {COSTS}
SELECT strftime(usage_start_date, '%Y-%m-%d') AS date, service_name AS service, count(*) AS row_count, {money(total('cost'))} AS total_cost
FROM costs GROUP BY 1, 2""")
def s4_training_files(spark, sf_dir):
    """Files of all four providers, three headers, in one folder."""
    costs = lineitem_costs(spark, sf_dir, ["usage_start_date", "service_name", "cost", "provider"])
    headers = {
        "AWS": ("lineItem/UsageStartDate", "product/ProductName", "lineItem/UnblendedCost"),
        "Azure": ("Date", "MeterCategory", "CostInBillingCurrency"),
        "GCP": ("usage_start_time", "service.description", "cost"),
        "Other": ("Date", "MeterCategory", "CostInBillingCurrency"),
    }
    folder = None
    for provider, (date, service, cost) in headers.items():
        folder = _landed(costs.where(F.col("provider") == provider).select(
            F.date_format("usage_start_date", "yyyy-MM-dd").alias(date), F.col("service_name").alias(service),
            F.col("cost").cast("string").alias(cost)), folder=folder)
    read, _ = exports.read_training(spark, [folder])
    return read.groupBy(F.date_format("date", "yyyy-MM-dd").alias("date"), "service").agg(
        F.count(F.lit(1)).alias("row_count"), money_col(exact_sum("cost")).alias("total_cost")
    )


@query("S5_azure_rows", _by_day_sql("SELECT usage_start_date AS d, service_name AS service, cost FROM costs", "azure"))
def s5_azure_rows(spark, sf_dir):
    rows = lineitem_costs(spark, sf_dir, ["usage_start_date", "service_name", "cost", "billing_period"]).select(
        F.col("cost").alias("totalCost"),
        F.date_format("usage_start_date", "yyyyMMdd").cast("int").alias("UsageDate"),
        F.when(F.col("billing_period") < "1999", F.col("service_name")).alias("ServiceName"),
        F.col("service_name").alias("MeterCategory"),
    )
    return _by_day(exports.map_azure_rows(rows))


@query("S6_aws_response", f"""WITH {COSTS}, groups AS (
    SELECT CAST(usage_start_date AS DATE) AS d, service_name, {total('cost')} AS t FROM costs GROUP BY 1, 2)
SELECT strftime(d, '%Y-%m-%d') AS date, service_name AS service, 'aws' AS provider, CAST(1 AS BIGINT) AS row_count,
       {money('t')} AS total_cost FROM groups""")
def s6_aws_response(spark, sf_dir):
    days = (
        lineitem_costs(spark, sf_dir, ["usage_start_date", "service_name", "cost"])
        .groupBy(F.date_format("usage_start_date", "yyyy-MM-dd").alias("day"), "service_name")
        .agg(exact_sum("cost").cast("string").alias("amount"))
        .withColumn("blended", F.substring("day", 10, 1).cast("int") % 2 == 1)
    )
    amount = F.struct(F.col("amount").alias("Amount"))
    missing = F.lit(None).cast("struct<Amount:string>")
    # one response per day; a day holds one group per service
    group = F.struct(
        F.array("service_name").alias("Keys"),
        F.struct(
            F.when(~F.col("blended"), amount).otherwise(missing).alias("UNBLENDED_COST"), amount.alias("BLENDED_COST"),
        ).alias("Metrics"),
    )
    landed = days.groupBy("day").agg(F.collect_list(group).alias("Groups")).select(
        F.array(F.struct(F.struct(F.col("day").alias("Start")).alias("TimePeriod"), "Groups")).alias("ResultsByTime")
    )
    # through JSON text, as a landed response would arrive
    text = landed.select(F.to_json(F.struct("ResultsByTime")).alias("body"))
    parsed = text.select(F.from_json("body", exports.AWS_RESPONSE_SCHEMA).alias("r")).select("r.*")
    return _by_day(exports.map_aws_response(parsed))


@query("S7_gcp_export", f"""WITH {COSTS}
SELECT strftime(usage_start_date, '%Y-%m-%d') AS date, service_name AS service, 'gcp' AS provider, CAST({total('cost')} AS DOUBLE) AS cost
FROM costs WHERE usage_start_date >= TIMESTAMP '2000-03-01' AND usage_start_date < TIMESTAMP '2001-03-01' GROUP BY 1, 2""")
def s7_gcp_export(spark, sf_dir):
    export = lineitem_costs(spark, sf_dir, ["usage_start_date", "service_name", "cost"]).select(
        F.col("usage_start_date").alias("usage_start_time"),
        F.struct(F.col("service_name").alias("description")).alias("service"), "cost",
    )
    mapped = exports.map_gcp_export(export, "2000-03-01", "2001-03-01")
    return mapped.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), "service", "provider", fixed_col("cost", 4).alias("cost")
    )


@query("S8_fetch_current_month", f"""WITH {COSTS}
SELECT strftime(usage_start_date, '%Y-%m-%d') AS date, {category_sql('service_name')} AS category, 'azure' AS provider,
       CAST({total('cost')} AS DOUBLE) AS cost
FROM costs WHERE usage_start_date >= TIMESTAMP '2001-06-01' AND usage_start_date < TIMESTAMP '2001-06-16' GROUP BY 1, 2""")
def s8_fetch(spark, sf_dir):
    rows = lineitem_costs(spark, sf_dir, ["usage_start_date", "service_name", "cost"]).select(
        F.col("cost").alias("Cost"), F.date_format("usage_start_date", "yyyyMMdd").cast("int").alias("UsageDate"),
        F.col("service_name").alias("MeterCategory"),
    )
    return ingesting.fetch(spark, "api", "Azure", rows, AS_OF).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), "category", "provider", fixed_col("cost", 4).alias("cost")
    )


def _normalized(spark, sf_dir) -> DataFrame:
    raw = lineitem_costs(spark, sf_dir, ["user_id", "usage_start_date", "service_name", "cost", "provider"]).select(
        "user_id", F.col("usage_start_date").alias("date"), F.col("service_name").alias("service"), "cost",
        F.lower("provider").alias("provider"),
    )
    return features.normalize_costs(raw, ("user_id",))


@query("S10_normalized_records", f"""WITH {COSTS}, n AS (
    SELECT user_id, CAST(usage_start_date AS DATE) AS d, {category_sql('service_name')} AS category, provider, {total('cost')} AS t
    FROM costs GROUP BY ALL)
SELECT user_id, provider, category AS service_name, 'global' AS region, billing_period, record_count, total_cost, 'ingestion' AS source FROM (
    SELECT user_id, provider, category, strftime(d, '%Y-%m') AS billing_period, count(*) AS record_count, {money('sum(t)')} AS total_cost
    FROM n GROUP BY ALL)""")
def s10_records(spark, sf_dir):
    wanted = records.normalized_to_records(_normalized(spark, sf_dir), F.col("user_id"))
    good, _ = records.ingest(wanted, AS_OF)
    return good.groupBy(
        "user_id", "provider", "service_name", "region", "billing_period", F.col("metadata")["source"].alias("source")
    ).agg(F.count(F.lit(1)).alias("record_count"), money_col(exact_sum("cost")).alias("total_cost"))


@query("S11_ingest_summary", f"""WITH {COSTS}, n AS (
    SELECT user_id, CAST(usage_start_date AS DATE) AS d, {category_sql('service_name')} AS category, provider, {total('cost')} AS t
    FROM costs GROUP BY ALL)
SELECT user_id, count(*) AS rows_ingested, string_agg(DISTINCT category, ',' ORDER BY category) AS categories,
       strftime(min(d), '%Y-%m-%d') AS date_from, strftime(max(d), '%Y-%m-%d') AS date_to, {money('sum(t)')} AS total_cost
FROM n GROUP BY user_id""")
def s11_summary(spark, sf_dir):
    return summaries.ingest_summary(_normalized(spark, sf_dir), ["user_id"])


# --- generic CSV, parsing ------------------------------------------------------

LANDED_ROWS = 500_000  # of one task that writes landed files


def _generic_raw(lines: DataFrame, *more: Column) -> DataFrame:
    """Text rows with free headers and every kind of damage, by line number."""
    line = F.col("l_linenumber")
    start = F.col("usage_start_date")
    return lines.select(
        F.col("cost_id").alias("row_id"),
        F.when(line % 2 == 0, F.lit(" AwS ")).alias("Cloud Provider"),
        F.when(line == 3, F.lit("Microsoft.Compute")).alias("ConsumedService"),
        F.when(line == 5, F.lit("   ")).otherwise(F.col("service_name")).alias("Product Name"),
        F.when(line == 6, F.lit("abc")).when(line == 4, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("$"), F.format_number("cost", 4))).alias("Cost"),
        F.when(line == 7, F.lit("31-31-2024")).when(line == 2, F.date_format(start, "yyyyMMdd"))
        .otherwise(F.date_format(start, "dd-MMM-yyyy")).alias("Start-Date"),
        F.when(line == 1, F.date_format(start, "yyyy-MM-dd HH:mm:ss")).alias("end_date"),
        F.lit("eur").alias("Currency"),
        F.col("tags")["resource_group"].alias("ResourceGroup"),
        F.when(line == 1, F.lit('{"environment": "production", "resource_group": "from-tags"}'))
        .otherwise(F.lit("environment: dev:1 ,owner:ops,owner:core")).alias("Labels"),
        F.col("resource_id").alias("Instance ID"),
        *more,
    )


_GENERIC = f"""SELECT cost_id AS row_id,
    CASE WHEN l_linenumber % 2 = 0 THEN 'aws' WHEN l_linenumber = 3 THEN 'azure' WHEN l_linenumber = 5 THEN 'other'
         WHEN service_name LIKE 'Azure%' THEN 'azure' WHEN service_name LIKE 'Amazon%' THEN 'aws' ELSE 'other' END AS provider,
    CASE WHEN l_linenumber <> 5 THEN service_name END AS service_name,
    CASE WHEN l_linenumber NOT IN (4, 6) THEN CAST(CAST(cost AS DECIMAL(20,4)) AS DOUBLE) END AS cost,
    CASE WHEN l_linenumber <> 7 THEN strftime(usage_start_date, '%Y-%m-%d') END AS start_date,
    CASE WHEN l_linenumber <> 7 THEN strftime(usage_start_date, '%Y-%m-%d') END AS end_date,
    'EUR' AS currency, CASE WHEN resource_id <> '' THEN resource_id END AS resource_id,
    CASE WHEN l_linenumber = 1 THEN 'production' ELSE 'dev:1' END AS environment,
    CASE WHEN l_linenumber = 1 THEN 'from-tags' ELSE resource_group END AS resource_group,
    CASE WHEN l_linenumber <> 1 THEN 'core' END AS owner,
    CASE l_linenumber WHEN 5 THEN 'service_name' WHEN 4 THEN 'cost' WHEN 6 THEN 'cost' WHEN 7 THEN 'usage_start_date' END AS error_field,
    CASE l_linenumber WHEN 5 THEN 'Missing or empty service name' WHEN 4 THEN 'Missing cost value' WHEN 6 THEN 'Invalid numeric value'
        WHEN 7 THEN 'Missing or invalid start date' END AS error FROM costs"""


def _generic_files(spark, sf_dir) -> str:
    """The damaged rows as CSV files, one for each line number; the later ones hold their columns in another order.

    A file is written in parts, whose names follow the order of the rows, by more tasks the
    more rows there are. The tables are joined once: each write reads its rows twice, for the
    bounds of the ranges and for the rows themselves.
    """
    fields = ["cost_id", "user_id", "service_name", "cost", "usage_start_date", "resource_id", "tags"]
    costs = lineitem_costs(spark, sf_dir, fields, sorted_joins=True).drop("user_id")
    lines = cut_lineage(costs.withColumn("l_linenumber", F.split("cost_id", "-")[1].cast("int")))
    tasks = max(spark.sparkContext.defaultParallelism, lines.count() // LANDED_ROWS + 1)
    folder = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}"
    for some, turned in ((lines.where("l_linenumber < 5"), False), (lines.where("l_linenumber >= 5"), True)):
        # rendered behind the shuffle, which so carries the short values
        placed = some.repartitionByRange(tasks, "l_linenumber", "cost_id").sortWithinPartitions("l_linenumber", "cost_id")
        rows = _generic_raw(placed, F.col("l_linenumber").alias("line"))  # the sorted column itself, else the writer sorts again
        rows = rows.select(*reversed(rows.columns)) if turned else rows
        rows.write.mode("append").partitionBy("line").option("header", True).option("quote", '"').option("escape", '"').csv(folder)
    return folder


def _line_file(path: Column) -> Column:
    """The part of a file's path that does not change from run to run; all parts of a file have it."""
    return F.regexp_extract(path, "line=[0-9]+", 0)


@query("S2_generic_csv", f"WITH {COSTS} {_GENERIC}")
def s2_generic(spark, sf_dir):
    parsed, _ = generic_csv.parse_files(spark, _generic_files(spark, sf_dir))
    tags = F.col("tags")
    return parsed.select(
        "row_id", "provider", "service_name", fixed_col("cost", 4).alias("cost"),
        F.date_format("usage_start_date", "yyyy-MM-dd").alias("start_date"),
        F.date_format("usage_end_date", "yyyy-MM-dd").alias("end_date"), "currency", "resource_id",
        tags["environment"].alias("environment"), tags["resource_group"].alias("resource_group"),
        tags["owner"].alias("owner"), "error_field", "error",
    )


_BAD = f"""r AS ({_GENERIC}), bad AS (SELECT *, 'line=' || split_part(row_id, '-', 2) AS file,
    row_number() OVER (PARTITION BY split_part(row_id, '-', 2) ORDER BY row_id) AS row FROM r QUALIFY error IS NOT NULL)"""


@query("P8_reject_report", f"""WITH {COSTS}, {_BAD}
SELECT file, row, error_field AS field, error, (SELECT count(*) FROM bad) AS dropped_rows FROM (SELECT * FROM bad ORDER BY file, row LIMIT 5)""")
def p8_rejects(spark, sf_dir):
    _, rejects = generic_csv.read_generic_csv(spark, _generic_files(spark, sf_dir), whole=_line_file)
    return generic_csv.reject_report(rejects)


@query("P8_rejects_of_files", f"WITH {COSTS}, {_BAD} SELECT file, row AS row_id, service_name, error_field, error FROM bad")
def p8_all_rejects(spark, sf_dir):
    _, rejects = generic_csv.read_generic_csv(spark, _generic_files(spark, sf_dir), whole=_line_file)
    return rejects.select("file", "row_id", "service_name", "error_field", "error")


@query("S2_records_of_files", f"""WITH {COSTS}, r AS ({_GENERIC})
SELECT provider, service_name, cost, start_date, environment, resource_group, owner FROM r WHERE error IS NULL""")
def s2_records(spark, sf_dir):
    good, _ = generic_csv.read_generic_csv(spark, _generic_files(spark, sf_dir))
    tags = F.col("tags")
    return good.select(
        "provider", "service_name", fixed_col("cost", 4).alias("cost"), F.date_format("usage_start_date", "yyyy-MM-dd").alias("start_date"),
        tags["environment"].alias("environment"), tags["resource_group"].alias("resource_group"), tags["owner"].alias("owner"))


_LAYOUTS = [
    "yyyy-MM-dd", "yyyy/MM/dd", "M/d/yyyy", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "MM-dd-yyyy",
    "dd-MM-yyyy", "dd-MM-yyyy HH:mm", "yyyyMMdd", "dd-MMM-yyyy", "dd MMM yyyy", "MMMM yyyy",
]


@query("P4_parse_date", """SELECT o_orderkey, CASE
    WHEN o_orderkey % 16 = 15 THEN NULL
    WHEN o_orderkey % 16 IN (3, 10) AND day(o_orderdate) <= 12
        THEN strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d')
    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders""")
def p4_parse_date(spark, sf_dir):
    kind = F.col("o_orderkey") % len(_LAYOUTS)
    text = F.lit(None).cast("string")
    for number, layout in enumerate(_LAYOUTS):
        text = F.when(kind == number, F.date_format("o_orderdate", layout)).otherwise(text)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return orders.select("o_orderkey", F.date_format(parsing.parse_date(F.col("text")), "yyyy-MM-dd").alias("date"))


@query("P5_parse_money", """SELECT c_custkey, CASE c_custkey % 5 WHEN 4 THEN NULL
    ELSE CAST(CAST(c_acctbal AS DECIMAL(20,2)) AS DOUBLE) END AS amount FROM customer""")
def p5_parse_money(spark, sf_dir):
    kind = F.col("c_custkey") % 5
    number = F.format_number("c_acctbal", 2)
    text = (
        F.when(kind == 0, F.concat(F.lit("$"), number)).when(kind == 1, F.concat(F.lit(" €"), number))
        .when(kind == 2, F.concat(number, F.lit(" £"))).when(kind == 3, F.regexp_replace(number, ",", ""))
        .otherwise(F.lit("NaN"))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", parsing.parse_money(text).alias("amount"))


@query("P6_infer_provider", f"""WITH {COSTS}, hints AS (SELECT service_name, CASE l_linenumber WHEN 1 THEN 'Microsoft.Compute'
    WHEN 2 THEN 'google.storage' WHEN 3 THEN 'cloud.run' WHEN 4 THEN 'my aws thing' WHEN 5 THEN '' END AS hint FROM costs)
SELECT service_name, hint AS consumed_service, CASE WHEN hint = 'Microsoft.Compute' THEN 'Azure'
    WHEN hint IN ('google.storage', 'cloud.run') THEN 'GCP' WHEN hint = 'my aws thing' THEN 'AWS'
    WHEN service_name LIKE 'Azure%' THEN 'Azure' WHEN service_name LIKE 'Amazon%' THEN 'AWS' ELSE 'Other' END AS provider,
    count(*) AS record_count FROM hints GROUP BY ALL""")
def p6_infer_provider(spark, sf_dir):
    line = F.col("l_linenumber")
    hint = (
        F.when(line == 1, "Microsoft.Compute").when(line == 2, "google.storage").when(line == 3, "cloud.run")
        .when(line == 4, "my aws thing").when(line == 5, "")
    )
    rows = _lines(spark, sf_dir, ["service_name"]).select("service_name", hint.alias("consumed_service"))
    return rows.withColumn(
        "provider", parsing.infer_provider(F.col("consumed_service"), F.col("service_name"))
    ).groupBy("service_name", "consumed_service", "provider").agg(F.count(F.lit(1)).alias("record_count"))


@query("P7_parse_tags", """SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS kind, 'ops' AS owner FROM events""")
def p7_parse_tags(spark, sf_dir):
    event = table(spark, sf_dir, "events")
    from_json = parsing.parse_tags(F.col("props"))
    from_pairs = parsing.parse_tags(F.concat(F.lit("kind:old, kind : "), F.col("event_type"), F.lit(",owner:ops,junk")))
    return event.select("event_id", parsing.merge_tags(from_pairs, from_json).alias("tags")).select(
        "event_id", F.col("tags")["k"].alias("k"), F.col("tags")["kind"].alias("kind"), F.col("tags")["owner"].alias("owner")
    )


_KEYWORDS = [keyword for _, keywords in CATEGORY_RULES for keyword in keywords]


@query("P9_category", f"""WITH keywords AS (SELECT {_KEYWORDS} AS list), names AS (
    SELECT CASE WHEN p_partkey % 9 = 8 THEN p_brand WHEN p_partkey % 9 = 7 THEN ' STORAGE '
        ELSE ' My ' || upper(list[CAST(p_partkey % {len(_KEYWORDS)} AS INTEGER) + 1]) || ' ' || p_name END AS service_name
    FROM part, keywords)
SELECT service_name, {category_sql('service_name')} AS category, count(*) AS part_count FROM names GROUP BY ALL""")
def p9_category(spark, sf_dir):
    key = F.col("p_partkey")
    keyword = F.element_at(F.array(*[F.lit(k) for k in _KEYWORDS]), (key % len(_KEYWORDS) + 1).cast("int"))
    name = F.when(key % 9 == 8, F.col("p_brand")).when(key % 9 == 7, F.lit(" STORAGE ")).otherwise(
        F.concat(F.lit(" My "), F.upper(keyword), F.lit(" "), F.col("p_name"))
    )
    names = table(spark, sf_dir, "part").groupBy(name.alias("service_name")).agg(F.count(F.lit(1)).alias("part_count"))
    return with_category(names)


@query("P10_categories_in_use", f"""WITH {COSTS}, s AS (SELECT DISTINCT service_name, {category_sql('service_name')} AS category FROM costs)
SELECT category, count(*) AS service_count FROM s GROUP BY 1""")
def p10_categories(spark, sf_dir):
    services = lineitem_costs(spark, sf_dir, ["service_name"]).distinct()
    return with_category(services).groupBy("category").agg(F.count(F.lit(1)).alias("service_count"))


# --- validation and building -----------------------------------------------------

def _json_records(spark, sf_dir) -> DataFrame:
    """Records as JSON-like text fields; the part key decides which rule a record breaks."""
    case = F.split("cost_id", "-")[2].cast("bigint") % 20
    start = F.date_format("usage_start_date", "yyyy-MM-dd'T'HH:mm:ss")
    rows = dealt(lineitem_costs(
        spark, sf_dir, ["cost_id", "user_id", "provider", "service_name", "cost", "usage_start_date", "usage_end_date", "region"]
    )).withColumn("case", case)
    case = F.col("case")
    return rows.select(
        "cost_id", "user_id", case.alias("kind"),
        F.when(case == 1, "").when(case == 2, "Oracle").when(case == 3, F.concat(F.lit(" "), F.upper("provider"), F.lit(" ")))
        .otherwise(F.col("provider")).alias("provider"),
        F.when(case == 4, F.repeat(F.lit("s"), 201)).when(case == 5, "  ").when(case == 14, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit(" "), F.col("service_name"))).alias("service_name"),
        F.when(case == 6, "-1").when(case == 7, "ten").otherwise(F.col("cost").cast("string")).alias("cost"),
        F.when(case == 8, "-2").when(case == 9, "many").when(case == 15, "2.5").alias("usage_quantity"),
        F.when(case == 10, "yesterday").when(case == 13, F.concat(start, F.lit("+05:00"))).otherwise(start).alias("usage_start_date"),
        F.when(case == 11, "1990-01-01").otherwise(F.date_format("usage_end_date", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("usage_end_date"),
        F.when(case == 12, "XYZ").when(case == 16, "EUR").alias("currency"),
        F.when(case != 17, F.col("region")).alias("region"),
    )


_ERRORS = """CASE l_partkey % 20 WHEN 1 THEN 'Field ''provider'' is required' WHEN 2 THEN 'Provider must be one of: AWS, Azure, GCP, Other'
    WHEN 4 THEN 'Service name is too long (max 200 characters)' WHEN 5 THEN 'Service name cannot be empty'
    WHEN 6 THEN 'Cost must be greater than or equal to 0' WHEN 7 THEN 'Cost must be a valid number'
    WHEN 8 THEN 'Usage quantity must be greater than or equal to 0' WHEN 9 THEN 'Usage quantity must be a valid number'
    WHEN 10 THEN 'Invalid date format. Use ISO 8601 format (YYYY-MM-DDTHH:MM:SS)'
    WHEN 11 THEN 'usage_start_date must be before or equal to usage_end_date'
    WHEN 12 THEN 'Currency must be one of: USD, EUR, GBP, INR, JPY, CNY' WHEN 14 THEN 'Field ''service_name'' is required' END"""


@query("P2_validation", f"WITH {COSTS} SELECT cost_id, {_ERRORS} AS error FROM costs")
def p2_validation(spark, sf_dir):
    return records.with_validation(_json_records(spark, sf_dir)).select("cost_id", "error")


@query("S11_reject_counts", f"""WITH {COSTS}, e AS (SELECT user_id, {_ERRORS} AS error FROM costs)
SELECT user_id, count(*) FILTER (error IS NULL) AS success_count, count(error) AS error_count FROM e GROUP BY user_id""")
def s11_counts(spark, sf_dir):
    return summaries.reject_counts(records.with_validation(_json_records(spark, sf_dir)), ["user_id"])


@query("S11_first_errors", f"""WITH {COSTS}, e AS (SELECT cost_id, {_ERRORS} AS error FROM costs)
SELECT * FROM e WHERE error IS NOT NULL ORDER BY cost_id LIMIT 10""")
def s11_first(spark, sf_dir):
    return summaries.first_errors(records.with_validation(_json_records(spark, sf_dir)), "cost_id")


@query("P3_build_record", f"""WITH {COSTS}, e AS (SELECT *, l_partkey % 20 AS kind, {_ERRORS} AS error FROM costs),
starts AS (SELECT *, usage_start_date - CASE WHEN kind = 13 THEN INTERVAL 5 HOUR ELSE INTERVAL 0 HOUR END AS s FROM e WHERE error IS NULL)
SELECT cost_id, user_id, provider, '' AS cloud_account_id, service_name, CASE WHEN kind = 17 THEN 'us-east-1' ELSE region END AS region,
       CASE WHEN kind = 15 THEN 2.5 ELSE 0 END::DOUBLE AS usage_quantity, {fixed('cost', 4)} AS cost,
       CASE WHEN kind = 16 THEN 'EUR' ELSE 'USD' END AS currency, strftime(s, '%Y-%m-%d %H') AS start,
       strftime(s, '%Y-%m') AS billing_period FROM starts""")
def p3_build(spark, sf_dir):
    good, _ = records.ingest(_json_records(spark, sf_dir), AS_OF)
    return good.select(
        "cost_id", "user_id", "provider", "cloud_account_id", "service_name", "region", "usage_quantity",
        fixed_col("cost", 4).alias("cost"), "currency", F.date_format("usage_start_date", "yyyy-MM-dd HH").alias("start"),
        "billing_period",
    )


def _updates(costs: DataFrame) -> DataFrame:
    """One correction per record id of every 7th part: new cost, sometimes invalid, sometimes a new date."""
    part = F.split("cost_id", "-")[2].cast("bigint")
    return costs.where(part % 7 == 0).groupBy("cost_id", "user_id").agg(F.max(part).alias("part")).select(
        "cost_id", "user_id",
        F.when(F.col("part") % 2 == 0, F.lit(12.5)).otherwise(F.lit(-1.0)).alias("cost"),
        F.when(F.col("part") % 3 == 0, F.lit("2001-02-03").cast("timestamp_ntz")).alias("usage_start_date"),
        F.when(F.col("part") % 3 == 0, F.lit("2001-02-04").cast("timestamp_ntz")).alias("usage_end_date"),
    )


_FIELDS = ["cost_id", "user_id", "provider", "service_name", "cost", "usage_start_date", "usage_end_date", "billing_period"]


@query("P17_corrections", f"""WITH {COSTS}, m AS (SELECT *, l_partkey % 14 = 0 AS hit, l_partkey % 42 = 0 AS moved FROM costs)
SELECT user_id, CASE WHEN moved THEN '2001-02' ELSE billing_period END AS billing_period, count(*) AS record_count,
       {money("sum(CAST(CASE WHEN hit THEN 12.5 ELSE cost END AS DECIMAL(20,4)))")} AS total_cost FROM m GROUP BY 1, 2""")
def p17_corrections(spark, sf_dir):
    costs = lineitem_costs(spark, sf_dir, _FIELDS)
    snapshot, _ = records.apply_corrections(costs, _updates(costs), AS_OF)
    return snapshot.groupBy("user_id", "billing_period").agg(
        F.count(F.lit(1)).alias("record_count"), money_col(exact_sum("cost")).alias("total_cost")
    )


@query("P17_rejected_corrections", f"""WITH {COSTS}
SELECT cost_id, user_id, 'Cost must be greater than or equal to 0' AS error FROM costs WHERE l_partkey % 7 = 0 AND l_partkey % 2 = 1""")
def p17_rejected(spark, sf_dir):
    costs = lineitem_costs(spark, sf_dir, _FIELDS)
    return records.apply_corrections(costs, _updates(costs), AS_OF)[1]


@query("P18_deletes", f"""WITH {COSTS}
SELECT user_id, count(*) AS record_count, {money(total('cost'))} AS total_cost FROM costs
WHERE user_id NOT IN (3, 8) AND l_partkey % 7 <> 0 GROUP BY user_id""")
def p18_deletes(spark, sf_dir):
    costs = lineitem_costs(spark, sf_dir, ["cost_id", "user_id", "cost"])
    ids = costs.where(F.split("cost_id", "-")[2].cast("bigint") % 7 == 0)
    closed = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 10).alias("user_id")).where(F.col("user_id").isin(3, 8))
    left = records.apply_deletes(records.apply_deletes(costs, ids, ["cost_id"]), closed, ["user_id"])
    return left.groupBy("user_id").agg(F.count(F.lit(1)).alias("record_count"), money_col(exact_sum("cost")).alias("total_cost"))
