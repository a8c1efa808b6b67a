"""Provider billing exports to (date, service, cost, provider)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numeric import exact_sum
from ..functions.parsing import computed_once, parse_export_date, parse_number
from .csv_headers import header_groups
from .headers import quoted, resolve

# --- fixed values -----------------------------------------------------------
# Accepted headers per provider and field, first match wins.
EXPORT_HEADERS = {
    "azure": {
        "date": ["UsageStartDate", "usage_start_date", "Date", "UsageDateTime", "usagedatetime", "usage_date",
                 "start_date", "from_date", "period_start", "begin_date"],
        "service": ["MeterCategory", "ServiceName", "service_name", "Service", "Product", "product_name",
                    "resource_type", "consumed_service", "ConsumedService", "SKU Description"],
        "cost": ["CostInBillingCurrency", "Cost", "cost", "PreTaxCost", "pretaxcost", "charge", "price",
                 "total_cost", "billed_cost", "unrounded_cost"],
    },
    "aws": {
        "date": ["lineItem/UsageStartDate", "bill/BillingPeriodStartDate", "UsageStartDate", "usage_start_date",
                 "Date", "date", "start_date", "from_date", "period_start"],
        "service": ["product/ProductName", "lineItem/ProductCode", "ProductName", "service_name", "Service",
                    "Product", "product_code", "service_description", "resource_type"],
        "cost": ["lineItem/UnblendedCost", "lineItem/BlendedCost", "BlendedCost", "UnblendedCost", "cost", "Cost",
                 "AmortizedCost", "charge", "price"],
    },
    "gcp": {
        "date": ["usage_start_time", "start_time", "usage_start_date", "Date", "date", "start_date", "from_date",
                 "period_start"],
        "service": ["service.description", "service_description", "service_name", "Service", "Product",
                    "product_name", "service", "resource_type"],
        "cost": ["cost", "total_cost", "Cost", "TotalCost", "charge", "price", "billed_cost", "amortized_cost"],
    },
}
# Headers of training files, all providers together.
TRAINING_HEADERS = {
    "date": ["Date", "UsageStartDate", "usage_start_date", "lineItem/UsageStartDate",
             "bill/BillingPeriodStartDate", "usage_start_time", "start_time", "date"],
    "service": ["MeterCategory", "ServiceName", "service_name", "product/ProductName", "lineItem/ProductCode",
                "service.description", "service_description", "service"],
    "cost": ["CostInBillingCurrency", "Cost", "predetected_cost", "lineItem/UnblendedCost",
             "lineItem/BlendedCost", "cost", "usage.amount_in_pricing_units"],
}
# ----------------------------------------------------------------------------

PROVIDER_KEYS = list(EXPORT_HEADERS)


def read_text_csv(spark: SparkSession, path, encoding: str = "UTF-8", multiline: bool = False) -> DataFrame:
    """CSV with a header, every column as text. Pass ``encoding='ISO-8859-1'`` for Latin files.

    ``multiline`` admits line breaks inside quotes; such files cannot be split
    between tasks, so it is off unless asked for.
    """
    return (
        spark.read.option("header", True).option("encoding", encoding)
        .option("quote", '"').option("escape", '"').option("multiLine", multiline)
        .option("enforceSchema", False).option("inferSchema", False).csv(path)
    )


def read_mixed_csv(spark: SparkSession, paths, encoding: str = "UTF-8", multiline: bool = False) -> list[DataFrame]:
    """One frame for each header found among the files: columns of another order or name never shift.

    The driver holds the file names by header, as any scan's file listing does.
    """
    groups = header_groups(spark, paths, encoding).orderBy("header").collect()
    return [read_text_csv(spark, group.files, encoding, multiline) for group in groups]


def _union(frames: list[DataFrame]) -> DataFrame:
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged


def _provider_key(provider: str) -> str:
    key = (provider or "").strip().lower()
    if key not in EXPORT_HEADERS:
        raise ValueError(f"unsupported provider '{provider}', use one of: {', '.join(PROVIDER_KEYS)}")
    return key


def map_export(raw: DataFrame, provider: str) -> DataFrame:
    """Text columns of one provider's export to (date, service, cost, provider).

    Rows without a readable date or cost are dropped.
    """
    key = _provider_key(provider)
    columns = {}
    for field, candidates in EXPORT_HEADERS[key].items():
        columns[field] = resolve(raw.columns, candidates, slash=True)
        if columns[field] is None:
            raise ValueError(
                f"no '{field}' column for {key}: expected one of {candidates}, found {raw.columns}"
            )
    parsed = computed_once(raw, {
        "__date": parse_export_date(F.col(quoted(columns["date"]))),
        "__cost": parse_number(F.col(quoted(columns["cost"]))),
    })
    return parsed.select(
        F.col("__date").alias("date"),
        F.trim(F.col(quoted(columns["service"]))).alias("service"),
        F.col("__cost").alias("cost"),
        F.lit(key).alias("provider"),
    ).na.drop(subset=["date", "cost"])


def read_export(spark: SparkSession, path, provider: str, encoding: str = "UTF-8", multiline: bool = False) -> DataFrame:
    """Billing CSV files of one provider; files of a folder may differ in their headers."""
    return _union([map_export(raw, provider) for raw in read_mixed_csv(spark, path, encoding, multiline)])


def map_azure_rows(rows: DataFrame) -> DataFrame:
    """Landed Azure cost-query rows: integer yyyyMMdd dates, service or meter category."""
    names = {column.lower(): column for column in rows.columns}

    def first(*candidates: str) -> Column | None:
        found = [F.col(quoted(names[name])) for name in candidates if name in names]
        return F.coalesce(*found) if found else None

    day, cost = first("usagedate", "date"), first("totalcost", "costinbillingcurrency", "cost")
    service = first("servicename", "metercategory")
    if day is None or cost is None or service is None:
        raise ValueError(f"rows need a date, a cost and a service column, found {rows.columns}")
    return rows.select(
        F.try_to_timestamp(day.cast("string"), F.lit("yyyyMMdd")).cast("timestamp_ntz").alias("date"),
        service.alias("service"),
        parse_number(cost.cast("string")).alias("cost"),
        F.lit("azure").alias("provider"),
    )


AWS_RESPONSE_SCHEMA = """
    ResultsByTime array<struct<
        TimePeriod: struct<Start: string, End: string>,
        Groups: array<struct<Keys: array<string>, Metrics: struct<
            UNBLENDED_COST: struct<Amount: string>,
            BLENDED_COST: struct<Amount: string>,
            UnblendedCost: struct<Amount: string>,
            BlendedCost: struct<Amount: string>>>>>>
"""


def map_aws_response(responses: DataFrame) -> DataFrame:
    """Landed cost-explorer responses, one row per day and service; zero rows stay."""
    day = responses.select(F.explode("ResultsByTime").alias("day"))
    group = day.select(F.col("day.TimePeriod.Start").alias("start"), F.explode("day.Groups").alias("group"))
    metrics = dict(group.select("group.Metrics.*").dtypes)
    amounts = [
        F.col(f"group.Metrics.{name}.Amount")
        for name in ("UNBLENDED_COST", "UnblendedCost", "BLENDED_COST", "BlendedCost") if name in metrics
    ]
    return group.select(
        parse_export_date(F.col("start")).alias("date"),
        F.try_element_at(F.col("group.Keys"), F.lit(1)).alias("service"),
        parse_number(F.coalesce(*amounts).cast("string")).alias("cost"),
        F.lit("aws").alias("provider"),
    ).na.drop(subset=["cost"])


def map_gcp_export(export: DataFrame, start: str, end: str) -> DataFrame:
    """Landed export table summed by day and service over [start, end)."""
    time_type = export.schema["usage_start_time"].dataType
    moment = F.col("usage_start_time")
    return (
        export.where((moment >= F.lit(start).cast(time_type)) & (moment < F.lit(end).cast(time_type)))
        .groupBy(F.to_date(moment).alias("day"), F.col("service.description").alias("service"))
        .agg(exact_sum("cost").cast("double").alias("cost"))
        .select(F.col("day").cast("timestamp_ntz").alias("date"), "service", "cost", F.lit("gcp").alias("provider"))
    )


def map_training(raw: DataFrame) -> DataFrame:
    """Training text columns to (date, service, cost); aliases coalesced, first non-null wins."""
    def pick(field: str) -> Column:
        present = [F.col(quoted(name)) for name in TRAINING_HEADERS[field] if name in raw.columns]
        if not present:
            raise ValueError(f"training data has no '{field}' column, found {raw.columns}")
        return F.coalesce(*present)

    return raw.select(
        F.to_date(parse_export_date(pick("date"))).alias("date"),
        F.trim(pick("service")).alias("service"),
        parse_number(pick("cost")).alias("cost"),
    ).na.drop(subset=["date"])


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that hold a file or folder; they are tried one by one only if not all of them do."""
    def found(some: list[str]) -> bool:
        try:
            spark.read.format("binaryFile").load(some)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    return paths if found(paths) else [path for path in paths if found([path])]


def read_training(
    spark: SparkSession, paths: list[str], encoding: str = "UTF-8", multiline: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Union of training CSVs with different headers, one scan for each header; and the skipped paths with their reasons.

    A path that does not exist, an empty file and a header without the needed columns are skipped.
    """
    present = _existing(spark, paths)
    skipped = [(path, "not found") for path in paths if path not in present]
    frames = []
    for raw in read_mixed_csv(spark, present, encoding, multiline) if present else []:
        missing = [field for field, names in TRAINING_HEADERS.items() if not set(names) & set(raw.columns)]
        if missing:
            skipped += [(path, f"no column for {', '.join(missing)}") for path in raw.inputFiles()]
        else:
            frames.append(map_training(raw))
    if not frames:
        raise ValueError("no readable training file")
    return _union(frames), spark.createDataFrame(skipped, "path string, reason string")
