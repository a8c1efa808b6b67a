"""Generic billing CSV with free header names to cost-record fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.parsing import (
    computed_once, empty_tags, infer_provider, merge_tags, parse_date, parse_epoch, parse_money, parse_number, parse_tags,
)
from ..session import cut_lineage
from .billing_exports import read_mixed_csv
from .headers import quoted, resolve

# --- fixed values -----------------------------------------------------------
# Accepted headers per target field, first match wins.
FIELD_HEADERS = {
    "provider": ["provider", "cloud_provider", "cloud", "vendor"],
    "cloud_account_id": ["cloud_account_id", "account_id", "account", "account_number", "subscriptionname",
                         "subscription_name", "subscription_id", "project_id"],
    "service_name": ["service_name", "service", "product", "product_name", "resource_type",
                     "service_description", "sku_description", "metercategory"],
    "consumed_service": ["consumedservice", "consumed_service"],
    "resource_id": ["resource_id", "resource", "instance_id", "instance", "resourcename", "resource_name"],
    "resource_group": ["resourcegroup", "resource_group"],
    "region": ["region", "location", "availability_zone", "zone", "region/zone", "resourcelocation",
               "resource_location"],
    "usage_quantity": ["usage_quantity", "quantity", "usage", "amount"],
    "usage_unit": ["usage_unit", "unit", "measurement_unit"],
    "cost": ["cost", "charge", "price", "total_cost", "billed_cost", "unrounded_cost_($)", "rounded_cost_($)",
             "total_cost_(inr)", "costinbillingcurrency", "pretaxcost"],
    "currency": ["currency", "currency_code", "billingcurrency", "billing_currency"],
    "usage_start_date": ["usage_start_date", "start_date", "from_date", "begin_date", "period_start",
                         "usage_start_time", "start_time", "date", "usage_date", "usagedatetime",
                         "usagestartdate"],
    "usage_end_date": ["usage_end_date", "end_date", "to_date", "finish_date", "period_end", "usage_end_time",
                       "end_time"],
    "tags": ["tags", "labels", "metadata"],
}
_FILE, _BLOCK, _ORDER = "__file", "__block", "__order"
REQUIRED_HEADERS = ["service_name", "cost", "usage_start_date"]
# ----------------------------------------------------------------------------


def map_headers(columns: list[str]) -> dict[str, str]:
    """Target field to source header, for the fields that occur."""
    found = {field: resolve(columns, names) for field, names in FIELD_HEADERS.items()}
    return {field: column for field, column in found.items() if column is not None}


def parse_records(raw: DataFrame) -> DataFrame:
    """Typed record fields plus ``error_field`` and ``error`` (null for a good row)."""
    mapping = map_headers(raw.columns)
    missing = [field for field in REQUIRED_HEADERS if field not in mapping]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}; detected: {', '.join(mapping)}")
    types = dict(raw.dtypes)

    def text(field: str) -> Column:
        if field not in mapping:
            return F.lit(None).cast("string")
        value = F.trim(F.col(quoted(mapping[field])).cast("string"))
        return F.when(value != "", value)

    def moment(field: str) -> Column:
        if field in mapping and types[mapping[field]] in ("int", "bigint", "double", "float"):
            return parse_epoch(F.col(quoted(mapping[field])))
        return parse_date(text(field))

    group = text("resource_group")
    checked = {
        "service_name": text("service_name"),
        "cost_text": text("cost"),
        "cost": parse_money(text("cost")),
        "usage_start_date": moment("usage_start_date"),
    }
    # what no check reads stays outside, so a reader that takes only rejects does not parse it
    staged = computed_once(raw, {f"__{name}": value for name, value in checked.items()}).withColumns({
        "__group_tag": F.when(group.isNotNull(), F.create_map(F.lit("resource_group"), group)).otherwise(empty_tags()),
        "__row_tags": parse_tags(text("tags")),
    })
    passthrough = [F.col(quoted(c)) for c in raw.columns if c in ("row_id", _FILE, _BLOCK, _ORDER)]
    parsed = staged.select(
        *passthrough,
        F.lower(F.coalesce(text("provider"), infer_provider(text("consumed_service"), F.col("__service_name")))).alias("provider"),
        text("cloud_account_id").alias("cloud_account_id"),
        F.col("__service_name").alias("service_name"),
        text("resource_id").alias("resource_id"),
        text("region").alias("region"),
        parse_number(text("usage_quantity")).alias("usage_quantity"),
        text("usage_unit").alias("usage_unit"),
        "__cost_text",
        F.col("__cost").alias("cost"),
        F.upper(text("currency")).alias("currency"),
        F.col("__usage_start_date").alias("usage_start_date"),
        F.coalesce(moment("usage_end_date"), "__usage_start_date").alias("usage_end_date"),
        merge_tags(F.col("__group_tag"), F.col("__row_tags")).alias("tags"),
    )
    checks = [
        ("service_name", F.col("service_name").isNull(), "Missing or empty service name"),
        ("cost", F.col("__cost_text").isNull(), "Missing cost value"),
        ("cost", F.col("cost").isNull(), "Invalid numeric value"),
        ("usage_start_date", F.col("usage_start_date").isNull(), "Missing or invalid start date"),
    ]
    field = error = None
    for name, failed, message in checks:
        field = F.when(failed, name) if field is None else field.when(failed, name)
        error = F.when(failed, message) if error is None else error.when(failed, message)
    return parsed.withColumn("error_field", field).withColumn("error", error).drop("__cost_text")


def split_records(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of a parsed frame."""
    good = parsed.where(F.col("error").isNull()).drop("error", "error_field")
    return good, parsed.where(F.col("error").isNotNull())


def parse_files(spark: SparkSession, path, encoding: str = "UTF-8", multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, places) of all files, whatever their headers; one scan each.

    Parsed rows carry their file, block of the file and order; ``places`` has the same for
    all raw rows and reads no value. Pass ``multiline`` for line breaks inside quotes.
    """
    parsed = places = None
    for raw in read_mixed_csv(spark, path, encoding, multiline):
        # the order counts rows within a scan task, so it is taken before anything is left out
        placed = raw.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK), F.monotonically_increasing_id().alias(_ORDER))
        found, where = parse_records(placed), placed.select(_FILE, _BLOCK, _ORDER)
        parsed, places = (found, where) if parsed is None else (parsed.unionByName(found), places.unionByName(where))
    if parsed is None:
        raise ValueError(f"no file in {path}")
    return parsed, places


def with_row_numbers(rows: DataFrame, places: DataFrame, whole: Callable[[Column], Column] | None = None) -> DataFrame:
    """``file`` and ``row_id``, counted from 1 within the file, of the given rows of ``parse_files``.

    Rows of a block are consecutive, so a row's number follows from its block's first row and
    the sizes of the blocks before; the rows themselves are neither sorted nor counted. Where a
    file was written in parts, ``whole`` makes its name of a part's path; parts follow one
    another by their paths.
    """
    blocks = places.groupBy(F.col(_FILE).alias("of_file"), F.col(_BLOCK).alias("of_block")).agg(
        F.min(_ORDER).alias("first"), F.count(F.lit(1)).alias("rows"))
    blocks = blocks.withColumn("of_whole", whole(F.col("of_file")) if whole else F.col("of_file"))
    before = Window.partitionBy("of_whole").orderBy("of_file", "of_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("earlier", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    met = rows.join(starts, (F.col(_FILE) == F.col("of_file")) & (F.col(_BLOCK) == F.col("of_block")))
    kept = [c for c in rows.columns if c not in (_FILE, _BLOCK, _ORDER, "row_id")]
    return met.select(*kept, F.col("of_whole").alias("file"), (F.col(_ORDER) - F.col("first") + F.col("earlier") + 1).alias("row_id"))


def read_records(
    spark: SparkSession, path, encoding: str = "UTF-8", multiline: bool = False, whole: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Parsed rows of all files with their file and row number."""
    return with_row_numbers(*parse_files(spark, path, encoding, multiline), whole)


def read_generic_csv(
    spark: SparkSession, path, encoding: str = "UTF-8", multiline: bool = False, whole: Callable[[Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of CSV files; rejects carry file and row number, records come straight from the scan."""
    parsed, places = parse_files(spark, path, encoding, multiline)
    good, rejects = split_records(parsed)
    return good.drop(_FILE, _BLOCK, _ORDER, "row_id"), with_row_numbers(rejects, places, whole)


def reject_report(parsed: DataFrame, row_id: str = "row_id", sample: int = 5) -> DataFrame:
    """First ``sample`` rejected rows by file and row number, each with the total number dropped.

    The rejects' places and errors are kept once, so the files are parsed once for both.
    """
    place = [c for c in ("file",) if c in parsed.columns]
    rejects = cut_lineage(parsed.where(F.col("error").isNotNull()).select(*place, F.col(row_id).alias("row"), F.col("error_field").alias("field"), "error"))
    total = rejects.agg(F.count(F.lit(1)).alias("dropped_rows"))
    head = rejects.orderBy(*place, "row").limit(sample)
    # a one-row aggregate next to at most ``sample`` rows
    return head.join(F.broadcast(total), F.lit(True), "inner")
