"""Text to value: dates, money, tags, provider names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))$"
_ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}$"
_ISO_SPACE = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"
_ISO_T = r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?Z?$"
_ISO_FULL = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:\d{2}|Z)?)?$"


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated once per row, however often they are used later.

    The optimizer inlines plain projections into every later use, filters
    included, which repeats costly parsing. A one-element generator is a
    boundary it does not cross. The values are computed before it, in a projection
    of their own, which is compiled; inside a generator they would be interpreted.
    """
    values = df.select("*", F.struct(*[value.alias(name) for name, value in columns.items()]).alias("__once"))
    return values.select("*", F.inline(F.array("__once"))).drop("__once")


def _naive(value: Column) -> Column:
    return value.cast("timestamp_ntz")


def _by_pattern(text: Column, *patterns: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(pattern)) for pattern in patterns])


def parse_date(value: Column) -> Column:
    """Date text in any of the accepted layouts as naive timestamp, else null.

    Layouts are told apart by shape first, so a row tries only the patterns
    that can match it. Month before day wins where both readings are valid.
    """
    text = F.trim(value)
    iso = text.rlike(_ISO_DATE) | text.rlike(_ISO_SPACE) | text.rlike(_ISO_T)
    return _naive(
        F.when(iso, F.regexp_replace(text, "Z$", "").try_cast("timestamp"))
        .when(text.rlike(r"^\d{4}/"), _by_pattern(text, "yyyy/M/d"))
        .when(text.contains("/"), _by_pattern(text, "M/d/yyyy", "d/M/yyyy"))
        .when(text.rlike(r"^\d{8}$"), _by_pattern(text, "yyyyMMdd"))
        .when(text.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), _by_pattern(text, "M-d-yyyy", "d-M-yyyy"))
        .when(text.rlike(r"^\d{1,2}-\d{1,2}-\d{4} "), _by_pattern(text, "d-M-yyyy H:m", "M-d-yyyy H:m"))
        .when(
            text.rlike(r"^\d{1,2}(-[A-Za-z]{3}-| [A-Za-z]{3} )\d{4}$"),
            _by_pattern(F.initcap(F.translate(text, "-", " ")), "d MMM yyyy"),
        )
    )


def parse_epoch(value: Column) -> Column:
    """Numeric date: seconds since 1970 within (0, 1e10), else null."""
    seconds = value.cast("double")
    return _naive(F.when((seconds > 0) & (seconds < 1e10), F.timestamp_seconds(seconds)))


def parse_iso(value: Column) -> Column:
    """ISO 8601 date or date-time, offsets converted to UTC, else null."""
    text = F.trim(value)
    return _naive(F.when(text.rlike(_ISO_FULL), text.try_cast("timestamp")))


def parse_export_date(value: Column) -> Column:
    """Billing-export date: ISO with optional offset, else any accepted layout."""
    return F.coalesce(parse_iso(value), parse_date(value))


def parse_number(value: Column) -> Column:
    """Plain number, else null. NaN is not a number."""
    text = F.trim(value)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def parse_money(value: Column) -> Column:
    """Amount text without currency signs and thousands commas as double, else null."""
    return parse_number(F.regexp_replace(value, "[$€£,]", ""))


def canonical_provider(value: Column) -> Column:
    """Provider in canonical spelling; unknown names stay as they are, trimmed."""
    key = F.lower(F.trim(value))
    return (
        F.when(key == "aws", "AWS").when(key == "azure", "Azure").when(key == "gcp", "GCP")
        .when(key == "other", "Other").otherwise(F.trim(value))
    )


def _provider_hint(value: Column) -> Column:
    hint = F.lower(F.trim(value))
    return (
        F.when(hint.startswith("microsoft.") | hint.contains("azure"), "Azure")
        .when(hint.startswith("amazon") | hint.contains("aws"), "AWS")
        .when(hint.startswith("google") | hint.contains("gcp") | hint.startswith("cloud."), "GCP")
    )


def infer_provider(consumed_service: Column, service_name: Column) -> Column:
    """Provider guessed from the consumed service, then from the service name."""
    return F.coalesce(_provider_hint(consumed_service), _provider_hint(service_name), F.lit("Other"))


def _last_wins(entries: Column) -> Column:
    """Map of key and value structs; of equal keys the last one stays.

    Sorted by key and descending place, an entry stays where its key begins. The entries and
    the sorted array are bound once by one-element transforms, so k entries cost one sort.
    """
    def bound(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), 0)

    def first_of_each(ranked: Column) -> Column:
        return F.filter(ranked, lambda entry, i: (i == 0) | (F.get(ranked, i - 1)["key"] != entry["key"]))

    def settled(given: Column) -> Column:
        ranked = F.array_sort(F.transform(given, lambda entry, i: F.struct(entry["key"].alias("key"), (-i).alias("place"), entry["value"].alias("value"))))
        kept = F.transform(bound(ranked, first_of_each), lambda entry: F.struct(entry["key"].alias("key"), entry["value"].alias("value")))
        return F.when(F.size(given) < 2, given).otherwise(kept)

    return F.map_from_entries(bound(entries, settled))


def _pairs(text: Column) -> Column:
    """'k:v,k:v' to a map; parts without a colon are left out, of equal keys the last one stays."""
    parts = F.filter(F.split(text, ","), lambda part: part.contains(":"))
    entries = F.transform(parts, lambda part: F.struct(
        _stripped(F.substring_index(part, ":", 1)).alias("key"), _stripped(F.substr(part, F.locate(":", part) + 1)).alias("value")))
    return F.when(text.contains(":"), _last_wins(entries)).otherwise(empty_tags())


def _stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(text, F.lit(" \t\n\x0b\f\r"))


def _object(text: Column) -> Column:
    """A flat JSON object to a map, null for anything else; of equal keys the last one stays."""
    return _last_wins(F.map_entries(F.from_json(text, "map<string,string>")))


def empty_tags() -> Column:
    return F.create_map().cast("map<string,string>")


def parse_tags(value: Column) -> Column:
    """Tags from a JSON object, else from 'k:v,k:v'; empty map for no text."""
    text = F.trim(value)
    return (
        F.when(text.isNull() | (text == ""), empty_tags())
        .when(text.startswith("{"), F.coalesce(_object(text), _pairs(text)))
        .otherwise(_pairs(text))
    )


def merge_tags(base: Column, over: Column) -> Column:
    """Union of two maps; entries of ``over`` win."""
    return F.map_concat(F.map_filter(base, lambda key, _: ~F.map_contains_key(over, key)), over)
