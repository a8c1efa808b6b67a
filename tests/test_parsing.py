from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spendframe.functions import parsing
from spendframe.functions.category import CATEGORY_RULES, category_rules, with_category


def _one(spark, values, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("v"))).collect()]


def test_date_layouts(spark):
    day = datetime(2024, 1, 13)
    cases = {
        "2024-01-13": day, "2024/01/13": day, "01/13/2024": day, "13/01/2024": day, "1/2/2024": datetime(2024, 1, 2),
        "2024-01-13 10:20:30": datetime(2024, 1, 13, 10, 20, 30), "2024-01-13T10:20:30": datetime(2024, 1, 13, 10, 20, 30),
        "2024-01-13T10:20:30Z": datetime(2024, 1, 13, 10, 20, 30),
        "2024-01-13T10:20:30.250": datetime(2024, 1, 13, 10, 20, 30, 250000),
        "2024-01-13T10:20:30.123456Z": datetime(2024, 1, 13, 10, 20, 30, 123456),
        "01-13-2024": day, "13-01-2024": day, "02-01-2024": datetime(2024, 2, 1),
        "02-01-2024 10:15": datetime(2024, 1, 2, 10, 15), "01-13-2024 10:15": datetime(2024, 1, 13, 10, 15),
        "20240113": day, "13-Jan-2024": day, "13 jan 2024": day, " 2024-01-13 ": day,
        "2024-02-30": None, "2024-01-13 extra": None, "yesterday": None, "": None, "13-Foo-2024": None,
        "2024-01-13T10:20:30+02:00": None, "1705104000": None,
    }
    assert _one(spark, cases, parsing.parse_date) == list(cases.values())


def test_epoch(spark):
    frame = spark.createDataFrame([(86400.0,), (0.0,), (1e10,), (-5.0,)], "v double")
    assert [r[0] for r in frame.select(parsing.parse_epoch(F.col("v"))).collect()] == [datetime(1970, 1, 2), None, None, None]


def test_iso_offsets_become_utc(spark):
    values = ["2024-01-05T10:00:00+02:00", "2024-01-05", "2024-01-05T10:00:00Z", "2024-01-05T10:00", "05/01/2024", "2024-13-01"]
    assert _one(spark, values, parsing.parse_iso) == [
        datetime(2024, 1, 5, 8), datetime(2024, 1, 5), datetime(2024, 1, 5, 10), datetime(2024, 1, 5, 10), None, None,
    ]


def test_money(spark):
    values = ["$1,234.50", "€ 5", "£7.25", "-3", "1e3", "abc", "NaN", "", None, "inf", "1.5d"]
    assert _one(spark, values, parsing.parse_money) == [1234.5, 5.0, 7.25, -3.0, 1000.0, None, None, None, None, float("inf"), None]


def test_provider_inference(spark):
    frame = spark.createDataFrame(
        [("Microsoft.Compute", "Amazon EC2"), ("", "AWS Lambda"), (None, "google maps"), (None, "cloud.run"),
         (None, "My GCP thing"), ("nothing", "Azure DNS"), (None, None), (None, "Cloud Run")], "c string, s string")
    got = [r[0] for r in frame.select(parsing.infer_provider(F.col("c"), F.col("s"))).collect()]
    assert got == ["Azure", "AWS", "GCP", "GCP", "GCP", "Azure", "Other", "Other"]


@pytest.mark.parametrize("text, expected", [
    ('{"a": "1", "b": 2}', {"a": "1", "b": "2"}),
    ("env:prod, team : core", {"env": "prod", "team": "core"}),
    ("url:http://x:80,junk,,a:1", {"url": "http://x:80", "a": "1"}),
    ("a:1,b:2,a:3", {"b": "2", "a": "3"}),
    ("a:1,ab:2", {"a": "1", "ab": "2"}), ("a:1,b:2,\na :3", {"a": "3", "b": "2"}), ('{"a":"1","b":null,"a":"2"}', {"a": "2", "b": None}),
    ("junk", {}), ("", {}), (None, {}), ("{broken", {}),
    ("{x:1", {"{x": "1"}),
])
def test_tags(spark, text, expected):
    assert _one(spark, [text], parsing.parse_tags) == [expected]


def test_tags_win_over_group(spark):
    frame = spark.range(1).select(
        F.create_map(F.lit("resource_group"), F.lit("a")).alias("g"),
        F.create_map(F.lit("resource_group"), F.lit("b"), F.lit("k"), F.lit("v")).alias("t"),
    )
    assert frame.select(parsing.merge_tags(F.col("g"), F.col("t"))).first()[0] == {"resource_group": "b", "k": "v"}
    assert frame.select(parsing.merge_tags(F.col("g"), parsing.empty_tags())).first()[0] == {"resource_group": "a"}


def test_categories(spark):
    cases = {
        "Amazon EC2": "Compute", " azure SQL Database ": "Database", "Cloud CDN": "Networking", "S3": "Storage",
        "Azure Monitor": "Management", "Key Vault": "Security", "security": "Security", "OTHER": "Other", "": "Other",
        None: "Other", "AWS Config": "Management", "Siamese cats": "Security", "Amazon RDS on EC2": "Database",
        "Backup DNS": "Networking", "Quantum": "Other",
    }
    frame = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, service_name string")
    assert [r.category for r in with_category(frame).orderBy("i").collect()] == list(cases.values())
    assert category_rules(spark).count() == sum(len(k) for _, k in CATEGORY_RULES) == 105
