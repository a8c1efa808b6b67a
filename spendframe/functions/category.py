"""Service name to infrastructure category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CATEGORIES = ["Compute", "Storage", "Database", "Networking", "Management", "Security", "Other"]

# --- fixed values -----------------------------------------------------------
# Substring rules in order of precedence: the first keyword found in the
# trimmed, lower-case service name decides.
CATEGORY_RULES = [
    ("Database", [
        "relational database", "rds", "sql database", "azure sql", "cloud sql", "cosmos db", "dynamodb",
        "redshift", "postgresql", "mysql", "mariadb", "elasticache", "redis cache", "firestore", "bigtable",
        "bigquery", "spanner", "memorystore", "aurora", "neptune", "microsoft.sql",
        "microsoft.dbforpostgresql", "microsoft.dbformysql", "microsoft.documentdb",
    ]),
    ("Networking", [
        "load balancer", "virtual private cloud", "vpc", "virtual network", "azure dns", "cloud dns",
        "route 53", "cloud cdn", "cloudfront", "front door", "content delivery", "firewall",
        "application gateway", "api gateway", "vpn gateway", "bandwidth", "network watcher", "cloud nat",
        "cloud interconnect", "cloud load balancing", "elastic load balancing", "microsoft.network", "dns",
    ]),
    ("Compute", [
        "ec2", "elastic compute", "virtual machines", "compute engine", "lambda", "azure functions",
        "cloud functions", "functions", "app service", "app engine", "container instances",
        "container apps", "kubernetes", "ecs", "eks", "cloud run", "vm scale sets", "lightsail", "batch",
        "fargate", "microsoft.compute", "microsoft.web",
    ]),
    ("Storage", [
        "s3", "blob storage", "disk storage", "persistent disk", "backup vault", "backup", "file storage",
        "filestore", "netapp", "glacier", "ebs", "storage gateway", "cloud storage", "microsoft.storage",
        "storage",
    ]),
    ("Management", [
        "azure monitor", "cloudwatch", "cloud monitoring", "cloud logging", "cloudtrail", "log analytics",
        "insight and analytics", "automation", "devops",
    ]),
    ("Security", [
        "key vault", "security center", "azure defender", "threat protection",
        "identity and access management", "iam", "guardduty", "security command center",
        "microsoft.keyvault",
    ]),
    ("Management", ["aws config", "systems manager", "trusted advisor"]),
]
# ----------------------------------------------------------------------------


def _category_of_key(key: Column) -> Column:
    """Category of an already trimmed lower-case name."""
    branch = F.when(key.isNull() | (key == ""), F.lit("Other"))
    for label in CATEGORIES:
        branch = branch.when(key == label.lower(), F.lit(label))
    for label, keywords in CATEGORY_RULES:
        for keyword in keywords:
            branch = branch.when(key.contains(keyword), F.lit(label))
    return branch.otherwise(F.lit("Other"))


def with_category(df: DataFrame, service: str = "service_name", out: str = "category") -> DataFrame:
    """Add the category column.

    Apply it after grouping by service where the query allows: the rule chain
    then runs once per group instead of once per cost row.
    """
    key = f"__{out}_key"
    return (
        df.withColumn(key, F.lower(F.trim(F.col(service))))
        .withColumn(out, _category_of_key(F.col(key)))
        .drop(key)
    )


def category_rules(spark: SparkSession) -> DataFrame:
    """The rule list as rows: position, keyword, category."""
    flat = [(keyword, label) for label, keywords in CATEGORY_RULES for keyword in keywords]
    return spark.createDataFrame(
        [(position, keyword, label) for position, (keyword, label) in enumerate(flat, start=1)],
        "position int, keyword string, category string",
    )


def category_sql(service: str) -> str:
    """The same chain as an SQL CASE over a service-name expression."""
    key = f"lower(trim({service}))"
    whens = [f"WHEN {service} IS NULL OR {key} = '' THEN 'Other'"]
    whens += [f"WHEN {key} = '{label.lower()}' THEN '{label}'" for label in CATEGORIES]
    whens += [
        f"WHEN contains({key}, '{keyword}') THEN '{label}'"
        for label, keywords in CATEGORY_RULES for keyword in keywords
    ]
    return "CASE " + " ".join(whens) + " ELSE 'Other' END"
