"""Registered queries over cost records: listings, summaries, trends, comparisons, insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.category import category_sql
from ..functions.numeric import exact_sum, fixed as fixed_col, money as money_col
from ..operators import features, filters, insights, summaries, trends
from ..sources.tables import event_costs, lineitem_costs, table
from .registry import AS_OF, COSTS, EVENTS, change, fixed, money, query, share, total

BASE = ["user_id", "cost", "usage_start_date"]
CURRENT = ("2001-04-01", "2001-06-15")
PREVIOUS = ("2001-01-01", "2001-03-31")
DAY = "strftime(usage_start_date, '%Y-%m-%d')"


# --- listing -----------------------------------------------------------------

@query("Q1_cost_page", f"""WITH {COSTS}, numbered AS (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cost DESC, cost_id, usage_start_date) AS position FROM costs)
SELECT user_id, CAST(position AS BIGINT) AS position, cost_id, provider, service_name, region, {fixed('cost')} AS cost,
       {DAY} AS date FROM numbered WHERE position > 50 AND position <= 100""")
def q1_cost_page(spark, sf_dir):
    fields = ["cost_id", *BASE, "provider", "service_name", "region"]
    page = summaries.cost_page_per_user(
        lineitem_costs(spark, sf_dir, fields), page=2, sort_by="cost", ties=("cost_id", "usage_start_date")
    )
    return page.select(
        "user_id", F.col("position").cast("bigint").alias("position"), "cost_id", "provider", "service_name", "region",
        fixed_col("cost").alias("cost"), F.date_format("usage_start_date", "yyyy-MM-dd").alias("date"),
    )


@query("Q1_page_metadata", f"""WITH {COSTS}
SELECT user_id, count(*) AS total_count, CAST(2 AS BIGINT) AS page, CAST(50 AS BIGINT) AS page_size,
       CAST((count(*) + 49) // 50 AS BIGINT) AS total_pages, 2 < (count(*) + 49) // 50 AS has_next, true AS has_prev
FROM costs WHERE provider = 'AWS' AND regexp_matches(service_name, 'amazon', 'i')
  AND usage_start_date >= TIMESTAMP '1998-01-01' AND usage_start_date <= TIMESTAMP '{AS_OF}' GROUP BY user_id""")
def q1_page_metadata(spark, sf_dir):
    costs = lineitem_costs(spark, sf_dir, [*BASE, "provider", "service_name"])
    return summaries.page_metadata(filters.select_costs(costs, "1998-01-01", AS_OF, "AWS", "amazon"), page=2)


# --- filters -----------------------------------------------------------------

def _counted(costs):
    return costs.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("record_count"), money_col(exact_sum("cost")).alias("total_cost")
    )


_COUNTED = f"SELECT user_id, count(*) AS record_count, {money(total('cost'))} AS total_cost FROM costs"


@query("P11_cost_filter", f"""WITH {COSTS} {_COUNTED}
WHERE usage_start_date >= TIMESTAMP '2000-01-01' AND usage_start_date <= TIMESTAMP '2000-12-31'
  AND provider = 'Azure' AND region = 'ASIA' AND regexp_matches(service_name, 'azure (sql|mon)', 'i') GROUP BY user_id""")
def p11_cost_filter(spark, sf_dir):
    costs = lineitem_costs(spark, sf_dir, [*BASE, "provider", "region", "service_name"])
    return _counted(filters.select_costs(costs, "2000-01-01", "2000-12-31", "Azure", "AZURE (sql|mon)", "ASIA"))


@query("P12_trend_filter", f"""WITH {COSTS} {_COUNTED}
WHERE regexp_matches(service_name, 'cdn', 'i') AND cloud_account_id = 'acct-7' GROUP BY user_id""")
def p12_trend_filter(spark, sf_dir):
    costs = lineitem_costs(spark, sf_dir, [*BASE, "cloud_account_id", "service_name"])
    return _counted(filters.select_costs(costs, service="CDN", account="acct-7", provider=filters.UNSET, region=filters.UNSET))


@query("P13_forecast_filter", f"""WITH {COSTS} {_COUNTED}
WHERE service_name = 'Key Vault' AND environment = 'staging' AND resource_group = 'Brand#13' GROUP BY user_id""")
def p13_forecast_filter(spark, sf_dir):
    costs = lineitem_costs(spark, sf_dir, [*BASE, "service_name", "tags"])
    return _counted(filters.select_for_forecast(costs, "Key Vault", environment="staging", resource_group="Brand#13"))


@query("P14_month_filter", f"""WITH {COSTS} {_COUNTED}
WHERE usage_start_date >= TIMESTAMP '1999-12-01' AND usage_start_date < TIMESTAMP '2000-01-01' GROUP BY user_id""")
def p14_month_filter(spark, sf_dir):
    return _counted(filters.in_month(lineitem_costs(spark, sf_dir, BASE), "1999-12"))


@query("P15_insight_rows", f"""WITH {COSTS}
SELECT user_id, {DAY} AS date, service_name AS service, region, {fixed('cost', 4)} AS cost, provider, usage_quantity, usage_unit
FROM costs WHERE usage_start_date >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND usage_start_date <= TIMESTAMP '{AS_OF}'""")
def p15_insight_rows(spark, sf_dir):
    return filters.insight_rows(lineitem_costs(spark, sf_dir), AS_OF).withColumn("cost", fixed_col("cost", 4))


@query("P16_legacy_date", """WITH texts AS (SELECT o_orderkey, o_orderdate, o_orderkey % 4 AS kind FROM orders)
SELECT o_orderkey, CASE kind WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM texts""")
def p16_legacy_date(spark, sf_dir):
    kind = F.col("o_orderkey") % 4
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey",
        F.when(kind == 0, F.col("o_orderdate")).alias("usage_start_date"),
        F.when(kind == 1, F.concat(day, F.lit("T10:30:00Z"))).when(kind == 2, F.concat(day, F.lit(" at noon")))
        .when(kind == 3, F.lit("unknown")).alias("date"),
    )
    found = filters.legacy_date(F.col("usage_start_date"), F.col("date"))
    return orders.select("o_orderkey", F.date_format(found, "yyyy-MM-dd").alias("date"))


@query("P19_environment_this_month", f"""WITH {COSTS} {_COUNTED}
WHERE environment = 'production' AND usage_start_date >= TIMESTAMP '2001-06-01' AND usage_start_date < TIMESTAMP '2001-07-01'
GROUP BY user_id""")
def p19_environment(spark, sf_dir):
    costs = lineitem_costs(spark, sf_dir, [*BASE, "tags"])
    return _counted(filters.this_month(filters.in_environment(costs, "production"), AS_OF))


@query("P19_high_cost", f"""WITH {COSTS}, ranked AS (
    SELECT user_id, CAST(cost AS DECIMAL(20,4)) AS exact, row_number() OVER (PARTITION BY user_id ORDER BY CAST(cost AS DECIMAL(20,4))) AS rn,
           count(*) OVER (PARTITION BY user_id) AS n FROM costs),
limits AS (SELECT user_id, min(exact) AS threshold FROM ranked WHERE rn >= ceil(0.9::DOUBLE * n) GROUP BY user_id)
SELECT user_id, CAST(threshold AS DOUBLE) AS cost_threshold, count(*) AS record_count,
       CAST(round(sum(exact), 2) AS DOUBLE) AS total_cost
FROM ranked JOIN limits USING (user_id) WHERE exact >= threshold GROUP BY user_id, threshold""")
def p19_high_cost(spark, sf_dir):
    costs = lineitem_costs(spark, sf_dir, ["user_id", "cost"]).withColumn("cost", F.round("cost", 4))  # the table's amounts have four places
    rows = filters.high_cost(costs)
    return rows.groupBy("user_id", "cost_threshold").agg(
        F.count(F.lit(1)).alias("record_count"), money_col(exact_sum("cost")).alias("total_cost")
    )


@query("Q10_extreme_amounts", """WITH amounts AS (
    SELECT o_custkey % 10 AS user_id, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT user_id, CAST(round(count(*) * 0.0000000021::DECIMAL(20,10), 8) AS VARCHAR) AS tiny,
       CAST(CAST(sum(100000000000000::DECIMAL(30,2) * (l_orderkey % 64)) AS DECIMAL(38,8)) AS VARCHAR) AS huge,
       CAST(CAST(sum(100000000000000::DECIMAL(30,2) * (l_orderkey % 64)) + sum(l_linenumber * 0.01::DECIMAL(3,2)) AS DECIMAL(38,8)) AS VARCHAR) AS both
FROM amounts GROUP BY user_id""")
def q10_extreme_amounts(spark, sf_dir):
    """Sums of prices per request and of amounts of 1e14 and more, alone and with ordinary ones."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    huge = F.lit(1e14) * (F.col("l_orderkey") % 64)
    both = F.explode(F.array(huge, F.col("l_linenumber") / 100))
    user = (F.col("o_custkey") % 10).alias("user_id")
    single = rows.groupBy(user).agg(
        exact_sum(F.lit(2.1e-9)).cast("string").alias("tiny"), exact_sum(huge).cast("string").alias("huge"))
    mixed = rows.select(user, both.alias("cost")).groupBy("user_id").agg(exact_sum("cost").cast("string").alias("both"))
    return single.join(mixed, "user_id")


# --- summaries ---------------------------------------------------------------

def _summary_sql(field: str) -> str:
    return f"""WITH {COSTS}, groups AS (
    SELECT user_id, {field} AS name, {total('cost')} AS t, count(*) AS record_count, min(cost) AS low, max(cost) AS high
    FROM costs GROUP BY 1, 2), whole AS (SELECT *, sum(t) OVER (PARTITION BY user_id) AS g FROM groups)
SELECT user_id, name, {money('t')} AS total_cost, record_count, {fixed('CAST(t AS DOUBLE) / record_count')} AS avg_cost,
       {fixed('low')} AS min_cost, {fixed('high')} AS max_cost, {share('t', 'g')} AS percentage, {money('g')} AS grand_total
FROM whole"""


def _summary(group_by: str):
    field = summaries.SUMMARY_FIELDS[group_by]
    wanted = list(dict.fromkeys(["user_id", "cost", field]))

    def run(spark, sf_dir):
        return summaries.cost_summary(lineitem_costs(spark, sf_dir, wanted), group_by)

    query(f"Q2_summary_{group_by}", _summary_sql(field))(run)
    return run


q2_provider = _summary("provider")
q2_service = _summary("service")
q2_region = _summary("region")
q2_billing_period = _summary("billing_period")


@query("Q6_top_resources", f"""WITH {COSTS}, groups AS (
    SELECT user_id, service_name, resource_id, region, {total('cost')} AS t, count(*) AS record_count FROM costs GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, service_name, resource_id, region) AS rank FROM groups)
SELECT user_id, CAST(rank AS BIGINT) AS rank, service_name, CASE WHEN resource_id = '' THEN 'N/A' ELSE resource_id END AS resource_id,
       region, {money('t')} AS total_cost, record_count FROM ranked WHERE rank <= 10""")
def q6_top_resources(spark, sf_dir):
    costs = lineitem_costs(spark, sf_dir, ["user_id", "cost", "service_name", "resource_id", "region"])
    return summaries.top_resources(costs).withColumn("rank", F.col("rank").cast("bigint"))


@query("Q7_filter_options", f"""WITH {COSTS}, options AS (
    SELECT user_id, 'service' AS field, service_name AS value FROM costs UNION SELECT user_id, 'region', region FROM costs
    UNION SELECT user_id, 'account', cloud_account_id FROM costs UNION SELECT user_id, 'provider', provider FROM costs)
SELECT user_id, field, value FROM options WHERE value <> ''""")
def q7_filter_options(spark, sf_dir):
    return summaries.filter_options(
        lineitem_costs(spark, sf_dir, ["user_id", "service_name", "region", "cloud_account_id", "provider"])
    )


@query("Q8_date_bounds", f"""WITH {COSTS}
SELECT user_id, strftime(min(usage_start_date), '%Y-%m-%d') AS min_date, strftime(max(usage_start_date), '%Y-%m-%d') AS max_date,
       count(*) AS record_count FROM costs WHERE provider = 'GCP' GROUP BY user_id""")
def q8_date_bounds(spark, sf_dir):
    costs = lineitem_costs(spark, sf_dir, ["user_id", "usage_start_date", "provider"])
    bounds = summaries.date_bounds(filters.select_costs(costs, provider="GCP"))
    return bounds.select(
        "user_id", F.date_format("min_date", "yyyy-MM-dd").alias("min_date"),
        F.date_format("max_date", "yyyy-MM-dd").alias("max_date"), "record_count",
    )


@query("Q10_totals", f"WITH {COSTS} SELECT user_id, {money(total('cost'))} AS total FROM costs GROUP BY user_id")
def q10_totals(spark, sf_dir):
    return summaries.total_cost(lineitem_costs(spark, sf_dir, ["user_id", "cost"])).select("user_id", money_col("total").alias("total"))


@query("Q10_service_totals", f"""WITH {COSTS}
SELECT user_id, service_name, {money(total('cost'))} AS total FROM costs GROUP BY ALL""")
def q10_service_totals(spark, sf_dir):
    totals = summaries.service_totals(lineitem_costs(spark, sf_dir, ["user_id", "service_name", "cost"]))
    return totals.select("user_id", "service_name", money_col("total").alias("total"))


@query("Q11_distinct_services", f"""WITH {COSTS}
SELECT user_id, billing_period, service_name, count(*) AS record_count FROM costs GROUP BY ALL""")
def q11_distinct(spark, sf_dir):
    costs = lineitem_costs(spark, sf_dir, ["user_id", "billing_period", "service_name"])
    return summaries.distinct_values(costs, ["user_id", "billing_period"], "service_name")


@query("Q11_distinct_accounts", f"""WITH {COSTS}
SELECT user_id, billing_period, count(DISTINCT cloud_account_id) AS distinct_count FROM costs GROUP BY ALL""")
def q11_count(spark, sf_dir):
    costs = lineitem_costs(spark, sf_dir, ["user_id", "billing_period", "cloud_account_id"])
    return summaries.distinct_count(costs, ["user_id", "billing_period"], "cloud_account_id")


@query("J5_top_services_costs", f"""WITH {COSTS}, g AS (SELECT user_id, service_name, {total('cost')} AS t FROM costs GROUP BY ALL),
top AS (SELECT user_id, service_name FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, service_name) <= 5)
SELECT user_id, service_name, billing_period, count(*) AS record_count, {money(total('cost'))} AS total_cost
FROM costs SEMI JOIN top USING (user_id, service_name) GROUP BY ALL""")
def j5_top_services(spark, sf_dir):
    costs = lineitem_costs(spark, sf_dir, ["user_id", "service_name", "billing_period", "cost"])
    found = summaries.totals_of_top_services(costs, ["billing_period"])
    return found.select("user_id", "service_name", "billing_period", "record_count", money_col("total").alias("total_cost"))


@query("J5_rows_of_top_services", f"""WITH {COSTS}, g AS (SELECT user_id, service_name, {total('cost')} AS t FROM costs GROUP BY ALL),
top AS (SELECT user_id, service_name FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, service_name) <= 2)
SELECT user_id, service_name, count(*) AS record_count, {money(total('cost'))} AS total_cost FROM costs SEMI JOIN top USING (user_id, service_name) GROUP BY ALL""")
def j5_rows(spark, sf_dir):
    costs = lineitem_costs(spark, sf_dir, ["user_id", "service_name", "cost"])
    return summaries.costs_of_top_services(costs, 2).groupBy("user_id", "service_name").agg(
        F.count(F.lit(1)).alias("record_count"), money_col(exact_sum("cost")).alias("total_cost"))


# --- trends ------------------------------------------------------------------

_DAILY = f"""daily AS (SELECT user_id, {DAY} AS date, {money(total('cost'))} AS total_cost, count(*) AS record_count FROM costs
    WHERE usage_start_date >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND usage_start_date <= TIMESTAMP '{AS_OF}' GROUP BY 1, 2)"""


@query("Q3_daily_trend", f"WITH {COSTS}, {_DAILY} SELECT * FROM daily")
def q3_daily(spark, sf_dir):
    return trends.daily_trend(lineitem_costs(spark, sf_dir, BASE), AS_OF)


@query("Q3_daily_trend_summary", f"""WITH {COSTS}, {_DAILY}
SELECT user_id, {money(total('total_cost'))} AS total_cost, {fixed(f"CAST({total('total_cost')} AS DOUBLE) / count(*)")} AS average_daily_cost,
       count(*) AS days_count FROM daily GROUP BY user_id""")
def q3_summary(spark, sf_dir):
    return trends.daily_trend_summary(trends.daily_trend(lineitem_costs(spark, sf_dir, BASE), AS_OF))


@query("Q4_monthly_trend", f"""WITH {COSTS}, monthly AS (
    SELECT user_id, billing_period AS month, {money(total('cost'))} AS total_cost, count(*) AS record_count,
           count(DISTINCT service_name) AS unique_services FROM costs
    WHERE usage_start_date >= TIMESTAMP '{AS_OF}' - INTERVAL 372 DAY AND usage_start_date <= TIMESTAMP '{AS_OF}' GROUP BY 1, 2),
lagged AS (SELECT *, lag(total_cost) OVER (PARTITION BY user_id ORDER BY month) AS p FROM monthly)
SELECT user_id, month, total_cost, record_count, unique_services, {fixed(change('total_cost', 'p'))} AS change_percentage FROM lagged""")
def q4_monthly(spark, sf_dir):
    return trends.monthly_trend(lineitem_costs(spark, sf_dir, [*BASE, "billing_period", "service_name"]), AS_OF, months=12)


def _auto_sql(period: str, item: str, where: str = "") -> tuple[str, str]:
    """(periods, breakdown) SQL over ``costs`` for a fixed period expression."""
    cells = f"""cells AS (SELECT user_id, {period} AS period, {item} AS item, {total('cost')} AS t,
        min(usage_start_date) AS first, max(usage_end_date) AS last FROM costs {where} GROUP BY 1, 2, 3)"""
    periods = f"""{cells}, periods AS (SELECT user_id, period, {money('sum(t)')} AS total_cost,
        strftime(min(first), '%Y-%m-%d') AS start, strftime(max(last), '%Y-%m-%d') AS "end" FROM cells GROUP BY 1, 2),
    lagged AS (SELECT *, lag(total_cost) OVER (PARTITION BY user_id ORDER BY period) AS p FROM periods)
    SELECT user_id, period, total_cost, start, "end",
        CASE WHEN p IS NOT NULL THEN coalesce({fixed(change('total_cost', 'p'))}, 0) END AS change_percentage FROM lagged"""
    breakdown = f"""{cells}, items AS (SELECT user_id, period, item, {money('t')} AS cost FROM cells)
    SELECT *, CAST(row_number() OVER (PARTITION BY user_id, period ORDER BY cost DESC, item) AS BIGINT) AS position FROM items"""
    return periods, breakdown


_AUTO = ["user_id", "cost", "usage_start_date", "usage_end_date", "billing_period"]


@query("Q9_auto_trend", f"WITH {COSTS}, " + _auto_sql("billing_period", "service_name")[0])
def q9_auto(spark, sf_dir):
    return trends.auto_trend(lineitem_costs(spark, sf_dir, [*_AUTO, "service_name"]))


@query("Q9_auto_trend_breakdown_region", f"WITH {COSTS}, " + _auto_sql("billing_period", "region")[1])
def q9_breakdown(spark, sf_dir):
    rows = trends.auto_trend_breakdown(lineitem_costs(spark, sf_dir, [*_AUTO, "region"]), "region")
    return rows.withColumn("position", F.col("position").cast("bigint"))


@query("Q9_auto_trend_daily_events", f"WITH {EVENTS}, " + _auto_sql(DAY, "service_name")[0])
def q9_events(spark, sf_dir):
    return trends.auto_trend(event_costs(spark, sf_dir))


_LATEST = f"""WHERE billing_period = (SELECT strftime(max(usage_start_date), '%Y-%m') FROM costs c WHERE c.user_id = costs.user_id)
    AND regexp_matches(service_name, 'amazon', 'i')"""


@query("Q9_auto_trend_latest_month", f"WITH {COSTS}, " + _auto_sql(DAY, "provider", _LATEST)[0])
def q9_latest(spark, sf_dir):
    costs = lineitem_costs(spark, sf_dir, [*_AUTO, "provider", "service_name"])
    return trends.auto_trend(costs, "provider", latest_month=True, filters={"service": "Amazon"})


@query("Q9_auto_trend_summary", f"""WITH {COSTS}, p AS (
    SELECT user_id, billing_period, {money(total('cost'))} AS total_cost FROM costs GROUP BY 1, 2)
SELECT user_id, count(*) AS periods_count, {money(total('total_cost'))} AS total_cost,
       {fixed(f"CAST({total('total_cost')} AS DOUBLE) / count(*)")} AS average_cost FROM p GROUP BY user_id""")
def q9_summary(spark, sf_dir):
    return trends.auto_trend_summary(trends.auto_trend(lineitem_costs(spark, sf_dir, [*_AUTO, "service_name"])))


@query("Q9_auto_trend_overview", f"""WITH {COSTS}, c AS (SELECT * FROM costs {_LATEST}), p AS (
    SELECT user_id, {DAY} AS period, {money(total('cost'))} AS total_cost, min(usage_start_date) AS a, max(usage_start_date) AS z FROM c GROUP BY 1, 2),
w AS (SELECT user_id, min(usage_start_date) AS a, max(usage_start_date) AS z FROM costs GROUP BY 1)
SELECT p.user_id, count(*) AS periods_count, {money(total('total_cost'))} AS total_cost, {fixed(f"CAST({total('total_cost')} AS DOUBLE) / count(*)")} AS average_cost,
    strftime(min(p.a), '%Y-%m-%d') AS start, strftime(max(p.z), '%Y-%m-%d') AS "end", strftime(any_value(w.z), '%Y-%m') AS detected_month,
    strftime(any_value(w.a), '%Y-%m-%d') AS full_start, strftime(any_value(w.z), '%Y-%m-%d') AS full_end FROM p JOIN w ON p.user_id = w.user_id GROUP BY p.user_id""")
def q9_overview(spark, sf_dir):
    costs = lineitem_costs(spark, sf_dir, [*_AUTO, "service_name"])
    return trends.auto_trend_overview(costs, latest_month=True, filters={"service": "Amazon"})


@query("Q9_auto_trend_nested", f"""WITH {COSTS}, i AS (SELECT user_id, billing_period AS period, region, {money(total('cost'))} AS c FROM costs GROUP BY 1, 2, 3),
t AS (SELECT user_id, billing_period AS period, {money(total('cost'))} AS total_cost FROM costs GROUP BY 1, 2)
SELECT user_id, period, any_value(total_cost) AS total_cost, string_agg(region, '|' ORDER BY c DESC, region) AS items, max(c) AS largest
FROM i JOIN t USING (user_id, period) GROUP BY 1, 2""")
def q9_nested(spark, sf_dir):
    costs = lineitem_costs(spark, sf_dir, [*_AUTO, "region"])
    nested = trends.nest_breakdown(trends.auto_trend(costs, "region"), trends.auto_trend_breakdown(costs, "region"))
    return nested.select(
        "user_id", "period", "total_cost", F.array_join(F.transform("breakdown", lambda b: b["service_name"]), "|").alias("items"),
        F.get("breakdown", F.lit(0))["cost"].alias("largest"))


_PERIODS = f"""periods AS (SELECT * REPLACE (CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN '1901-01' ELSE billing_period END AS billing_period) FROM costs)"""


def _other_periods(spark, sf_dir):
    """Costs whose billing period is missing or not the month of the start date."""
    line = F.split("cost_id", "-")[1].cast("int")
    return lineitem_costs(spark, sf_dir, ["cost_id", *_AUTO, "service_name"]).withColumn(
        "billing_period", F.when(line == 2, "1901-01").when(line != 1, F.col("billing_period")))


@query("P14_month_of_other_periods", f"""WITH {COSTS}, {_PERIODS} SELECT user_id, billing_period, count(*) AS record_count, {money(total('cost'))} AS total_cost FROM periods
WHERE usage_start_date >= TIMESTAMP '2001-05-01' AND usage_start_date < TIMESTAMP '2001-06-01' GROUP BY 1, 2""")
def p14_other(spark, sf_dir):
    return filters.in_month(_other_periods(spark, sf_dir), "2001-05").groupBy("user_id", "billing_period").agg(
        F.count(F.lit(1)).alias("record_count"), money_col(exact_sum("cost")).alias("total_cost"))


@query("Q9_trend_of_other_periods", f"""WITH {COSTS}, {_PERIODS} SELECT user_id, coalesce(billing_period, strftime(usage_start_date, '%Y-%m')) AS period, {money(total('cost'))} AS total_cost
FROM periods WHERE usage_start_date >= TIMESTAMP '2000-03-01' AND usage_start_date <= TIMESTAMP '2001-06-30' GROUP BY 1, 2""")
def q9_other(spark, sf_dir):
    found = trends.auto_trend(_other_periods(spark, sf_dir), filters={"start": "2000-03-01", "end": "2001-06-30"}, granularity="monthly")
    return found.select("user_id", "period", "total_cost")


@query("Q23_item_totals", f"""WITH {COSTS}, cells AS (
    SELECT user_id, billing_period, service_name AS name, {money(total('cost'))} AS cost FROM costs GROUP BY 1, 2, 3),
totals AS (SELECT user_id, name, {total('cost')} AS t FROM cells GROUP BY 1, 2),
whole AS (SELECT *, sum(t) OVER (PARTITION BY user_id) AS g FROM totals)
SELECT user_id, name, {money('t')} AS cost, {share('t', 'g', 1)} AS share_pct FROM whole""")
def q23_item_totals(spark, sf_dir):
    return trends.item_totals(trends.auto_trend_breakdown(lineitem_costs(spark, sf_dir, [*_AUTO, "service_name"])))


@query("Q24_month_over_month", f"""WITH {COSTS}, m AS (
    SELECT user_id, strftime(usage_start_date, '%Y-%m') AS month, {total('cost')} AS t FROM costs GROUP BY 1, 2),
r AS (SELECT *, lag(t) OVER w AS p, row_number() OVER (PARTITION BY user_id ORDER BY month DESC) AS rn FROM m
      WINDOW w AS (PARTITION BY user_id ORDER BY month))
SELECT user_id, month, {money('t')} AS current_cost, {money('p')} AS previous_cost,
       {fixed('(CAST(t AS DOUBLE) / CAST(p AS DOUBLE) - 1) * 100', 1)} AS change_pct, t >= p AS is_up
FROM r WHERE rn = 1 AND p IS NOT NULL AND p <> 0""")
def q24_month_over_month(spark, sf_dir):
    return trends.month_over_month(lineitem_costs(spark, sf_dir, BASE))


@query("Q25_service_search", f"""WITH {COSTS} SELECT user_id, service_name, {money(total('cost'))} AS total FROM costs
WHERE contains(lower(service_name), 'azure') GROUP BY ALL""")
def q25_search(spark, sf_dir):
    totals = summaries.service_totals(lineitem_costs(spark, sf_dir, ["user_id", "service_name", "cost"]))
    return trends.search_services(totals, "AZURE", "service_name").select("user_id", "service_name", money_col("total").alias("total"))


@query("Q25_service_drilldown", f"""WITH {COSTS}, periods AS (SELECT DISTINCT user_id, billing_period AS period FROM costs),
s AS (SELECT user_id, billing_period AS period, {money(total('cost'))} AS t FROM costs WHERE service_name = 'Key Vault' GROUP BY 1, 2)
SELECT user_id, period, 'Key Vault' AS service_name, coalesce(t, 0) AS total_cost FROM periods LEFT JOIN s USING (user_id, period)""")
def q25_drilldown(spark, sf_dir):
    costs = lineitem_costs(spark, sf_dir, ["user_id", "billing_period", "service_name", "cost"])
    return trends.service_drilldown(costs, "Key Vault")


@query("Q27_month_options", f"""WITH {COSTS}, b AS (
    SELECT user_id, date_trunc('month', min(usage_start_date)) AS a, date_trunc('month', max(usage_start_date)) AS z FROM costs GROUP BY 1),
m AS (SELECT user_id, unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 MONTH)) AS d FROM b)
SELECT user_id, strftime(d, '%Y-%m') AS value, strftime(d, '%b %Y') AS label FROM m""")
def q27_month_options(spark, sf_dir):
    return trends.month_options(lineitem_costs(spark, sf_dir, ["user_id", "usage_start_date"]))


@query("W4_period_change", f"""WITH {COSTS}, g AS (
    SELECT user_id, billing_period AS period, {money(total('cost'))} AS total_cost FROM costs GROUP BY 1, 2),
l AS (SELECT *, lag(total_cost) OVER (PARTITION BY user_id ORDER BY period) AS p FROM g)
SELECT user_id, period, total_cost, {fixed(change('total_cost', 'p'))} AS change_percentage FROM l""")
def w4_change(spark, sf_dir):
    monthly = lineitem_costs(spark, sf_dir, ["user_id", "billing_period", "cost"]).groupBy(
        "user_id", F.col("billing_period").alias("period")
    ).agg(money_col(exact_sum("cost")).alias("total_cost"))
    return trends.with_change(monthly, "period")


@query("W5_cumulative", f"""WITH {COSTS}, g AS (
    SELECT user_id, service_name, billing_period AS period, {total('cost')} AS t FROM costs GROUP BY 1, 2, 3)
SELECT user_id, service_name, period, {money('t')} AS cost,
       {money('sum(t) OVER (PARTITION BY user_id, service_name ORDER BY period)')} AS cumulative_cost FROM g""")
def w5_cumulative(spark, sf_dir):
    return trends.cumulative_cost(lineitem_costs(spark, sf_dir, ["user_id", "service_name", "billing_period", "cost"]))


_CATEGORY_DAILY = f"""rows AS (SELECT user_id, CAST(usage_start_date AS DATE) AS day, {category_sql('service_name')} AS category, cost
    FROM costs WHERE usage_start_date >= TIMESTAMP '2001-05-25' AND usage_start_date < TIMESTAMP '2001-07-01'),
daily AS (SELECT user_id, day, category, {total('cost')} AS t FROM rows GROUP BY 1, 2, 3),
means AS (SELECT *, CAST(sum(t) OVER w AS DOUBLE) / count(t) OVER w AS m FROM daily
    WINDOW w AS (PARTITION BY user_id, category ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
cells AS (SELECT user_id, strftime(day, '%Y-%m-%d') AS date, category, {money('t')} AS cost, {fixed(change('t', 'm'), 1)} AS dev
    FROM means WHERE day >= DATE '2001-06-01')"""
_PIVOT = ", ".join(
    f"coalesce(max(CASE WHEN category = '{c}' THEN cost END), 0) AS \"{c}\", max(CASE WHEN category = '{c}' THEN dev END) AS \"{c}_dev\""
    for c in trends.CATEGORIES
)


@query("Q22_category_daily", f"WITH {COSTS}, {_CATEGORY_DAILY} SELECT user_id, date, {_PIVOT} FROM cells GROUP BY user_id, date")
def q22_category_daily(spark, sf_dir):
    daily = trends.category_daily(lineitem_costs(spark, sf_dir, [*BASE, "service_name"]), "2001-06")
    return trends.category_daily_pivot(daily)


@query("Q22_category_alerts", f"WITH {COSTS}, {_CATEGORY_DAILY} SELECT * FROM cells WHERE dev > 40")
def q22_category_alerts(spark, sf_dir):
    daily = trends.category_daily(lineitem_costs(spark, sf_dir, [*BASE, "service_name"]), "2001-06")
    return trends.category_alerts(daily)


# --- comparison and insights -------------------------------------------------

def _pairs_sql(current, previous) -> str:
    within = [f"usage_start_date BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}'" for a, b in (current, previous)]
    sums = [f"coalesce(sum(CASE WHEN {w} THEN CAST(cost AS DECIMAL(20,4)) END), 0)" for w in within]
    return f"""pairs AS (SELECT user_id, service_name, {sums[0]} AS c, {sums[1]} AS p FROM costs
    WHERE {within[0]} OR {within[1]} GROUP BY 1, 2)"""


@query("Q5_comparison", f"""WITH {COSTS}, {_pairs_sql(CURRENT, PREVIOUS)}, changed AS (
    SELECT *, coalesce({change('c', 'p')}, CASE WHEN c > 0 THEN 100 END, 0) AS ch FROM pairs)
SELECT user_id, service_name, {money('c')} AS current_cost, {money('p')} AS previous_cost, {money('c - p')} AS difference,
       {fixed('ch')} AS change_percentage, CASE WHEN ch > 0 THEN 'increased' WHEN ch < 0 THEN 'decreased' ELSE 'stable' END AS status
FROM changed""")
def q5_comparison(spark, sf_dir):
    return insights.compare_periods(lineitem_costs(spark, sf_dir, [*BASE, "service_name"]), CURRENT, PREVIOUS)


@query("Q5_comparison_totals", f"""WITH {COSTS}, {_pairs_sql(CURRENT, PREVIOUS)}, t AS (
    SELECT user_id, sum(c) AS c, sum(p) AS p FROM pairs GROUP BY 1)
SELECT user_id, {money('c')} AS current_total, {money('p')} AS previous_total, {money('c - p')} AS total_difference,
       coalesce({fixed(change('c', 'p'))}, 0) AS total_change_percentage FROM t""")
def q5_totals(spark, sf_dir):
    return insights.comparison_totals(lineitem_costs(spark, sf_dir, [*BASE, "service_name"]), CURRENT, PREVIOUS)


@query("J1_period_join", f"""WITH {COSTS}, {_pairs_sql(CURRENT, PREVIOUS)}
SELECT user_id, service_name, {money('c')} AS current_cost, {money('p')} AS previous_cost FROM pairs""")
def j1_period_join(spark, sf_dir):
    costs = lineitem_costs(spark, sf_dir, [*BASE, "service_name"])
    return insights.join_periods(filters.between_dates(costs, *CURRENT), filters.between_dates(costs, *PREVIOUS))


_WINDOWS = insights.trailing_windows(AS_OF)


@query("Q18_spend_change", f"""WITH {COSTS}, {_pairs_sql(*_WINDOWS)}, t AS (SELECT user_id, sum(c) AS c, sum(p) AS p FROM pairs GROUP BY 1)
SELECT user_id, {money('c')} AS current_period, {money('p')} AS previous_period, coalesce({fixed(change('c', 'p'))}, 0) AS change_pct FROM t""")
def q18_spend_change(spark, sf_dir):
    return insights.spend_change(lineitem_costs(spark, sf_dir, [*BASE, "service_name"]), AS_OF)


@query("Q19_top_driver", f"""WITH {COSTS}, g AS (SELECT user_id, service_name, {total('cost')} AS t FROM costs GROUP BY 1, 2),
r AS (SELECT *, sum(t) OVER (PARTITION BY user_id) AS w, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, service_name) AS rn FROM g)
SELECT user_id, service_name AS service, {money('t')} AS cost, {share('t', 'w', 1)} AS percentage FROM r WHERE rn = 1""")
def q19_top_driver(spark, sf_dir):
    return insights.top_driver(lineitem_costs(spark, sf_dir, ["user_id", "service_name", "cost"]))


@query("Q20_fastest_growing", f"""WITH {COSTS}, {_pairs_sql(*_WINDOWS)}, g AS (
    SELECT user_id, service_name, {change('c', 'p')} AS growth FROM pairs WHERE p > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY growth DESC, service_name) AS rn FROM g)
SELECT user_id, service_name AS service, {fixed('growth', 1)} AS growth_pct FROM r WHERE rn = 1""")
def q20_fastest(spark, sf_dir):
    return insights.fastest_growing(lineitem_costs(spark, sf_dir, [*BASE, "service_name"]), AS_OF)


@query("Q21_category_distribution", f"""WITH {COSTS}, g AS (
    SELECT user_id, {category_sql('service_name')} AS category, {total('cost')} AS t FROM costs GROUP BY 1, 2),
w AS (SELECT *, sum(t) OVER (PARTITION BY user_id) AS whole FROM g)
SELECT user_id, category, {money('t')} AS cost, {share('t', 'whole', 1)} AS percentage FROM w""")
def q21_distribution(spark, sf_dir):
    return insights.category_distribution(lineitem_costs(spark, sf_dir, ["user_id", "service_name", "cost"]))


@query("W6_share_of_total", f"""WITH {COSTS}, g AS (
    SELECT user_id, cloud_account_id, {total('cost')} AS t FROM costs GROUP BY 1, 2),
w AS (SELECT *, sum(t) OVER (PARTITION BY user_id) AS whole FROM g)
SELECT user_id, cloud_account_id, {share('t', 'whole', 4)} AS percentage FROM w""")
def w6_share(spark, sf_dir):
    from pyspark.sql import Window

    from ..functions.numeric import share_pct

    accounts = lineitem_costs(spark, sf_dir, ["user_id", "cloud_account_id", "cost"]).groupBy(
        "user_id", "cloud_account_id"
    ).agg(exact_sum("cost").alias("total"))
    whole = F.sum("total").over(Window.partitionBy("user_id"))
    return accounts.select("user_id", "cloud_account_id", share_pct(F.col("total"), whole, 4).alias("percentage"))


@query("G1_normalize", f"""WITH {COSTS}
SELECT strftime(usage_start_date, '%Y-%m-%d') AS date, {category_sql('service_name')} AS category, provider,
       CAST({total('cost')} AS DOUBLE) AS cost FROM costs GROUP BY 1, 2, 3""")
def g1_normalize(spark, sf_dir):
    raw = lineitem_costs(spark, sf_dir, ["usage_start_date", "service_name", "cost", "provider"]).select(
        F.col("usage_start_date").alias("date"), F.col("service_name").alias("service"), "cost", "provider"
    )
    return features.normalize_costs(raw).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), "category", "provider", fixed_col("cost", 4).alias("cost")
    )
