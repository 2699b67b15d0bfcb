"""Period analytics as registered queries: the last 90 days against the 90 before."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import events as ev
from ledgerline.operators import periods as pd_
from ledgerline.plans.catalog import query
from ledgerline.plans.core_queries import rounded
from ledgerline.sources.star import star_lines

DAYS = 90


def _lines(spark: SparkSession, d: str, days: int = DAYS) -> tuple[DataFrame, pd_.Period]:
    return _period_of(star_lines(spark, d), days)


def _period_of(lines: DataFrame, days: int = DAYS) -> tuple[DataFrame, pd_.Period]:
    last = ev.latest_day(lines)
    return lines, pd_.period(last - dt.timedelta(days=days - 1), last)


_P = """pl AS (SELECT *, CASE WHEN transaction_day BETWEEN d - 89 AND d THEN 'current' WHEN transaction_day BETWEEN d - 179 AND d - 90 THEN 'prior' END AS period, d FROM lines, cutoff)"""
_K = f"""{_P}, k0 AS (SELECT period, sum(line_revenue)::DOUBLE AS revenue, count(DISTINCT transaction_id) AS orders, count(DISTINCT customer_id) AS customers, sum(quantity) AS units FROM pl WHERE period IS NOT NULL GROUP BY 1),
 k AS (SELECT *, revenue / orders AS aov, units / orders AS units_per_order, revenue / units AS price_per_unit, revenue / customers AS revenue_per_customer, orders / customers AS orders_per_customer FROM k0)"""
_NAMES = ["revenue", "orders", "customers", "units", "aov", "units_per_order", "price_per_unit", "revenue_per_customer", "orders_per_customer"]


@query("period_kpis", f"{_K} SELECT period, round(revenue, 2) AS revenue, orders, customers, units, round(aov, 4) AS aov, round(units_per_order, 4) AS units_per_order, round(price_per_unit, 4) AS price_per_unit, round(revenue_per_customer, 4) AS revenue_per_customer, round(orders_per_customer, 4) AS orders_per_customer FROM k")
def period_kpis(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pd_.period_kpis(*_lines(spark, d)), 4)


_LONG = " UNION ALL ".join(f"SELECT '{n}' AS kpi, a.{n}::DOUBLE AS current, b.{n}::DOUBLE AS prior FROM (FROM k WHERE period = 'current') a, (FROM k WHERE period = 'prior') b" for n in _NAMES)


@query("kpi_delta", f"{_K}, l AS ({_LONG}) SELECT kpi, round(current, 4) AS current, round(prior, 4) AS prior, round(current - prior, 4) AS change, round((current - prior) / prior * 100, 4) AS pct_change, CASE WHEN current > prior THEN 'up' WHEN current < prior THEN 'down' ELSE 'neutral' END AS trend FROM l")
def kpi_delta(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pd_.kpi_delta(pd_.period_kpis(*_lines(spark, d))), 4)


_DRIVERS = f"""{_K}, w0 AS (SELECT b.revenue AS prior_revenue, a.revenue AS current_revenue, (a.customers - b.customers) * b.orders_per_customer * b.aov AS customer_effect, a.customers * (a.orders_per_customer - b.orders_per_customer) * b.aov AS frequency_effect,
      a.customers * a.orders_per_customer * (a.units_per_order - b.units_per_order) * b.price_per_unit AS units_effect, a.customers * a.orders_per_customer * a.units_per_order * (a.price_per_unit - b.price_per_unit) AS price_effect FROM (FROM k WHERE period = 'current') a, (FROM k WHERE period = 'prior') b),
    w AS (SELECT *, (SELECT n FROM (VALUES ('customer_effect', abs(customer_effect)), ('frequency_effect', abs(frequency_effect)), ('units_effect', abs(units_effect)), ('price_effect', abs(price_effect))) t(n, v) ORDER BY v DESC LIMIT 1) AS primary_driver FROM w0)"""


@query(
    "revenue_waterfall",
    f"""{_DRIVERS} SELECT round(prior_revenue, 2) AS prior_revenue, round(current_revenue, 2) AS current_revenue, round(customer_effect, 2) AS customer_effect, round(frequency_effect, 2) AS frequency_effect, round(units_effect, 2) AS units_effect, round(price_effect, 2) AS price_effect, primary_driver FROM w""",
)
def revenue_waterfall(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pd_.revenue_drivers(pd_.period_kpis(*_lines(spark, d))), 2)


_CMP = """n AS (SELECT {key}, sum(line_revenue)::DOUBLE AS revenue, count(DISTINCT transaction_id) AS orders, sum(quantity) AS units, count(DISTINCT customer_id) AS customers FROM pl WHERE period = 'current' GROUP BY 1),
 o AS (SELECT {key}, sum(line_revenue)::DOUBLE AS prior_revenue, count(DISTINCT transaction_id) AS prior_orders, sum(quantity) AS prior_units FROM pl WHERE period = 'prior' GROUP BY 1)"""
_PRODUCT = f"""{_P}, {_CMP.format(key="product_id")}, t AS (SELECT count(DISTINCT transaction_id) AS orders_all, sum(line_revenue)::DOUBLE AS revenue_all FROM pl WHERE period = 'current'),
 pf AS (SELECT n.*, coalesce(prior_revenue, 0) AS prior_revenue, coalesce(prior_orders, 0) AS prior_orders, coalesce(prior_units, 0) AS prior_units, orders / orders_all * 100 AS basket_penetration, CASE WHEN revenue_all > 0 THEN revenue / revenue_all * 100 ELSE 0 END AS revenue_share,
   revenue - coalesce(prior_revenue, 0) AS revenue_change, (rank() OVER (ORDER BY revenue DESC))::INTEGER AS revenue_rank, (rank() OVER (ORDER BY coalesce(prior_revenue, 0) DESC))::INTEGER AS prior_revenue_rank FROM n LEFT JOIN o USING (product_id), t)"""


@query("product_period_features", _PRODUCT + " SELECT product_id, round(revenue, 2) AS revenue, orders, units, customers, round(prior_revenue, 2) AS prior_revenue, prior_orders, prior_units, round(basket_penetration, 4) AS basket_penetration, round(revenue_share, 4) AS revenue_share, round(revenue_change, 2) AS revenue_change, revenue_rank, prior_revenue_rank, prior_revenue_rank - revenue_rank AS rank_change FROM pf")
def product_period_features(spark: SparkSession, d: str) -> DataFrame:
    out = pd_.product_period_features(*_lines(spark, d))
    names = ["product_id", "revenue", "orders", "units", "customers", "prior_revenue", "prior_orders", "prior_units", "basket_penetration", "revenue_share", "revenue_change", "revenue_rank", "prior_revenue_rank", "rank_change"]
    return rounded(out.select(*names), 4).withColumns({c: F.round(c, 2) + 0.0 for c in ("revenue", "prior_revenue", "revenue_change")})


@query("product_movers", _PRODUCT + " SELECT product_id, round(revenue_change, 2) AS revenue_change FROM pf ORDER BY abs(revenue_change) DESC, product_id LIMIT 20")
def product_movers(spark: SparkSession, d: str) -> DataFrame:
    out = pd_.product_period_features(*_lines(spark, d)).orderBy(F.desc(F.abs("revenue_change")), "product_id").limit(20)
    return rounded(out.select("product_id", "revenue_change"), 2)


@query(
    "category_period_features",
    f"""{_P}, {_CMP.format(key="category")}, c AS (SELECT n.*, coalesce(prior_revenue, 0) AS prior_revenue FROM n LEFT JOIN o USING (category))
    SELECT category, round(revenue, 2) AS revenue, orders, units, customers, round(prior_revenue, 2) AS prior_revenue, round(CASE WHEN sum(revenue) OVER () > 0 THEN revenue / sum(revenue) OVER () * 100 ELSE 0 END, 4) AS revenue_share, round(revenue / orders, 4) AS avg_order_value,
      round(revenue - prior_revenue, 2) AS revenue_change, round((revenue - prior_revenue) / nullif(prior_revenue, 0) * 100, 4) AS growth, round((revenue - prior_revenue) / nullif(sum(revenue - prior_revenue) OVER (), 0) * 100, 4) AS contribution_pct FROM c""",
)
def category_period_features(spark: SparkSession, d: str) -> DataFrame:
    out = rounded(pd_.category_period_features(*_lines(spark, d)), 4)
    return out.withColumns({c: F.round(c, 2) + 0.0 for c in ("revenue", "prior_revenue", "revenue_change")})


def _contribution_sql(key: str, value: str, n: int) -> str:
    return f"""{_P}, s AS (SELECT {key}, coalesce({value} FILTER (period = 'current'), 0)::DOUBLE AS current, coalesce({value} FILTER (period = 'prior'), 0)::DOUBLE AS prior FROM pl WHERE period IS NOT NULL GROUP BY 1),
      r AS (SELECT *, current - prior AS change, (current - prior) / sum(current - prior) OVER () * 100 AS c, rank() OVER (ORDER BY round(abs(current - prior), 4) DESC) AS k FROM s)
    SELECT {key}, round(current, 2) AS current, round(prior, 2) AS prior, round(change, 2) AS change, round(coalesce(c, 0), 4) AS contribution_pct, k::INTEGER AS rank FROM r WHERE k <= {n}"""


def _contributed(spark: SparkSession, d: str, key: str, measure: str) -> DataFrame:
    out = rounded(pd_.contribution(*_lines(spark, d), key, measure), 4)
    return out.withColumns({c: F.round(c, 2) + 0.0 for c in ("current", "prior", "change")})


@query("category_contribution", _contribution_sql("category", "sum(line_revenue)", 10))
def category_contribution(spark: SparkSession, d: str) -> DataFrame:
    return _contributed(spark, d, "category", "revenue")


@query("drilldown_department", _contribution_sql("department", "count(DISTINCT transaction_id)", 10))
def drilldown_department(spark: SparkSession, d: str) -> DataFrame:
    return _contributed(spark, d, "department", "orders")


@query(
    "kpi_sparklines",
    """s AS (SELECT (5 - floor(date_diff('day', transaction_day, d) / 90))::INTEGER AS period_index, line_revenue, transaction_id, customer_id FROM lines, cutoff)
    SELECT period_index, sum(line_revenue)::DOUBLE AS revenue, count(DISTINCT transaction_id) AS orders, count(DISTINCT customer_id) AS customers, round(sum(line_revenue)::DOUBLE / count(DISTINCT transaction_id), 4) AS aov FROM s WHERE period_index >= 0 GROUP BY 1""",
)
def kpi_sparklines(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pd_.kpi_sparklines(*_lines(spark, d)), 4)


@query(
    "yoy_revenue",
    """b AS (SELECT (d - 89)::DATE AS s, d::DATE AS e FROM cutoff), a AS (SELECT date_trunc('month', transaction_day)::DATE AS bucket, sum(line_revenue)::DOUBLE AS revenue FROM lines, b WHERE transaction_day BETWEEN s AND e GROUP BY 1),
    y AS (SELECT (date_trunc('month', transaction_day) + INTERVAL 1 YEAR)::DATE AS bucket, sum(line_revenue)::DOUBLE AS revenue_year_before FROM lines, b WHERE transaction_day BETWEEN (s - INTERVAL 1 YEAR)::DATE AND (e - INTERVAL 1 YEAR)::DATE GROUP BY 1)
    SELECT bucket, coalesce(revenue, 0) AS revenue, coalesce(revenue_year_before, 0) AS revenue_year_before FROM a FULL JOIN y USING (bucket)""",
    dates=("bucket",),
)
def yoy_revenue(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pd_.year_over_year(*_lines(spark, d)), 2)


@query(
    "category_mix_trend",
    f"""{_P}, m AS (SELECT date_trunc('month', transaction_day)::DATE AS bucket, category, sum(line_revenue)::DOUBLE AS revenue FROM pl WHERE period = 'current' GROUP BY 1, 2)
    SELECT bucket, category, revenue, round(revenue / sum(revenue) OVER (PARTITION BY bucket) * 100, 4) AS share FROM m""",
    dates=("bucket",),
)
def category_mix_trend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pd_.category_mix(*_lines(spark, d)), 4)


@query(
    "top_product_trends",
    f"""{_P}, t AS (SELECT product_id FROM pl WHERE period = 'current' GROUP BY 1 ORDER BY sum(line_revenue) DESC, product_id LIMIT 5)
    SELECT date_trunc('month', transaction_day)::DATE AS bucket, product_id, sum(line_revenue)::DOUBLE AS revenue FROM pl WHERE period = 'current' AND product_id IN (FROM t) GROUP BY 1, 2""",
    dates=("bucket",),
)
def top_product_trends(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pd_.top_product_trends(*_lines(spark, d)), 2)


_QUADRANT = "{src}, m AS (SELECT quantile_cont({x}, 0.5) AS mx, quantile_cont({y}, 0.5) AS my FROM q) SELECT {key}, round({x}, 4) AS {x}, round({y}, 4) AS {y}, CASE WHEN {x} >= mx AND {y} >= my THEN '{n[0]}' WHEN {x} >= mx THEN '{n[1]}' WHEN {y} >= my THEN '{n[2]}' ELSE '{n[3]}' END AS quadrant FROM q, m"
_STARS = ("Stars", "Broad, low price", "Niche premium", "Long tail")


@query("product_quadrant", _QUADRANT.format(src=_PRODUCT + ", q AS (SELECT product_id, basket_penetration, revenue / orders AS rev_per_order FROM pf ORDER BY revenue DESC, product_id LIMIT 50)", key="product_id", x="basket_penetration", y="rev_per_order", n=_STARS))
def product_quadrant(spark: SparkSession, d: str) -> DataFrame:
    top = pd_.product_period_features(*_lines(spark, d)).orderBy(F.desc("revenue"), "product_id").limit(50)
    out = pd_.quadrants(top, "basket_penetration", "rev_per_order", _STARS)
    return rounded(out.select("product_id", "basket_penetration", "rev_per_order", "quadrant"), 4)


_C = """c AS (SELECT customer_id, bool_or(transaction_day BETWEEN d - 89 AND d) AS now, bool_or(transaction_day BETWEEN d - 179 AND d - 90) AS prior, bool_or(transaction_day < d - 89) AS ever, bool_or(transaction_day < d - 89 AND transaction_day >= d - 89 - 90) AS recent,
  count(DISTINCT transaction_id) AS orders, sum(line_revenue)::DOUBLE AS revenue FROM lines, cutoff GROUP BY 1), v AS (SELECT *, row_number() OVER (ORDER BY revenue DESC, customer_id) AS k, floor(count(*) OVER () * 0.2) AS top FROM c)"""


@query(
    "retention_metrics",
    f"""{_C} SELECT round(count(*) FILTER (now AND prior) / count(*) FILTER (prior), 6) AS retention_rate, round(coalesce(count(*) FILTER (ever AND NOT recent AND now) / nullif(count(*) FILTER (ever AND NOT recent), 0), 0), 6) AS reactivation_rate,
    round(count(*) FILTER (now AND NOT ever) / count(*) FILTER (now), 6) AS new_customer_share, round(count(*) FILTER (orders > 1) / count(*), 6) AS repeat_purchase_rate, round(sum(revenue) FILTER (orders > 1) / sum(revenue), 6) AS repeat_revenue_share,
    count(*) FILTER (now) AS curr_customers, count(*) FILTER (prior) AS prior_customers, count(*) FILTER (now AND prior) AS retained, count(*) FILTER (ever AND NOT recent AND now) AS reactivated, count(*) FILTER (now AND NOT ever) AS new_customers,
    count(*) FILTER (k <= top AND NOT now) AS inactive_valuable_count, round(coalesce(sum(revenue) FILTER (k <= top AND NOT now), 0), 2) AS inactive_valuable_revenue FROM v""",
)
def retention_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = rounded(pd_.retention_metrics(*_lines(spark, d)))
    return out.withColumn("inactive_valuable_revenue", F.round("inactive_valuable_revenue", 2))


@query("retained_customers", f"{_C} SELECT customer_id FROM c WHERE now AND prior")
def retained_customers(spark: SparkSession, d: str) -> DataFrame:
    return pd_.retained_customers(*_lines(spark, d))


@query("reactivated_customers", f"{_C} SELECT customer_id FROM c WHERE now AND ever AND NOT recent")
def reactivated_customers(spark: SparkSession, d: str) -> DataFrame:
    return pd_.reactivated_customers(*_lines(spark, d))


@query("inactive_valuable", f"{_C} SELECT customer_id, revenue FROM v WHERE k <= top AND NOT now")
def inactive_valuable(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pd_.inactive_valuable(*_lines(spark, d)), 2)


_DAILY = "dk AS (SELECT transaction_day, sum(line_revenue)::DOUBLE AS revenue, count(DISTINCT transaction_id) AS orders, count(DISTINCT customer_id) AS customers, sum(quantity) AS units FROM lines, cutoff WHERE transaction_day >= d - 89 - 56 GROUP BY 1), dv AS (SELECT *, revenue / orders AS aov, units / orders AS units_per_order, revenue / customers AS revenue_per_customer FROM dk)"
_UNPIVOT = " UNION ALL ".join(f"SELECT transaction_day, '{m}' AS metric, {m}::DOUBLE AS value FROM dv" for m in pd_.ANOMALY_METRICS)
_ANOMALY = f"""{_DAILY}, l AS ({_UNPIVOT}), w AS (SELECT *, avg(value) OVER p AS expected, stddev_samp(value) OVER p AS sd, count(value) OVER p AS n FROM l WINDOW p AS (PARTITION BY metric ORDER BY transaction_day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)),
 f AS (SELECT transaction_day, metric, value, expected, (value - expected) / nullif(expected, 0) * 100 AS pct_deviation, CASE WHEN value > expected + 2 * sd THEN 'high' ELSE 'low' END AS direction FROM w, cutoff WHERE n >= 7 AND transaction_day >= d - 89 AND (value > expected + 2 * sd OR value < expected - 2 * sd))"""


@query("anomaly_daily", f"{_ANOMALY} SELECT transaction_day, metric, round(value, 4) AS value, round(expected, 4) AS expected, round(coalesce(pct_deviation, 0), 4) AS pct_deviation, direction FROM f", dates=("transaction_day",))
def anomaly_daily(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pd_.anomalies(*_lines(spark, d)).drop("upper", "lower"), 4)


@query("anomaly_summary", f"{_ANOMALY} SELECT metric, count(*) AS anomalies, round(max(abs(pct_deviation)), 4) AS max_abs_deviation FROM f GROUP BY 1")
def anomaly_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pd_.anomaly_summary(pd_.anomalies(*_lines(spark, d))), 4)


@query("daily_kpis", "SELECT transaction_day, sum(line_revenue)::DOUBLE AS revenue, count(DISTINCT transaction_id) AS orders, count(DISTINCT customer_id) AS customers, sum(quantity) AS units, round((sum(sum(line_revenue)) OVER (ORDER BY transaction_day ROWS 6 PRECEDING))::DOUBLE, 2) AS rolling_revenue FROM lines GROUP BY 1", dates=("transaction_day",))
def daily_kpis(spark: SparkSession, d: str) -> DataFrame:
    out = pd_.rolling_sum(pd_.daily_kpis(star_lines(spark, d)), "revenue")
    return rounded(out.select("transaction_day", "revenue", "orders", "customers", "units", "rolling_revenue"), 2)


@query("grouped_expressions", "SELECT department, sum(line_revenue)::DOUBLE AS revenue, count(DISTINCT transaction_id) AS orders, max(quantity) AS largest FROM lines GROUP BY 1")
def grouped_expressions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pd_.group_by_expressions(star_lines(spark, d), ["department"], {"revenue": "sum(line_revenue)", "orders": "nunique(transaction_id)", "largest": "max(quantity)"}), 2)


@query("category_quadrant", f"{_P}, {_CMP.format(key='category')}, q AS (SELECT category, (revenue - prior_revenue) / nullif(prior_revenue, 0) * 100 AS growth, revenue / sum(revenue) OVER () * 100 AS revenue_share FROM n JOIN o USING (category)), m AS (SELECT quantile_cont(growth, 0.5) AS mx, quantile_cont(revenue_share, 0.5) AS my FROM q) SELECT category, round(growth, 4) AS growth, round(revenue_share, 4) AS revenue_share, CASE WHEN growth >= mx AND revenue_share >= my THEN 'Growing leaders' WHEN growth >= mx THEN 'Growing, small' WHEN revenue_share >= my THEN 'Large, slowing' ELSE 'Declining' END AS quadrant FROM q, m")
def category_quadrant(spark: SparkSession, d: str) -> DataFrame:
    rows = pd_.category_period_features(*_lines(spark, d)).filter("growth IS NOT NULL")
    out = pd_.quadrants(rows, "growth", "revenue_share", ("Growing leaders", "Growing, small", "Large, slowing", "Declining"))
    return rounded(out.select("category", "growth", "revenue_share", "quadrant"), 4)
