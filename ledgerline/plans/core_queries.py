"""Quality, summaries, events, features and scores as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import events as ev
from ledgerline.operators import features as ft
from ledgerline.operators import quality as qa
from ledgerline.operators import scoring as sc
from ledgerline.operators import summaries as sm
from ledgerline.plans.catalog import query
from ledgerline.sources.readers import app_lines
from ledgerline.sources.star import star_lines
from ledgerline.storage import settled


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and decimals as doubles, for comparison across engines."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double" or kind.startswith("decimal"):
            c = F.round(c.cast("double"), digits) + 0.0
        out.append(c.alias(name))
    return df.select(*out)


@query("lines_normalised", "SELECT customer_id, transaction_day, transaction_id, product_id, department, category, price, quantity, line_revenue::DOUBLE AS line_revenue FROM lines", dates=("transaction_day",))
def lines_normalised(spark: SparkSession, d: str) -> DataFrame:
    return star_lines(spark, d).select("customer_id", "transaction_day", "transaction_id", "product_id", "department", "category", "price", "quantity", F.col("line_revenue").cast("double").alias("line_revenue"))


_ISSUES = {
    "missing_customer_id_rows": "customer_id IS NULL", "missing_transaction_id_rows": "transaction_id IS NULL", "missing_product_id_rows": "product_id IS NULL",
    "missing_category_rows": "category IS NULL", "missing_transaction_date_rows": "transaction_date IS NULL", "malformed_transaction_date_rows": "false",
    "missing_price_rows": "price IS NULL", "invalid_price_conversion_rows": "false", "negative_price_rows": "price < 0", "zero_price_rows": "price = 0",
    "missing_quantity_rows": "quantity IS NULL", "invalid_quantity_conversion_rows": "false", "negative_quantity_return_rows": "quantity < 0",
    "zero_quantity_rows": "quantity = 0", "uncomputable_line_revenue_rows": "line_revenue IS NULL",
}
_REQUIRED = "customer_id, transaction_date, transaction_id, product_id, product_description, department, category, price, quantity"


@query(
    "issue_counts",
    " UNION ALL ".join(f"SELECT '{k}' AS issue, count(*) FILTER ({v}) AS rows FROM lines" for k, v in _ISSUES.items())
    + f" UNION ALL SELECT 'exact_duplicate_excess_rows', (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM lines GROUP BY {_REQUIRED})) UNION ALL SELECT 'ignored_extra_columns', 0",
)
def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    return qa.issue_counts(star_lines(spark, d))


@query("cleaning_counts", f"SELECT count(*) AS rows_in, (SELECT count(*) FROM (SELECT DISTINCT {_REQUIRED} FROM lines)) AS rows_distinct, count(*) FILTER (quantity IS NULL OR quantity <> 0) AS rows_nonzero, count(*) FILTER (price IS NULL OR price >= 0) AS rows_nonnegative FROM lines")
def cleaning_counts(spark: SparkSession, d: str) -> DataFrame:
    lines = star_lines(spark, d)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return (
        n(lines, "rows_in")
        .crossJoin(n(qa.clean(lines, duplicates=True), "rows_distinct"))
        .crossJoin(n(qa.clean(lines, zero_quantity=True), "rows_nonzero"))
        .crossJoin(n(qa.clean(lines, negative_price=True), "rows_nonnegative"))
    )  # one row each


@query(
    "structural_checks",
    """SELECT 'transaction_ids_used_by_multiple_customers' AS "check", (SELECT count(*) FROM (SELECT transaction_id FROM lines GROUP BY 1 HAVING count(DISTINCT customer_id) > 1)) AS violations
    UNION ALL SELECT 'customer_transaction_keys_spanning_multiple_days', (SELECT count(*) FROM (SELECT customer_id, transaction_id FROM lines GROUP BY ALL HAVING count(DISTINCT transaction_day) > 1))
    UNION ALL SELECT 'product_ids_with_conflicting_category_or_department', (SELECT count(*) FROM (SELECT product_id FROM lines GROUP BY 1 HAVING count(DISTINCT department) > 1 OR count(DISTINCT category) > 1))""",
)
def structural_checks(spark: SparkSession, d: str) -> DataFrame:
    return qa.structural_checks(star_lines(spark, d))


@query("accounting_totals", "SELECT coalesce(sum(line_revenue) FILTER (quantity > 0), 0)::DOUBLE AS gross, coalesce(sum(-line_revenue) FILTER (quantity < 0), 0)::DOUBLE AS returns, sum(line_revenue)::DOUBLE AS net, 0.0::DOUBLE AS difference FROM lines")
def accounting_totals(spark: SparkSession, d: str) -> DataFrame:
    return qa.accounting_totals(star_lines(spark, d))


@query("app_lines_totals", "SELECT category, count(*) AS lines, sum(line_revenue)::DOUBLE AS revenue FROM lines WHERE quantity IS NULL OR quantity <> 0 GROUP BY 1")
def app_lines_totals(spark: SparkSession, d: str) -> DataFrame:
    return app_lines(star_lines(spark, d)).groupBy("category").agg(F.count(F.lit(1)).alias("lines"), F.sum("revenue").cast("double").alias("revenue"))


# -- roll-ups

_DIM = """count(*) AS line_items, coalesce(sum(line_revenue) FILTER (quantity > 0), 0)::DOUBLE AS gross_purchase_revenue, coalesce(sum(-line_revenue) FILTER (quantity < 0), 0)::DOUBLE AS return_value,
  coalesce(sum(line_revenue), 0)::DOUBLE AS net_revenue, coalesce(sum(quantity) FILTER (quantity > 0), 0)::DOUBLE AS units_purchased, coalesce(sum(-quantity) FILTER (quantity < 0), 0)::DOUBLE AS units_returned,
  count(DISTINCT customer_id) AS distinct_customers, count(DISTINCT product_id) AS distinct_products FROM lines GROUP BY 1"""


_GRAINS = {"category": "category", "department": "department", "month": "strftime(transaction_day, '%Y-%m')", "weekday": "isodow(transaction_day)::INTEGER", "quarter": "year(transaction_day) || 'Q' || quarter(transaction_day)", "year": "year(transaction_day)"}


@query("dimension_summaries", "SELECT * FROM (" + " UNION ALL ".join(f"(SELECT '{k}' AS dimension, CAST({v} AS VARCHAR) AS key, {_DIM[: _DIM.index(' FROM ')]} FROM lines GROUP BY 1, 2)" for k, v in _GRAINS.items()) + ")")
def dimension_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Six summaries from one scan of the lines, in one long table."""
    out = None
    for k, table in sm.report_summaries(star_lines(spark, d)).items():
        named = table.select(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("key"), *[c for c in table.columns if c != k])
        out = named if out is None else out.unionByName(named)
    return rounded(out, 2)


@query("category_summary", f"SELECT category, {_DIM}")
def category_summary(spark: SparkSession, d: str) -> DataFrame:
    return sm.dimension_summary(star_lines(spark, d), category=F.col("category"))


@query("department_summary", f"SELECT department, {_DIM}")
def department_summary(spark: SparkSession, d: str) -> DataFrame:
    return sm.dimension_summary(star_lines(spark, d), department=F.col("department"))


@query("monthly_summary", f"SELECT strftime(transaction_day, '%Y-%m') AS month, {_DIM}")
def monthly_summary(spark: SparkSession, d: str) -> DataFrame:
    return sm.monthly_summary(star_lines(spark, d))


@query("weekday_summary", f"SELECT isodow(transaction_day)::INTEGER AS weekday, {_DIM}")
def weekday_summary(spark: SparkSession, d: str) -> DataFrame:
    return sm.weekday_summary(star_lines(spark, d))


@query(
    "transaction_summary",
    """SELECT customer_id, transaction_id, min(transaction_day) AS first_day, count(DISTINCT transaction_day) AS distinct_dates, count(*) AS line_items,
    coalesce(sum(line_revenue) FILTER (quantity > 0), 0)::DOUBLE AS gross_purchase_revenue, coalesce(sum(-line_revenue) FILTER (quantity < 0), 0)::DOUBLE AS return_value, sum(line_revenue)::DOUBLE AS net_revenue,
    coalesce(sum(quantity) FILTER (quantity > 0), 0)::DOUBLE AS units_purchased, count(DISTINCT product_id) AS distinct_products, count(DISTINCT customer_id) AS distinct_customers,
    coalesce(sum(quantity) FILTER (quantity > 0), 0) > 0 AS is_purchase_transaction FROM lines GROUP BY 1, 2""", dates=("first_day",))
def transaction_summary(spark: SparkSession, d: str) -> DataFrame:
    return sm.transaction_summary(star_lines(spark, d))


_WILSON = """SELECT product_id, repeat_buyers, observed_buyers, repeat_buyers::DOUBLE / observed_buyers AS p, 1.959963984540054::DOUBLE AS z, observed_buyers::DOUBLE AS n FROM (
    SELECT product_id, count(*) FILTER (n >= 2) AS repeat_buyers, count(*) AS observed_buyers FROM (
      SELECT product_id, customer_id, count(DISTINCT transaction_day) AS n FROM lines WHERE quantity > 0 GROUP BY ALL) GROUP BY 1)"""


@query(
    "product_repeat_behavior",
    f"""w AS ({_WILSON}) SELECT product_id, repeat_buyers, observed_buyers, round(p, 6) AS repeat_buyer_rate,
    round(greatest(0.0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS repeat_rate_ci95_lower,
    round(least(1.0, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS repeat_rate_ci95_upper,
    'customer-day trips' AS repeat_unit FROM w""",
)
def product_repeat_behavior(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sm.product_repeat_behavior(star_lines(spark, d)))


@query(
    "product_summary",
    f"""w AS ({_WILSON}), s AS (SELECT product_id, {_DIM}), m AS (
      SELECT product_id, count(DISTINCT product_description) AS description_variants, count(DISTINCT department) AS department_variants, count(DISTINCT category) AS category_variants,
        min(product_description) AS observed_description, min(department) AS observed_department, min(category) AS observed_category FROM lines GROUP BY 1)
    SELECT s.*, m.* EXCLUDE (product_id), greatest(description_variants, department_variants, category_variants) > 1 AS has_metadata_conflict, observed_buyers, repeat_buyers, round(p, 6) AS repeat_buyer_rate
    FROM s JOIN m USING (product_id) LEFT JOIN w USING (product_id)""",
)
def product_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sm.product_summary(star_lines(spark, d)))


@query(
    "product_variants",
    """m AS (SELECT product_id FROM lines GROUP BY 1 HAVING count(DISTINCT product_description) > 1 OR count(DISTINCT department) > 1 OR count(DISTINCT category) > 1)
    SELECT product_id, product_description, department, category, count(*) AS variant_line_items FROM lines WHERE product_id IN (FROM m) GROUP BY ALL""",
)
def product_variants(spark: SparkSession, d: str) -> DataFrame:
    return sm.product_variants(star_lines(spark, d))


_SPEND = "spend AS (SELECT customer_id, sum(trip_value)::DOUBLE AS gross_spend FROM trips GROUP BY 1)"


@query(
    "revenue_concentration",
    f"""{_SPEND}, r AS (SELECT gross_spend AS v, row_number() OVER (ORDER BY gross_spend, customer_id) AS up, count(*) OVER () AS n, sum(gross_spend) OVER () AS t FROM spend)
    SELECT n AS customers, round(any_value(t), 2) AS total_gross_spend, round(sum(v) FILTER (up > n - greatest(1, ceil(n * 0.01))) / any_value(t), 6) AS top_1pct_share, round(sum(v) FILTER (up > n - greatest(1, ceil(n * 0.05))) / any_value(t), 6) AS top_5pct_share,
      round(sum(v) FILTER (up > n - greatest(1, ceil(n * 0.1))) / any_value(t), 6) AS top_10pct_share, round(2 * sum(up * v) / (n * any_value(t)) - (n + 1.0) / n, 6) AS gini, round(sum((v / t) ** 2), 8) AS hhi FROM r GROUP BY n""",
)
def revenue_concentration(spark: SparkSession, d: str) -> DataFrame:
    out = sm.revenue_concentration(sm.customer_spend(ev.purchase_events(star_lines(spark, d))))
    return out.withColumns({"total_gross_spend": F.round("total_gross_spend", 2), "hhi": F.round("hhi", 8)} | {c: F.round(c, 6) for c in ("top_1pct_share", "top_5pct_share", "top_10pct_share", "gini")})


def _pareto_sql(key: str, source: str) -> str:
    return f"""p AS ({source}) SELECT {key}, v::DOUBLE AS revenue, rank::INTEGER AS rank, round(c, 6) AS cumulative_share FROM (
      SELECT {key}, v, row_number() OVER w AS rank, (sum(v) OVER (w ROWS UNBOUNDED PRECEDING))::DOUBLE / (sum(v) OVER ())::DOUBLE AS c FROM p WINDOW w AS (ORDER BY v DESC, {key})) WHERE rank <= 50"""


@query("pareto_products", _pareto_sql("product_id", "SELECT product_id, sum(line_revenue) AS v FROM lines GROUP BY 1"))
def pareto_products(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sm.pareto(star_lines(spark, d).groupBy("product_id").agg(F.sum("line_revenue").alias("revenue")), "product_id", "revenue"))


@query("pareto_customers", _pareto_sql("customer_id", "SELECT customer_id, sum(line_revenue) AS v FROM lines GROUP BY 1"))
def pareto_customers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sm.pareto(star_lines(spark, d).groupBy("customer_id").agg(F.sum("line_revenue").alias("revenue")), "customer_id", "revenue"))


@query(
    "lorenz_customers",
    """s AS (SELECT customer_id, sum(trip_value) AS v FROM trips GROUP BY 1)
    SELECT customer_id, v::DOUBLE AS gross_spend, round((row_number() OVER w)::DOUBLE / count(*) OVER (), 6) AS customer_share, round((sum(v) OVER (w ROWS UNBOUNDED PRECEDING))::DOUBLE / (sum(v) OVER ())::DOUBLE, 6) AS value_share FROM s WINDOW w AS (ORDER BY v, customer_id)""",
)
def lorenz_customers(spark: SparkSession, d: str) -> DataFrame:
    spend = ev.purchase_events(star_lines(spark, d)).groupBy("customer_id").agg(F.sum("trip_value").alias("gross_spend"))
    return rounded(sm.lorenz(spend, "customer_id", "gross_spend"))


# -- events


@query("trips_day", "SELECT customer_id, transaction_day, trip_value::DOUBLE AS trip_value, n_lines, n_products, n_units FROM trips", dates=("transaction_day",))
def trips_day(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.purchase_events(star_lines(spark, d)))


@query(
    "trips_transaction",
    """SELECT customer_id, transaction_id, sum(greatest(line_revenue, 0))::DOUBLE AS trip_value, count(*) AS n_lines, count(DISTINCT product_id) AS n_products, sum(quantity) AS n_units, min(transaction_day) AS transaction_day
    FROM lines WHERE quantity > 0 GROUP BY 1, 2 HAVING sum(greatest(line_revenue, 0)) > 0""", dates=("transaction_day",))
def trips_transaction(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.purchase_events(star_lines(spark, d), grain=ev.TRANSACTION))


@query("event_grain_check", "SELECT count(*) AS events, 0::BIGINT AS repeated_keys, min(transaction_day) AS first_day, max(transaction_day) AS last_day FROM trips", dates=("first_day", "last_day",))
def event_grain_check(spark: SparkSession, d: str) -> DataFrame:
    return ev.event_grain_check(ev.purchase_events(star_lines(spark, d)))


@query("baskets_category", "SELECT customer_id, transaction_day::VARCHAR AS basket_key, array_to_string(list_sort(list(DISTINCT category)), '|') AS items FROM lines WHERE quantity > 0 GROUP BY 1, 2")
def baskets_category(spark: SparkSession, d: str) -> DataFrame:
    return ev.baskets(star_lines(spark, d)).withColumn("items", F.array_join("items", "|"))


@query("baskets_transaction_only", "SELECT min(customer_id) AS customer_id, transaction_id AS basket_key, array_to_string(list_sort(list(DISTINCT category)), '|') AS items FROM lines WHERE quantity > 0 GROUP BY 2")
def baskets_transaction_only(spark: SparkSession, d: str) -> DataFrame:
    return ev.baskets(star_lines(spark, d), grain=ev.TRANSACTION, key_mode="transaction-only").withColumn("items", F.array_join("items", "|"))


_ASOF = """r AS (SELECT * FROM lines WHERE quantity < 0), b AS (SELECT DISTINCT customer_id, product_id, transaction_date AS t FROM lines WHERE quantity > 0),
  m AS (SELECT r.*, b.t AS purchase_time FROM r ASOF LEFT JOIN b ON r.customer_id = b.customer_id AND r.product_id = b.product_id AND r.transaction_date >= b.t)"""


@query("returns_asof", f"{_ASOF} SELECT customer_id, product_id, transaction_id, transaction_day, quantity, line_revenue::DOUBLE AS line_revenue, purchase_time, purchase_time IS NOT NULL AS matched FROM m", dates=("transaction_day", "purchase_time",))
def returns_asof(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.match_returns(star_lines(spark, d)).select("customer_id", "product_id", "transaction_id", "transaction_day", "quantity", "line_revenue", "purchase_time", "matched"))


@query(
    "returns_info",
    f"""{_ASOF} SELECT count(*) AS return_lines, count(*) FILTER (purchase_time IS NOT NULL) AS matched_lines, sum(-line_revenue)::DOUBLE AS return_value, coalesce(sum(-line_revenue) FILTER (purchase_time IS NOT NULL), 0)::DOUBLE AS matched_value,
    round(coalesce(sum(-line_revenue) FILTER (purchase_time IS NOT NULL), 0)::DOUBLE / sum(-line_revenue)::DOUBLE, 6) AS matched_value_share, 'calendar_day' AS precision FROM m""",
)
def returns_info(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.returns_info(ev.match_returns(star_lines(spark, d))))


_REF = "ref AS (SELECT product_id, quantile_cont(price, 0.5) AS reference_price, count(*) AS n, count(DISTINCT price) AS k FROM lines WHERE quantity > 0 AND price > 0 GROUP BY 1 HAVING count(*) >= 5)"


@query(
    "price_index_lines",
    f"""{_REF} SELECT customer_id, product_id, transaction_id, price, round(reference_price, 6) AS reference_price, round(price / reference_price, 6) AS price_index, coalesce(price / reference_price <= 0.9, false) AS promo_like
    FROM lines LEFT JOIN ref USING (product_id) WHERE quantity > 0 AND price > 0""",
)
def price_index_lines(spark: SparkSession, d: str) -> DataFrame:
    out = ev.price_index(star_lines(spark, d))
    return out.select("customer_id", "product_id", "transaction_id", "price", F.round("reference_price", 6).alias("reference_price"), F.round("price_index", 6).alias("price_index"), "promo_like")


@query("price_index_info", f"{_REF} SELECT count(*) AS eligible_products, count(*) FILTER (k > 1) AS varying_products, round(count(*) FILTER (k > 1) / count(*), 6) AS varying_share, count(*) FILTER (k > 1) / count(*) >= 0.05 AS usable FROM ref")
def price_index_info(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.price_index_info(star_lines(spark, d)))


# -- customer features

CORE_SQL = """g AS (SELECT *, date_diff('day', lag(transaction_day) OVER (PARTITION BY customer_id ORDER BY transaction_day), transaction_day) AS gap FROM trips),
c AS (SELECT customer_id, count(*) AS n_trips, min(transaction_day) AS first_day, max(transaction_day) AS last_day, sum(trip_value)::DOUBLE AS gross_spend, sum(trip_value)::DOUBLE / count(*) AS mean_trip_value,
  avg(n_products) AS mean_products_per_trip, quantile_cont(n_products, 0.5) AS median_products_per_trip, quantile_cont(gap, 0.5) AS median_gap, avg(gap) AS mean_gap, stddev_samp(gap) AS std_gap, count(gap) AS n_gaps FROM g GROUP BY 1),
core AS (SELECT c.*, n_trips - 1 AS x, date_diff('day', first_day, last_day) AS t_x, date_diff('day', first_day, d) AS "T", date_diff('day', last_day, d) AS recency_days,
  CASE WHEN mean_gap > 0 THEN std_gap / mean_gap END AS interpurchase_cv, CASE WHEN median_gap > 0 THEN greatest(30.0, 2 * median_gap) ELSE 90.0 END AS heuristic_threshold_days,
  date_diff('day', last_day, d) > CASE WHEN median_gap > 0 THEN greatest(30.0, 2 * median_gap) ELSE 90.0 END AS inactive_by_heuristic,
  (n_gaps * coalesce(CASE WHEN n_gaps >= 3 AND std_gap > 0 THEN (mean_gap / std_gap) ** 2 END, 1.0) + 3) / (n_gaps + 3) AS regularity_shape_shrunk FROM c, cutoff)"""
_CORE = ["customer_id", "n_trips", "first_day", "last_day", "gross_spend", "mean_trip_value", "median_gap", "mean_gap", "std_gap", "n_gaps", "x", "t_x", "T", "recency_days", "interpurchase_cv", "heuristic_threshold_days", "inactive_by_heuristic", "regularity_shape_shrunk"]
_ROUNDED = {"gross_spend": 2, "median_gap": 4, "mean_gap": 4, "std_gap": 4, "interpurchase_cv": 4, "heuristic_threshold_days": 4, "regularity_shape_shrunk": 4}


def core(lines: DataFrame) -> tuple[DataFrame, object]:
    as_of = ev.latest_day(lines)
    return ft.customer_core(ev.purchase_events(lines, as_of), as_of), as_of


@query("customer_core", CORE_SQL + " SELECT " + ", ".join(f'round({c}, {_ROUNDED[c]})::DOUBLE AS {c}' if c in _ROUNDED else f'"{c}"' for c in _CORE) + " FROM core", dates=("first_day", "last_day",))
def customer_core(spark: SparkSession, d: str) -> DataFrame:
    out, _ = core(star_lines(spark, d))
    return out.select(*[F.round(c, _ROUNDED[c]).alias(c) if c in _ROUNDED else F.col(c) for c in _CORE])


@query("interpurchase_intervals", "SELECT customer_id, transaction_day, date_diff('day', lag(transaction_day) OVER (PARTITION BY customer_id ORDER BY transaction_day), transaction_day)::DOUBLE AS interpurchase_interval_days FROM trips", dates=("transaction_day",))
def interpurchase_intervals(spark: SparkSession, d: str) -> DataFrame:
    out = ft.interpurchase_intervals(ev.purchase_events(star_lines(spark, d)))
    return out.withColumn("interpurchase_interval_days", F.col("interpurchase_interval_days").cast("double"))


def _win(w: int) -> str:
    return f"""coalesce(sum(line_revenue) FILTER (quantity > 0 AND transaction_day BETWEEN d - {w - 1} AND d), 0)::DOUBLE AS gross_spend_{w}d,
    coalesce(sum(-line_revenue) FILTER (quantity < 0 AND transaction_day BETWEEN d - {w - 1} AND d), 0)::DOUBLE AS return_value_{w}d"""


WINDOW_SQL = f"""ws AS (SELECT customer_id, {_win(30)}, {_win(90)}, {_win(365)},
   coalesce(sum(line_revenue) FILTER (quantity > 0 AND transaction_day BETWEEN d - 89 AND d), 0)::DOUBLE AS recent_spend, coalesce(sum(line_revenue) FILTER (quantity > 0 AND transaction_day BETWEEN d - 179 AND d - 90), 0)::DOUBLE AS prior_spend
   FROM lines, cutoff WHERE transaction_day <= d GROUP BY 1 HAVING count(*) FILTER (quantity > 0) > 0),
 wt AS (SELECT customer_id, count(*) FILTER (transaction_day BETWEEN d - 29 AND d) AS n_trips_30d, count(*) FILTER (transaction_day BETWEEN d - 89 AND d) AS n_trips_90d, count(*) FILTER (transaction_day BETWEEN d - 364 AND d) AS n_trips_365d,
   count(*) FILTER (transaction_day BETWEEN d - 89 AND d) AS recent_trips, count(*) FILTER (transaction_day BETWEEN d - 179 AND d - 90) AS prior_trips FROM trips, cutoff GROUP BY 1),
 win AS (SELECT ws.*, coalesce(n_trips_30d, 0) AS n_trips_30d, coalesce(n_trips_90d, 0) AS n_trips_90d, coalesce(n_trips_365d, 0) AS n_trips_365d, coalesce(recent_trips, 0) AS recent_trips, coalesce(prior_trips, 0) AS prior_trips,
   round(gross_spend_30d - return_value_30d, 2) AS net_revenue_30d, round(gross_spend_90d - return_value_90d, 2) AS net_revenue_90d, round(gross_spend_365d - return_value_365d, 2) AS net_revenue_365d,
   round(CASE WHEN prior_spend > 0 THEN (recent_spend - prior_spend) / prior_spend * 100 END, 4) AS spend_change_pct, round(CASE WHEN prior_trips > 0 THEN (recent_trips - prior_trips) / prior_trips * 100 END, 4) AS trip_change_pct FROM ws LEFT JOIN wt USING (customer_id))"""


@query("window_features", WINDOW_SQL + " SELECT * FROM win")
def window_features(spark: SparkSession, d: str) -> DataFrame:
    lines = star_lines(spark, d)
    as_of = ev.latest_day(lines)
    out = ft.window_features(lines, ev.purchase_events(lines, as_of), as_of)
    return out.withColumns({c: F.round(c, 2) + 0.0 for c in out.columns if c.startswith("net_revenue")} | {c: F.round(c, 4) for c in ("spend_change_pct", "trip_change_pct")})


def _top_sql(by: str) -> str:
    return f"""{by}_v AS (SELECT customer_id, {by}, sum(greatest(line_revenue, 0)) AS v FROM lines WHERE quantity > 0 GROUP BY ALL),
    {by}_t AS (SELECT customer_id, count(*) AS distinct_{by}, (array_agg({by} ORDER BY v DESC, {by}))[1] AS top_{by}, round(sum((v::DOUBLE / t::DOUBLE) ** 2), 6) AS {by}_hhi FROM (SELECT *, sum(v) OVER (PARTITION BY customer_id) AS t FROM {by}_v) GROUP BY 1)"""


BREADTH_SQL = f"{_top_sql('category')}, {_top_sql('department')}, p AS (SELECT customer_id, count(DISTINCT product_id) AS distinct_products FROM lines WHERE quantity > 0 GROUP BY 1), breadth AS (SELECT * FROM p LEFT JOIN category_t USING (customer_id) LEFT JOIN department_t USING (customer_id))"


@query("breadth_features", BREADTH_SQL + " SELECT * FROM breadth")
def breadth_features(spark: SparkSession, d: str) -> DataFrame:
    lines = star_lines(spark, d)
    return rounded(ft.breadth_features(lines, ev.latest_day(lines)))


PROMO_SQL = """pref AS (SELECT product_id, quantile_cont(price, 0.5) AS ref FROM lines WHERE quantity > 0 AND price > 0 GROUP BY 1),
 pl AS (SELECT customer_id, line_revenue, price / ref AS idx FROM lines JOIN pref USING (product_id) WHERE quantity > 0 AND price > 0),
 promo AS (SELECT customer_id, round(coalesce(sum(line_revenue) FILTER (idx <= 0.9), 0)::DOUBLE / sum(line_revenue)::DOUBLE, 4) AS promo_spend_share, round(sum(idx * line_revenue::DOUBLE) / sum(line_revenue)::DOUBLE, 4) AS mean_price_index, round(quantile_cont(idx, 0.5), 4) AS median_price_index FROM pl GROUP BY 1)"""


@query("promo_features", PROMO_SQL + " SELECT * FROM promo")
def promo_features(spark: SparkSession, d: str) -> DataFrame:
    lines = star_lines(spark, d)
    return rounded(ft.promo_features(lines, ev.latest_day(lines)), 4)


@query(
    "gated_promo_features",
    f"""{_REF}, u AS (SELECT count(*) FILTER (k > 1) / count(*) >= 0.05 AS usable FROM ref),
    pl AS (SELECT customer_id, line_revenue, price / reference_price AS idx FROM lines JOIN ref USING (product_id) WHERE quantity > 0 AND price > 0),
    promo AS (SELECT customer_id, coalesce(sum(line_revenue) FILTER (idx <= 0.9), 0)::DOUBLE / sum(line_revenue)::DOUBLE AS share, sum(idx * line_revenue::DOUBLE) / sum(line_revenue)::DOUBLE AS mean FROM pl GROUP BY 1)
    SELECT customer_id, CASE WHEN usable THEN round(share, 4) END AS promo_spend_share, CASE WHEN usable THEN round(mean, 4) END AS mean_price_index
    FROM (SELECT DISTINCT customer_id FROM lines WHERE quantity > 0 AND customer_id IS NOT NULL) LEFT JOIN promo USING (customer_id) CROSS JOIN u""",
)
def gated_promo_features(spark: SparkSession, d: str) -> DataFrame:
    lines = star_lines(spark, d)
    return rounded(ft.gated_promo_features(lines, ev.latest_day(lines)), 4)


RETURN_SQL = _ASOF + """, ret AS (SELECT customer_id, count(*) AS return_lines, sum(-line_revenue)::DOUBLE AS return_value, coalesce(sum(-line_revenue) FILTER (purchase_time IS NOT NULL), 0)::DOUBLE AS matched_return_value,
 coalesce(sum(-line_revenue) FILTER (purchase_time IS NULL), 0)::DOUBLE AS unmatched_return_value FROM m GROUP BY 1)"""


@query("return_features", RETURN_SQL + " SELECT * FROM ret")
def return_features(spark: SparkSession, d: str) -> DataFrame:
    lines = star_lines(spark, d)
    return ft.return_features(lines, ev.latest_day(lines))


SHARE_SQL = """cs AS (SELECT customer_id, category, v::DOUBLE / (sum(v) OVER (PARTITION BY customer_id))::DOUBLE AS share FROM (SELECT customer_id, category, sum(greatest(line_revenue, 0)) AS v FROM lines WHERE quantity > 0 GROUP BY ALL)),
 ce AS (SELECT customer_id, (array_agg(category ORDER BY share DESC, category))[1] AS top_category_by_share, round(-sum(share * ln(share + 1e-10)), 6) AS category_entropy FROM cs GROUP BY 1)"""


@query("category_shares", SHARE_SQL + " SELECT customer_id, category, round(share, 6) AS share FROM cs")
def category_shares(spark: SparkSession, d: str) -> DataFrame:
    lines = star_lines(spark, d)
    return rounded(ft.category_shares(lines, ev.latest_day(lines)))


@query("category_affinity", SHARE_SQL + " SELECT customer_id, top_category_by_share, category_entropy FROM ce")
def category_affinity(spark: SparkSession, d: str) -> DataFrame:
    lines = star_lines(spark, d)
    return rounded(ft.category_entropy(ft.category_shares(lines, ev.latest_day(lines))))


@query("category_share_pivot", SHARE_SQL + ", wide AS (PIVOT (SELECT customer_id, 'category_' || category || '_spend_share' AS k, round(share, 6) AS share FROM cs) ON k IN ('category_ECONOMY_spend_share', 'category_LARGE_spend_share', 'category_MEDIUM_spend_share', 'category_PROMO_spend_share', 'category_SMALL_spend_share', 'category_STANDARD_spend_share') USING coalesce(sum(share), 0.0) GROUP BY customer_id) SELECT * FROM wide")
def category_share_pivot(spark: SparkSession, d: str) -> DataFrame:
    lines = star_lines(spark, d)
    wide = ft.category_affinity(ft.category_shares(lines, ev.latest_day(lines)), ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"])
    return rounded(wide.drop("top_category_by_share", "category_entropy"))


TREND_SQL = """mi AS (SELECT customer_id, 12 - ((year(d) * 12 + month(d)) - (year(transaction_day) * 12 + month(transaction_day))) AS i, sum(line_revenue)::DOUBLE AS v FROM lines, cutoff WHERE quantity > 0 GROUP BY ALL),
 grid AS (SELECT c.customer_id, g.i, coalesce(mi.v, 0.0) AS v FROM (SELECT DISTINCT customer_id FROM mi) c CROSS JOIN (SELECT unnest(range(13)) AS i) g LEFT JOIN mi ON mi.customer_id = c.customer_id AND mi.i = g.i),
 tr AS (SELECT customer_id, count(*) FILTER (v > 0) AS a, regr_slope(ln(1 + v), i) AS s, stddev_pop(v) AS sd, avg(v) AS m FROM grid GROUP BY 1),
 trend AS (SELECT customer_id, round(CASE WHEN a >= 3 THEN s END, 6) + 0.0 AS revenue_trend_slope, round(CASE WHEN a >= 3 AND m > 0 THEN sd / m END, 6) AS revenue_cv, round(a / 13.0::DOUBLE, 6) AS active_months_fraction FROM tr)"""


@query("trend_features", TREND_SQL + " SELECT * FROM trend")
def trend_features(spark: SparkSession, d: str) -> DataFrame:
    lines = star_lines(spark, d)
    return rounded(ft.trend_features(lines, ev.latest_day(lines)))


COMPOSITION_SQL = """dy AS (SELECT customer_id, transaction_day, count(DISTINCT product_id) AS p, count(DISTINCT category) AS c, sum(quantity) AS u, sum(line_revenue)::DOUBLE AS v FROM lines WHERE quantity > 0 GROUP BY 1, 2),
 comp AS (SELECT customer_id, round(avg(p), 6) AS mean_products_per_day, round(avg(c), 6) AS mean_categories_per_day, round(avg(u), 6) AS mean_units_per_day, round(CASE WHEN avg(v) > 0 THEN stddev_samp(v) / avg(v) END, 6) AS day_revenue_cv FROM dy GROUP BY 1)"""


@query("basket_composition", COMPOSITION_SQL + " SELECT * FROM comp")
def basket_composition(spark: SparkSession, d: str) -> DataFrame:
    lines = star_lines(spark, d)
    return rounded(ft.basket_composition(lines, ev.latest_day(lines)))


SNAP_SQL = f"""{CORE_SQL}, {RETURN_SQL}, net AS (SELECT core.*, coalesce(return_value, 0) AS return_value, greatest(gross_spend - coalesce(return_value, 0), 0) AS net_spend, least(coalesce(return_value, 0) / gross_spend, 1) AS return_value_ratio FROM core LEFT JOIN ret USING (customer_id))"""


@query(
    "customer_snapshot",
    f"""{SNAP_SQL}, {WINDOW_SQL}, {BREADTH_SQL}, {PROMO_SQL}, {SHARE_SQL}, {TREND_SQL}, {COMPOSITION_SQL}
    SELECT n.customer_id, n.n_trips, n.recency_days, round(n.gross_spend, 2) AS gross_spend, round(n.net_spend, 2) AS net_spend, round(n.return_value_ratio, 4) AS return_value_ratio, strftime(n.first_day, '%Y-%m') AS observed_first_purchase_cohort_month,
      win.gross_spend_90d, win.n_trips_365d, breadth.top_category, breadth.distinct_products, promo.promo_spend_share, ce.category_entropy, trend.active_months_fraction, comp.mean_products_per_day
    FROM net n LEFT JOIN win USING (customer_id) LEFT JOIN breadth USING (customer_id) LEFT JOIN promo USING (customer_id) LEFT JOIN ce USING (customer_id) LEFT JOIN trend USING (customer_id) LEFT JOIN comp USING (customer_id)""",
)
def customer_snapshot(spark: SparkSession, d: str) -> DataFrame:
    lines = settled(star_lines(spark, d).select(*ft.NEEDED), "lines")
    out = ft.customer_snapshot(lines, ev.latest_day(lines)).select(
        "customer_id", "n_trips", "recency_days", "gross_spend", "net_spend", F.round("return_value_ratio", 4).alias("return_value_ratio"), "observed_first_purchase_cohort_month",
        "gross_spend_90d", "n_trips_365d", "top_category", "distinct_products", F.round("promo_spend_share", 4).alias("promo_spend_share"), "category_entropy", "active_months_fraction", "mean_products_per_day",
    )
    return rounded(out).withColumns({c: F.round(c, 2) for c in ("gross_spend", "net_spend")})


# -- scores

RFM_SQL = f"""{SNAP_SQL}, e AS (SELECT list_distinct(quantile_cont(recency_days, [0.2, 0.4, 0.6, 0.8])) AS r, list_distinct(quantile_cont(n_trips, [0.2, 0.4, 0.6, 0.8])) AS f, list_distinct(quantile_cont(net_spend, [0.2, 0.4, 0.6, 0.8])) AS m FROM net),
 s AS (SELECT net.*, CASE WHEN len(r) = 0 THEN 3 ELSE 6 - round_even(1 + len(list_filter(r, lambda q: q < recency_days)) * 4.0 / len(r), 0) END::INTEGER AS r_score,
   CASE WHEN len(f) = 0 THEN 3 ELSE round_even(1 + len(list_filter(f, lambda q: q < n_trips)) * 4.0 / len(f), 0) END::INTEGER AS f_score,
   CASE WHEN len(m) = 0 THEN 3 ELSE round_even(1 + len(list_filter(m, lambda q: q < net_spend)) * 4.0 / len(m), 0) END::INTEGER AS m_score FROM net, e),
 rfm AS (SELECT *, r_score::VARCHAR || f_score || m_score AS rfm_score, CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions' WHEN r_score >= 3 AND f_score >= 4 THEN 'Frequent / loyal'
   WHEN r_score <= 2 AND f_score >= 4 AND m_score >= 4 THEN 'Previously high-value / lapsed' WHEN r_score <= 2 AND f_score >= 3 THEN 'At risk by recency' WHEN r_score >= 4 AND f_score <= 2 THEN 'Recent / low frequency'
   WHEN r_score <= 2 AND f_score <= 2 THEN 'Hibernating / low frequency' WHEN r_score >= 3 AND f_score >= 3 THEN 'Potential loyalists' ELSE 'Mixed / needs attention' END AS rfm_segment FROM s)"""


def scored(lines: DataFrame) -> DataFrame:
    out, as_of = core(lines)
    back = ft.return_features(lines, as_of).select("customer_id", "return_value")
    out = out.join(back, "customer_id", "left").fillna(0.0, ["return_value"])
    return sc.rfm_scores(out.withColumn("net_spend", F.greatest(F.col("gross_spend") - F.col("return_value"), F.lit(0.0))))


@query("rfm_scores", RFM_SQL + " SELECT customer_id, recency_days, n_trips, round(net_spend, 2) AS net_spend, r_score, f_score, m_score, rfm_score, rfm_segment FROM rfm")
def rfm_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored(star_lines(spark, d)).select("customer_id", "recency_days", "n_trips", F.round("net_spend", 2).alias("net_spend"), "r_score", "f_score", "m_score", "rfm_score", "rfm_segment")


@query(
    "rfm_segment_profile",
    f"""{RFM_SQL} SELECT rfm_segment, count(*) AS customers, quantile_cont(recency_days, 0.5) AS median_recency_days, quantile_cont(n_trips, 0.5) AS median_n_trips, round(quantile_cont(net_spend, 0.5), 4) AS median_net_spend,
    round(sum(net_spend), 2) AS total_net_spend, round(avg((n_trips > 1)::INTEGER), 6) AS repeat_rate, round(avg(mean_trip_value), 4) AS avg_trip_value FROM rfm GROUP BY 1""",
)
def rfm_segment_profile(spark: SparkSession, d: str) -> DataFrame:
    out = sc.segment_profile(scored(star_lines(spark, d)), "rfm_segment")
    return out.withColumns({"median_net_spend": F.round("median_net_spend", 4), "total_net_spend": F.round("total_net_spend", 2), "repeat_rate": F.round("repeat_rate", 6), "avg_trip_value": F.round("avg_trip_value", 4)})


def _app_bin(v: str, k: str) -> str:
    return f"(SELECT list_distinct(quantile_cont(rk_{v}, list_transform(range(0, q_{v} + 1), lambda i: i / q_{v}::DOUBLE)))  FROM ranked) AS {k}"


_APP_SQL = """a AS (SELECT customer_id, date_diff('day', max(transaction_day), any_value(d)) AS recency, count(DISTINCT transaction_id) AS frequency, sum(line_revenue)::DOUBLE AS monetary FROM lines, cutoff GROUP BY 1),
 ar AS (SELECT *, (rank() OVER (ORDER BY recency)) + (count(*) OVER (PARTITION BY recency) - 1) / 2.0::DOUBLE AS kr, (rank() OVER (ORDER BY frequency)) + (count(*) OVER (PARTITION BY frequency) - 1) / 2.0::DOUBLE AS kf, (rank() OVER (ORDER BY monetary)) + (count(*) OVER (PARTITION BY monetary) - 1) / 2.0::DOUBLE AS km FROM a),
 ed AS (SELECT list_sort(list_distinct(quantile_cont(kr, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS er, list_sort(list_distinct(quantile_cont(kf, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS ef, list_sort(list_distinct(quantile_cont(km, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS em FROM ar),
 asx AS (SELECT ar.*, (len(er) - 1 - len(list_filter(er[2:len(er) - 1], lambda q: kr > q)))::INTEGER AS r_score, (1 + len(list_filter(ef[2:len(ef) - 1], lambda q: kf > q)))::INTEGER AS f_score, (1 + len(list_filter(em[2:len(em) - 1], lambda q: km > q)))::INTEGER AS m_score FROM ar, ed)
 SELECT customer_id, recency::INTEGER AS recency, frequency, monetary, r_score, f_score, m_score, r_score::VARCHAR || f_score || m_score AS rfm_score,
  CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions' WHEN r_score >= 3 AND f_score >= 4 AND m_score >= 3 THEN 'Loyal Customers' WHEN r_score >= 4 AND f_score <= 2 THEN 'New Customers' WHEN r_score >= 3 AND f_score >= 3 THEN 'Potential Loyalists'
   WHEN r_score <= 2 AND f_score >= 3 AND m_score >= 3 THEN 'At Risk High Value' WHEN r_score <= 2 AND f_score >= 2 THEN 'At Risk' WHEN r_score <= 2 AND f_score <= 2 AND m_score <= 2 THEN 'Hibernating' ELSE 'Needs Attention' END AS segment FROM asx"""


@query("rfm_app", _APP_SQL)
def rfm_app(spark: SparkSession, d: str) -> DataFrame:
    lines = star_lines(spark, d)
    return sc.rfm_app(lines, ev.latest_day(lines))


@query(
    "value_tiers",
    """v AS (SELECT customer_id, sum(line_revenue) AS revenue FROM lines GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY revenue DESC, customer_id) - 1 AS i, count(*) OVER () AS n FROM v)
    SELECT customer_id, revenue::DOUBLE AS revenue, CASE WHEN i < floor(n * 1 / 100) THEN 'Top 1%' WHEN i < floor(n * 5 / 100) THEN 'Top 1-5%' WHEN i < floor(n * 10 / 100) THEN 'Top 5-10%' WHEN i < floor(n * 20 / 100) THEN 'Top 10-20%' WHEN i < floor(n * 70 / 100) THEN 'Middle 50%' ELSE 'Bottom 30%' END AS value_tier FROM o""",
)
def value_tiers(spark: SparkSession, d: str) -> DataFrame:
    revenue = star_lines(spark, d).groupBy("customer_id").agg(F.sum("line_revenue").alias("revenue"))
    return rounded(sc.value_tiers(revenue, "customer_id", "revenue"))


@query("lifecycle", "SELECT customer_id, min(transaction_day) AS first_day, max(transaction_day) AS last_day, CASE WHEN min(transaction_day) >= any_value(d) - 90 THEN 'New' WHEN max(transaction_day) < any_value(d) - 90 THEN 'Dormant' ELSE 'Active' END AS lifecycle FROM trips, cutoff GROUP BY 1", dates=("first_day", "last_day",))
def lifecycle(spark: SparkSession, d: str) -> DataFrame:
    lines = star_lines(spark, d)
    as_of = ev.latest_day(lines)
    rows = ev.purchase_events(lines, as_of).groupBy("customer_id").agg(F.min("transaction_day").alias("first_day"), F.max("transaction_day").alias("last_day"))
    return rows.withColumn("lifecycle", sc.lifecycle(F.col("first_day"), F.col("last_day"), as_of))


@query("lorenz_segments", f"""{RFM_SQL}, o AS (SELECT rfm_segment, net_spend AS v, row_number() OVER (PARTITION BY rfm_segment ORDER BY net_spend) AS i FROM rfm), t AS (SELECT rfm_segment, count(*) AS n, sum(i * v) AS w, sum(v) AS t FROM o GROUP BY 1) SELECT rfm_segment, n, round(2 * w / (n * t) - (n + 1.0) / n, 6) AS gini FROM t WHERE n > 10 AND t > 0""")
def lorenz_segments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sm.lorenz_gini(scored(star_lines(spark, d)), "net_spend", ["rfm_segment"]))


@query("segment_modes", f"{RFM_SQL}, {_top_sql('category')}, j AS (SELECT rfm_segment, top_category, count(*) AS n FROM rfm JOIN category_t USING (customer_id) GROUP BY ALL) SELECT rfm_segment, (array_agg(top_category ORDER BY n DESC, top_category))[1] AS modal_category FROM j GROUP BY 1")
def segment_modes(spark: SparkSession, d: str) -> DataFrame:
    from ledgerline.functions.semantics import most_frequent

    lines = star_lines(spark, d)
    top = ft.top_component(ev.purchases(lines), "category")
    return most_frequent(scored(lines).join(top, "customer_id"), ["rfm_segment"], "top_category", "modal_category")
