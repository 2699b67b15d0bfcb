"""Period analytics: contexts, KPIs and their drivers, products, categories, retention and anomalies."""

from __future__ import annotations

import calendar
import datetime as dt
import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.ranking import numbered, value_ranks
from ledgerline.functions.quantiles import quantile_table
from ledgerline.functions.semantics import ratio
from ledgerline.storage import settled

LOG = logging.getLogger(__name__)

@dataclass(frozen=True)
class Period:
    """A period and the one it is compared with, all days inclusive."""

    start: dt.date
    end: dt.date
    prior_start: dt.date
    prior_end: dt.date
    mode: str = "prior"

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1


def _year_before(day: dt.date) -> dt.date:
    return day.replace(year=day.year - 1, day=min(day.day, calendar.monthrange(day.year - 1, day.month)[1]))


def period(start: dt.date, end: dt.date, mode: str = "prior", custom: tuple[dt.date, dt.date] | None = None) -> Period:
    """Compare with the equally long period before (prior), the same days a year earlier (yoy), or given days (custom)."""
    if start > end:
        raise ValueError("a period must not end before it starts")
    if mode == "prior":
        last = start - dt.timedelta(days=1)
        return Period(start, end, last - (end - start), last, mode)
    if mode == "yoy":
        return Period(start, end, _year_before(start), _year_before(end), mode)
    if mode == "custom" and custom:
        return Period(start, end, *custom, mode)
    raise ValueError(f"unknown comparison {mode!r}")


def preset(name: str, last: dt.date) -> tuple[dt.date, dt.date]:
    """last_7, last_28, last_90, month_to_date or quarter_to_date, up to ``last``."""
    if name.startswith("last_"):
        return last - dt.timedelta(days=int(name[5:]) - 1), last
    if name == "month_to_date":
        return last.replace(day=1), last
    if name == "quarter_to_date":
        return last.replace(month=(last.month - 1) // 3 * 3 + 1, day=1), last
    raise ValueError(f"unknown preset {name!r}")


def valid_range(start: dt.date, end: dt.date, first: dt.date, last: dt.date) -> bool:
    """Whether the days from start to end are in order and within the data's first and last day."""
    return first <= start <= end <= last


def not_empty(df: DataFrame | None, what: str = "") -> bool:
    """Whether there are rows to work on; ``what`` names the table in a warning where there are none."""
    found = df is not None and not df.isEmpty()
    if not found and what:
        LOG.warning("no rows for %s", what)
    return found


def within(start: dt.date, end: dt.date) -> Column:
    return F.col("transaction_day").between(F.lit(start), F.lit(end))


def in_period(lines: DataFrame, start: dt.date, end: dt.date, include_returns: bool = True) -> DataFrame:
    rows = lines.filter(within(start, end))
    return rows if include_returns else rows.filter("quantity > 0")


_KPIS = ["revenue", "orders", "customers", "units", "aov", "units_per_order", "price_per_unit", "revenue_per_customer", "orders_per_customer"]


def period_kpis(lines: DataFrame, p: Period) -> DataFrame:
    """Nine KPIs of both periods from one pass; ratios are 0 where there is nothing to divide by."""
    which = F.when(within(p.start, p.end), "current").when(within(p.prior_start, p.prior_end), "prior").alias("period")
    rows = lines.filter(within(p.start, p.end) | within(p.prior_start, p.prior_end))
    out = rows.groupBy(which).agg(F.coalesce(F.sum("line_revenue").cast("double"), F.lit(0.0)).alias("revenue"), F.countDistinct("transaction_id").alias("orders"), F.countDistinct("customer_id").alias("customers"), F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("units"))
    share = lambda a, b: F.coalesce(ratio(F.col(a), F.col(b)), F.lit(0.0))
    return out.withColumns({"aov": share("revenue", "orders"), "units_per_order": share("units", "orders"), "price_per_unit": share("revenue", "units"), "revenue_per_customer": share("revenue", "customers"), "orders_per_customer": share("orders", "customers")})


def _side_by_side(kpis: DataFrame) -> DataFrame:
    """One row: each KPI of both periods, 0 where a period has no lines."""
    value = lambda k, p: F.coalesce(F.max(F.when(F.col("period") == p, F.col(k).cast("double"))), F.lit(0.0)).alias(f"{p}_{k}")
    return kpis.agg(*[value(k, p) for k in _KPIS for p in ("current", "prior")])


def kpi_delta(kpis: DataFrame, flat: float = 0.0) -> DataFrame:
    """kpi, current, prior, change, pct_change, trend; against a prior of 0 the trend is neutral."""
    wide = _side_by_side(kpis)
    rows = wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(f"current_{k}").alias("current"), F.col(f"prior_{k}").alias("prior")) for k in _KPIS])))
    change = F.col("current") - F.col("prior")
    pct = F.when(F.col("prior") == 0, 0.0).otherwise(F.try_divide(change, F.col("prior")) * 100)
    rows = rows.withColumns({"change": F.when(F.col("prior") == 0, F.col("current")).otherwise(change), "pct_change": pct})
    trend = F.when((F.col("prior") == 0) | (F.abs("pct_change") <= flat), "neutral").when(F.col("pct_change") > 0, "up").otherwise("down")
    return rows.withColumn("trend", trend)


def revenue_drivers(kpis: DataFrame) -> DataFrame:
    """The revenue change as effects of customers, frequency, units an order and price, in that order, and the largest."""
    w = _side_by_side(kpis)
    c0, c1, f0, f1 = (F.col(f"{p}_{k}") for k in ("customers", "orders_per_customer") for p in ("prior", "current"))
    u0, u1, p0, p1 = (F.col(f"{p}_{k}") for k in ("units_per_order", "price_per_unit") for p in ("prior", "current"))
    effects = {"customer_effect": (c1 - c0) * f0 * F.col("prior_aov"), "frequency_effect": c1 * (f1 - f0) * F.col("prior_aov"), "units_effect": c1 * f1 * (u1 - u0) * p0, "price_effect": c1 * f1 * u1 * (p1 - p0)}
    out = w.select(F.col("prior_revenue"), F.col("current_revenue"), *[e.alias(n) for n, e in effects.items()])
    order = F.array_sort(F.array(*[F.struct((-F.abs(n)).alias("a"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in enumerate(effects)]))
    return out.withColumn("primary_driver", order[0]["n"])


def _compared(lines: DataFrame, p: Period, key: str) -> tuple[DataFrame, DataFrame]:
    """Measures of a key in the current period, and its prior ones."""
    measures = [F.sum("line_revenue").cast("double").alias("revenue"), F.countDistinct("transaction_id").alias("orders"), F.sum("quantity").alias("units"), F.countDistinct("customer_id").alias("customers")]
    now = in_period(lines, p.start, p.end).filter(F.col(key).isNotNull()).groupBy(key).agg(*measures)
    prior = in_period(lines, p.prior_start, p.prior_end).filter(F.col(key).isNotNull()).groupBy(key).agg(*measures[:3])
    return now, prior.select(key, *[F.col(c).alias(f"prior_{c}") for c in ("revenue", "orders", "units")])


def _both_periods(lines: DataFrame, p: Period, key: str) -> DataFrame:
    """The lines of both periods, written once with what their measures look at."""
    rows = lines.filter(within(p.start, p.end) | within(p.prior_start, p.prior_end))
    return settled(rows.select(*dict.fromkeys([key, "transaction_day", "transaction_id", "customer_id", "quantity", "line_revenue"])), "periods")


def product_period_features(lines: DataFrame, p: Period) -> DataFrame:
    """Products of the period with penetration, shares, the prior period and the change of rank.

    The lines of both periods are written once, and so are the products, which ranks look at several times.
    """
    lines = _both_periods(lines, p, "product_id")
    now, prior = _compared(lines, p, "product_id")
    totals = in_period(lines, p.start, p.end).agg(F.countDistinct("transaction_id").alias("__orders"), F.sum("line_revenue").cast("double").alias("__revenue"))
    out = now.join(prior, "product_id", "left").fillna(0, ["prior_revenue", "prior_orders", "prior_units"]).crossJoin(F.broadcast(totals))  # one row
    out = settled(out, "products")
    for c, into in (("revenue", "revenue_rank"), ("prior_revenue", "prior_revenue_rank")):
        ranks = value_ranks(out.select((-F.col(c)).alias("__down")), "__down").select("__down", (F.col("before_n") + 1).cast("int").alias(into))
        out = out.withColumn("__down", -F.col(c)).join(ranks, "__down").drop("__down")
    out = out.withColumns({
        "basket_penetration": F.coalesce(ratio(F.col("orders"), F.col("__orders")) * 100, F.lit(0.0)),
        "rev_per_order": ratio(F.col("revenue"), F.col("orders")),
        "avg_selling_price": ratio(F.col("revenue"), F.col("units")),
        "revenue_share": F.when(F.col("__revenue") > 0, F.col("revenue") / F.col("__revenue") * 100).otherwise(0.0),
        "revenue_change": F.col("revenue") - F.col("prior_revenue"),
    })
    out = out.withColumns({"pct_change": ratio(F.col("revenue_change"), F.col("prior_revenue")) * 100, "rank_change": F.col("prior_revenue_rank") - F.col("revenue_rank")})
    return out.drop("__orders", "__revenue")


def category_period_features(lines: DataFrame, p: Period, key: str = "category") -> DataFrame:
    """Categories of the period with share, growth and contribution to the whole change."""
    now, prior = _compared(_both_periods(lines, p, key), p, key)
    out = now.join(prior.select(key, "prior_revenue"), key, "left").fillna(0.0, ["prior_revenue"])
    whole = Window.partitionBy()
    total, change = F.sum("revenue").over(whole), F.col("revenue") - F.col("prior_revenue")
    moved = F.sum("revenue").over(whole) - F.sum("prior_revenue").over(whole)
    return out.withColumns({
        "revenue_share": F.when(total > 0, F.col("revenue") / total * 100).otherwise(0.0),
        "avg_order_value": ratio(F.col("revenue"), F.col("orders")),
        "revenue_change": change,
        "growth": ratio(change, F.col("prior_revenue")) * 100,
        "contribution_pct": F.coalesce(ratio(change, moved) * 100, F.lit(0.0)),
    })


def contribution(lines: DataFrame, p: Period, key: str, measure: str = "revenue", n: int = 10) -> DataFrame:
    """Values of a dimension in either period, their change and its share of the whole; the n largest with ties."""
    value = {"revenue": F.sum("line_revenue").cast("double"), "orders": F.countDistinct("transaction_id").cast("double"), "customers": F.countDistinct("customer_id").cast("double")}[measure]
    side = lambda a, b, name: in_period(lines, a, b).groupBy(key).agg(value.alias(name))
    rows = side(p.start, p.end, "current").join(side(p.prior_start, p.prior_end, "prior"), key, "full_outer").fillna(0.0, ["current", "prior"])
    change = F.col("current") - F.col("prior")
    rows = rows.withColumn("change", change).withColumn("contribution_pct", F.coalesce(ratio(F.col("change"), F.sum("change").over(Window.partitionBy())) * 100, F.lit(0.0)))
    return rows.withColumn("rank", F.rank().over(Window.orderBy(F.desc(F.abs("change"))))).filter(F.col("rank") <= n)


def kpi_sparklines(lines: DataFrame, p: Period, periods: int = 6) -> DataFrame:
    """KPIs of the last back-to-back periods of equal length, the oldest first, from one pass."""
    back = F.floor(F.datediff(F.lit(p.end), "transaction_day") / p.days).cast("int")
    rows = lines.filter((F.col("transaction_day") <= F.lit(p.end)) & (back < periods)).withColumn("period_index", periods - 1 - back)
    out = rows.groupBy("period_index").agg(F.sum("line_revenue").cast("double").alias("revenue"), F.countDistinct("transaction_id").alias("orders"), F.countDistinct("customer_id").alias("customers"))
    return out.withColumn("aov", F.coalesce(ratio(F.col("revenue"), F.col("orders")), F.lit(0.0)))


def bucket(span_days: int) -> Column:
    """Days up to 14 days, weeks that begin on Tuesday (and end on Monday) up to 60, else months."""
    day = F.col("transaction_day")
    if span_days <= 14:
        return day
    if span_days <= 60:
        return F.date_add(day, F.pmod(7 - F.weekday(day), F.lit(7)).cast("int"))
    return F.trunc(day, "MM")


def year_over_year(lines: DataFrame, p: Period) -> DataFrame:
    """Revenue by bucket of the period and of a year before, laid side by side; empty buckets are 0."""
    before = period(p.start, p.end, "yoy")
    kind = bucket(p.days)
    side = lambda a, b: in_period(lines, a, b).groupBy(kind.alias("b")).agg(F.sum("line_revenue").cast("double").alias("v"))
    now = side(p.start, p.end).select(F.col("b").alias("bucket"), F.col("v").alias("revenue"))
    then = side(before.prior_start, before.prior_end).select(F.add_months("b", 12).alias("bucket"), F.col("v").alias("revenue_year_before"))
    return now.join(then, "bucket", "full_outer").fillna(0.0, ["revenue", "revenue_year_before"])


def category_mix(lines: DataFrame, p: Period, top: int = 6) -> DataFrame:
    """Shares of the leading categories, and of the others together, by bucket of the period."""
    rows = in_period(lines, p.start, p.end).filter("category IS NOT NULL")
    leading = rows.groupBy("category").agg(F.sum("line_revenue").alias("t")).orderBy(F.desc("t"), "category").limit(top).select("category", F.lit(True).alias("__top"))
    named = rows.join(F.broadcast(leading), "category", "left").withColumn("category", F.when(F.col("__top"), F.col("category")).otherwise("Other"))
    out = named.groupBy(bucket(p.days).alias("bucket"), "category").agg(F.sum("line_revenue").cast("double").alias("revenue"))
    return out.withColumn("share", ratio(F.col("revenue"), F.sum("revenue").over(Window.partitionBy("bucket"))) * 100)


def top_product_trends(lines: DataFrame, p: Period, n: int = 5) -> DataFrame:
    """Revenue of the leading products by bucket of the period."""
    rows = in_period(lines, p.start, p.end)
    leading = rows.groupBy("product_id").agg(F.sum("line_revenue").alias("t")).orderBy(F.desc("t"), "product_id").limit(n).select("product_id")
    return rows.join(F.broadcast(leading), "product_id", "left_semi").groupBy(bucket(p.days).alias("bucket"), "product_id").agg(F.sum("line_revenue").cast("double").alias("revenue"))


def quadrants(df: DataFrame, x: str, y: str, names: tuple[str, str, str, str]) -> DataFrame:
    """Rows by whether they reach the medians of x and y: (high x, high y), (high, low), (low, high), (low, low). The rows are
    written once before their medians are sought."""
    df = settled(df, "quadrants")
    mid = quantile_table(df, [x, y], (0.5,))
    out = df.withColumns({n: F.lit((mid[c] or [None])[0]).cast("double") for n, c in (("mid_x", x), ("mid_y", y))})
    right, top = F.col(x) >= F.col("mid_x"), F.col(y) >= F.col("mid_y")
    return out.withColumn("quadrant", F.when(right & top, names[0]).when(right, names[1]).when(top, names[2]).otherwise(names[3]))


def retention_metrics(lines: DataFrame, p: Period, inactivity: int = 90) -> DataFrame:
    """Retention, reactivation, new and repeat customers, and valuable ones who stayed away, from flags by customer."""
    day = F.col("transaction_day")
    seen = lambda c: F.max(F.coalesce(c, F.lit(False)))
    rows = lines.filter(F.col("customer_id").isNotNull() & (day <= F.lit(p.end)))
    c = rows.groupBy("customer_id").agg(
        seen(within(p.start, p.end)).alias("now"),
        seen(within(p.prior_start, p.prior_end)).alias("prior"),
        seen(day < F.lit(p.start)).alias("ever"),
        seen((day < F.lit(p.start)) & (day >= F.lit(p.start - dt.timedelta(days=inactivity)))).alias("recent"),
        F.countDistinct("transaction_id").alias("orders"),
        F.sum("line_revenue").cast("double").alias("revenue"),
    )
    c = settled(c, "customers")
    c = numbered(c.withColumn("down", -F.col("revenue")), "down", "customer_id", "rank").crossJoin(F.broadcast(c.agg(F.floor(F.count(F.lit(1)) * 0.2).alias("top"))))  # one row
    n = lambda condition: F.count_if(condition)
    now, prior, ever, recent, again = (F.col(k) for k in ("now", "prior", "ever", "recent", "orders"))
    away = (F.col("rank") <= F.col("top")) & ~now
    counts = c.agg(
        n(now).alias("curr_customers"), n(prior).alias("prior_customers"), n(now & prior).alias("retained"), n(ever & ~recent).alias("dormant"), n(ever & ~recent & now).alias("reactivated"), n(now & ~ever).alias("new_customers"),
        n(again > 1).alias("repeat_customers"), F.count(F.lit(1)).alias("customers"), F.coalesce(F.sum(F.when(again > 1, F.col("revenue"))), F.lit(0.0)).alias("repeat_revenue"), F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("total_revenue"),
        n(away).alias("inactive_valuable_count"), F.coalesce(F.sum(F.when(away, F.col("revenue"))), F.lit(0.0)).alias("inactive_valuable_revenue"),
    )
    share = lambda a, b: F.coalesce(ratio(F.col(a), F.col(b)), F.lit(0.0))
    return counts.select(
        share("retained", "prior_customers").alias("retention_rate"), share("reactivated", "dormant").alias("reactivation_rate"), share("new_customers", "curr_customers").alias("new_customer_share"), share("repeat_customers", "customers").alias("repeat_purchase_rate"),
        share("repeat_revenue", "total_revenue").alias("repeat_revenue_share"), "curr_customers", "prior_customers", "retained", "reactivated", "new_customers", "inactive_valuable_count", "inactive_valuable_revenue",
    )


def customers_between(lines: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    return lines.filter(F.col("customer_id").isNotNull() & within(start, end)).select("customer_id").distinct()


def retained_customers(lines: DataFrame, p: Period) -> DataFrame:
    return customers_between(lines, p.start, p.end).join(customers_between(lines, p.prior_start, p.prior_end), "customer_id", "left_semi")


def reactivated_customers(lines: DataFrame, p: Period, inactivity: int = 90) -> DataFrame:
    """Customers of the period who had bought before, but not in the days just before it."""
    eve = p.start - dt.timedelta(days=1)
    before = lines.filter(F.col("customer_id").isNotNull() & (F.col("transaction_day") <= F.lit(eve))).select("customer_id").distinct()
    dormant = before.join(customers_between(lines, p.start - dt.timedelta(days=inactivity), eve), "customer_id", "left_anti")
    return customers_between(lines, p.start, p.end).join(dormant, "customer_id", "left_semi")


def inactive_valuable(lines: DataFrame, p: Period, share: float = 0.2) -> DataFrame:
    """The leading fifth of customers by revenue up to the period's end who bought nothing in it."""
    spend = lines.filter(F.col("customer_id").isNotNull() & (F.col("transaction_day") <= F.lit(p.end))).groupBy("customer_id").agg(F.sum("line_revenue").alias("revenue"))
    ranked = numbered(spend.withColumn("down", -F.col("revenue")), "down", "customer_id", "rank").crossJoin(F.broadcast(spend.agg(F.floor(F.count(F.lit(1)) * share).alias("top"))))  # one row
    return ranked.filter("rank <= top").join(customers_between(lines, p.start, p.end), "customer_id", "left_anti").select("customer_id", "revenue")


def daily_kpis(lines: DataFrame) -> DataFrame:
    out = lines.filter("transaction_day IS NOT NULL").groupBy("transaction_day").agg(F.sum("line_revenue").cast("double").alias("revenue"), F.countDistinct("transaction_id").alias("orders"), F.countDistinct("customer_id").alias("customers"), F.sum("quantity").alias("units"))
    return out.withColumns({"aov": ratio(F.col("revenue"), F.col("orders")), "units_per_order": ratio(F.col("units"), F.col("orders")), "revenue_per_customer": ratio(F.col("revenue"), F.col("customers"))})


ANOMALY_METRICS = ("revenue", "orders", "customers", "aov", "units_per_order", "revenue_per_customer")


def anomalies(lines: DataFrame, p: Period, rows: int = 28, k: float = 2.0, least: int = 7) -> DataFrame:
    """Days of the period outside mean +- k deviations of the ``rows`` observed days before, for six metrics.

    The series has a row a day, so one ordered window over it is small whatever the lines are.
    """
    daily = daily_kpis(lines.filter(within(p.start - dt.timedelta(days=2 * rows), p.end)))
    long = daily.select("transaction_day", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ANOMALY_METRICS])))
    past = Window.partitionBy("metric").orderBy("transaction_day").rowsBetween(-rows, -1)
    seen = F.count("value").over(past)
    long = long.withColumns({"expected": F.when(seen >= least, F.avg("value").over(past)), "__sd": F.when(seen >= least, F.stddev_samp("value").over(past))})
    long = long.withColumns({"upper": F.col("expected") + k * F.col("__sd"), "lower": F.col("expected") - k * F.col("__sd")}).drop("__sd")
    out = long.filter((F.col("transaction_day") >= F.lit(p.start)) & ((F.col("value") > F.col("upper")) | (F.col("value") < F.col("lower"))))
    return out.withColumns({"pct_deviation": F.coalesce(ratio(F.col("value") - F.col("expected"), F.col("expected")) * 100, F.lit(0.0)), "direction": F.when(F.col("value") > F.col("upper"), "high").otherwise("low")})


def anomaly_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("metric").agg(F.count(F.lit(1)).alias("anomalies"), F.max(F.abs("pct_deviation")).alias("max_abs_deviation"))


def rolling_sum(daily: DataFrame, value: str, rows: int = 7) -> DataFrame:
    """The sum over the last observed days, not calendar days."""
    return daily.withColumn(f"rolling_{value}", F.sum(value).over(Window.orderBy("transaction_day").rowsBetween(-(rows - 1), 0)))


ALLOWED = {"sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "nunique": F.countDistinct, "count_distinct": F.countDistinct}


def group_by_expressions(df: DataFrame, by: list[str], measures: dict[str, str]) -> DataFrame:
    """Aggregates written as name(column), of a fixed list of names."""
    out = []
    for name, text in measures.items():
        kind, _, column = text.rstrip(")").partition("(")
        if kind.strip() not in ALLOWED or column.strip() not in df.columns:
            raise ValueError(f"unknown aggregate {text!r}")
        out.append(ALLOWED[kind.strip()](column.strip()).alias(name))
    return df.groupBy(*by).agg(*out)
