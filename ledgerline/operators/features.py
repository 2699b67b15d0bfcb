"""Point-in-time customer features: every family looks at purchases and returns up to ``as_of`` only."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.semantics import ratio, steady_deviation, steady_mean, steady_sum
from ledgerline.operators.events import DAY, match_returns, price_index_info, purchase_events, purchases
from ledgerline.storage import is_settled, settled

KEY = "customer_id"
NEEDED = (KEY, "transaction_id", "transaction_date", "transaction_day", "product_id", "category", "department", "price", "quantity", "line_revenue")


def _days_before(as_of: dt.date, days: int) -> Column:
    return F.lit(as_of - dt.timedelta(days=days))


def gaps(events: DataFrame) -> DataFrame:
    """Events with the days since the customer's previous event."""
    return events.withColumn("gap", F.datediff("transaction_day", F.lag("transaction_day").over(Window.partitionBy(KEY).orderBy("transaction_day"))))


def interpurchase_intervals(events: DataFrame) -> DataFrame:
    return gaps(events).select(KEY, "transaction_day", F.col("gap").alias("interpurchase_interval_days"))


def customer_core(events: DataFrame, as_of: dt.date, least_days: int = 30, factor: float = 2.0, default_days: int = 90) -> DataFrame:
    """Counts, spend, gaps, recency, an inactivity heuristic and the regularity of purchases."""
    rows = gaps(events.filter(F.col("transaction_day") <= F.lit(as_of)))
    out = rows.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_trips"),
        F.min("transaction_day").alias("first_day"),
        F.max("transaction_day").alias("last_day"),
        F.sum("trip_value").cast("double").alias("gross_spend"),
        (F.sum("trip_value").cast("double") / F.count(F.lit(1))).alias("mean_trip_value"),
        F.avg("n_products").alias("mean_products_per_trip"),
        F.percentile("n_products", F.lit(0.5)).alias("median_products_per_trip"),
        F.percentile("gap", F.lit(0.5)).alias("median_gap"),
        F.avg("gap").alias("mean_gap"),
        steady_deviation("gap").alias("std_gap"),
        F.count("gap").alias("n_gaps"),
    )
    threshold = F.when(F.col("median_gap") > 0, F.greatest(F.lit(float(least_days)), factor * F.col("median_gap"))).otherwise(float(default_days))
    k_hat = F.when((F.col("n_gaps") >= 3) & (F.col("std_gap") > 0), F.pow(ratio(F.col("mean_gap"), F.col("std_gap")), 2.0))
    return out.withColumns({
        "x": F.col("n_trips") - 1,
        "t_x": F.datediff("last_day", "first_day"),
        "T": F.datediff(F.lit(as_of), "first_day"),
        "recency_days": F.datediff(F.lit(as_of), "last_day"),
        "interpurchase_cv": F.when(F.col("mean_gap") > 0, F.col("std_gap") / F.col("mean_gap")),
        "heuristic_threshold_days": threshold,
        "inactive_by_heuristic": F.datediff(F.lit(as_of), "last_day") > threshold,
        "regularity_shape_shrunk": (F.col("n_gaps") * F.coalesce(k_hat, F.lit(1.0)) + 3) / (F.col("n_gaps") + 3),
    })


def daily_grain(lines: DataFrame, as_of: dt.date) -> DataFrame:
    """A row for each customer and day: value, lines, different products and categories, units and revenue bought, and value
    returned. What a customer buys in a day is a bounded set."""
    buy, back, rev = F.col("quantity") > 0, F.col("quantity") < 0, F.col("line_revenue")
    kinds = lambda c: F.size(F.collect_set(F.when(buy, F.col(c)))).cast("long")
    rows = lines.filter(F.col(KEY).isNotNull() & (F.col("transaction_day") <= F.lit(as_of)))
    return rows.groupBy(KEY, "transaction_day").agg(
        F.coalesce(F.sum(F.when(buy, F.greatest(F.coalesce(rev, F.lit(0)), F.lit(0)))), F.lit(0)).alias("trip_value"), F.count_if(buy).alias("n_lines"), kinds("product_id").alias("n_products"), kinds("category").alias("n_categories"),
        F.sum(F.when(buy, F.col("quantity"))).alias("n_units"), F.sum(F.when(buy, rev)).alias("bought"), F.sum(F.when(back, -rev)).alias("returned"),
    )


def window_features(lines: DataFrame, events: DataFrame, as_of: dt.date, windows: tuple[int, ...] = (30, 90, 365), recent: int = 90) -> DataFrame:
    """Gross, return and net value and trips in calendar windows, and recent against prior, from one pass each."""
    return _windows(daily_grain(lines, as_of), events, as_of, windows, recent)


def _windows(daily: DataFrame, events: DataFrame, as_of: dt.date, windows: tuple[int, ...], recent: int) -> DataFrame:
    day = F.col("transaction_day")

    def inside(a: int, b: int) -> Column:
        return day.between(_days_before(as_of, a), _days_before(as_of, b))

    total = lambda c, x, n: F.coalesce(F.sum(F.when(c, F.col(x))).cast("double"), F.lit(0.0)).alias(n)
    measures = [m for w in windows for m in (total(inside(w - 1, 0), "bought", f"gross_spend_{w}d"), total(inside(w - 1, 0), "returned", f"return_value_{w}d"))]
    measures += [total(inside(recent - 1, 0), "bought", "recent_spend"), total(inside(2 * recent - 1, recent), "bought", "prior_spend")]
    spend = daily.groupBy(KEY).agg(F.sum("n_lines").alias("__buys"), *measures).filter("__buys > 0").drop("__buys")
    trips = events.filter(day <= F.lit(as_of)).groupBy(KEY).agg(
        *[F.count_if(inside(w - 1, 0)).alias(f"n_trips_{w}d") for w in windows], F.count_if(inside(recent - 1, 0)).alias("recent_trips"), F.count_if(inside(2 * recent - 1, recent)).alias("prior_trips")
    )
    out = spend.join(trips, KEY, "left").fillna(0)
    change = lambda a, b: F.when(F.col(b) > 0, (F.col(a) - F.col(b)) / F.col(b) * 100)
    return out.withColumns({f"net_revenue_{w}d": F.col(f"gross_spend_{w}d") - F.col(f"return_value_{w}d") for w in windows} | {"spend_change_pct": change("recent_spend", "prior_spend"), "trip_change_pct": change("recent_trips", "prior_trips")})


def item_grain(lines: DataFrame, as_of: dt.date) -> DataFrame:
    """What each customer spent on each product, with its category and department, in purchases; no value below 0."""
    value = F.greatest(F.coalesce("line_revenue", F.lit(0)), F.lit(0))
    return purchases(lines, as_of).groupBy(KEY, "product_id", "category", "department").agg(F.sum(value).alias("line_revenue"))


def top_component(lines: DataFrame, by: str) -> DataFrame:
    """A customer's distinct values of ``by``, the leading one by spend (ties by name), and how concentrated they are."""
    value = F.greatest(F.coalesce("line_revenue", F.lit(0)), F.lit(0))
    spend = lines.filter(F.col(by).isNotNull()).groupBy(KEY, by).agg(F.sum(value).alias("v"))
    share = ratio(F.col("v"), F.sum("v").over(Window.partitionBy(KEY)))
    return spend.withColumn("s", share).groupBy(KEY).agg(
        F.count(F.lit(1)).alias(f"distinct_{by}"), F.min_by(by, F.struct(-F.col("v"), F.col(by))).alias(f"top_{by}"), steady_sum(F.col("s") * F.col("s"), 18).alias(f"{by}_hhi")
    )


def breadth_features(lines: DataFrame, as_of: dt.date) -> DataFrame:
    return _breadth(item_grain(lines, as_of))


def _breadth(rows: DataFrame) -> DataFrame:
    products = rows.groupBy(KEY).agg(F.countDistinct("product_id").alias("distinct_products"))
    return products.join(top_component(rows, "category"), KEY, "left").join(top_component(rows, "department"), KEY, "left")


def promo_features(lines: DataFrame, as_of: dt.date, least: int = 1, threshold: float = 0.10) -> DataFrame:
    """Share of spend at promotional prices, and the spend-weighted mean and the median of the price index."""
    rows = purchases(lines, as_of).filter("price > 0 AND product_id IS NOT NULL")
    reference = rows.groupBy("product_id").agg(F.percentile("price", F.lit(0.5)).alias("__ref"), F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least)
    rows = rows.join(reference, "product_id").withColumn("idx", F.col("price") / F.col("__ref"))
    rev = F.col("line_revenue").cast("double")
    promo = F.sum(F.when(F.col("idx") <= 1 - threshold, F.col("line_revenue")))
    return rows.groupBy(KEY).agg(ratio(F.coalesce(promo, F.lit(0)), F.sum("line_revenue")).alias("promo_spend_share"), ratio(steady_sum(F.col("idx") * rev), F.sum("line_revenue")).alias("mean_price_index"), F.percentile("idx", F.lit(0.5)).alias("median_price_index"))


def gated_promo_features(lines: DataFrame, as_of: dt.date, least: int = 5, threshold: float = 0.10) -> DataFrame:
    """The two measures of spend for every purchasing customer, over products with ``least`` priced purchases; null for all
    where the prices of too few products vary to tell a promotion."""
    rows = purchases(lines, as_of)
    usable = F.broadcast(price_index_info(rows, least).select("usable"))  # one row
    found = rows.select(KEY).distinct().join(promo_features(lines, as_of, least, threshold), KEY, "left").crossJoin(usable)
    return found.select(KEY, *[F.when(F.col("usable"), F.col(c)).alias(c) for c in ("promo_spend_share", "mean_price_index")])


def return_features(lines: DataFrame, as_of: dt.date) -> DataFrame:
    """All return value, and what of it has or lacks a purchase before."""
    value = -F.col("line_revenue")
    total = lambda c, n: F.coalesce(F.sum(F.when(c, value)).cast("double"), F.lit(0.0)).alias(n)
    rows = match_returns(lines, as_of)
    return rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("return_lines"), total(F.lit(True), "return_value"), total(F.col("matched"), "matched_return_value"), total(~F.col("matched"), "unmatched_return_value"))


def category_shares(lines: DataFrame, as_of: dt.date, top: int = 30) -> DataFrame:
    """Long form: a customer's share of spend in each leading category, all others together."""
    return _shares(item_grain(lines, as_of), top)


def _shares(items: DataFrame, top: int) -> DataFrame:
    rows = items.filter("category IS NOT NULL").groupBy(KEY, "category").agg(F.sum("line_revenue").alias("v"))
    leading = rows.groupBy("category").agg(F.sum("v").alias("t")).orderBy(F.desc("t"), "category").limit(top).select("category", F.lit(True).alias("__top"))
    named = rows.join(leading, "category", "left").withColumn("category", F.when(F.col("__top"), F.col("category")).otherwise("__other__"))
    spend = named.groupBy(KEY, "category").agg(F.sum("v").alias("v"))
    return spend.select(KEY, "category", ratio(F.col("v"), F.sum("v").over(Window.partitionBy(KEY))).alias("share"))


MOST_CATEGORIES = 1000


def category_affinity(shares: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Wide form with the top category (ties by name) and the entropy of shares; a column for each category.

    Without a list the categories are those of ``shares``, which :func:`category_shares` keeps to 31; more than a thousand are
    too many for columns and an error.
    """
    if categories is None:
        categories = sorted(r[0] for r in shares.select("category").distinct().limit(MOST_CATEGORIES + 1).collect())
        if len(categories) > MOST_CATEGORIES:
            raise ValueError(f"more than {MOST_CATEGORIES} categories cannot be columns; give a list")
    wide = shares.groupBy(KEY).pivot("category", categories).agg(F.first("share"))
    wide = wide.select(KEY, *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(f"category_{c}_spend_share") for c in categories])
    return wide.join(category_entropy(shares), KEY)


def category_entropy(shares: DataFrame) -> DataFrame:
    """The top category and -sum s ln(s + 1e-10) of a customer's shares."""
    s = F.col("share")
    return shares.groupBy(KEY).agg(F.min_by("category", F.struct(-s, F.col("category"))).alias("top_category_by_share"), (-steady_sum(s * F.log(s + 1e-10), 18)).alias("category_entropy"))


def trend_features(lines: DataFrame, as_of: dt.date, months: int = 13) -> DataFrame:
    """Slope of log revenue, variation and activity over 13 calendar months that end with the month of ``as_of``.

    Months without purchases count as zero; they are added by their number instead of by a grid of rows.
    """
    return _trend(daily_grain(lines, as_of), as_of, months)


def _trend(daily: DataFrame, as_of: dt.date, months: int = 13) -> DataFrame:
    last = as_of.replace(day=1)
    index = (months - 1) - (F.lit(last.year * 12 + last.month) - (F.year("transaction_day") * 12 + F.month("transaction_day")))
    rows = daily.filter("n_lines > 0").select(KEY, index.alias("i"), "bought")
    monthly = rows.groupBy(KEY, "i").agg(F.coalesce(F.sum("bought").cast("double"), F.lit(0.0)).alias("v"))
    inside = F.col("i") >= 0
    y, i, v = F.when(inside, F.log1p(F.greatest(F.col("v"), F.lit(0.0)))), F.col("i"), F.when(inside, F.col("v"))
    n, si, sii = float(months), sum(range(months)), sum(k * k for k in range(months))
    out = monthly.groupBy(KEY).agg(F.count_if(inside & (F.col("v") > 0)).alias("active"), *[F.coalesce(steady_sum(c), F.lit(0.0)).alias(n) for c, n in ((y, "sy"), (i * y, "siy"), (v, "sv"), (v * v, "svv"))])
    slope = (n * F.col("siy") - si * F.col("sy")) / (n * sii - si * si)
    mean = F.col("sv") / n
    spread = F.sqrt(F.greatest(F.col("svv") / n - mean * mean, F.lit(0.0)))
    enough = F.col("active") >= 3
    return out.select(KEY, F.when(enough, slope).alias("revenue_trend_slope"), F.when(enough & (mean > 0), spread / mean).alias("revenue_cv"), (F.col("active") / n).alias("active_months_fraction"))


def basket_composition(lines: DataFrame, as_of: dt.date) -> DataFrame:
    """Means over customer-days of distinct products, categories and units, and the variation of their revenue."""
    return _composition(daily_grain(lines, as_of))


def _composition(daily: DataFrame) -> DataFrame:
    days = daily.filter("n_lines > 0").select(KEY, F.col("n_products").alias("p"), F.col("n_categories").alias("c"), F.col("n_units").alias("u"), F.col("bought").cast("double").alias("v"))
    cv = F.when(steady_mean("v") > 0, steady_deviation("v") / steady_mean("v"))
    return days.groupBy(KEY).agg(F.avg("p").alias("mean_products_per_day"), F.avg("c").alias("mean_categories_per_day"), steady_mean("u").alias("mean_units_per_day"), cv.alias("day_revenue_cv"))


def customer_snapshot(lines: DataFrame, as_of: dt.date, grain: str = DAY, windows: tuple[int, ...] = (30, 90, 365), recent: int = 90) -> DataFrame:
    """All families side by side; each is keyed by customer, so the joins share one partitioning.

    The lines are read once and brought to two grains, customer and day and customer and product, which are written; all
    families but promotions and returns, which look at single lines, derive from these.
    """
    lines = lines if is_settled(lines) else settled(lines.select(*[c for c in NEEDED if c in lines.columns]))
    daily, items = settled(daily_grain(lines, as_of)), settled(item_grain(lines, as_of))
    events = daily.filter("trip_value > 0") if grain == DAY else purchase_events(lines, as_of, grain)
    out = customer_core(events, as_of)
    out = out.join(return_features(lines, as_of), KEY, "left").fillna(0, ["return_lines", "return_value", "matched_return_value", "unmatched_return_value"])
    gross, back = F.col("gross_spend"), F.col("return_value")
    out = out.withColumns({
        "net_spend": F.greatest(gross - back, F.lit(0.0)),
        "return_value_ratio": F.coalesce(F.least(F.greatest(ratio(back, gross), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)),
        "observed_first_purchase_cohort_month": F.date_format("first_day", "yyyy-MM"),
    })
    for family in (
        _windows(daily, events, as_of, windows, recent),
        _breadth(items),
        promo_features(lines, as_of),
        category_entropy(_shares(items, 30)),
        _trend(daily, as_of),
        _composition(daily),
    ):
        out = out.join(family, KEY, "left")
    return out.fillna(0.0, ["active_months_fraction"])


# The columns that a snapshot must and may have.
REQUIRED_FEATURES = ["customer_id", "n_trips", "first_day", "last_day", "gross_spend", "mean_trip_value", "x", "t_x", "T", "recency_days", "heuristic_threshold_days", "regularity_shape_shrunk", "return_value", "net_spend", "return_value_ratio"]
OPTIONAL_FEATURES = ["distinct_products", "top_category", "category_hhi", "promo_spend_share", "mean_price_index", "median_price_index", "category_entropy", "revenue_trend_slope", "revenue_cv", "active_months_fraction", "mean_products_per_day", "day_revenue_cv", "spend_change_pct", "trip_change_pct"]
