"""Purchase events, baskets, matched returns and price indices."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY, TRANSACTION = "trip", "transaction"


def latest_day(lines: DataFrame) -> dt.date | None:
    return lines.agg(F.max("transaction_day")).first()[0]


def up_to(lines: DataFrame, as_of: dt.date) -> DataFrame:
    """Lines without later ones; lines without a day stay for accounting."""
    return lines.filter(F.col("transaction_day").isNull() | (F.col("transaction_day") <= F.lit(as_of)))


def purchases(lines: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    rows = lines.filter("quantity > 0 AND customer_id IS NOT NULL AND transaction_day IS NOT NULL")
    return rows if as_of is None else rows.filter(F.col("transaction_day") <= F.lit(as_of))


def purchase_events(lines: DataFrame, as_of: dt.date | None = None, grain: str = DAY, least_value: float = 0.0) -> DataFrame:
    """One row for each customer and day, or customer and transaction, whose value is above ``least_value``."""
    rows = purchases(lines, as_of)
    keys = ["customer_id", "transaction_day"]
    if grain == TRANSACTION:
        rows, keys = rows.filter("transaction_id IS NOT NULL"), ["customer_id", "transaction_id"]
    measures = [
        F.sum(F.greatest(F.coalesce("line_revenue", F.lit(0)), F.lit(0))).alias("trip_value"),
        F.count(F.lit(1)).alias("n_lines"),
        F.countDistinct("product_id").alias("n_products"),
        F.sum("quantity").alias("n_units"),
    ]
    if grain == TRANSACTION:
        measures.append(F.min("transaction_day").alias("transaction_day"))
    # one exchange of narrow rows, which the distinct count then finds in place
    rows = rows.select(*dict.fromkeys([*keys, "transaction_day", "product_id", "line_revenue", "quantity"])).repartition(*keys)
    return rows.groupBy(*keys).agg(*measures).filter(F.col("trip_value") > least_value)


def event_grain_check(events: DataFrame, grain: str = DAY) -> DataFrame:
    """events, repeated keys and the range of days."""
    keys = ["customer_id", "transaction_day" if grain == DAY else "transaction_id"]
    counts = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("transaction_day").alias("a"), F.max("transaction_day").alias("b"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.count_if(F.col("n") > 1).alias("repeated_keys"), F.min("a").alias("first_day"), F.max("b").alias("last_day"))


def baskets(lines: DataFrame, item: str = "category", grain: str = DAY, key_mode: str = "customer-transaction", as_of: dt.date | None = None) -> DataFrame:
    """customer_id, basket_key and the sorted distinct items; with key mode transaction-only, a shared id is one basket."""
    rows = purchases(lines, as_of).filter(F.col(item).isNotNull())
    if grain == DAY:
        keys = [F.col("customer_id"), F.col("transaction_day").cast("string").alias("basket_key")]
    else:
        rows = rows.filter("transaction_id IS NOT NULL")
        keys = [F.col("transaction_id").alias("basket_key")] + ([F.col("customer_id")] if key_mode == "customer-transaction" else [])
    out = rows.groupBy(*keys).agg(F.sort_array(F.collect_set(item)).alias("items"), F.min("customer_id").alias("__c"))
    return out.drop("__c") if "customer_id" in out.columns else out.withColumnRenamed("__c", "customer_id").select("customer_id", "basket_key", "items")


def match_returns(lines: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Return lines with the latest purchase of the same customer and product not after them, and whether there is one.

    Purchases and returns are laid in one order; the last purchase time before each return is carried along. That is one pass and
    one shuffle, in which purchases carry no more than their keys and time.
    """
    keys = ["customer_id", "product_id"]
    rows = lines.filter("customer_id IS NOT NULL AND product_id IS NOT NULL AND transaction_date IS NOT NULL AND quantity <> 0")
    if as_of is not None:
        rows = rows.filter(F.col("transaction_day") <= F.lit(as_of))
    back = F.col("quantity") < 0
    own = [F.when(back, F.col(c)).alias(c) for c in lines.columns if c not in (*keys, "transaction_date")]
    both = rows.select(*keys, "transaction_date", *own, F.when(~back, F.col("transaction_date")).alias("__buy"))
    order = Window.partitionBy(*keys).orderBy("transaction_date", F.col("__buy").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("purchase_time", F.last("__buy", ignorenulls=True).over(order)).filter(F.col("quantity") < 0)
    return out.select(*lines.columns, "purchase_time", F.col("purchase_time").isNotNull().alias("matched"))


def returns_info(returns: DataFrame) -> DataFrame:
    """How many returns and how much of their value have a purchase, and the precision of their times."""
    value = -F.col("line_revenue")
    timed = F.col("transaction_date") != F.date_trunc("day", "transaction_date").cast("timestamp_ntz")
    out = returns.agg(
        F.count(F.lit(1)).alias("return_lines"),
        F.count_if("matched").alias("matched_lines"),
        F.coalesce(F.sum(value).cast("double"), F.lit(0.0)).alias("return_value"),
        F.coalesce(F.sum(F.when(F.col("matched"), value)).cast("double"), F.lit(0.0)).alias("matched_value"),
        F.coalesce(F.max(timed), F.lit(False)).alias("__timed"),
    )
    share = F.when(F.col("return_value") > 0, F.col("matched_value") / F.col("return_value")).otherwise(0.0)
    return out.select("return_lines", "matched_lines", "return_value", "matched_value", share.alias("matched_value_share"), F.when(F.col("__timed"), "timestamp").otherwise("calendar_day").alias("precision"))


def reference_prices(lines: DataFrame, least: int = 5) -> DataFrame:
    """Median price of products with at least ``least`` priced purchases."""
    rows = lines.filter("quantity > 0 AND price > 0 AND product_id IS NOT NULL")
    out = rows.groupBy("product_id").agg(F.percentile("price", F.lit(0.5)).alias("reference_price"), F.count(F.lit(1)).alias("observations"), F.countDistinct("price").alias("prices"))
    return out.filter(F.col("observations") >= least)


def price_index(lines: DataFrame, least: int = 5, threshold: float = 0.10) -> DataFrame:
    """Purchase lines with their product's reference price, the index to it, and whether it looks like a promotion."""
    rows = lines.filter("quantity > 0 AND price > 0 AND product_id IS NOT NULL").join(reference_prices(lines, least).select("product_id", "reference_price"), "product_id", "left")
    index = F.col("price") / F.col("reference_price")
    return rows.withColumns({"price_index": index, "promo_like": F.coalesce(index <= 1 - threshold, F.lit(False))})


def price_index_info(lines: DataFrame, least: int = 5) -> DataFrame:
    """Products with enough prices, how many of them vary, and whether the index can be used (5 percent vary)."""
    out = reference_prices(lines, least).agg(F.count(F.lit(1)).alias("eligible_products"), F.count_if(F.col("prices") > 1).alias("varying_products"))
    share = F.when(F.col("eligible_products") > 0, F.col("varying_products") / F.col("eligible_products")).otherwise(0.0)
    return out.withColumn("varying_share", share).withColumn("usable", F.col("varying_share") >= 0.05)
