"""Roll-ups of lines by dimension, transaction, product and customer."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.ranking import numbered, running
from ledgerline.functions.semantics import ratio, when_sum, wilson
from ledgerline.operators.events import DAY
from ledgerline.storage import settled


# What distinct ids are called.
_DISTINCT = {"customer_id": "distinct_customers", "product_id": "distinct_products"}


def _additive() -> list[Column]:
    rev = F.col("line_revenue")
    return [
        F.count(F.lit(1)).alias("line_items"),
        when_sum(F.col("quantity") > 0, rev).alias("gross_purchase_revenue"),
        when_sum(F.col("quantity") < 0, -rev).alias("return_value"),
        F.coalesce(F.sum(rev).cast("double"), F.lit(0.0)).alias("net_revenue"),
        when_sum(F.col("quantity") > 0, F.col("quantity")).alias("units_purchased"),
        when_sum(F.col("quantity") < 0, -F.col("quantity")).alias("units_returned"),
    ]


def dimension_summaries(lines: DataFrame, dimensions: dict[str, Column]) -> dict[str, DataFrame]:
    """``dimension_summary`` by each of many dimensions, of which a customer or product meets few values, from one scan.

    Distinct counts are turned round: one aggregation by customer gathers the set of values that the customer has in every
    dimension, and the customers of a value are the sets that hold it; so too for products. The lines are shuffled by customer
    and by product once, after adding up in their tasks, whatever the number of dimensions, and never expanded by distinct count.
    """
    named = [c.alias(k) for k, c in dimensions.items()]
    rows = settled(lines.select("customer_id", "product_id", "line_revenue", "quantity", *named))
    sets = {of: settled(rows.filter(F.col(of).isNotNull()).groupBy(of).agg(*[F.collect_set(F.struct(k)).alias(k) for k in dimensions])) for of in ("customer_id", "product_id")}
    out = {}
    for k in dimensions:
        got = rows.groupBy(k).agg(*_additive())
        for of, name in (("customer_id", "distinct_customers"), ("product_id", "distinct_products")):
            counts = sets[of].select(F.inline(k)).groupBy(F.col(k).alias("__k")).agg(F.count(F.lit(1)).alias(name))
            got = got.join(counts, F.col(k).eqNullSafe(F.col("__k")), "left").drop("__k").fillna(0, [name])
        out[k] = got
    return out


def dimension_summary(lines: DataFrame, **by: Column) -> DataFrame:
    """Eight measures by any dimension; missing keys form a group of their own.

    The lines are written once. Each distinct count goes by the pairs of key and id, which tasks bring together before they are
    shuffled, and no line is expanded by distinct count.
    """
    rows = settled(lines.select(*[c.alias(k) for k, c in by.items()], *[c for c in ("customer_id", "product_id", "line_revenue", "quantity") if c not in by]))
    return _summed(rows, list(by), ("customer_id", "product_id"))


def _summed(rows: DataFrame, keys: list[str], ids: Sequence[str]) -> DataFrame:
    """The measures of written ``rows`` by ``keys``, with the distinct counts of ``ids``."""
    out = rows.groupBy(*keys).agg(*_additive())
    for of in ids:
        counts = rows.filter(F.col(of).isNotNull()).select(*keys, of).distinct().groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(F.lit(1)).alias(_DISTINCT[of]))
        on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        out = out.join(counts, on, "left").drop(*[f"__{k}" for k in keys]).fillna(0, [_DISTINCT[of]])
    return out


# The dimensions of the report's summaries.
DIMENSIONS = {"category": F.col, "department": F.col, "month": lambda _: F.date_format("transaction_day", "yyyy-MM"), "weekday": lambda _: F.weekday("transaction_day") + 1, "quarter": lambda _: F.concat(F.year("transaction_day").cast("string"), F.lit("Q"), F.quarter("transaction_day").cast("string")), "year": lambda _: F.year("transaction_day")}


def report_summaries(lines: DataFrame) -> dict[str, DataFrame]:
    """Summaries by category, department, month, weekday (Monday is 1), quarter and year, from one scan."""
    return dimension_summaries(lines, {k: f(k) for k, f in DIMENSIONS.items()})


def monthly_summary(lines: DataFrame) -> DataFrame:
    return dimension_summary(lines, month=F.date_format("transaction_day", "yyyy-MM"))


def weekday_summary(lines: DataFrame) -> DataFrame:
    """Monday is 1."""
    return dimension_summary(lines, weekday=F.weekday("transaction_day") + 1)


def transaction_summary(lines: DataFrame, key_mode: str = "customer-transaction") -> DataFrame:
    keys = ["customer_id", "transaction_id"] if key_mode == "customer-transaction" else ["transaction_id"]
    rev, n = F.col("line_revenue"), F.col("quantity")
    out = lines.dropna(subset=keys).groupBy(*keys).agg(
        F.min("transaction_day").alias("first_day"),
        F.countDistinct("transaction_day").alias("distinct_dates"),
        F.count(F.lit(1)).alias("line_items"),
        when_sum(n > 0, rev).alias("gross_purchase_revenue"),
        when_sum(n < 0, -rev).alias("return_value"),
        F.coalesce(F.sum(rev).cast("double"), F.lit(0.0)).alias("net_revenue"),
        when_sum(n > 0, n).alias("units_purchased"),
        F.countDistinct("product_id").alias("distinct_products"),
        F.countDistinct("customer_id").alias("distinct_customers"),
    )
    return out.withColumn("is_purchase_transaction", F.col("units_purchased") > 0)


# The metadata of a product, and what they are called.
METADATA = {"description": "product_description", "department": "department", "category": "category"}
_METADATA_COLUMNS = (*[f"{k}_variants" for k in METADATA], *[f"observed_{k}" for k in METADATA], "has_metadata_conflict")


def _variants(lines: DataFrame) -> DataFrame:
    """Line counts of each product with each combination of metadata: few rows a product, added up in tasks first."""
    return lines.filter("product_id IS NOT NULL").groupBy("product_id", *METADATA.values()).agg(F.count(F.lit(1)).alias("variant_line_items"))


def product_metadata(lines: DataFrame) -> DataFrame:
    """One row of metadata for each product: how many variants, the least of each, and whether they conflict."""
    return _metadata(_variants(lines))


def _metadata(variants: DataFrame) -> DataFrame:
    out = variants.groupBy("product_id").agg(*[F.countDistinct(c).alias(f"{k}_variants") for k, c in METADATA.items()], *[F.min(c).alias(f"observed_{k}") for k, c in METADATA.items()])
    return out.withColumn("has_metadata_conflict", F.greatest(*[f"{k}_variants" for k in METADATA]) > 1)


def product_variants(lines: DataFrame) -> DataFrame:
    """Line counts of each metadata variant of products whose metadata conflict; two different values are a least and a greatest."""
    variants = settled(_variants(lines))
    differ = reduce(Column.__or__, [F.min(c) < F.max(c) for c in METADATA.values()])
    conflicts = variants.groupBy("product_id").agg(F.coalesce(differ, F.lit(False)).alias("differ")).filter("differ").select("product_id")
    return variants.join(conflicts, "product_id", "left_semi")


def _repeat(lines: DataFrame, unit: str) -> DataFrame:
    """Buyers of each product and those with two units or more: with a first that is not the last."""
    rows = lines.filter(f"quantity > 0 AND customer_id IS NOT NULL AND product_id IS NOT NULL AND {unit} IS NOT NULL").select("product_id", "customer_id", unit)
    buyers = rows.repartition("product_id", "customer_id").groupBy("product_id", "customer_id").agg((F.min(unit) < F.max(unit)).alias("again"))
    return buyers.groupBy("product_id").agg(F.count_if("again").alias("repeat_buyers"), F.count(F.lit(1)).alias("observed_buyers"))


def product_repeat_behavior(lines: DataFrame, grain: str = DAY) -> DataFrame:
    """Buyers of each product and those who bought it on two days (or in two transactions) or more."""
    out = _repeat(lines, "transaction_day" if grain == DAY else "transaction_id")
    low, high = wilson(F.col("repeat_buyers"), F.col("observed_buyers"))
    unit_name = "customer-day trips" if grain == DAY else "transaction ids"
    return out.select("*", ratio(F.col("repeat_buyers"), F.col("observed_buyers")).alias("repeat_buyer_rate"), low.alias("repeat_rate_ci95_lower"), high.alias("repeat_rate_ci95_upper"), F.lit(unit_name).alias("repeat_unit"))


def product_summary(lines: DataFrame, grain: str = DAY) -> DataFrame:
    """Measures, metadata and repeat buyers by product.

    The lines are written once. Measures and metadata are added up in tasks; customers and repeat buyers come from the pairs of
    product and customer, one exchange of narrow rows. A product's only product is itself.
    """
    unit = "transaction_day" if grain == DAY else "transaction_id"
    rows = settled(lines.filter("product_id IS NOT NULL").select("product_id", "customer_id", unit, *METADATA.values(), "line_revenue", "quantity"))
    day = F.when(F.col("quantity") > 0, F.col(unit))
    pairs = rows.filter("customer_id IS NOT NULL").select("product_id", "customer_id", day.alias("d")).repartition("product_id", "customer_id")
    pairs = pairs.groupBy("product_id", "customer_id").agg(F.min("d").alias("first"), F.max("d").alias("last"))
    bought = F.count("first")
    people = pairs.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("distinct_customers"), F.when(bought > 0, bought).alias("observed_buyers"), F.when(bought > 0, F.count_if(F.col("first") < F.col("last"))).alias("repeat_buyers")
    )
    people = people.withColumn("repeat_buyer_rate", ratio(F.col("repeat_buyers"), F.col("observed_buyers")))
    out = rows.groupBy("product_id").agg(*_additive()).join(people, "product_id", "left").fillna(0, ["distinct_customers"]).withColumn("distinct_products", F.lit(1).cast("long"))
    out = out.join(_metadata(_variants(rows)), "product_id")
    return out.select("product_id", *[c for c in out.columns if c not in ("product_id", "observed_buyers", "repeat_buyers", "repeat_buyer_rate", *_METADATA_COLUMNS, *_DISTINCT.values())], *_DISTINCT.values(), *_METADATA_COLUMNS, "observed_buyers", "repeat_buyers", "repeat_buyer_rate")


def customer_spend(events: DataFrame) -> DataFrame:
    return events.groupBy("customer_id").agg(F.sum("trip_value").cast("double").alias("gross_spend"))


def revenue_concentration(spend: DataFrame, value: str = "gross_spend") -> DataFrame:
    """Shares of the leading 1, 5 and 10 percent, Gini and Herfindahl index of customers' spend.

    Customers are counted by value; a value's rows have the ranks that follow those with less.
    """
    v = F.greatest(F.col(value).cast("double"), F.lit(0.0))
    counts = spend.groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("k"))
    total = counts.agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("v")).alias("total"))
    rows = running(counts, ["v"], ["k"]).crossJoin(F.broadcast(total))  # one row
    least = lambda share: F.col("n") - F.greatest(F.lit(1), F.ceil(F.col("n") * share))
    inside = lambda share: F.least(F.greatest(F.col("before_k") + F.col("k") - least(share), F.lit(0)), F.col("k"))
    top = lambda share: F.sum(inside(share) * F.col("v")) / F.first("total")
    ranks = F.col("k") * F.col("before_k") + F.col("k") * (F.col("k") + 1) / 2
    out = rows.groupBy("n").agg(
        F.first("total").alias("total_gross_spend"),
        top(0.01).alias("top_1pct_share"),
        top(0.05).alias("top_5pct_share"),
        top(0.10).alias("top_10pct_share"),
        (2.0 * F.sum(ranks * F.col("v")) / (F.col("n") * F.first("total")) - (F.col("n") + 1.0) / F.col("n")).alias("gini"),
        F.sum(F.col("k") * F.pow(F.col("v") / F.col("total"), 2.0)).alias("hhi"),
    )
    return out.filter("total_gross_spend > 0").withColumnRenamed("n", "customers")


def pareto(df: DataFrame, key: str, value: str, n: int = 50) -> DataFrame:
    """The n leading keys with their share of the whole and its running sum (a top-n report)."""
    total = df.agg(F.sum(value).alias("__total"))
    ranked = df.orderBy(F.desc(value), key).limit(n).crossJoin(total)
    order = Window.orderBy(F.desc(value), key)
    return ranked.select(key, value, F.row_number().over(order).alias("rank"), ratio(F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.col("__total")).alias("cumulative_share"))


def lorenz(df: DataFrame, key: str, value: str, by: list[str] | None = None) -> DataFrame:
    """The Lorenz curve: shares of customers and of value, from the least value on, by group where asked.

    Numbers and sums go by levels of the value, within a group too, so a group of any size is in no single task.
    """
    by = list(by or [])
    rows = df.withColumn("__v", F.greatest(F.col(value), F.lit(0)))
    whole = rows.groupBy(*[F.col(b).alias(f"__of_{b}") for b in by]).agg(F.count(F.lit(1)).alias("__n"), F.sum("__v").alias("__t"))
    rows = numbered(rows.select(*by, key, value, "__v"), "__v", key, "__i", "__s", by)
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"__of_{b}"))
    rows = rows.join(F.broadcast(whole), on) if by else rows.crossJoin(F.broadcast(whole))  # a row for each group
    return rows.select(*by, key, value, ratio(F.col("__i"), F.col("__n")).alias("customer_share"), ratio(F.col("__s"), F.col("__t")).alias("value_share"))


def lorenz_gini(df: DataFrame, value: str, by: list[str], least: int = 10) -> DataFrame:
    """Gini by the closed form of the trapezoid rule, for groups of more than ``least`` rows.

    Customers are counted by value; k equal values have the ranks that follow those with less.
    """
    v = F.greatest(F.col(value), F.lit(0))
    counts = df.groupBy(*by, v.alias("__v")).agg(F.count(F.lit(1)).alias("__k"))
    rows = running(counts, ["__v"], ["__k"], by)
    ranks = (F.col("__k") * F.col("before___k") + F.col("__k") * (F.col("__k") + 1) / 2).cast("long")
    out = rows.groupBy(*by).agg(F.sum("__k").alias("n"), F.sum(ranks * F.col("__v")).cast("double").alias("__w"), F.sum(F.col("__k") * F.col("__v")).cast("double").alias("__t"))
    gini = 2.0 * F.col("__w") / (F.col("n") * F.col("__t")) - (F.col("n") + 1.0) / F.col("n")
    return out.filter((F.col("n") > least) & (F.col("__t") > 0)).select(*by, "n", gini.alias("gini"))
