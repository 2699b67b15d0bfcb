"""Data-quality counts, cleaning rules, structural checks and accounting invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.semantics import when_sum
from ledgerline.schema import REQUIRED


def issue_counts(lines: DataFrame, extra_columns: int = 0) -> DataFrame:
    """issue, rows: all counts from one pass, and the rows beyond the first of exact duplicates from a second."""
    has = lambda flag, c: F.col(flag) if flag in lines.columns else F.col(c).isNotNull()
    counts = {
        "missing_customer_id_rows": F.col("customer_id").isNull(),
        "missing_transaction_id_rows": F.col("transaction_id").isNull(),
        "missing_product_id_rows": F.col("product_id").isNull(),
        "missing_category_rows": F.col("category").isNull(),
        "missing_transaction_date_rows": ~has("has_date", "transaction_date"),
        "malformed_transaction_date_rows": has("has_date", "transaction_date") & F.col("transaction_date").isNull(),
        "missing_price_rows": F.col("price").isNull(),
        "invalid_price_conversion_rows": has("has_price", "price") & F.col("price").isNull(),
        "negative_price_rows": F.col("price") < 0,
        "zero_price_rows": F.col("price") == 0,
        "missing_quantity_rows": F.col("quantity").isNull(),
        "invalid_quantity_conversion_rows": has("has_quantity", "quantity") & F.col("quantity").isNull(),
        "negative_quantity_return_rows": F.col("quantity") < 0,
        "zero_quantity_rows": F.col("quantity") == 0,
        "uncomputable_line_revenue_rows": F.col("line_revenue").isNull(),
    }
    one = lines.agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
    excess = lines.groupBy(*REQUIRED).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("exact_duplicate_excess_rows"))
    wide = one.crossJoin(excess).withColumn("ignored_extra_columns", F.lit(extra_columns).cast("long"))  # one row each
    return wide.unpivot([], wide.columns, "issue", "rows")


def clean(lines: DataFrame, duplicates: bool = False, zero_quantity: bool = False, negative_price: bool = False) -> DataFrame:
    """Lines without what the flags name; missing quantities and prices stay."""
    if duplicates:
        lines = lines.dropDuplicates(REQUIRED)
    if zero_quantity:
        lines = lines.filter("quantity IS NULL OR quantity <> 0")
    if negative_price:
        lines = lines.filter("price IS NULL OR price >= 0")
    return lines


def structural_checks(lines: DataFrame) -> DataFrame:
    """check, violations: identifiers whose use does not fit the grain."""
    keyed = lines.filter("customer_id IS NOT NULL AND transaction_id IS NOT NULL")
    count = lambda df, name: df.agg(F.count_if("bad").alias("violations")).select(F.lit(name).alias("check"), "violations")
    owners = keyed.groupBy("transaction_id").agg((F.countDistinct("customer_id") > 1).alias("bad"))
    days = keyed.filter("transaction_day IS NOT NULL").groupBy("customer_id", "transaction_id").agg((F.countDistinct("transaction_day") > 1).alias("bad"))
    kinds = lines.filter("product_id IS NOT NULL").groupBy("product_id").agg(((F.countDistinct("department") > 1) | (F.countDistinct("category") > 1)).alias("bad"))
    return (
        count(owners, "transaction_ids_used_by_multiple_customers")
        .unionByName(count(days, "customer_transaction_keys_spanning_multiple_days"))
        .unionByName(count(kinds, "product_ids_with_conflicting_category_or_department"))
    )


def accounting_totals(lines: DataFrame) -> DataFrame:
    """Gross, returns and net of all lines, and by how much gross less returns misses the net."""
    buy, back = F.col("quantity") > 0, F.col("quantity") < 0
    out = lines.agg(when_sum(buy, F.col("line_revenue")).alias("gross"), when_sum(back, -F.col("line_revenue")).alias("returns"), F.coalesce(F.sum("line_revenue").cast("double"), F.lit(0.0)).alias("net"))
    return out.withColumn("difference", F.round(F.col("gross") - F.col("returns") - F.col("net"), 2) + 0.0)


def assert_accounting(lines: DataFrame, summaries: dict[str, DataFrame], tolerance: float = 0.01) -> None:
    """Raise unless every roll-up has the totals of the lines."""
    want = accounting_totals(lines).first()
    if abs(want["difference"]) > tolerance:
        raise ValueError(f"gross less returns differs from net by {want['difference']}")
    for name, df in summaries.items():
        got = df.agg(F.sum("gross_purchase_revenue"), F.sum("return_value"), F.sum("net_revenue")).first()
        if any(abs((a or 0) - b) > tolerance * max(1.0, abs(b) * 1e-6) for a, b in zip(got, want[:3], strict=True)):
            raise ValueError(f"{name} does not add up: {tuple(got)} against {tuple(want[:3])}")


def feature_contract(df: DataFrame, required: list[str], optional: list[str], strict: bool = False) -> dict[str, list[str]]:
    """Required and optional features that a table lacks."""
    out = {"missing_required": [c for c in required if c not in df.columns], "missing_optional": [c for c in optional if c not in df.columns]}
    if strict and out["missing_required"]:
        raise ValueError(f"missing required features: {out['missing_required']}")
    return out
