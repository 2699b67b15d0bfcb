"""Transaction lines from the star schema: an order is a transaction, a part a product, its brand and type the departments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import table


def star_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders and line items; flag R marks returns. Money is decimal, so sums do not depend on their order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    returned = F.col("l_returnflag") == "R"
    money = F.col("l_extendedprice").cast("decimal(18,2)")
    return (
        items.join(orders, items.l_orderkey == orders.o_orderkey)
        .join(part, items.l_partkey == part.p_partkey)
        .select(
            F.col("o_custkey").cast("string").alias("customer_id"),
            F.to_date("o_orderdate").alias("transaction_day"),
            F.col("o_orderdate").alias("transaction_date"),
            F.col("o_orderkey").cast("string").alias("transaction_id"),
            F.col("l_partkey").cast("string").alias("product_id"),
            F.col("p_name").alias("product_description"),
            F.col("p_brand").alias("department"),
            F.col("p_type").alias("category"),
            F.try_divide("l_extendedprice", "l_quantity").alias("price"),
            F.when(returned, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"),
            F.when(returned, -money).otherwise(money).cast("decimal(18,2)").alias("line_revenue"),
        )
    )


#: The same lines, and their daily purchase events, for SQL oracles.
LINES_SQL = """
lines AS (
  SELECT o.o_custkey::VARCHAR AS customer_id, o.o_orderdate::DATE AS transaction_day, o.o_orderdate AS transaction_date,
    o.o_orderkey::VARCHAR AS transaction_id, l.l_partkey::VARCHAR AS product_id, p.p_name AS product_description,
    p.p_brand AS department, p.p_type AS category, l.l_extendedprice / l.l_quantity AS price,
    CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END AS quantity,
    CAST(CASE WHEN l.l_returnflag = 'R' THEN -(l.l_extendedprice::DECIMAL(18,2)) ELSE l.l_extendedprice::DECIMAL(18,2) END AS DECIMAL(18,2)) AS line_revenue
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
), cutoff AS (SELECT max(transaction_day) AS d FROM lines),
trips AS (
  SELECT customer_id, transaction_day, sum(greatest(line_revenue, 0)) AS trip_value, count(*) AS n_lines,
    count(DISTINCT product_id) AS n_products, sum(quantity) AS n_units
  FROM lines WHERE quantity > 0 AND customer_id IS NOT NULL AND transaction_day IS NOT NULL
  GROUP BY ALL HAVING sum(greatest(line_revenue, 0)) > 0
)"""
