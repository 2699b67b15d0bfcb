"""Generated transaction lines with links from returns to purchases, and the constraints that lines should keep.

Every draw is a hash of the seed and what it is drawn for, so the rows do not depend on tasks and the same seed gives the same
history at any degree of parallelism.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.joining import checked_join
from ledgerline.schema import REQUIRED

DEPARTMENTS = ("Grocery", "Fresh", "Household", "Leisure")


def _draw(seed: int, what: str, *of: str | Column) -> Column:
    """A number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(what), *[F.col(c) if isinstance(c, str) else c for c in of]), 11).cast("double") / float(1 << 53)


def synthetic_lines(spark: SparkSession, customers: int, days: int = 730, products: int = 200, seed: int = 7, first: dt.date = dt.date(2023, 1, 1), return_share: float = 0.04) -> tuple[DataFrame, DataFrame]:
    """Lines with the required columns, and links (return_transaction_id, original_transaction_id, customer_id, product_id).

    A customer joins on some day, buys at a rate of their own that is exponentially distributed, and stops after a trip with a
    probability of their own; a trip has one to six products; some purchases come back within a month.
    """
    people = spark.range(customers).select(F.col("id").alias("c"))
    people = people.withColumns({"start": F.floor(_draw(seed, "start", "c") * days * 0.6), "gap": 3 - 40 * F.log(1 - _draw(seed, "rate", "c")), "leave": 0.02 + 0.25 * F.pow(_draw(seed, "leave", "c"), F.lit(2.0))})
    # as many trips as the rate allows, cut off by a geometric draw and by the end
    room = F.floor((days - F.col("start")) / F.col("gap"))
    stay = F.floor(F.log(1 - _draw(seed, "stay", "c")) / F.log(1 - F.col("leave")))
    trips = people.select("c", "start", "gap", F.explode(F.sequence(F.lit(0), F.least(room, stay).cast("int"))).alias("t"))
    day = F.least(F.floor(F.col("start") + F.col("gap") * (F.col("t") + 0.8 * _draw(seed, "day", "c", "t"))), F.lit(days - 1)).cast("int")
    trips = trips.withColumns({"day": day, "n": (1 + F.floor(6 * F.pow(_draw(seed, "size", "c", "t"), F.lit(1.5)))).cast("int")})
    items = trips.select("c", "t", "day", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).withColumn("p", F.floor(products * F.pow(_draw(seed, "product", "c", "t", "i"), F.lit(2.0))).cast("int"))
    items = items.groupBy("c", "t", "day", "p").agg(F.count(F.lit(1)).cast("double").alias("quantity"))
    base = F.round(0.5 + 40 * F.pow(_draw(seed, "price", "p"), F.lit(3.0)), 2)
    promo = F.when(_draw(seed, "promo", "p", F.floor(F.col("day") / 14)) < 0.15, 0.8).otherwise(1.0)
    department = F.element_at(F.array(*[F.lit(d) for d in DEPARTMENTS]), (F.pmod("p", F.lit(len(DEPARTMENTS))) + 1).cast("int"))
    when = lambda d, *k: F.timestamp_seconds((F.unix_date(F.lit(first)) + d).cast("long") * 86400 + 28800 + F.floor(36000 * _draw(seed, "time", *k)))
    sales = items.select(
        F.concat(F.lit("C"), F.lpad("c", 8, "0")).alias("customer_id"), when(F.col("day"), "c", "t").cast("timestamp_ntz").alias("transaction_date"), F.concat_ws("-", F.lit("S"), F.col("c").cast("string"), F.col("t").cast("string")).alias("transaction_id"),
        F.concat(F.lit("P"), F.lpad("p", 5, "0")).alias("product_id"), F.concat(F.lit("Product "), F.col("p").cast("string")).alias("product_description"), department.alias("department"), F.concat(department, F.lit(" "), F.pmod("p", F.lit(12)).cast("string")).alias("category"),
        F.round(base * promo, 2).alias("price"), "quantity", "c", "t", "day", "p",
    )
    back = sales.filter(_draw(seed, "return", "c", "t", "p") < return_share).withColumn("late", (1 + F.floor(30 * _draw(seed, "late", "c", "t", "p"))).cast("int")).filter(F.col("day") + F.col("late") < days)
    returned = F.concat_ws("-", F.lit("R"), F.col("c").cast("string"), F.col("t").cast("string"), F.col("p").cast("string"))
    returns = back.withColumns({"original_transaction_id": F.col("transaction_id"), "transaction_id": returned, "quantity": -F.col("quantity"), "transaction_date": F.col("transaction_date") + F.make_interval(days=F.col("late"))})
    links = returns.select(F.col("transaction_id").alias("return_transaction_id"), "original_transaction_id", "customer_id", "product_id")
    return sales.select(*REQUIRED).unionByName(returns.select(*REQUIRED)), links


def constraint_violations(lines: DataFrame) -> DataFrame:
    """constraint_name and how many rows, keys or transactions break it."""
    missing = F.lit(False)
    for c in REQUIRED:
        missing = missing | F.col(c).isNull()
    rows = lines.agg(F.count_if(missing).alias("a"), F.count_if(~F.coalesce((F.col("price") > 0) & (F.col("quantity") != 0), F.lit(True))).alias("b"))
    several = lambda key, *of: lines.groupBy(*key).agg(*[F.countDistinct(c).alias(c + "_") for c in of]).agg(F.count_if(F.greatest(*[F.col(c + "_") for c in of], F.lit(0)) > 1).alias("n"))
    named = [
        ("missing values", rows.select(F.col("a").alias("n"))),
        ("price not above 0 or quantity 0", rows.select(F.col("b").alias("n"))),
        ("repeated product in a transaction", lines.groupBy("transaction_id", "product_id").agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") > 1).alias("n"))),
        ("transaction with several customers or times", several(["transaction_id"], "customer_id", "transaction_date")),
        ("product with several descriptions", several(["product_id"], "product_description", "department", "category")),
    ]
    out = None
    for name, df in named:
        row = df.select(F.lit(name).alias("constraint_name"), F.col("n").alias("violations"))
        out = row if out is None else out.unionByName(row)
    return out


def return_violations(lines: DataFrame, links: DataFrame) -> DataFrame:
    """Returns whose sign, price, time or quantity do not agree with the purchase that they are linked to.

    A return has one link, and a purchase line may have several returns.
    """
    side = lambda c, q: lines.filter(q).select(F.col("transaction_id").alias(f"{c}_transaction_id"), "product_id", "customer_id", *[F.col(x).alias(f"{c}_{x}") for x in ("price", "quantity", "transaction_date")])
    keys = ["product_id", "customer_id"]
    both = checked_join(links, side("original", "quantity > 0"), ["original_transaction_id", *keys], "many_to_one")
    both = checked_join(both, side("return", "quantity < 0"), ["return_transaction_id", *keys], "one_to_one")
    wrong = (F.col("original_price") != F.col("return_price")) | (F.col("return_transaction_date") <= F.col("original_transaction_date")) | (-F.col("return_quantity") > F.col("original_quantity"))
    lost = links.join(both.select("return_transaction_id"), "return_transaction_id", "left_anti").select("return_transaction_id", F.lit("no such purchase or return").alias("problem"))
    return both.filter(wrong).select("return_transaction_id", F.lit("price, time or quantity").alias("problem")).unionByName(lost)
