"""Repeat-purchase survival and cohort retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.semantics import ratio, wilson

LANDMARKS = (7, 14, 30, 60, 90, 180, 365)


def repeat_times(events: DataFrame, as_of: dt.date, burn_in: int = 90) -> DataFrame:
    """Days from a customer's first to second event, or to ``as_of`` without one, and whether they are new after burn-in."""
    order = Window.partitionBy("customer_id").orderBy("transaction_day")
    rows = events.filter(F.col("transaction_day") <= F.lit(as_of)).withColumn("i", F.row_number().over(order)).filter("i <= 2")
    out = rows.groupBy("customer_id").agg(F.min("transaction_day").alias("first_trip_day"), F.max(F.when(F.col("i") == 2, F.col("transaction_day"))).alias("second"))
    begin = events.agg(F.min("transaction_day").alias("begin"))
    out = out.crossJoin(F.broadcast(begin))  # one row
    return out.select(
        "customer_id",
        "first_trip_day",
        (F.col("first_trip_day") >= F.date_add("begin", burn_in)).alias("is_new_after_burn_in"),
        F.datediff(F.coalesce("second", F.lit(as_of)), "first_trip_day").alias("duration"),
        F.col("second").isNotNull().alias("repeated"),
    )


def survival_groups(times: DataFrame) -> DataFrame:
    """Each customer in all groups it belongs to: all, new or left-censored, and the quarter of new ones."""
    quarter = F.concat(F.year("first_trip_day").cast("string"), F.lit("Q"), F.quarter("first_trip_day").cast("string"))
    new = F.col("is_new_after_burn_in")
    groups = F.array_compact(F.array(F.lit("all"), F.when(new, "new_after_burn_in").otherwise("left_censored"), F.when(new, F.concat(F.lit("new_"), quarter))))
    return times.withColumn("group", F.explode(groups))


def kaplan_meier(times: DataFrame, by: str = "group", least: int = 20, landmarks: tuple[int, ...] = LANDMARKS) -> DataFrame:
    """Share repeated by each landmark, with Greenwood intervals, for groups of ``least`` customers or more.

    The table of risks has a row for each group and duration in days; running products are sums of logs.
    """
    at = times.groupBy(by, "duration").agg(F.count(F.lit(1)).alias("n"), F.count_if("repeated").alias("d"))
    order = Window.partitionBy(by).orderBy("duration")
    after, before = order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(by)
    at = at.withColumns({"risk": F.sum("n").over(after), "size": F.sum("n").over(whole), "longest": F.max("duration").over(whole)}).filter(F.col("size") >= least)
    all_gone = (F.col("d") >= F.col("risk")) & (F.col("d") > 0)
    at = at.withColumns({
        "log_s": F.sum(F.when(all_gone, 0.0).otherwise(F.log(1 - F.col("d") / F.col("risk")))).over(before),
        "gone": F.max(all_gone.cast("int")).over(before),
        "var": F.sum(F.when(F.col("risk") > F.col("d"), F.col("d") / (F.col("risk") * (F.col("risk") - F.col("d")))).otherwise(0.0)).over(before),
    })
    marks = at.withColumn("landmark", F.explode(F.array(*[F.lit(x) for x in landmarks]))).filter(F.col("landmark") <= F.col("longest"))
    past = F.col("duration") <= F.col("landmark")
    out = marks.groupBy(by, "landmark").agg(
        F.first("size").alias("customers"), F.coalesce(F.sum(F.when(F.col("duration") >= F.col("landmark"), F.col("n"))), F.lit(0)).alias("at_risk"),
        F.max_by(F.when(past, F.col("log_s")), F.when(past, F.col("duration"))).alias("log_s"), F.max(F.when(past, F.col("gone"))).alias("gone"), F.max(F.when(past, F.col("var"))).alias("var"),
    )
    s = F.when(F.col("gone") == 1, 0.0).otherwise(F.exp(F.coalesce("log_s", F.lit(0.0))))
    half = 1.96 * s * F.sqrt(F.coalesce("var", F.lit(0.0)))
    bound = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return out.select(by, "landmark", "customers", "at_risk", (1 - s).alias("repeat_probability"), bound(1 - s - half).alias("ci95_lower"), bound(1 - s + half).alias("ci95_upper"))


def repeat_survival(events: DataFrame, as_of: dt.date, burn_in: int = 90) -> DataFrame:
    return kaplan_meier(survival_groups(repeat_times(events, as_of, burn_in)))


def cohort_retention(events: DataFrame, as_of: dt.date, burn_in: int = 90) -> DataFrame:
    """New customers' monthly cohorts by age in months: active customers, rate with Wilson interval, and whether the month is over."""
    new = repeat_times(events, as_of, burn_in).filter("is_new_after_burn_in").select("customer_id", F.trunc("first_trip_day", "MM").alias("cohort"))
    age = F.months_between(F.trunc("transaction_day", "MM"), F.col("cohort")).cast("int")
    active = events.filter(F.col("transaction_day") <= F.lit(as_of)).join(new, "customer_id").groupBy("cohort", age.alias("age")).agg(F.countDistinct("customer_id").alias("active_customers"))
    last = F.months_between(F.trunc(F.lit(as_of), "MM"), F.col("cohort")).cast("int")
    grid = new.groupBy("cohort").agg(F.count(F.lit(1)).alias("cohort_customers")).withColumn("age", F.explode(F.sequence(F.lit(0), last)))
    out = grid.join(active, ["cohort", "age"], "left").fillna(0, ["active_customers"])
    low, high = wilson(F.col("active_customers"), F.col("cohort_customers"))
    complete = F.last_day(F.add_months("cohort", F.col("age"))) <= F.lit(as_of)
    return out.select(F.date_format("cohort", "yyyy-MM").alias("cohort_month"), "age", "cohort_customers", "active_customers", ratio(F.col("active_customers"), F.col("cohort_customers")).alias("retention_rate"), low.alias("ci95_lower"), high.alias("ci95_upper"), complete.alias("is_complete_month"))
