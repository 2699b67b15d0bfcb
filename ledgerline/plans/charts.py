"""The data of the report's charts, by the name of the chart; drawing them is left to the caller."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import affinity, features, overview, scoring, summaries, survival
from ledgerline.operators import events as ev
from ledgerline.operators import periods as pr
from ledgerline.operators import quality as qa
from ledgerline.plans.basket_queries import FULL
from ledgerline.plans.tables import result_tables

# The charts of the report.
CHARTS = ("validation", "calibration", "customer_map", "segment_value", "cluster_selection", "rfm", "survival", "cohorts", "concentration", "trend", "categories", "rules", "next_trip", "momentum", "promo", "cadence", "quality", "lorenz_segments", "action_quadrant", "affinity_network", "promo_return_lollipop", "cohort_retention_revenue")


def chart_tables(lines: DataFrame, as_of: dt.date, horizon: int = 90) -> dict[str, Callable[[], DataFrame]]:
    """What makes the data of each chart; nothing runs before it is asked for, and shared tables are computed once."""
    tables = result_tables(lines, as_of, horizon)
    events = ev.purchase_events(lines, as_of)
    customers = tables["customer_features"]

    def quadrant() -> DataFrame:
        rows = customers().filter("p_alive IS NOT NULL")
        return pr.quadrants(rows, "p_alive", "expected_value", ("Nurture", "Grow", "Win back", "Let go")).select("customer_id", "p_alive", "expected_value", "quadrant")

    def lollipop() -> DataFrame:
        return customers().groupBy("cluster_label").agg(F.avg("promo_spend_share").alias("promo_spend_share"), F.avg("return_value_ratio").alias("return_value_ratio"), F.count(F.lit(1)).alias("customers"))

    def cadence() -> DataFrame:
        gaps = features.interpurchase_intervals(events).filter("interpurchase_interval_days IS NOT NULL")
        return gaps.groupBy((F.floor(F.col("interpurchase_interval_days") / 7) * 7).alias("from_day")).agg(F.count(F.lit(1)).alias("intervals"))

    def momentum() -> DataFrame:
        rows = customers().filter("spend_change_pct IS NOT NULL")
        return rows.groupBy((F.floor(F.least(F.col("spend_change_pct"), F.lit(500.0)) / 25) * 25).alias("from_pct")).agg(F.count(F.lit(1)).alias("customers"))

    made = {
        "validation": tables["holdout_metrics"],
        "calibration": tables["holdout_calibration"],
        "customer_map": lambda: customers().select("customer_id", "p_alive", "expected_value", "expected_trips", "rfm_segment", "cluster_label"),
        "segment_value": lambda: overview.segment_overview(customers()),
        "cluster_selection": tables["cluster_diagnostics"],
        "rfm": tables["rfm_segment_profiles"],
        "survival": tables["repeat_survival"],
        "cohorts": tables["cohort_retention_new_customers"],
        "concentration": lambda: summaries.lorenz(summaries.customer_spend(events), "customer_id", "gross_spend"),
        "trend": tables["monthly_summary"],
        "categories": tables["category_summary"],
        "rules": tables["basket_affinity"],
        "next_trip": tables["next_trip_affinity"],
        "momentum": momentum,
        "promo": lambda: customers().select("customer_id", "promo_spend_share", "mean_price_index"),
        "cadence": cadence,
        "quality": lambda: qa.issue_counts(lines),
        "lorenz_segments": lambda: summaries.lorenz(customers(), "customer_id", "net_spend", ["rfm_segment"]),
        "action_quadrant": quadrant,
        "affinity_network": lambda: affinity.affinity_network(affinity.associations(lines, FULL)),
        "promo_return_lollipop": lollipop,
        "cohort_retention_revenue": lambda: survival.cohort_retention(events, as_of).join(overview.cohort_sizes(scoring.rfm_scores(features.customer_snapshot(lines, as_of))).select("cohort_month", "revenue"), "cohort_month", "left"),
    }
    return {name: made[name] for name in CHARTS}
