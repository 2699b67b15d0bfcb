"""Comparisons and figures of the dashboard, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.ranking import running
from ledgerline.functions.semantics import most_frequent, ratio


def segment_difference(df: DataFrame, segment: str, a: str, b: str, metrics: list[str]) -> DataFrame:
    """metric, its means in two segments and by how many percent the second differs; null where the first mean is 0."""
    mean = lambda m, s: F.avg(F.when(F.col(segment) == s, F.col(m)))
    wide = df.agg(*[mean(m, s).alias(f"{m}:{k}") for m in metrics for k, s in (("a", a), ("b", b))])
    rows = wide.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}:a`").alias("mean_a"), F.col(f"`{m}:b`").alias("mean_b")) for m in metrics])))
    return rows.withColumn("difference_pct", F.when(F.col("mean_a") != 0, (F.col("mean_b") - F.col("mean_a")) / F.col("mean_a") * 100))


def crosstab(df: DataFrame, a: str, b: str, total: str = "All") -> DataFrame:
    """Customers of each pair of values, with margins named ``total``; rows that lack a value are left out."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).cube(a, b).agg(F.count(F.lit(1)).alias("customers"))
    return rows.select(F.coalesce(F.col(a).cast("string"), F.lit(total)).alias(a), F.coalesce(F.col(b).cast("string"), F.lit(total)).alias(b), "customers")


def cohort_sizes(customers: DataFrame) -> DataFrame:
    """Customers and their net spend by the month of their first purchase."""
    month = F.date_format("first_day", "yyyy-MM")
    return customers.groupBy(month.alias("cohort_month")).agg(F.count(F.lit(1)).alias("customers"), F.sum("net_spend").alias("revenue"))


def leading_sum(df: DataFrame, value: str, n: int) -> float:
    """The sum of the n largest values: rows are counted by value, and sums over levels of it say which are among the n."""
    counts = df.groupBy((-F.col(value)).alias("__down")).agg(F.count(F.lit(1)).alias("k"))
    rows = running(counts, ["__down"], ["k"])
    taken = F.least(F.greatest(F.lit(n) - F.col("before_k"), F.lit(0)), F.col("k"))
    return rows.agg(F.sum(-F.col("__down") * taken)).first()[0]


def dashboard_cards(scored: DataFrame, survival: DataFrame, metrics: DataFrame, day: int = 90) -> DataFrame:
    """card and value: customers, share likely to be active, value expected and the leading tenth's share of it, customers back
    within ``day`` days, and how well the purchase model ranks."""
    value = F.greatest(F.coalesce("expected_value", F.lit(0.0)), F.lit(0.0))
    whole = scored.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("p_alive").isNotNull(), (F.col("p_alive") >= 0.5).cast("double"))).alias("active"), F.sum(value).alias("v")).first()
    n = whole["n"]
    top = leading_sum(scored.select(value.alias("v")), "v", max(1, -(-n // 10))) if n >= 10 and whole["v"] else None
    back = survival.filter((F.col("group") == "all") & (F.col("landmark") == day)).select("repeat_probability").first()
    model = metrics.filter("model = 'BG/NBD' AND status = 'completed'").select("auc", "spearman").first()
    cards = [
        ("customers_scored", float(n)),
        ("likely_active_share", whole["active"]),
        ("expected_value", whole["v"]),
        ("top_tenth_share", top / whole["v"] if top is not None else None),
        (f"repeat_within_{day}_days", back[0] if back else None),
        ("model_auc", model["auc"] if model else None),
        ("model_spearman", model["spearman"] if model else None),
    ]
    return scored.sparkSession.createDataFrame([(k, None if v is None else float(v)) for k, v in cards], "card string, value double")


# How the label of a segment begins, and what to test with it.
HINTS = (
    ("Active / higher", "Hypothesis: protect and grow. Test retention perks against a holdout group."),
    ("Active / lower", "Hypothesis: raise basket value or breadth. Test cross-category offers."),
    ("Lapsing", "Hypothesis: win-back candidates. Test timed reminders against a holdout group."),
    ("Lapsed", "Hypothesis: low-cost reactivation only. Check cost against expected revenue first."),
)
OTHER_HINT = "Describe first; test actions against a holdout group."


def segment_overview(scored: DataFrame, label: str = "cluster_label", top: str = "top_category") -> DataFrame:
    """Each segment's customers, means of what the models expect and of behaviour, most common top category, its shares of
    customers and of expected value, and a hypothesis to test; customers without a label are one segment."""
    rows = scored.withColumn("segment", F.coalesce(F.col(label), F.lit("Unclustered")))
    means = [c for c in ("promo_spend_share", "return_value_ratio", "recency_days") if c in scored.columns]
    out = rows.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"), F.avg("p_alive").alias("mean_p_alive"), F.avg("expected_trips").alias("expected_trips"), F.avg("expected_trip_value").alias("expected_value_per_trip"), F.coalesce(F.sum("expected_value"), F.lit(0.0)).alias("total_expected_revenue"),
        *[F.avg(c).alias(f"mean_{c}") for c in means],
    )
    if top in scored.columns:
        out = out.join(most_frequent(rows, ["segment"], top, "most_common_top_category"), "segment", "left")
    whole = Window.partitionBy()  # a row for each segment
    hint = F.lit(OTHER_HINT)
    for begins, text in reversed(HINTS):
        hint = F.when(F.col("segment").startswith(begins), text).otherwise(hint)
    total = F.sum("total_expected_revenue").over(whole)
    return out.withColumns({"share_of_customers": ratio(F.col("customers"), F.sum("customers").over(whole)), "share_of_expected_revenue": F.when(total > 0, F.col("total_expected_revenue") / total), "hypothesis_to_test": hint})
