"""Priority actions, driver narrative and exploration of the customer table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.quantiles import grouped_quantiles
from ledgerline.functions.semantics import correlation, small_table
from ledgerline.operators import periods as pr
from ledgerline.operators.scoring import rfm_app
from ledgerline.storage import settled


# What each rule of the action matrix is about, by its priority.
RULES = {
    1: ("Retention", "historical_revenue_at_risk", "inactive_valuable_count > 0", "Reactivation rate, revenue recovered"),
    2: ("Retention", "historical_revenue_at_risk", "at_risk_monetary_sum > 0", "Reactivation rate, revenue per reactivated customer"),
    3: ("Acquisition", "future_lifetime_value", "new_customer_share > 20%", "Second purchase rate within 30/60/90 days"),
    4: ("Cross-sell", "aov_uplift_potential", "high_lift_pairs_count > 0", "Bundle attachment rate, AOV, units per order"),
    5: ("Merchandising", "revenue_mix_improvement", "category_opportunities_count > 0", "Category revenue growth, share of wallet"),
    6: ("Diagnostics", "risk_mitigation", "total_anomalies > 0", "Return to expected range"),
    7: ("Growth", "future_revenue_potential", "champions_count > 0", "Revenue per champion, category breadth, referral rate"),
}
MOST_PAIRS = 5


def category_kinds(category: DataFrame) -> DataFrame:
    """Categories with their kind: growing below the median share (emerging), growing from there on (scale), shrinking from there
    on (declining), or none."""
    mid = F.broadcast(category.agg(F.percentile("revenue_share", F.lit(0.5)).alias("__mid")))  # one row, of few categories
    large = F.col("revenue_share") >= F.col("__mid")
    kind = F.when((F.col("growth") > 0) & ~large, "emerging").when((F.col("growth") > 0) & large, "scale").when((F.col("growth") < 0) & large, "declining")
    return category.crossJoin(mid).withColumn("kind", kind).drop("__mid")


def action_matrix(lines: DataFrame, p: pr.Period, pairs: DataFrame | None = None) -> DataFrame:
    """The rules that apply to a period, a row for each: priority, category, title, impact (revenue, or null), impact_type,
    metric_to_track, affected_count and priority_rule.

    They look at valuable customers who stayed away, customers at risk and champions by RFM, new customers above a fifth,
    ``pairs`` with a lift above 2 (five at the most), kinds of categories, and unusual days.
    """
    keep = settled(pr.retention_metrics(lines, p))
    segments = settled(rfm_app(lines, p.end).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("monetary").alias("v")))
    category = settled(category_kinds(pr.category_period_features(lines, p)))
    one = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("v").alias("v"))
    risk, champions = one(segments.filter("segment IN ('At Risk High Value', 'At Risk')")), one(segments.filter("segment = 'Champions'"))
    kinds = category.agg(F.countDistinct("kind").alias("k"), F.count(F.lit(1)).alias("n"))
    days = pr.anomalies(lines, p).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("double")

    def rule(df: DataFrame, priority: int, title: Column, impact: Column, count: Column) -> DataFrame:
        about, kind, name, track = RULES[priority]
        return df.select(F.lit(priority).alias("priority"), F.lit(about).alias("category"), title.alias("title"), impact.alias("impact"), F.lit(kind).alias("impact_type"), F.lit(track).alias("metric_to_track"), count.cast("long").alias("affected_count"), F.lit(name).alias("priority_rule"))

    say = lambda before, n, after: F.concat(F.lit(before), n.cast("string"), F.lit(after))
    share = F.format_string("%.0f", F.col("new_customer_share") * 100)
    rules = [
        rule(keep.filter("inactive_valuable_count > 0"), 1, say("Win back ", F.col("inactive_valuable_count"), " valuable customers who stayed away"), F.col("inactive_valuable_revenue"), F.col("inactive_valuable_count")),
        rule(risk.filter("n > 0"), 2, say("Reach ", F.col("n"), " customers at risk"), F.col("v"), F.col("n")),
        rule(keep.filter("new_customer_share > 0.2"), 3, say("Guide the ", share, "% new customers to a second purchase"), none, F.lit(0)),
        rule(kinds.filter("k > 0"), 5, say("Review ", F.col("k"), " kinds of category opportunities"), none, F.col("n")),
        rule(days.filter("n > 0"), 6, say("Look into ", F.col("n"), " unusual signals"), none, F.col("n")),
        rule(champions.filter("n > 0"), 7, say("Deepen ties with ", F.col("n"), " champions"), F.col("v"), F.col("n")),
    ]
    if pairs is not None:
        found = pairs.filter("lift > 2").limit(MOST_PAIRS).agg(F.count(F.lit(1)).alias("n"))
        rules.insert(3, rule(found.filter("n > 0"), 4, say("Try ", F.col("n"), " bundles of items bought together"), none, F.col("n")))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def narrative(drivers: DataFrame) -> DataFrame:
    """One sentence on the revenue change and its main driver."""
    change = F.col("current_revenue") - F.col("prior_revenue")
    text = F.concat(F.lit("Revenue "), F.when(change >= 0, "rose by ").otherwise("fell by "), F.format_number(F.abs(change), 2), F.lit(", mostly through the "), F.regexp_replace("primary_driver", "_", " "), F.lit("."))
    return drivers.select(text.alias("narrative"))


def explorer(customers: DataFrame, segments: list[str] | None = None, alive: tuple[float, float] | None = None, least_value: float | None = None, n: int = 1000) -> DataFrame:
    """Customers by segment, probability of being active and value, the n most valuable (a top-n report)."""
    rows = customers
    if segments:
        rows = rows.filter(F.col("rfm_segment").isin(segments))
    if alive:
        rows = rows.filter(F.col("p_alive").between(*alive))
    if least_value is not None:
        rows = rows.filter(F.col("net_spend") >= least_value)
    return rows.orderBy(F.desc("net_spend"), "customer_id").limit(n)


def record(customers: DataFrame, customer_id: str) -> DataFrame:
    """One customer as feature and value."""
    row = customers.filter(F.col("customer_id") == customer_id)
    values = [c for c in row.columns if c != "customer_id"]
    return row.select("customer_id", *[F.col(c).cast("string").alias(c) for c in values]).unpivot(["customer_id"], values, "feature", "value")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlations of column pairs, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.agg(*[correlation(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("correlation")) for k, (a, b) in enumerate(pairs)])))


def segment_z_scores(df: DataFrame, segment: str, columns: list[str]) -> DataFrame:
    """Segments' means as deviations from the overall mean (long form)."""
    whole = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))])
    by = df.groupBy(segment).agg(*[F.avg(c).alias(c) for c in columns]).crossJoin(F.broadcast(whole))  # one row
    z = [((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0))).alias(c) for c in columns]
    return by.select(segment, *z).unpivot([segment], columns, "feature", "z")


def quartiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """Rows and quartiles of each group, of which there are few."""
    found = grouped_quantiles(df, [value], (0.25, 0.5, 0.75), [by])
    table = small_table(df, [by], "q1 double, median double, q3 double", [(*g, *v[value]) for g, v in found.items()])
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(table.withColumnRenamed(by, "__by"), F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")


def mean_by(df: DataFrame, by: str, value: str, n: int = 20) -> DataFrame:
    """The n leading groups by mean (a chart's data)."""
    return df.groupBy(by).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("rows")).orderBy(F.desc("mean"), by).limit(n)
