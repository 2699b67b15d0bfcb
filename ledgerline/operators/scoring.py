"""RFM scores and segments in both variants, value tiers and lifecycle."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.ranking import numbered, running, value_ranks
from ledgerline.functions.quantiles import quantile_table, with_medians
from ledgerline.functions.semantics import ratio, right_closed_bin
from ledgerline.storage import settled


def edge_scores(value: str, quintiles: Sequence[float], reverse: bool = False) -> Column:
    """1 to 5 by distinct quintile edges: what lies above an edge scores more; levels spread evenly, halves to even."""
    edges = sorted(set(quintiles))
    levels = len(edges) + 1
    if levels == 1:
        return F.lit(3)
    above = sum((F.when(F.col(value) > e, 1).otherwise(0) for e in edges), F.lit(1))
    score = F.rint(1 + (above - 1) * F.lit(4.0) / (levels - 1)).cast("int")
    return 6 - score if reverse else score


# The names of segments and the scores that they stand for, in both variants below.
def _labels(rules: Sequence[tuple[Column, str]], other: str) -> Column:
    out = F.when(*rules[0])
    for rule in rules[1:]:
        out = out.when(*rule)
    return out.otherwise(other)


def segment_v1(r: Column, f: Column, m: Column) -> Column:
    return _labels(
        [
            ((r >= 4) & (f >= 4) & (m >= 4), "Champions"),
            ((r >= 3) & (f >= 4), "Frequent / loyal"),
            ((r <= 2) & (f >= 4) & (m >= 4), "Previously high-value / lapsed"),
            ((r <= 2) & (f >= 3), "At risk by recency"),
            ((r >= 4) & (f <= 2), "Recent / low frequency"),
            ((r <= 2) & (f <= 2), "Hibernating / low frequency"),
            ((r >= 3) & (f >= 3), "Potential loyalists"),
        ],
        "Mixed / needs attention",
    )


def segment_v2(r: Column, f: Column, m: Column) -> Column:
    return _labels(
        [
            ((r >= 4) & (f >= 4) & (m >= 4), "Champions"),
            ((r >= 3) & (f >= 4) & (m >= 3), "Loyal Customers"),
            ((r >= 4) & (f <= 2), "New Customers"),
            ((r >= 3) & (f >= 3), "Potential Loyalists"),
            ((r <= 2) & (f >= 3) & (m >= 3), "At Risk High Value"),
            ((r <= 2) & (f >= 2), "At Risk"),
            ((r <= 2) & (f <= 2) & (m <= 2), "Hibernating"),
        ],
        "Needs Attention",
    )


def rfm_scores(customers: DataFrame) -> DataFrame:
    """Variant 1 over recency_days, n_trips and net_spend; the customers are written once, and one pass gives all edges."""
    customers = settled(customers)
    edges = quantile_table(customers, ["recency_days", "n_trips", "net_spend"], (0.2, 0.4, 0.6, 0.8))
    out = customers.withColumns({n: edge_scores(c, edges[c], c == "recency_days") for n, c in (("r_score", "recency_days"), ("f_score", "n_trips"), ("m_score", "net_spend"))})
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return out.withColumns({"rfm_score": F.concat(*[c.cast("string") for c in (r, f, m)]), "rfm_segment": segment_v1(r, f, m)})


def rank_scores(df: DataFrame, values: Sequence[str], q: int = 5, reverse: Sequence[str] = ()) -> tuple[DataFrame, dict[str, Column]]:
    """Variant 2: quantile bins of average ranks, with repeated edges dropped; one value scores 3.

    Ranks go by the distinct values, of which there are fewer than rows; the rows get theirs by a join. The edges of all
    measures come from the same passes.
    """
    distinct = df.agg(*[F.countDistinct(v).alias(v) for v in values]).first()
    ranked = df
    for v in values:
        ranks = value_ranks(df, v).select(v, (F.col("before_n") + (F.col("n") + 1) / 2.0).alias(f"__rank_{v}"))
        ranked = ranked.join(ranks, v)
    ranked = settled(ranked)
    bins = {v: min(q, distinct[v]) for v in values}
    shares = sorted({k / b for b in bins.values() for k in range(b + 1)} | {0.0})
    edges = quantile_table(ranked, [f"__rank_{v}" for v in values], shares)
    out = {}
    for v in values:
        if distinct[v] < 2:
            out[v] = F.lit((q + 1) // 2)
            continue
        at = dict(zip(shares, edges[f"__rank_{v}"], strict=True))
        own = [at[k / bins[v]] for k in range(bins[v] + 1)]
        score = right_closed_bin(F.col(f"__rank_{v}"), own) + 1
        out[v] = len(set(own)) - score if v in reverse else score
    return ranked, out


def rfm_app(lines: DataFrame, as_of: dt.date) -> DataFrame:
    """Variant 2: recency, distinct transactions and revenue of each customer, scores and segment."""
    rows = lines.filter(F.col("customer_id").isNotNull() & (F.col("transaction_day") <= F.lit(as_of)))
    out = rows.groupBy("customer_id").agg(F.datediff(F.lit(as_of), F.max("transaction_day")).alias("recency"), F.countDistinct("transaction_id").alias("frequency"), F.sum("line_revenue").cast("double").alias("monetary"))
    out, scores = rank_scores(settled(out), ["recency", "frequency", "monetary"], reverse=["recency"])
    out = out.withColumns({f"{v[0]}_score": c for v, c in scores.items()})
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return out.select("customer_id", "recency", "frequency", "monetary", "r_score", "f_score", "m_score", F.concat(*[c.cast("string") for c in (r, f, m)]).alias("rfm_score"), segment_v2(r, f, m).alias("segment"))


# The slices of customers and their names.
TIERS = ((0, 1, "Top 1%"), (1, 5, "Top 1-5%"), (5, 10, "Top 5-10%"), (10, 20, "Top 10-20%"), (20, 70, "Middle 50%"), (70, 100, "Bottom 30%"))


def value_tiers(df: DataFrame, key: str, value: str) -> DataFrame:
    """Tiers as slices of the customers in order of value, highest first."""
    down = numbered(df.select(key, value, (-F.col(value)).alias("__down")), "__down", key, "__i").withColumn("__i", F.col("__i") - 1)
    rows = down.crossJoin(df.agg(F.count(F.lit(1)).alias("__n")))  # one row
    upto = lambda p: F.floor(F.col("__n") * p / 100)
    tier = _labels([(F.col("__i") < upto(b), name) for _, b, name in TIERS[:-1]], TIERS[-1][2])
    return rows.select(key, value, tier.alias("value_tier"))


def lifecycle(first_day: Column, last_day: Column, end: dt.date, window: int = 90) -> Column:
    since = F.lit(end - dt.timedelta(days=window))
    return F.when(first_day >= since, "New").when(last_day < since, "Dormant").otherwise("Active")


def segment_profile(df: DataFrame, segment: str) -> DataFrame:
    """Customers, medians, spend and repeat rate by segment."""
    out = df.groupBy(segment).agg(F.count(F.lit(1)).alias("customers"), F.sum("net_spend").alias("total_net_spend"), F.avg((F.col("n_trips") > 1).cast("double")).alias("repeat_rate"), F.avg("mean_trip_value").alias("avg_trip_value"))
    return with_medians(df, [segment], {f"median_{c}": c for c in ("recency_days", "n_trips", "net_spend")}, out)


def compare_segments(df: DataFrame, a: str, b: str) -> DataFrame:
    """Customers of each pair of segments, with shares of both sides and medians."""
    out = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("customers"), F.avg((F.col("n_trips") > 1).cast("double")).alias("repeat_rate"))
    out = with_medians(df, [a, b], {"median_net_spend": "net_spend", "median_recency_days": "recency_days"}, out)
    return out.withColumns({f"share_of_{k}": ratio(F.col("customers"), F.sum("customers").over(Window.partitionBy(k))) for k in (a, b)})


def auc(df: DataFrame, score: str, positive: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from average ranks, of each group of ``by``; null if one class is missing. ``positive`` is boolean."""
    counts = df.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col(positive)).alias("__yes"), F.count_if(~F.col(positive)).alias("__no"))
    rows = running(counts, [score], ["__n"], by)
    out = rows.groupBy(*by).agg(F.coalesce(F.sum(F.col("__yes") * (F.col("before___n") + (F.col("__n") + 1) / 2.0)), F.lit(0.0)).alias("s"), F.coalesce(F.sum("__yes"), F.lit(0)).alias("n1"), F.coalesce(F.sum("__no"), F.lit(0)).alias("n0"))
    return out.select(*by, ratio(F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2.0, F.col("n1") * F.col("n0")).alias("auc"), "n1", "n0")


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of average ranks, from counts of pairs of values, of each group of ``by``; null where a side does not vary."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).alias("a"), F.col(b).alias("b"))

    def twice(c: str) -> DataFrame:  # ranks as whole numbers
        counts = running(rows.groupBy(*by, c).agg(F.count(F.lit(1)).alias("n")), [c], ["n"], by)
        return counts.select(*by, c, (2 * F.col("before_n") + F.col("n") + 1).cast("decimal(20,0)").alias("r" + c))

    pairs = rows.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).cast("decimal(20,0)").alias("w")).join(twice("a"), [*by, "a"]).join(twice("b"), [*by, "b"])
    total = lambda *c: F.sum(reduce(lambda x, y: (x * y).cast("decimal(38,0)"), [F.col(x) for x in ("w", *c)])).cast("double")
    n, x, y, xx, yy, xy = total(), total("ra"), total("rb"), total("ra", "ra"), total("rb", "rb"), total("ra", "rb")
    return pairs.groupBy(*by).agg(ratio(xy - x * y / n, F.sqrt((xx - x * x / n) * (yy - y * y / n))).alias("spearman"))
