"""Basket affinity: associated item pairs with inference at customer level, and transitions to the next basket."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.ranking import least_from, running
from ledgerline.functions.semantics import hash_half, ratio, steady_sum
from ledgerline.functions.special import chi2_sf_1df
from ledgerline.operators.events import DAY, baskets
from ledgerline.storage import settled


@dataclass(frozen=True)
class AffinityConfig:
    level: str = "category"
    grain: str = DAY
    key_mode: str = "customer-transaction"
    min_support: float = 0.01
    min_confidence: float = 0.20
    min_lift: float = 1.0
    fdr_alpha: float = 0.05
    max_items: int | None = 100  # budgets; None is without bound
    max_baskets: int | None = 50_000
    max_items_per_basket: int | None = 30
    max_pair_operations: int | None = 1_000_000
    min_customers: int = 30
    seed: int = 42

    def to_dict(self) -> dict:
        return asdict(self)


def _within(sizes: DataFrame, most: int, seed: int) -> DataFrame:
    """Customers in order of a hash of their id, as long as the sum of their ``n`` stays within ``most``.

    Sums run over levels of the hash and then inside a level, so no task holds all customers.
    """
    hashed = F.conv(F.substring(F.md5(F.concat("customer_id", F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")
    rows = running(sizes.select("customer_id", F.col("n").cast("long").alias("n"), hashed.alias("h")), ["h", "customer_id"], ["n"])
    return rows.filter(F.col("before_n") + F.col("n") <= most).select("customer_id")


def candidate_baskets(lines: DataFrame, c: AffinityConfig) -> DataFrame:
    """Baskets of sampled customers with the items that most customers buy.

    Whole customers are taken in order of a hash of their id, as long as their baskets, and then their pairs, stay within
    the budgets; without budgets, all are. Each basket keeps its most common items.
    """
    all_ = baskets(lines, c.level, c.grain, c.key_mode).filter("customer_id IS NOT NULL")
    if c == replace(c, max_items=None, max_baskets=None, max_items_per_basket=None, max_pair_operations=None):
        return all_.select("customer_id", "basket_key", "items")  # without budgets no order of items or customers matters
    reach = all_.select("customer_id", F.explode("items").alias("item")).distinct().groupBy("item").agg(F.count(F.lit(1)).alias("reach"))
    order = F.struct((-F.col("reach")).alias("r"), "item")
    ranks = reach.select("item", order.alias("ix"))
    if c.max_items is not None:
        ranks = F.broadcast(ranks.orderBy("ix").limit(c.max_items))  # at most max_items rows
    if c.max_baskets is not None:
        all_ = all_.join(_within(all_.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")), c.max_baskets, c.seed), "customer_id", "left_semi")
    held = all_.select("customer_id", "basket_key", F.explode("items").alias("item")).join(ranks, "item")
    common = F.array_sort(F.collect_list(F.struct("ix", "item")))
    out = held.groupBy("customer_id", "basket_key").agg((common if c.max_items_per_basket is None else F.slice(common, 1, c.max_items_per_basket)).alias("p"))
    out = out.select("customer_id", "basket_key", F.transform("p", lambda x: x["item"]).alias("items"))
    if c.max_pair_operations is not None:
        cost = out.groupBy("customer_id").agg(F.sum(F.size("items") * (F.size("items") - 1) / 2).alias("n"))
        out = out.join(_within(cost, c.max_pair_operations, c.seed), "customer_id", "left_semi")
    return out


def _pairs(held: DataFrame, seed: int) -> DataFrame:
    rows = held.select("customer_id", F.array_sort("items").alias("i"), hash_half(F.col("customer_id"), seed).alias("half"))
    left = rows.select("customer_id", "half", "i", F.posexplode("i").alias("p", "a"))
    return left.select("customer_id", "half", "a", F.explode(F.slice("i", F.col("p") + 2, F.size("i"))).alias("b"))


def _counted_pairs(pairs: DataFrame) -> DataFrame:
    by_customer = pairs.groupBy("a", "b", "customer_id", "half").agg(F.count(F.lit(1)).alias("n"))
    return by_customer.groupBy("a", "b").agg(F.sum("n").alias("pair_baskets"), F.count(F.lit(1)).alias("n_ab"), F.count_if(F.col("half") == 0).alias("n_ab_0"), F.count_if(F.col("half") == 1).alias("n_ab_1"))


def pair_counts(held: DataFrame, seed: int = 42) -> DataFrame:
    """Item pairs (a < b by name) with baskets and customers, also by half of the customers."""
    return _counted_pairs(_pairs(held, seed))


PAIR_BUCKETS = 1 << 20


def frequent_pairs(held: DataFrame, least: float, seed: int = 42, buckets: int = PAIR_BUCKETS) -> DataFrame:
    """What :func:`pair_counts` gives for the pairs in ``least`` baskets or more, without shuffling the others (Park, Chen and Yu
    1995).

    Items in fewer baskets go first. A first pass counts hashes of pairs, and only pairs whose bucket reaches ``least`` are
    then counted exactly. A basket's pairs are made twice but stay in their task; shuffled are at most ``buckets`` counts of
    each task, and rows of pairs whose bucket is full. Buckets that are full are at most pairs a basket over least share.
    """
    often = held.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("item")
    rows = held.select("customer_id", "basket_key", F.explode("items").alias("item")).join(often, "item")
    rows = settled(rows.groupBy("customer_id", "basket_key").agg(F.array_sort(F.collect_list("item")).alias("items")).filter(F.size("items") > 1))
    paired = _pairs(rows, seed).withColumn("bucket", F.pmod(F.xxhash64("a", "b"), F.lit(buckets)))
    full = paired.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("bucket")
    return _counted_pairs(paired.join(full, "bucket", "left_semi")).filter(F.col("pair_baskets") >= least)


def item_counts(held: DataFrame, seed: int = 42) -> DataFrame:
    rows = held.select("customer_id", F.explode("items").alias("item"), hash_half(F.col("customer_id"), seed).alias("half"))
    by_customer = rows.groupBy("item", "customer_id", "half").agg(F.count(F.lit(1)).alias("n"))
    return by_customer.groupBy("item").agg(F.sum("n").alias("baskets"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("half") == 0).alias("n_0"), F.count_if(F.col("half") == 1).alias("n_1"))


def totals(held: DataFrame, seed: int = 42) -> DataFrame:
    """One row: baskets, and customers in all and in each half."""
    by_customer = held.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"), F.min(hash_half(F.col("customer_id"), seed)).alias("half"))
    return by_customer.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_baskets"), F.count(F.lit(1)).alias("N"), F.count_if(F.col("half") == 0).alias("N_0"), F.count_if(F.col("half") == 1).alias("N_1"))


def pair_statistics(df: DataFrame, n_ab: str = "n_ab", n_a: str = "n_a", n_b: str = "n_b", n: str = "N") -> DataFrame:
    """Lift, odds ratio with a half added to each cell and its interval, and Yates' chi-square of a two-by-two table."""
    ab, a, b, total = (F.col(c).cast("double") for c in (n_ab, n_a, n_b, n))
    cells = [ab + 0.5, a - ab + 0.5, b - ab + 0.5, total - a - b + ab + 0.5]
    log_or = F.log(cells[0] * cells[3] / (cells[1] * cells[2]))
    se = F.sqrt(sum((1 / c for c in cells[1:]), 1 / cells[0]))
    spread = a * b * (total - a) * (total - b)
    chi2 = F.when(spread > 0, F.pow(F.abs(ab * total - a * b) - total / 2, 2.0) * total / spread)
    out = df.withColumns({
        "lift": ratio(ratio(ab, a), ratio(b, total)),
        "odds_ratio": F.exp(log_or),
        "or_ci_lower": F.exp(log_or - 1.96 * se),
        "or_ci_upper": F.exp(log_or + 1.96 * se),
        "chi2": chi2,
    })
    p = F.pandas_udf(lambda x: pd.Series(chi2_sf_1df(x.to_numpy(float))), "double")
    return out.withColumn("p_value", F.coalesce(p(F.coalesce("chi2", F.lit(0.0))), F.lit(1.0)))


def benjamini_hochberg(df: DataFrame, p: str = "p_value", into: str = "q_value") -> DataFrame:
    """q-values of any number of rows: the least p * m / rank of those with the same or a larger p.

    Rows are counted by p, and of equal p the last rank gives the least, so that a q-value belongs to a p-value; ranks and the
    minimum from the right go by levels of p, and no task holds all of them.
    """
    counts = settled(df.groupBy(p).agg(F.count(F.lit(1)).alias("__n")))
    whole = counts.agg(F.sum("__n").alias("__m"))  # one row
    ranks = running(counts, [p], ["__n"]).crossJoin(F.broadcast(whole))
    ranks = ranks.withColumn("__raw", F.col(p) * F.col("__m") / (F.col("before___n") + F.col("__n")))
    table = least_from(ranks, p, "__raw", "__q").select(F.col(p).alias("__p"), F.least("__q", F.lit(1.0)).alias(into))
    return df.join(table, F.col(p).eqNullSafe(F.col("__p"))).drop("__p")


def associations(lines: DataFrame, c: AffinityConfig = AffinityConfig(), held: DataFrame | None = None) -> DataFrame:
    """Directed rules with basket measures, customer statistics, q-values, persistence over halves and the joint filter."""
    held = settled(candidate_baskets(lines, c)) if held is None else held
    items, whole = item_counts(held, c.seed), totals(held, c.seed)
    side = lambda k: items.select(F.col("item").alias(k), *[F.col(x).alias(f"{y}_{k}" if not z else f"n_{k}_{z}") for x, y, z in (("baskets", "baskets", ""), ("n", "n", ""), ("n_0", "", "0"), ("n_1", "", "1"))])
    small = F.broadcast if c.max_items is not None else lambda df: df  # at most max_items rows
    least = c.min_support * (whole.first()["total_baskets"] or 0)
    counted = frequent_pairs(held, least, c.seed) if least > 1 else pair_counts(held, c.seed)
    rows = counted.join(small(side("a")), "a").join(small(side("b")), "b").crossJoin(F.broadcast(whole))  # totals are one row
    rows = rows.filter((F.col("N") >= c.min_customers) & (F.col("pair_baskets") >= F.col("total_baskets") * c.min_support))
    rows = benjamini_hochberg(settled(pair_statistics(rows)))
    for h in ("0", "1"):
        rows = rows.withColumn(f"lift_half_{h}", ratio(ratio(F.col(f"n_ab_{h}"), F.col(f"n_a_{h}")), ratio(F.col(f"n_b_{h}"), F.col(f"N_{h}"))))
    shared = ["pair_baskets", "n_ab", "N", "lift", "odds_ratio", "or_ci_lower", "or_ci_upper", "chi2", "p_value", "q_value", "lift_half_0", "lift_half_1"]

    def directed(x: str, y: str) -> DataFrame:
        confidence = ratio(F.col("pair_baskets"), F.col(f"baskets_{x}"))
        return rows.select(F.col(x).alias("antecedent"), F.col(y).alias("consequent"), ratio(F.col("pair_baskets"), F.col("total_baskets")).alias("support"), confidence.alias("confidence"), ratio(confidence, ratio(F.col(f"baskets_{y}"), F.col("total_baskets"))).alias("basket_lift"), *shared)

    both = directed("a", "b").unionByName(directed("b", "a"))
    passes = (F.col("confidence") >= c.min_confidence) & (F.col("basket_lift") >= c.min_lift) & (F.col("q_value") <= c.fdr_alpha) & (F.col("or_ci_lower") > 1) & (F.col("lift_half_0") > 1) & (F.col("lift_half_1") > 1)
    return both.withColumn("passes_all_filters", F.coalesce(passes, F.lit(False)))


def transitions(lines: DataFrame, c: AffinityConfig = AffinityConfig(), least: int = 30, held: DataFrame | None = None) -> DataFrame:
    """Items of a basket against those of the customer's next one, with q-values over all pairs."""
    held = candidate_baskets(lines, c) if held is None else held
    order = Window.partitionBy("customer_id").orderBy("basket_key")
    moves = settled(held.select("items", F.lag("items").over(order).alias("before")).filter("before IS NOT NULL"))
    whole = moves.agg(F.count(F.lit(1)).alias("N"))
    count = lambda column, name: moves.select(F.explode(column).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n_" + name))
    pairs = moves.select(F.explode("before").alias("from_item"), "items").select("from_item", F.explode("items").alias("to_item")).groupBy("from_item", "to_item").agg(F.count(F.lit(1)).alias("n_pair"))
    small = F.broadcast if c.max_items is not None else lambda df: df  # at most max_items rows
    rows = pairs.join(small(count("before", "from_item")), "from_item").join(small(count("items", "to_item")), "to_item").crossJoin(F.broadcast(whole))
    rows = benjamini_hochberg(settled(pair_statistics(rows.filter(F.col("N") >= least), "n_pair", "n_from_item", "n_to_item", "N")))
    return rows.withColumns({"probability": ratio(F.col("n_pair"), F.col("n_from_item")), "significant": (F.col("q_value") <= c.fdr_alpha) & (F.col("or_ci_lower") > 1)})


def affinity_status(lines: DataFrame, c: AffinityConfig = AffinityConfig()) -> DataFrame:
    """One row: how many baskets and customers there are and were used, and what that means."""
    whole = baskets(lines, c.level, c.grain, c.key_mode).filter("customer_id IS NOT NULL").agg(F.count(F.lit(1)).alias("all_baskets"), F.countDistinct("customer_id").alias("all_customers"))
    within = replace(c, max_pair_operations=None)  # what the budget of baskets leaves, before that of pairs
    kept = candidate_baskets(lines, within).agg(F.countDistinct("customer_id").alias("kept_customers"))
    used = candidate_baskets(lines, c).agg(F.count(F.lit(1)).alias("used_baskets"), F.countDistinct("customer_id").alias("used_customers"))
    status = F.when(F.col("used_customers") < c.min_customers, "skipped").when(F.col("used_customers") < F.col("kept_customers"), "truncated").when(F.col("used_customers") < F.col("all_customers"), "sampled").otherwise("completed")
    return whole.crossJoin(kept).crossJoin(used).withColumn("status", status).drop("kept_customers")  # one row each


def invoice_pairs(lines: DataFrame, item: str = "category", least_support: float = 0.0) -> DataFrame:
    """Item pairs by transaction with support and lift."""
    rows = lines.filter(f"quantity > 0 AND transaction_id IS NOT NULL AND {item} IS NOT NULL").groupBy("transaction_id").agg(F.array_sort(F.collect_set(item)).alias("i"))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    items = rows.select(F.explode("i").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("c"))
    left = rows.select("i", F.posexplode("i").alias("p", "a"))
    pairs = left.select("a", F.explode(F.slice("i", F.col("p") + 2, F.size("i"))).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("pair_count"))
    out = pairs.join(items.select(F.col("item").alias("a"), F.col("c").alias("ca")), "a").join(items.select(F.col("item").alias("b"), F.col("c").alias("cb")), "b").crossJoin(F.broadcast(n))
    out = out.withColumns({"support": F.col("pair_count") / F.col("n"), "lift": F.col("pair_count").cast("double") * F.col("n") / (F.col("ca") * F.col("cb"))})
    return out.filter(F.col("support") >= least_support).select("a", "b", "pair_count", "support", "lift")


def lift_matrix(rules: DataFrame, n: int = 15) -> DataFrame:
    """Basket lift between the n items with the largest sums of it (long form)."""
    top = rules.groupBy("antecedent").agg(F.sum("basket_lift").alias("s")).orderBy(F.desc("s"), "antecedent").limit(n).select(F.col("antecedent").alias("item"))
    return rules.join(F.broadcast(top.withColumnRenamed("item", "antecedent")), "antecedent", "left_semi").join(F.broadcast(top.withColumnRenamed("item", "consequent")), "consequent", "left_semi").select("antecedent", "consequent", "basket_lift")


def affinity_network(rules: DataFrame) -> DataFrame:
    """Items with their number of partners and the sum of lifts, over undirected pairs."""
    edges = rules.filter("antecedent < consequent").select("antecedent", "consequent", "basket_lift")
    ends = edges.select(F.col("antecedent").alias("item"), "basket_lift").unionByName(edges.select(F.col("consequent").alias("item"), "basket_lift"))
    return ends.groupBy("item").agg(F.count(F.lit(1)).alias("degree"), steady_sum("basket_lift").alias("weight"))


def joint_revenue(lines: DataFrame, rules: DataFrame, level: str = "category") -> DataFrame:
    """Rules with the revenue of the transactions that hold both items; transactions keep only items that rules name."""
    keyed = rules.withColumns({"a": F.least("antecedent", "consequent"), "b": F.greatest("antecedent", "consequent")})
    wanted = keyed.select("a", "b").distinct()
    named = wanted.select(F.col("a").alias("item")).unionByName(wanted.select(F.col("b").alias("item"))).distinct()
    rows = lines.filter(f"quantity > 0 AND transaction_id IS NOT NULL AND {level} IS NOT NULL")
    value = rows.groupBy("transaction_id").agg(F.sum("line_revenue").alias("v"))
    held = rows.select("transaction_id", F.col(level).alias("item")).join(named, "item", "left_semi").groupBy("transaction_id").agg(F.array_sort(F.collect_set("item")).alias("i"))
    left = held.filter(F.size("i") > 1).join(value, "transaction_id").select("v", "i", F.posexplode("i").alias("p", "a"))
    both = left.select("v", "a", F.explode(F.slice("i", F.col("p") + 2, F.size("i"))).alias("b")).join(wanted, ["a", "b"], "left_semi")
    return keyed.join(both.groupBy("a", "b").agg(F.sum("v").cast("double").alias("joint_revenue")), ["a", "b"], "left").drop("a", "b")


# Names of the columns of pairs in the period view.
PAIR_NAMES = {"antecedent": "product_a", "consequent": "product_b", "pair_baskets": "co_occurrence", "confidence": "confidence_a_to_b", "basket_lift": "lift"}


def item_metrics(lines: DataFrame, level: str = "product_id") -> DataFrame:
    """Orders, revenue and units of each item, and its share of all orders."""
    whole = lines.agg(F.countDistinct("transaction_id").alias("__n"))  # one row
    out = lines.filter(F.col(level).isNotNull()).groupBy(level).agg(F.countDistinct("transaction_id").alias("orders"), F.sum("line_revenue").cast("double").alias("revenue"), F.sum("quantity").alias("units"))
    return out.crossJoin(F.broadcast(whole)).withColumn("support", ratio(F.col("orders"), F.col("__n"))).drop("__n")


def basket_associations(lines: DataFrame, c: AffinityConfig = AffinityConfig(level="product_id"), descriptions: bool = True) -> dict[str, DataFrame]:
    """The period view of baskets over the period's ``lines``: ``product_metrics``, ``pairs`` under their names there, with joint
    revenue and descriptions of both items, and ``diagnostics``."""
    lines = settled(lines)
    rules = settled(associations(lines, c))
    pairs = joint_revenue(lines, rules, c.level).fillna(0.0, ["joint_revenue"])
    if descriptions and c.level == "product_id" and "product_description" in lines.columns:
        named = lines.filter("product_id IS NOT NULL").groupBy("product_id").agg(F.min("product_description").alias("d"))
        for side, name in (("antecedent", "desc_a"), ("consequent", "desc_b")):
            pairs = pairs.join(named.select(F.col("product_id").alias(side), F.col("d").alias(name)), side, "left")
    pairs = pairs.withColumnsRenamed({"lift": "customer_lift"}).withColumnsRenamed(PAIR_NAMES)
    return {"product_metrics": item_metrics(lines, c.level), "pairs": pairs, "diagnostics": affinity_status(lines, c)}
