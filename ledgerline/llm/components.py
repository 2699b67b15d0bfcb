"""Connected components of links, by alternating large-star and small-star steps on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerline.llm.common import dropped, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each larger neighbour of a node on the node's least neighbour, or on the node itself.

    The least neighbour comes from a partial aggregation and goes back by a join that adaptive execution can split, so a
    node may have any number of links.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of these. Links are (u, v) with v < u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _counted(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The written links, and their number with sums of two hashes, gathered by the job that writes them."""
    seen = Observation()
    mixed = [F.sum(F.xxhash64(F.lit(k), "u", "v").cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)]
    out = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), *mixed), name)
    return out, tuple(seen.get[k] for k in ("n", "h1", "h2"))


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node and component (its least node) for every node of ``edges`` (u, v), which must not be null.

    The links of a round are written to the shared folder, so the plan does not grow and lost executors do not cost rounds.
    The rounds end when one has left the links as they were.
    """
    links = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, state = _counted(_small_star(links), "links")
    for _ in range(rounds):
        after, then = _counted(_small_star(_large_star(now)), "links")
        dropped(now)
        now, state, before = after, then, state
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
