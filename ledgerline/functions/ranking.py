"""Ranks and running sums over a whole table without a single task that holds it.

Rows are counted by value first, so ties of any number are one row. Values go to levels, an integer that rises with them and
has at most some hundred thousand different results; sums over the levels are a table of bounded size, and what is left to
order lies within a level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PER_DOUBLING = 4096
_LOWEST = 64  # doublings below 1 that are told apart; smaller values share a level with 0


def level(value: Column) -> Column:
    """An integer that never falls as the value rises: 4096 steps a doubling, also below 1; null for null.

    Scores between 0 and 1 have some hundred thousand levels, and half of evenly spread ones lie in 4096.
    """
    v = value.cast("double")
    steps = F.floor((F.log2(F.greatest(F.abs(v), F.lit(2.0**-_LOWEST))) + _LOWEST) * PER_DOUBLING)
    return (F.signum(v) * steps).cast("long")


def running(groups: DataFrame, order: Sequence[str], measures: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``groups`` with before_<measure>: its sum over the groups ahead, in order of columns of which the first is a number, within
    each value of ``by``, of which there are few."""
    rows = groups.withColumn("__level", level(F.col(order[0])))
    ahead = lambda m, w: F.coalesce(F.sum(m).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy(*by, "__level").orderBy(*order)
    rows = rows.withColumns({f"__in_{m}": ahead(m, inside) for m in measures})
    sums = groups.groupBy(*[F.col(b).alias(f"__by_{b}") for b in by], level(F.col(order[0])).alias("__of")).agg(*[F.sum(m).alias(m) for m in measures])
    keys = [f"__by_{b}" for b in by]
    base = sums.select(*keys, "__of", *[ahead(m, Window.partitionBy(*keys).orderBy("__of")).alias(f"__base_{m}") for m in measures])  # a row for each level
    on = F.col("__level").eqNullSafe(F.col("__of"))
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"__by_{b}"))
    out = rows.join(F.broadcast(base), on)
    return out.select(*groups.columns, *[(F.col(f"__base_{m}") + F.col(f"__in_{m}")).alias(f"before_{m}") for m in measures])


def least_from(rows: DataFrame, order: str, value: str, into: str) -> DataFrame:
    """``rows`` with the least ``value`` of those whose number ``order`` is the same or larger: by levels from the right first, and
    then inside a level."""
    rows = rows.withColumn("__level", level(F.col(order)))
    inside = F.min(value).over(Window.partitionBy("__level").orderBy(F.desc(order)))
    behind = Window.orderBy(F.desc("__of")).rowsBetween(Window.unboundedPreceding, -1)
    levels = rows.groupBy(F.col("__level").alias("__of")).agg(F.min(value).alias("__m"))
    base = levels.select("__of", F.min("__m").over(behind).alias("__behind"))  # a row for each level
    out = rows.withColumn("__in", inside).join(F.broadcast(base), F.col("__level").eqNullSafe(F.col("__of")))
    return out.withColumn(into, F.least("__in", "__behind")).drop("__level", "__in", "__of", "__behind")


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """value, n (its rows) and before_n (rows with smaller values), a row for each value; nulls come first."""
    return running(df.groupBy(value).agg(F.count(F.lit(1)).alias("n")), [value], ["n"])


def numbered(df: DataFrame, value: str, key: str, into: str, running_value: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the number of each row, from 1, in order of value and key, within each value of ``by``; with ``running_value``,
    also the sum of values up to the row. Equal values are ordered by key within what their keys begin with."""
    kind = df.schema[key].dataType
    head = F.floor(F.col(key) / 65536) if isinstance(kind, T.NumericType) else F.substring(F.col(key).cast("string"), 1, 6)
    rows = df.withColumn("__head", head)
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by, value, "__head").orderBy(key)))
    groups = df.groupBy(*by, value, head.alias("__head")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
    groups = running(groups, [value, "__head"], ["n", "s"], by).select(*[F.col(b).alias(f"__g_{b}") for b in by], F.col(value).alias("__gv"), F.col("__head").alias("__gh"), "before_n", "before_s")
    on = F.col(value).eqNullSafe(F.col("__gv")) & F.col("__head").eqNullSafe(F.col("__gh"))
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"__g_{b}"))
    out = rows.join(groups, on)
    extra = {into: F.col("before_n") + F.col("__r")}
    if running_value:
        extra[running_value] = F.col("before_s") + F.col("__r") * F.col(value)
    return out.withColumns(extra).select(*df.columns, *extra)
