"""Exact quantiles of whole tables and groups, for all columns together, without a task that holds a column.

A pass counts the values of every column by equal slices of the range in which a wanted rank lies, and notes each slice's least
and greatest value; the slice that holds the rank is the next pass's range. Ranges shrink by the number of slices, so a few
passes leave one value, however many rows there are. A group's slices are few, so what runs over them is small. Groups of a
bounded number of rows are left to Spark's own exact percentile, whose buffer they fit, in one pass for all of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICES = 4096
SMALL = 100_000


def _melted(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """A row for each value that is not missing: group, number of the column, value."""
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    return df.select(F.struct(*[F.col(b) for b in by]).alias("g") if by else F.struct(F.lit(0).alias("_")).alias("g"), F.inline(pairs)).filter("v IS NOT NULL AND NOT isnan(v)")


def _keys(rows: DataFrame, keys: Sequence[tuple], grouped: bool) -> DataFrame:
    schema = T.StructType([T.StructField("tg", rows.schema["g"].dataType), T.StructField("tc", T.IntegerType())])
    return F.broadcast(rows.sparkSession.createDataFrame([(g if grouped else (0,), c) for g, c in keys], schema))  # a row for each small group


def grouped_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], by: Sequence[str] = (), slices: int = SLICES, small: int = SMALL) -> dict[tuple, dict[str, list[float]]]:
    """Quantiles with linear interpolation, by group (a tuple; without ``by`` the only one is ()) and column.

    Groups and columns are few: what comes back is a row for each rank, and a group without values of a column has none of it.
    """
    rows = _melted(df, columns, by)
    key = lambda r: (tuple(r["g"]) if by else (), r["c"])
    sizes = {key(r): (r["n"], r["low"], r["high"]) for r in rows.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    out: dict[tuple, dict[str, list[float]]] = {}
    few = {k for k, (n, low, high) in sizes.items() if n <= small}
    if few:
        held = rows if len(few) == len(sizes) else rows.join(_keys(rows, sorted(few, key=repr), bool(by)), (F.col("g").eqNullSafe(F.col("tg"))) & (F.col("c") == F.col("tc")))
        for r in held.groupBy("g", "c").agg(F.percentile("v", F.array(*[F.lit(float(s)) for s in shares])).alias("q")).collect():  # a row for each group and column
            g, c = key(r)
            out.setdefault(g, {})[columns[c]] = list(r["q"])
    sizes = {k: v for k, v in sizes.items() if k not in few}
    # (group, column, rank from 0) -> range of values and rows ahead of it
    wanted = {(k, r): (low, high, 0) for k, (n, low, high) in sizes.items() for s in shares for r in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))}
    while open_ := {w: at for w, at in wanted.items() if at[0] < at[1]}:
        ranges = sorted({(k, low, high) for (k, _), (low, high, _) in open_.items()}, key=repr)
        number = {r: i for i, r in enumerate(ranges)}
        schema = T.StructType([T.StructField("tg", rows.schema["g"].dataType), *(T.StructField(c, t) for c, t in (("tc", T.IntegerType()), ("low", T.DoubleType()), ("high", T.DoubleType()), ("i", T.IntegerType())))])
        table = df.sparkSession.createDataFrame([(k[0] if by else (0,), k[1], low, high, i) for (k, low, high), i in number.items()], schema)
        inside = rows.join(F.broadcast(table), F.col("g").eqNullSafe(F.col("tg")) & (F.col("c") == F.col("tc")) & F.col("v").between(F.col("low"), F.col("high")))  # a row for each open range
        slice_ = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * slices), F.lit(slices - 1))
        counts = inside.groupBy("i", slice_.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        ahead = F.sum("n").over(Window.partitionBy("i").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))  # at most ``slices`` rows
        found = counts.withColumn("ahead", F.coalesce(ahead, F.lit(0)))
        ranks = [(number[k, low, high], rank - before) for (k, rank), (low, high, before) in open_.items()]
        asked = df.sparkSession.createDataFrame(sorted(set(ranks)), "j int, r long")
        hit = found.join(F.broadcast(asked), (F.col("i") == F.col("j")) & (F.col("r") >= F.col("ahead")) & (F.col("r") < F.col("ahead") + F.col("n")))  # a row for each rank
        hits = {(h["j"], h["r"]): (h["least"], h["most"], h["ahead"]) for h in hit.select("j", "r", "least", "most", "ahead").collect()}
        for (k, rank), (low, high, before) in open_.items():
            least, most, ahead_ = hits[number[k, low, high], rank - before]
            if (least, most) == (low, high):
                raise ValueError("values are too far apart to be told apart as doubles")
            wanted[k, rank] = (least, most, before + ahead_)
    for (g, c), (n, _, _) in sizes.items():
        values = []
        for s in shares:
            at = s * (n - 1)
            a, b = math.floor(at), math.ceil(at)
            low, high = wanted[(g, c), a][0], wanted[(g, c), b][0]
            values.append(low if a == b or low == high else (b - at) * low + (at - a) * high)
        out.setdefault(g, {})[columns[c]] = values
    return out


def quantile_table(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float]]:
    """Quantiles of each column of a table; a column without values has an empty list."""
    found = grouped_quantiles(df, columns, shares).get((), {})
    return {c: found.get(c, []) for c in columns}


def quantiles(df: DataFrame, c: str, shares: Sequence[float]) -> list[float]:
    """The same for one column."""
    return quantile_table(df, [c], shares)[c]


def with_medians(df: DataFrame, by: Sequence[str], medians: dict[str, str], out: DataFrame) -> DataFrame:
    """``out``, a row for each group of few, with the medians of columns of ``df`` (name of the median: column)."""
    found = grouped_quantiles(df, list(medians.values()), (0.5,), by)
    rows = [(*g, *[(v.get(c) or [None])[0] for c in medians.values()]) for g, v in found.items()]
    fields = [T.StructField(f"__by_{b}", df.schema[b].dataType) for b in by] + [T.StructField(n, T.DoubleType()) for n in medians]
    table = F.broadcast(df.sparkSession.createDataFrame(rows, T.StructType(fields)))
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"__by_{b}"))
    return out.join(table, on, "left").drop(*[f"__by_{b}" for b in by])
