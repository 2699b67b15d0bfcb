"""Column helpers with the reference semantics of missing values, ranks, quantile bins and intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z95 = 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    """a / b in doubles; null where b is 0 or missing."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def amount(c: Column) -> Column:
    """A sum of money as a double; nothing summed is 0."""
    return F.coalesce(F.sum(c).cast("double"), F.lit(0.0))


def steady_sum(c: Column | str, scale: int = 12) -> Column:
    """A sum of doubles that does not depend on the order of rows: of decimals with ``scale`` places, as a double."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast(f"decimal(38,{scale})")).cast("double")


def steady_mean(c: Column | str, scale: int = 12) -> Column:
    return ratio(steady_sum(c, scale), F.count(c))


def steady_deviation(c: Column | str, scale: int = 6) -> Column:
    """The sample deviation from sums that do not depend on the order of rows; null for fewer than two values."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    n, s, ss = F.count(c).cast("double"), steady_sum(x, scale), steady_sum(x * x, scale)
    return F.when(n > 1, F.sqrt(F.greatest(ss - s * s / n, F.lit(0.0)) / (n - 1)))


def when_sum(condition: Column, c: Column) -> Column:
    return amount(F.when(condition, c))


def distinct_when(condition: Column, c: Column) -> Column:
    return F.countDistinct(F.when(condition, c))


def average_rank(value: Column, by: Sequence[Column | str] = ()) -> Column:
    """Ranks from 1, ties sharing their mean."""
    order = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def right_closed_bin(value: Column, edges: Sequence[float]) -> Column:
    """Bins (e0, e1], (e1, e2], ... from 0, the first closed on the left too; equal edges count once."""
    inner = sorted(set(edges))[1:-1]
    return sum((F.when(value > e, 1).otherwise(0) for e in inner), F.lit(0))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The Wilson interval of k out of n; null for n = 0."""
    p = ratio(k, n)
    size = n.cast("double")
    centre = (p + z * z / (2 * size)) / (1 + z * z / size)
    half = z * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size)) / (1 + z * z / size)
    ok = n > 0
    return F.when(ok, F.greatest(F.lit(0.0), centre - half)), F.when(ok, F.least(F.lit(1.0), centre + half))


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation; null where a side does not vary."""
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def most_frequent(df: DataFrame, by: list[str], c: str, into: str) -> DataFrame:
    """The most frequent value of a group, the smallest among equals."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*by).agg(F.min_by(c, F.struct(-F.col("__n"), F.col(c))).alias(into))


def first_rows(by: list[str], *order: Column) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def sample_by_hash(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """A fixed sample of n rows: those with the least hashes of key and seed."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def hash_half(key: Column, seed: int) -> Column:
    """0 or 1 by a hash of the key."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long"), F.lit(2)).cast("int")


def small_table(df: DataFrame, columns: Sequence[str], further: str, rows: Sequence[tuple]) -> DataFrame:
    """A few rows from the driver, to be broadcast: columns typed as in ``df``, and ``further`` ones."""
    schema = T.StructType([*df.select(*columns).schema.fields, *T.StructType.fromDDL(further).fields])
    return F.broadcast(df.sparkSession.createDataFrame(list(rows), T.StructType([T.StructField(f.name, f.dataType) for f in schema])))
