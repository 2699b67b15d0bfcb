"""Scans of transaction lines and sinks of result tables."""

from __future__ import annotations

import json
import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.schema import DATE_PATTERNS, IDS, NULL_TOKENS, NUMBERS, REQUIRED, TEXTS, map_columns


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """CSV as text columns (no inference), or Parquet, by suffix."""
    name = path.rstrip("/").lower()
    if name.endswith((".csv", ".csv.gz", ".txt")):
        return spark.read.options(header=True, mode="PERMISSIVE", encoding="UTF-8", escape='"', multiLine=False).csv(path)
    if name.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported input {path!r}: expected .csv, .parquet or .pq")


def blank_to_null(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    return F.when(~text.isin(NULL_TOKENS), text)


def number(c: Column) -> Column:
    """Numbers as doubles; what is not a finite number becomes null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def parse_timestamp(c: Column, pattern: str | None = None) -> Column:
    """The first pattern that fits: an explicit one, then ISO forms. Ambiguous day and month orders stay null."""
    patterns = ([pattern] if pattern else []) + DATE_PATTERNS
    parsed = [F.try_to_timestamp(F.trim(c.cast("string")), F.lit(p)).cast("timestamp_ntz") for p in patterns]
    return F.coalesce(*parsed)


def normalise(raw: DataFrame, date_pattern: str | None = None) -> DataFrame:
    """Typed lines from raw columns with the required names; other columns are left out.

    ``has_date``, ``has_price`` and ``has_quantity`` tell absent values from malformed ones.
    """
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    kind = dict(raw.dtypes)["transaction_date"]
    when = raw["transaction_date"].cast("timestamp_ntz") if kind.startswith(("timestamp", "date")) else parse_timestamp(raw["transaction_date"], date_pattern)
    texts = [blank_to_null(raw[c]).alias(c) for c in IDS + TEXTS]
    flags = [blank_to_null(raw[c]).isNotNull().alias(n) for c, n in (("transaction_date", "has_date"), ("price", "has_price"), ("quantity", "has_quantity"))]
    rows = raw.select(*texts, *[number(blank_to_null(raw[c])).alias(c) for c in NUMBERS], when.alias("transaction_date"), *flags)
    revenue = F.col("price") * F.col("quantity")
    return rows.withColumns({"transaction_day": F.to_date("transaction_date"), "line_revenue": F.when(F.abs(revenue) != float("inf"), revenue)})


def load_lines(spark: SparkSession, path: str, date_pattern: str | None = None, aliases: bool = True) -> DataFrame:
    """Scan, rename recognised headers and normalise."""
    raw = read_raw(spark, path)
    if aliases:
        raw = raw.select(*[F.col(f"`{have}`").alias(want) for want, have in map_columns(raw.columns).items()])
    return normalise(raw, date_pattern)


def app_lines(lines: DataFrame) -> DataFrame:
    """The interactive view: zero quantities removed, returns kept, revenue as another name of line_revenue."""
    return lines.filter("quantity IS NULL OR quantity <> 0").withColumn("revenue", F.col("line_revenue"))


def demo_lines(lines: DataFrame) -> DataFrame:
    """Lines with customer, day, quantity and price all present."""
    return lines.dropna(subset=["customer_id", "transaction_day", "quantity", "price"])


def write_table(df: DataFrame, folder: str, name: str, kind: str = "parquet") -> str:
    """A result table as zstd Parquet or CSV with header; returns the path.

    A table with a column that Parquet cannot hold is written as CSV instead, with such columns as text.
    """
    path = f"{folder}/{name}.{kind}"
    if kind == "parquet":
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        except AnalysisException as e:
            if "UNSUPPORTED_DATA_TYPE_FOR_DATASOURCE" not in str(e):
                raise
            simple = df.select(*[F.col(f"`{c}`").cast("string") if not isinstance(df.schema[c].dataType, T.NumericType) else F.col(f"`{c}`") for c in df.columns])
            return write_table(simple, folder, name, "csv")
    elif kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown format {kind!r}")
    return path


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A result table in either format, or None."""
    for kind in ("parquet", "csv"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.{kind}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.read.parquet(str(path)) if kind == "parquet" else spark.read.csv(str(path), header=True, inferSchema=True)
    return None


def json_safe(value: object) -> object:
    """Values as JSON can hold them: non-finite numbers become null, dates text."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [json_safe(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if value is None or isinstance(value, bool | int | float | str) else str(value)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file, through Spark's file system layer."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small record as one JSON file."""
    write_text(spark, json.dumps(json_safe(value), indent=2, sort_keys=True) + "\n", path)
