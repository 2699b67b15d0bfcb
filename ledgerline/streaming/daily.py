"""Daily KPIs of a stream of lines (beyond what the line-item reports need): event time, watermark, one state a day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_stream(lines: DataFrame, late: str = "2 days") -> DataFrame:
    """Revenue, units and lines by day of a streaming DataFrame with transaction_date; later rows than ``late`` are dropped.

    Distinct orders are estimated, since exact ones would keep every id in the state.
    """
    rows = lines.withColumn("at", F.col("transaction_date").cast("timestamp")).withWatermark("at", late)
    out = rows.groupBy(F.window("at", "1 day")).agg(F.sum("line_revenue").cast("double").alias("revenue"), F.sum("quantity").alias("units"), F.count(F.lit(1)).alias("lines"), F.approx_count_distinct("transaction_id").alias("orders_estimate"))
    return out.select(F.to_date("window.start").alias("transaction_day"), "revenue", "units", "lines", "orders_estimate")
