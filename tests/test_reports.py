"""The report command and the streaming daily KPIs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ledgerline.plans import tables
from ledgerline.sources.star import star_lines
from ledgerline.streaming.daily import daily_stream

SF = "/root/testdata/sf0.001"


def test_report_writes_tables(spark, tmp_path):
    lines = star_lines(spark, SF)
    names = ["category_summary", "customer_revenue_concentration", "rfm_segment_profiles", "basket_affinity", "repeat_survival"]
    meta = tables.write_report(lines, str(tmp_path), only=names)
    assert set(meta["tables"]) == set(names) and not meta["skipped"]
    assert json.loads((tmp_path / "run_metadata.json").read_text())["as_of"] == str(meta["as_of"])
    quality = json.loads((tmp_path / "data_quality.json").read_text())
    assert {"issues", "structural_checks", "accounting"} <= set(quality) and abs(quality["accounting"]["difference"]) < 0.01
    report = (tmp_path / "report.md").read_text()
    assert report.startswith("# Customer analysis") and "## Basket affinity" in report and "## Repeat survival" in report
    assert set(tables.result_tables(lines, meta["as_of"])) >= {
        "data_quality_issues", "customer_features", "holdout_metrics", "holdout_calibration", "model_parameters", "cluster_diagnostics", "cluster_profiles", "rfm_segment_profiles",
        "rfm_cluster_comparison", "cluster_stability", "cluster_labels_snapshots", "repeat_survival", "cohort_retention_new_customers", "interpurchase_intervals", "basket_affinity", "next_trip_affinity",
        "customer_revenue_concentration", "transaction_summary", "product_summary", "product_metadata_variants", "product_repeat_behavior", "category_summary", "department_summary", "monthly_summary", "weekday_summary",
    }


def test_broken_tables_are_told_apart_from_too_little_data(spark, tmp_path, monkeypatch):
    def few():
        raise ValueError("too few customers")

    made = {"a": few, "b": lambda: spark.range(1).select(F.raise_error(F.lit("broken"))), "c": lambda: spark.range(3).toDF("n"), "d": lambda: spark.sql("SELECT 1 AS n, interval '1' month AS i, null AS v")}
    monkeypatch.setattr(tables, "result_tables", lambda *_: made)
    meta = tables.write_report(star_lines(spark, SF), str(tmp_path))
    assert set(meta["skipped"]) == {"a"} and set(meta["failed"]) == {"b"} and set(meta["tables"]) == {"c", "d"}
    assert "too few customers" in (tmp_path / "report.md").read_text()


def test_stream_equals_batch(spark, tmp_path):
    lines = star_lines(spark, SF).select("transaction_date", "transaction_id", "quantity", "line_revenue")
    lines.write.parquet(str(tmp_path / "in"))
    stream = daily_stream(spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {r["transaction_day"]: (r["lines"], round(r["revenue"], 2)) for r in spark.table("daily").collect()}
    want = {r["d"]: (r["n"], round(float(r["v"]), 2)) for r in lines.groupBy(F.to_date("transaction_date").alias("d")).agg(F.count("*").alias("n"), F.sum("line_revenue").alias("v")).collect()}
    assert got == want


def test_every_chart_has_its_data(spark):
    from ledgerline.operators import events as ev
    from ledgerline.plans import charts
    from ledgerline.sources.star import star_lines

    lines = star_lines(spark, "/root/testdata/sf0.001")
    made = charts.chart_tables(lines, ev.latest_day(lines))
    assert list(made) == list(charts.CHARTS) and len(made) == 22
    for name in ("calibration", "customer_map", "segment_value", "concentration", "categories", "momentum", "cadence", "lorenz_segments", "action_quadrant", "promo_return_lollipop", "cohort_retention_revenue"):
        table = made[name]()
        assert table.count() > 0 and len(table.columns) > 1, name
