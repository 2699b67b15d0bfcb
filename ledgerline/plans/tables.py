"""The full report: all result tables of one set of lines, and the command that writes them."""

from __future__ import annotations

import argparse
import datetime as dt
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import affinity, features, models, scoring, summaries, survival
from ledgerline.operators import events as ev
from ledgerline.operators import quality as qa
from ledgerline.operators.snapshots import category_logs_at
from ledgerline.plans.basket_queries import FULL
from ledgerline.session import get_spark, ship
from ledgerline.sources import readers
from ledgerline.storage import settled


def result_tables(lines: DataFrame, as_of: dt.date, horizon: int = 90) -> dict[str, Callable[[], DataFrame]]:
    """Name of each table and what makes it; nothing runs before it is asked for."""
    lines, spark = ev.up_to(lines, as_of), lines.sparkSession
    events = ev.purchase_events(lines, as_of)
    snapshot = features.customer_snapshot(lines, as_of)
    held: dict[str, DataFrame] = {}

    def scored() -> DataFrame:
        if "scored" not in held:
            held["scored"], held["fits"] = models.score_customers(scoring.rfm_scores(snapshot), horizon)
        return held["scored"]

    def fits() -> DataFrame:
        scored()
        spark = lines.sparkSession
        return held["fits"][0].row(spark).unionByName(held["fits"][1].row(spark)).withColumn("params", F.to_json("params"))

    def clusters(part: int) -> DataFrame:
        if "clusters" not in held:
            pcs = models.components(settled(category_logs_at(lines, [as_of])[0])).drop("as_of")
            held["clusters"] = models.choose_clusters(scored(), pcs=pcs)
        return held["clusters"][part]

    def snapshots() -> DataFrame:
        if "snapshots" not in held:
            days = models.snapshot_days(lines, horizon)
            held["snapshots"] = models.cluster_snapshots(lines, days, horizon)[0] if days else None
        return held["snapshots"]

    def stability() -> DataFrame:
        return models.stability_of(snapshots()) if snapshots() is not None else models.snapshot_stability(lines, [], horizon)

    def snapshot_labels() -> DataFrame:
        return models.snapshot_labels(snapshots()) if snapshots() is not None else spark.createDataFrame([], "customer_id string, cluster int, cluster_label string, snapshot string")

    def by(dimension: str) -> Callable[[], DataFrame]:
        def make() -> DataFrame:
            if "dimensions" not in held:
                held["dimensions"] = summaries.report_summaries(lines)
            return held["dimensions"][dimension]

        return make

    return {
        "data_quality_issues": lambda: qa.issue_counts(lines),
        "structural_checks": lambda: qa.structural_checks(lines),
        "customer_features": lambda: clusters(0),
        "holdout_metrics": lambda: models.holdout_metrics(lines, as_of, horizon),
        "holdout_calibration": lambda: models.holdout_calibration(lines, as_of, horizon),
        "model_parameters": fits,
        "cluster_diagnostics": lambda: clusters(1),
        "cluster_profiles": lambda: models.cluster_profiles(clusters(0)),
        "rfm_cluster_comparison": lambda: scoring.compare_segments(clusters(0), "rfm_segment", "cluster_label"),
        "cluster_stability": stability,
        "cluster_labels_snapshots": snapshot_labels,
        "rfm_segment_profiles": lambda: scoring.segment_profile(scored(), "rfm_segment"),
        "repeat_survival": lambda: survival.repeat_survival(events, as_of),
        "cohort_retention_new_customers": lambda: survival.cohort_retention(events, as_of),
        "interpurchase_intervals": lambda: features.interpurchase_intervals(events),
        "basket_affinity": lambda: affinity.associations(lines, FULL),
        "next_trip_affinity": lambda: affinity.transitions(lines, FULL).filter("significant"),
        "affinity_status": lambda: affinity.affinity_status(lines, FULL),
        "customer_revenue_concentration": lambda: summaries.revenue_concentration(summaries.customer_spend(events)),
        "transaction_summary": lambda: summaries.transaction_summary(lines),
        "product_summary": lambda: summaries.product_summary(lines),
        "product_metadata_variants": lambda: summaries.product_variants(lines),
        "product_repeat_behavior": lambda: summaries.product_repeat_behavior(lines),
        "category_summary": by("category"),
        "department_summary": by("department"),
        "monthly_summary": by("month"),
        "weekday_summary": by("weekday"),
    }


def data_quality(lines: DataFrame) -> dict:
    """Issue counts, structural checks and accounting totals as a record."""
    issues = qa.issue_counts(lines)
    checks = qa.structural_checks(lines)
    return {"issues": [r.asDict() for r in issues.collect()], "structural_checks": [r.asDict() for r in checks.collect()], "accounting": qa.accounting_totals(lines).first().asDict()}  # a few rows each


def _markdown(df: DataFrame, rows: int) -> str:
    """The first rows of a result table; the report shows them and the table's file holds all."""
    said = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "/")
    lines = [" | ".join(df.columns), " | ".join("---" for _ in df.columns)]
    return "\n".join(f"| {x} |" for x in [*lines, *[" | ".join(said(v) for v in r) for r in df.limit(rows).collect()]])


REPORTED = ("data_quality_issues", "holdout_metrics", "holdout_calibration", "model_parameters", "cluster_diagnostics", "cluster_profiles", "rfm_segment_profiles", "repeat_survival", "basket_affinity", "affinity_status", "customer_revenue_concentration")


def write_markdown(spark: SparkSession, folder: str, meta: dict, rows: int = 20) -> str:
    """report.md: what was computed, the leading rows of the tables that summarise, and what was left out and why."""
    parts = ["# Customer analysis", f"As of {meta['as_of']}."]
    for name in REPORTED:
        table = readers.read_table(spark, folder, name) if name in meta["tables"] else None
        if table is not None:
            parts.append(f"## {name.replace('_', ' ').capitalize()}\n\n{_markdown(table, rows)}")
    for what in ("skipped", "failed"):
        if meta[what]:
            parts.append(f"## {what.capitalize()}\n\n" + "\n".join(f"- {k}: {v}" for k, v in sorted(meta[what].items())))
    path = f"{folder}/report.md"
    readers.write_text(spark, "\n\n".join(parts) + "\n", path)
    return path


def write_report(lines: DataFrame, folder: str, as_of: dt.date | None = None, kind: str = "parquet", only: list[str] | None = None) -> dict:
    """Write the tables, data_quality.json, report.md and run_metadata.json.

    A table that has too little to work on (a ValueError of its operator) is skipped with the reason; one that breaks is recorded
    as failed, and the others go on.
    """
    began = time.time()
    spark = lines.sparkSession
    as_of = as_of or ev.latest_day(lines)
    lines = settled(lines)
    qa.assert_accounting(lines, summaries.report_summaries(lines))
    meta: dict = {"as_of": as_of, "tables": {}, "skipped": {}, "failed": {}}
    for name, make in result_tables(lines, as_of).items():
        if only and name not in only:
            continue
        try:
            meta["tables"][name] = readers.write_table(make(), folder, name, kind)
        except ValueError as e:
            meta["skipped"][name] = str(e).splitlines()[0][:300]
        except Exception as e:
            meta["failed"][name] = f"{type(e).__name__}: {str(e).splitlines()[0][:300]}"
    readers.write_json(spark, data_quality(lines), f"{folder}/data_quality.json")
    meta["report"] = write_markdown(spark, folder, meta)
    meta["elapsed_seconds"] = round(time.time() - began, 1)
    readers.write_json(spark, meta, f"{folder}/run_metadata.json")
    return meta


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--as-of", type=dt.date.fromisoformat)
    p.add_argument("--date-pattern")
    p.add_argument("--format", choices=["parquet", "csv"], default="parquet")
    p.add_argument("--drop-exact-duplicates", action="store_true")
    p.add_argument("--exclude-zero-quantity", action="store_true")
    p.add_argument("--exclude-negative-prices", action="store_true")
    a = p.parse_args(args)
    spark = get_spark("ledgerline-report")
    ship(spark)
    lines = qa.clean(readers.load_lines(spark, a.input, a.date_pattern), a.drop_exact_duplicates, a.exclude_zero_quantity, a.exclude_negative_prices)
    meta = write_report(lines, a.output, a.as_of, a.format)
    print(meta)
    if meta["failed"]:
        raise SystemExit(1)


if __name__ == "__main__":
    main()
