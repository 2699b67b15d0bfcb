"""How much queries read and shuffle: in proportion to the lines, however many days, ids and passes there are."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import affinity as af
from ledgerline.operators import models as mo
from ledgerline.operators import snapshots as sn
from ledgerline.operators import summaries as sm
from ledgerline.plans import basket_queries as bq
from ledgerline.registry import oracle_sql, queries
from ledgerline.sources.star import star_lines
SF = "/root/testdata/sf0.001"


def work(spark, f) -> tuple[int, int]:
    """Rows read and rows shuffled by what ``f`` runs and by the table that it returns."""
    none, store = spark._jvm.java.util.ArrayList, spark.sparkContext._jsc.sc().statusStore()

    def stages() -> dict[int, tuple[int, int]]:
        found, held = store.stageList(none(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none()).iterator(), {}
        while found.hasNext():
            s = found.next()
            held[s.stageId()] = s.inputRecords(), s.shuffleWriteRecords()
        return held

    last = max(stages(), default=-1)
    f().write.format("noop").mode("overwrite").save()
    mine = [v for k, v in stages().items() if k > last]
    return sum(v[0] for v in mine), sum(v[1] for v in mine)


@pytest.fixture(scope="module")
def n_lines(spark):
    return star_lines(spark, SF).count()


def test_days_do_not_multiply_what_is_shuffled(spark, n_lines):
    lines = star_lines(spark, SF)
    days = mo.snapshot_days(lines)
    assert len(days) > 20
    for f in (sn.promo_at, sn.returns_at, lambda lines, days: sn.category_logs_at(lines, days)[0]):
        one, many = (work(spark, lambda d=d, f=f: f(lines, d))[1] for d in (days[-1:], days))
        assert many < 2 * one + n_lines / 10


# for each query the most rows read and shuffled, as multiples of the lines; before, queries read or shuffled more
@pytest.mark.parametrize("name, read, shuffled", [("product_summary", 5.0, 1.8), ("product_quadrant", 5.0, 0.6), ("product_period_features", 5.0, 0.42), ("category_quadrant", 5.0, 0.1), ("action_matrix", 10.0, 1.5), ("rolling_origin_calibration", 11.0, 2.6), ("holdout_metrics", 7.7, 3.3)])
def test_lines_are_joined_once_for_many_passes(spark, n_lines, name, read, shuffled):
    got = work(spark, lambda: queries()[name](spark, SF))
    assert got[0] <= read * n_lines and got[1] <= shuffled * n_lines


@pytest.mark.parametrize("f", [lambda lines: sm.dimension_summary(lines, category=F.col("category")), lambda lines: sm.dimension_summary(lines, department=F.col("department")), sm.product_variants])
def test_distinct_counts_do_not_expand_lines(spark, f):
    assert "Expand" not in f(star_lines(spark, SF))._jdf.queryExecution().optimizedPlan().toString()


def test_baskets_without_budgets_are_not_ranked(spark):
    held = af.candidate_baskets(star_lines(spark, SF), bq.FULL)
    assert held._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


@pytest.mark.parametrize("n, rows", [(50_000, 1), (50_001, 0)])
def test_affinity_status_equals_sql_at_the_budget_of_baskets(spark, tmp_path, n, rows):
    k = F.col("id")
    spark.range(n).select(k.alias("o_orderkey"), k.alias("o_custkey"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(n).select(k.alias("l_orderkey"), F.lit(1).cast("long").alias("l_partkey"), F.lit(1.0).alias("l_quantity"), F.lit(2.0).alias("l_extendedprice"), F.lit("N").alias("l_returnflag")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 2).select(k.alias("p_partkey"), F.lit("x").alias("p_name"), F.lit("b").alias("p_brand"), F.lit("SMALL").alias("p_type")).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = [tuple(r) for r in queries()["affinity_status"](spark, str(tmp_path)).collect()]
    assert got == con.sql(oracle_sql()["affinity_status"]).fetchall() and len(got) == rows
