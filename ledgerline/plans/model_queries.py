"""Models, validation, segments and actions as registered queries."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import actions as ac
from ledgerline.operators import affinity as af
from ledgerline.operators import events as ev
from ledgerline.operators import joining, survival
from ledgerline.operators import models as mo
from ledgerline.operators import overview as ov
from ledgerline.operators import periods as pr
from ledgerline.operators import scoring as sc
from ledgerline.plans.basket_queries import FULL
from ledgerline.plans.catalog import query
from ledgerline.plans.core_queries import _APP_SQL, CORE_SQL, RFM_SQL, rounded, scored
from ledgerline.plans.period_queries import _ANOMALY, _C, _CMP, _DRIVERS, _K, _lines, _period_of
from ledgerline.sources import synthetic as sy
from ledgerline.sources.star import star_lines
from ledgerline.storage import settled

HORIZON = 90

_CUT = "ct AS (SELECT d - 90 AS c FROM cutoff), known AS (SELECT trips.* FROM trips, ct WHERE transaction_day <= c)"


@query("population_mean_baseline", f"{_CUT} SELECT count(DISTINCT customer_id) AS customers, count(*) FILTER (transaction_day > c - 90) AS trips, round(count(*) FILTER (transaction_day > c - 90) / count(DISTINCT customer_id), 6) AS mean_trips FROM known, ct")
def population_mean_baseline(spark: SparkSession, d: str) -> DataFrame:
    lines = star_lines(spark, d)
    cut = ev.latest_day(lines) - dt.timedelta(days=HORIZON)
    return rounded(mo.population_mean(ev.purchase_events(lines), cut, HORIZON))


_ACTUAL = """act AS (SELECT customer_id, count(*) FILTER (transaction_day > c AND transaction_day <= c + 90) AS actual_trips, coalesce(sum(trip_value) FILTER (transaction_day > c AND transaction_day <= c + 90), 0)::DOUBLE AS actual_value FROM trips, ct GROUP BY 1 HAVING min(transaction_day) <= any_value(c)),
 nv AS (SELECT customer_id, (count(*) - 1) / greatest(date_diff('day', min(transaction_day), any_value(c)), 1)::DOUBLE * 90 AS naive_trips, (count(*) - 1) AS x, date_diff('day', max(transaction_day), any_value(c)) AS recency FROM known, ct GROUP BY 1)"""


@query("holdout_actuals", f"{_CUT}, {_ACTUAL} SELECT * FROM act")
def holdout_actuals(spark: SparkSession, d: str) -> DataFrame:
    lines = star_lines(spark, d)
    return rounded(mo.holdout_actuals(ev.purchase_events(lines), ev.latest_day(lines) - dt.timedelta(days=HORIZON), HORIZON), 2)


def _naive(spark: SparkSession, d: str) -> DataFrame:
    lines = star_lines(spark, d)
    as_of = ev.latest_day(lines)
    cut = as_of - dt.timedelta(days=HORIZON)
    core = mo.customer_core(ev.purchase_events(lines, cut), cut).select("customer_id", (F.col("x") / F.greatest("T", F.lit(1)) * HORIZON).alias("naive_trips"))
    return core.join(mo.holdout_actuals(ev.purchase_events(lines, as_of), cut, HORIZON), "customer_id")


@query(
    "holdout_naive_metrics",
    f"{_CUT}, {_ACTUAL}, e AS (SELECT naive_trips AS p, actual_trips AS a, naive_trips - actual_trips AS e FROM nv JOIN act USING (customer_id)) SELECT count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(sum(abs(e)) / sum(abs(a)), 6) AS wape, round(avg(e), 6) AS bias, round(sum(p), 4) AS predicted_total, sum(a)::DOUBLE AS actual_total FROM e",
)
def holdout_naive_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mo.error_metrics(_naive(spark, d), "naive_trips", "actual_trips")).withColumn("predicted_total", F.round("predicted_total", 4))


@query(
    "auc_naive",
    f"{_CUT}, {_ACTUAL}, r AS (SELECT (rank() OVER (ORDER BY naive_trips)) + (count(*) OVER (PARTITION BY naive_trips) - 1) / 2.0::DOUBLE AS r, actual_trips > 0 AS p FROM nv JOIN act USING (customer_id)) SELECT round((sum(r) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2.0::DOUBLE) / (count(*) FILTER (p) * count(*) FILTER (NOT p)), 6) AS auc, count(*) FILTER (p) AS n1, count(*) FILTER (NOT p) AS n0 FROM r",
)
def auc_naive(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sc.auc(_naive(spark, d).withColumn("again", F.col("actual_trips") > 0), "naive_trips", "again"))


@query(
    "spearman_naive",
    f"{_CUT}, {_ACTUAL}, r AS (SELECT (rank() OVER (ORDER BY naive_trips)) + (count(*) OVER (PARTITION BY naive_trips) - 1) / 2.0::DOUBLE AS a, (rank() OVER (ORDER BY actual_trips)) + (count(*) OVER (PARTITION BY actual_trips) - 1) / 2.0::DOUBLE AS b FROM nv JOIN act USING (customer_id)) SELECT round(corr(a, b), 6) AS spearman FROM r",
)
def spearman_naive(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sc.spearman(_naive(spark, d), "naive_trips", "actual_trips"))


@query(
    "decile_calibration_naive",
    f"{_CUT}, {_ACTUAL}, i AS (SELECT naive_trips, actual_trips, row_number() OVER (ORDER BY naive_trips, customer_id) AS i, count(*) OVER () AS n FROM nv JOIN act USING (customer_id)) SELECT greatest(ceil((i - 1) * 10 / greatest(n - 1, 1)::DOUBLE), 1)::INTEGER AS decile, count(*) AS customers, round(avg(naive_trips), 6) AS mean_predicted, round(avg(actual_trips), 6) AS mean_actual FROM i GROUP BY 1",
)
def decile_calibration_naive(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mo.calibration(_naive(spark, d), "naive_trips", "actual_trips"))


def _scores(spark: SparkSession, d: str) -> tuple[DataFrame, list[mo.Fit], DataFrame]:
    lines = settled(mo.purchases_and_returns(star_lines(spark, d)), "lines")
    out, fits = mo.score_customers(scored(lines), HORIZON)
    return out, fits, lines


@query("bgnbd_scores")
def bgnbd_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)[0].select("customer_id", "x", "t_x", "T", "p_alive", "expected_trips", "prediction_source")


@query("gamma_gamma_scores")
def gamma_gamma_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)[0].select("customer_id", "n_trips", "mean_trip_value", "expected_trip_value", "expected_value")


@query("model_parameters")
def model_parameters(spark: SparkSession, d: str) -> DataFrame:
    _, fits, _ = _scores(spark, d)
    return fits[0].row(spark).unionByName(fits[1].row(spark)).select("model", "status", "reason", "converged", F.to_json("params").alias("params"), "value", "rows", "independence_warning")


def _bought(spark: SparkSession, d: str) -> DataFrame:
    """Lines with what validations look at, written once for the latest day and the events."""
    return settled(star_lines(spark, d).select("customer_id", "transaction_day", "product_id", "quantity", "line_revenue"), "lines")


@query("holdout_metrics")
def holdout_metrics(spark: SparkSession, d: str) -> DataFrame:
    lines = _bought(spark, d)
    return mo.holdout_metrics(lines, ev.latest_day(lines), HORIZON)


@query("holdout_calibration")
def holdout_calibration(spark: SparkSession, d: str) -> DataFrame:
    lines = _bought(spark, d)
    return mo.holdout_calibration(lines, ev.latest_day(lines), HORIZON)


@query("rolling_origin")
def rolling_origin(spark: SparkSession, d: str) -> DataFrame:
    lines = _bought(spark, d)
    return mo.aggregate_origins(mo.rolling_origins(lines, ev.latest_day(lines), HORIZON))


@query("rolling_origin_metrics")
def rolling_origin_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The metrics of each origin, of which rolling_origin gives the aggregate."""
    lines = _bought(spark, d)
    return mo.rolling_origins(lines, ev.latest_day(lines), HORIZON)


@query("rolling_origin_calibration")
def rolling_origin_calibration(spark: SparkSession, d: str) -> DataFrame:
    lines = _bought(spark, d)
    return mo.rolling_calibration(lines, ev.latest_day(lines), HORIZON)


def _clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The latest day's customers with their features of all families, RFM segments and clusters."""
    lines = settled(mo.purchases_and_returns(star_lines(spark, d)), "lines")
    table, pcs = mo.scored_snapshots(lines, [ev.latest_day(lines)], HORIZON)
    return mo.choose_clusters(sc.rfm_scores(table).drop("as_of"), pcs=pcs.drop("as_of"))


@query("cluster_assignments")
def cluster_assignments(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d)[0].select("customer_id", "cluster", "cluster_label")


@query("cluster_diagnostics")
def cluster_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d)[1]


@query("cluster_profiles")
def cluster_profiles(spark: SparkSession, d: str) -> DataFrame:
    return mo.cluster_profiles(_clusters(spark, d)[0])


@query("rfm_cluster_comparison")
def rfm_cluster_comparison(spark: SparkSession, d: str) -> DataFrame:
    return sc.compare_segments(_clusters(spark, d)[0], "rfm_segment", "cluster_label")


@query("snapshot_stability")
def snapshot_stability(spark: SparkSession, d: str) -> DataFrame:
    lines = settled(mo.purchases_and_returns(star_lines(spark, d)), "lines")
    return mo.snapshot_stability(lines, mo.snapshot_days(lines, HORIZON), HORIZON)


@query("category_components")
def category_components(spark: SparkSession, d: str) -> DataFrame:
    lines = star_lines(spark, d)
    return mo.clr_components(lines, ev.latest_day(lines))


@query(
    "segment_agreement",
    f"""{RFM_SQL}, l AS (SELECT customer_id, rfm_segment AS a, CASE WHEN recency_days <= 90 THEN 'recent' ELSE 'away' END AS b FROM rfm), cl AS (SELECT a, b, count(*)::DOUBLE AS n FROM l GROUP BY 1, 2),
    x AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cl GROUP BY a)) AS sa, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cl GROUP BY b)) AS sb FROM cl)
    SELECT round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari FROM x""",
)
def segment_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(star_lines(spark, d)).withColumn("b", F.when(F.col("recency_days") <= 90, "recent").otherwise("away"))
    return rounded(mo.adjusted_rand(rows, "rfm_segment", "b"))


@query(
    "segment_comparison",
    f"""{RFM_SQL}, cs AS (SELECT rfm_segment, CASE WHEN n_trips > 1 THEN 'repeat' ELSE 'single' END AS buyer, count(*) AS customers, round(quantile_cont(net_spend, 0.5), 4) AS median_net_spend, quantile_cont(recency_days, 0.5) AS median_recency_days, round(avg((n_trips > 1)::INTEGER), 6) AS repeat_rate FROM rfm GROUP BY 1, 2)
    SELECT *, round(customers / sum(customers) OVER (PARTITION BY rfm_segment), 6) AS share_of_rfm_segment, round(customers / sum(customers) OVER (PARTITION BY buyer), 6) AS share_of_buyer FROM cs""",
)
def segment_comparison(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(star_lines(spark, d)).withColumn("buyer", F.when(F.col("n_trips") > 1, "repeat").otherwise("single"))
    return rounded(sc.compare_segments(rows, "rfm_segment", "buyer")).withColumn("median_net_spend", F.round("median_net_spend", 4))


_NUM = ["n_trips", "recency_days", "gross_spend", "mean_trip_value"]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM core" for i, a in enumerate(_NUM) for b in _NUM[i:])


@query("correlation_matrix", f"{CORE_SQL}, r AS ({_CORR}) SELECT * FROM r")
def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ac.correlation_matrix(scored(star_lines(spark, d)), _NUM))


@query("explorer_filter", f"{RFM_SQL} SELECT customer_id, rfm_segment, round(net_spend, 2) AS net_spend FROM rfm WHERE rfm_segment IN ('Champions', 'Potential loyalists') AND net_spend >= 500000 ORDER BY net_spend DESC, customer_id LIMIT 1000")
def explorer_filter(spark: SparkSession, d: str) -> DataFrame:
    out = ac.explorer(scored(star_lines(spark, d)), ["Champions", "Potential loyalists"], least_value=500_000.0)
    return rounded(out.select("customer_id", "rfm_segment", "net_spend"), 2)


@query("customer_record", f"{RFM_SQL} SELECT customer_id, feature, value FROM (SELECT customer_id, n_trips::VARCHAR AS n_trips, recency_days::VARCHAR AS recency_days, rfm_segment FROM rfm WHERE customer_id = '7') UNPIVOT (value FOR feature IN (n_trips, recency_days, rfm_segment))")
def customer_record(spark: SparkSession, d: str) -> DataFrame:
    return ac.record(scored(star_lines(spark, d)).select("customer_id", "n_trips", "recency_days", "rfm_segment"), "7")


@query("segment_quartiles", f"{RFM_SQL} SELECT rfm_segment, count(*) AS n, round(quantile_cont(recency_days, 0.25), 4) AS q1, round(quantile_cont(recency_days, 0.5), 4) AS median, round(quantile_cont(recency_days, 0.75), 4) AS q3 FROM rfm GROUP BY 1")
def segment_quartiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ac.quartiles(scored(star_lines(spark, d)), "rfm_segment", "recency_days"), 4)


@query("segment_z_scores", f"{RFM_SQL}, w AS (SELECT avg(n_trips) AS m, stddev_samp(n_trips) AS s, avg(recency_days) AS mr, stddev_samp(recency_days) AS sr FROM rfm), gs AS (SELECT rfm_segment, avg(n_trips) AS a, avg(recency_days) AS b FROM rfm GROUP BY 1) SELECT rfm_segment, 'n_trips' AS feature, round((a - m) / s, 6) AS z FROM gs, w UNION ALL SELECT rfm_segment, 'recency_days', round((b - mr) / sr, 6) FROM gs, w")
def segment_z_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ac.segment_z_scores(scored(star_lines(spark, d)), "rfm_segment", ["n_trips", "recency_days"]))


@query("mean_by_segment", f"{RFM_SQL} SELECT rfm_segment, round(avg(n_trips), 6) AS mean, count(*) AS rows FROM rfm GROUP BY 1 ORDER BY 2 DESC LIMIT 20")
def mean_by_segment(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ac.mean_by(scored(star_lines(spark, d)), "rfm_segment", "n_trips"))


_PCT = "CASE WHEN a <> 0 THEN round((b - a) / a * 100, 4) END"
_MEANS = " UNION ALL ".join(f"SELECT '{m}' AS metric, avg({m}) FILTER (rfm_segment = 'Champions') AS a, avg({m}) FILTER (rfm_segment = 'Hibernating / low frequency') AS b FROM rfm" for m in _NUM)


@query("segment_difference", f"{RFM_SQL}, md AS ({_MEANS}) SELECT metric, round(a, 4) AS mean_a, round(b, 4) AS mean_b, {_PCT} AS difference_pct FROM md")
def segment_difference(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ov.segment_difference(scored(star_lines(spark, d)), "rfm_segment", "Champions", "Hibernating / low frequency", _NUM), 4)


@query(
    "segment_crosstab",
    f"""{RFM_SQL}, l AS (SELECT rfm_segment AS a, CASE WHEN n_trips > 1 THEN 'repeat' ELSE 'single' END AS b FROM rfm)
    SELECT coalesce(a, 'All') AS rfm_segment, coalesce(b, 'All') AS buyer, count(*) AS customers FROM l GROUP BY CUBE (a, b)""",
)
def segment_crosstab(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(star_lines(spark, d)).withColumn("buyer", F.when(F.col("n_trips") > 1, "repeat").otherwise("single"))
    return ov.crosstab(rows, "rfm_segment", "buyer")


@query("cohort_sizes", f"{RFM_SQL}, f AS (SELECT customer_id, strftime(min(transaction_day), '%Y-%m') AS cohort_month FROM trips GROUP BY 1) SELECT cohort_month, count(*) AS customers, round(sum(net_spend), 2) AS revenue FROM rfm JOIN f USING (customer_id) GROUP BY 1")
def cohort_sizes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ov.cohort_sizes(scored(star_lines(spark, d))), 2)


@query("dashboard_cards")
def dashboard_cards(spark: SparkSession, d: str) -> DataFrame:
    rows, _, lines = _scores(spark, d)
    as_of = ev.latest_day(lines)
    events = ev.purchase_events(lines, as_of)
    return ov.dashboard_cards(rows, survival.repeat_survival(events, as_of), mo.holdout_metrics(lines, as_of, HORIZON))


_CHECKS = """dup AS (SELECT transaction_id, product_id FROM lines GROUP BY 1, 2 HAVING count(*) > 1),
 mixed AS (SELECT transaction_id FROM lines GROUP BY 1 HAVING count(DISTINCT customer_id) > 1 OR count(DISTINCT transaction_date) > 1),
 prod AS (SELECT product_id FROM lines GROUP BY 1 HAVING count(DISTINCT product_description) > 1 OR count(DISTINCT department) > 1 OR count(DISTINCT category) > 1)
 SELECT 'missing values' AS constraint_name, (SELECT count(*) FROM lines WHERE customer_id IS NULL OR transaction_date IS NULL OR transaction_id IS NULL OR product_id IS NULL OR product_description IS NULL OR department IS NULL OR category IS NULL OR price IS NULL OR quantity IS NULL) AS violations
 UNION ALL SELECT 'price not above 0 or quantity 0', (SELECT count(*) FROM lines WHERE NOT (price > 0 AND quantity <> 0))
 UNION ALL SELECT 'repeated product in a transaction', (SELECT count(*) FROM dup)
 UNION ALL SELECT 'transaction with several customers or times', (SELECT count(*) FROM mixed)
 UNION ALL SELECT 'product with several descriptions', (SELECT count(*) FROM prod)"""


@query("constraint_violations", _CHECKS)
def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    return sy.constraint_violations(star_lines(spark, d))


@query("returns_to_purchases", "b AS (SELECT customer_id, product_id, max(transaction_date) AS last_bought FROM lines WHERE quantity > 0 GROUP BY 1, 2) SELECT customer_id, product_id, transaction_id, strftime(last_bought, '%Y-%m-%d') AS last_bought FROM lines JOIN b USING (customer_id, product_id) WHERE quantity < 0")
def returns_to_purchases(spark: SparkSession, d: str) -> DataFrame:
    lines = star_lines(spark, d)
    bought = lines.filter("quantity > 0").groupBy("customer_id", "product_id").agg(F.max("transaction_date").alias("last_bought"))
    back = lines.filter("quantity < 0").select("customer_id", "product_id", "transaction_id")
    out = joining.checked_join(back, bought, ["customer_id", "product_id"], "many_to_one")
    return out.withColumn("last_bought", F.date_format("last_bought", "yyyy-MM-dd"))


_APP_SEGMENTS = _APP_SQL[: _APP_SQL.rindex(" SELECT customer_id, recency")] + ", ap AS (" + _APP_SQL[_APP_SQL.rindex(" SELECT customer_id, recency") :] + ")"
_RULE = "SELECT {n} AS priority, '{about}' AS category, {title} AS title, {impact}::DOUBLE AS impact, '{kind}' AS impact_type, '{track}' AS metric_to_track, {count}::BIGINT AS affected_count, '{rule}' AS priority_rule FROM {source}"


def _rule(n: int, title: str, impact: str, count: str, source: str) -> str:
    about, kind, rule, track = ac.RULES[n]
    return _RULE.format(n=n, about=about, kind=kind, rule=rule, track=track, title=title, impact=impact, count=count, source=source)


_ACTIONS = f"""{_K}, {_APP_SEGMENTS}, {_C}, ret AS (SELECT count(*) FILTER (now AND NOT ever) / count(*) FILTER (now) AS fresh, count(*) FILTER (k <= top AND NOT now) AS away, round(sum(revenue) FILTER (k <= top AND NOT now), 2) AS lost FROM v),
 {_CMP.format(key="category")}, cf AS (SELECT revenue / (sum(revenue) OVER ()) * 100 AS share, (revenue - coalesce(prior_revenue, 0)) / nullif(coalesce(prior_revenue, 0), 0) * 100 AS g FROM n LEFT JOIN o USING (category)), cm AS (SELECT median(share) AS mid FROM cf),
 ck AS (SELECT count(DISTINCT CASE WHEN g > 0 AND share < mid THEN 1 WHEN g > 0 THEN 2 WHEN g < 0 AND share >= mid THEN 3 END) AS kinds, count(*) AS n FROM cf, cm), {_ANOMALY},
 qi AS (SELECT DISTINCT customer_id, transaction_day, product_id AS item FROM lines, cutoff WHERE quantity > 0 AND transaction_day BETWEEN d - 89 AND d), qt AS (SELECT count(*) AS total, count(DISTINCT customer_id) AS customers FROM (SELECT DISTINCT customer_id, transaction_day FROM qi)), qs AS (SELECT item, count(*) AS k FROM qi GROUP BY 1),
 qp AS (SELECT x.item AS a, y.item AS b, count(*) AS k FROM qi x JOIN qi y ON x.customer_id = y.customer_id AND x.transaction_day = y.transaction_day AND x.item <> y.item GROUP BY 1, 2),
 ql AS (SELECT least(count(*), 5) AS n FROM qp JOIN qs u ON u.item = a JOIN qs w ON w.item = b, qt WHERE qp.k >= total * 0.01 AND customers >= 30 AND (qp.k::DOUBLE / u.k) / (w.k::DOUBLE / total) > 2)
 {_rule(1, "'Win back ' || away || ' valuable customers who stayed away'", "lost", "away", "ret WHERE away > 0")}
 UNION ALL {_rule(2, "'Reach ' || count(*) || ' customers at risk'", "round(sum(monetary), 2)", "count(*)", "ap WHERE segment IN ('At Risk High Value', 'At Risk') HAVING count(*) > 0")}
 UNION ALL {_rule(3, "'Guide the ' || format('{:.0f}', fresh * 100) || '% new customers to a second purchase'", "NULL", "0", "ret WHERE fresh > 0.2")}
 UNION ALL {_rule(4, "'Try ' || n || ' bundles of items bought together'", "NULL", "n", "ql WHERE n > 0")}
 UNION ALL {_rule(5, "'Review ' || kinds || ' kinds of category opportunities'", "NULL", "n", "ck WHERE kinds > 0")}
 UNION ALL {_rule(6, "'Look into ' || count(*) || ' unusual signals'", "NULL", "count(*)", "f HAVING count(*) > 0")}
 UNION ALL {_rule(7, "'Deepen ties with ' || count(*) || ' champions'", "round(sum(monetary), 2)", "count(*)", "ap WHERE segment = 'Champions' HAVING count(*) > 0")}"""


@query("action_matrix", _ACTIONS)
def action_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = star_lines(spark, d).select("customer_id", "transaction_day", "transaction_id", "product_id", "product_description", "category", "quantity", "line_revenue")
    lines, p = _period_of(settled(rows, "lines"))
    pairs = af.basket_associations(pr.in_period(lines, p.start, p.end), replace(FULL, level="product_id"))["pairs"]
    return ac.action_matrix(lines, p, pairs).withColumn("impact", F.round("impact", 2))


@query("segment_overview")
def segment_overview(spark: SparkSession, d: str) -> DataFrame:
    return ov.segment_overview(_clusters(spark, d)[0])


@query("executive_narrative", f"""{_DRIVERS} SELECT 'Revenue ' || CASE WHEN current_revenue >= prior_revenue THEN 'rose' ELSE 'fell' END || ' by ' || format('{{:,.2f}}', abs(current_revenue - prior_revenue)) || ', mostly through the ' || replace(primary_driver, '_', ' ') || '.' AS narrative FROM w""")
def executive_narrative(spark: SparkSession, d: str) -> DataFrame:
    lines, p = _lines(spark, d)
    return ac.narrative(pr.revenue_drivers(pr.period_kpis(lines, p)))


@query("action_quadrant")
def action_quadrant(spark: SparkSession, d: str) -> DataFrame:
    rows = _scores(spark, d)[0].filter("p_alive IS NOT NULL")
    return pr.quadrants(rows, "p_alive", "net_spend", ("Nurture", "Grow", "Win back", "Let go")).select("customer_id", "p_alive", "net_spend", "quadrant")
