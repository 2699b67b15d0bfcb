"""Many days, groups and clusterings at once, against the same work done one by one or by brute force."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.functions.quantiles import grouped_quantiles
from ledgerline.functions.ranking import least_from, level, value_ranks
from ledgerline.operators import affinity as af
from ledgerline.operators import clustering as cl
from ledgerline.operators import events as ev
from ledgerline.operators import features as ft
from ledgerline.operators import lifetime as lt
from ledgerline.operators import models as mo
from ledgerline.operators import overview as ov
from ledgerline.operators import scoring as sc
from ledgerline.operators import snapshots as sn
from ledgerline.operators import summaries as sm
from ledgerline.sources.star import star_lines

SF = "/root/testdata/sf0.001"


# -- quantiles and ranks


def test_quantiles_are_exact_for_groups_and_columns(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(rng.gamma(0.3) * 10.0 ** rng.integers(-3, 6)), float(rng.integers(0, 4)), None) for g in ("a", "b") for _ in range(3000)] + [("one", 5.0, None, None), ("b", float("nan"), 1.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double, none double")
    shares = (0.0, 0.05, 0.25, 0.5, 0.9, 1.0)
    got = grouped_quantiles(df, ["x", "y", "none"], shares, ["g"], slices=64, small=2)
    p = df.toPandas()
    for g, part in p.groupby("g"):
        for c in ("x", "y"):
            v = part[c].dropna()
            if len(v):
                assert np.allclose(got[g,][c], np.quantile(v, shares), rtol=1e-12)
        assert "none" not in got[g,]
    assert got["one",] == {"x": [5.0] * 6} and grouped_quantiles(df.limit(0), ["x"], shares) == {}
    mixed = grouped_quantiles(df, ["x", "y", "none"], shares, ["g"], small=3000)  # some groups in one pass, some by slices
    assert all(mixed[g][c] == pytest.approx(got[g][c]) for g in got for c in got[g])
    want = df.filter("NOT isnan(x)").agg(F.percentile("x", F.array(*[F.lit(s) for s in shares]))).first()[0]
    assert grouped_quantiles(df, ["x"], shares, small=0)[()]["x"] == list(want)


def test_levels_are_even_below_one_and_rise(spark):
    df = spark.range(1_000_000).select((F.xxhash64("id").cast("double") / 2.0**64 + 0.5).alias("v"))
    most, levels = df.groupBy(level(F.col("v")).alias("l")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.count(F.lit(1))).first()
    assert most < 500 and levels > 10_000
    values = [-1e9, -3.5, -1.0, -0.2, -1e-30, 0.0, 1e-30, 1e-9, 0.1, 0.5, 0.500001, 1.0, 1.5, 7.0, 1e12]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", level(F.col("v")).alias("l")).orderBy("v").select("l").collect()]
    assert got == sorted(got)
    ranks = value_ranks(df.limit(5000), "v").toPandas().sort_values("v")
    assert (ranks.before_n.to_numpy() == np.arange(5000)).all()


def test_least_from_the_right_and_false_discovery_rates(spark):
    rng = np.random.default_rng(2)
    order = np.round(rng.random(4000), 3)
    value = rng.random(4000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(order, value, strict=True)], "o double, v double")
    got = least_from(df.groupBy("o").agg(F.min("v").alias("v")), "o", "v", "m").toPandas().sort_values("o")
    want = pd.Series(value).groupby(order).min()[::-1].cummin()[::-1]
    assert np.array_equal(got.m, want)
    p = np.concatenate([rng.random(3000) ** 3, np.zeros(5), np.ones(7)])
    q = af.benjamini_hochberg(spark.createDataFrame([(float(x),) for x in p], "p_value double")).toPandas()
    assert len(q) == len(p)
    ranked = np.sort(p)
    raw = np.minimum(np.minimum.accumulate((ranked * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1], 1)
    assert np.allclose(q.sort_values("p_value").q_value, raw[np.searchsorted(ranked, np.sort(p))], rtol=1e-12)


def test_no_task_holds_all_pairs_or_a_segment(spark):
    df = spark.createDataFrame([("a", str(i), float(i % 97)) for i in range(500)] + [("b", str(i), float(i)) for i in range(40)], "seg string, customer_id string, v double")
    curve = sm.lorenz(df, "customer_id", "v", ["seg"])
    gini = sm.lorenz_gini(df, "v", ["seg"])
    for plan in (curve, gini, af.benjamini_hochberg(df.select((F.col("v") / 100).alias("p_value")))):
        text = plan._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in text.splitlines() if "Window [" in line]
        assert windows and all("__level" in w or "__of" in w or "__head" in w for w in windows), windows
    for seg, part in df.toPandas().groupby("seg"):
        v = np.sort(part.v.to_numpy())
        n = len(v)
        want = 2 * (np.arange(1, n + 1) * v).sum() / (n * v.sum()) - (n + 1) / n
        assert {r["seg"]: r["gini"] for r in gini.collect()}[seg] == pytest.approx(want)
        c = curve.filter(F.col("seg") == seg).toPandas().sort_values("customer_share")
        assert np.allclose(c.value_share, np.cumsum(v) / v.sum())
    assert ov.leading_sum(df, "v", 50) == pytest.approx(np.sort(df.toPandas().v)[-50:].sum())


def test_budgets_take_a_prefix_of_customers(spark):
    sizes = spark.createDataFrame([(f"C{i}", 1 + i % 5) for i in range(300)], "customer_id string, n long")
    got = {r[0] for r in af._within(sizes, 200, 42).collect()}
    import hashlib

    order = sorted(((int(hashlib.md5(f"C{i}:42".encode()).hexdigest()[:8], 16), f"C{i}", 1 + i % 5) for i in range(300)))
    total, want = 0, set()
    for _, c, n in order:
        total += n
        if total > 200:
            break
        want.add(c)
    assert got == want


# -- many days


def test_features_at_many_days_equal_those_of_each_day(spark):
    lines = star_lines(spark, SF)
    days = mo.snapshot_days(lines)
    assert len(days) > 20
    events = ev.purchase_events(lines)
    got = sn.snapshots_at(lines, events, days).toPandas()
    for day in (days[0], days[9], days[-1]):
        a = got[got.as_of == day].set_index("customer_id").sort_index()
        core = ft.customer_core(ev.purchase_events(lines, day), day).toPandas().set_index("customer_id").sort_index()
        assert list(a.index) == list(core.index)
        for c in core.columns:
            x, y = a[c], core[c]
            assert (x.astype(str) == y.astype(str)).all() if c.endswith("_day") else np.array_equal(x.astype(float), y.astype(float), equal_nan=True), c
        back = ft.return_features(lines, day).toPandas().set_index("customer_id")
        both = back.index.intersection(a.index)
        for c in back.columns:
            assert np.allclose(a.loc[both, c].astype(float), back.loc[both, c].astype(float)), c
        promo = ft.promo_features(lines, day).toPandas().set_index("customer_id").promo_spend_share.dropna().astype(float)
        assert np.allclose(a.promo_spend_share.dropna().astype(float), promo.reindex(a.promo_spend_share.dropna().index))


def test_models_of_groups_equal_those_of_each_group(spark):
    lines = star_lines(spark, SF)
    days = mo.snapshot_days(lines)[-2:]
    cores = sn.core_at(ev.purchase_events(lines), days)
    together = lt.fit_groups(cores, "as_of")
    for day in days:
        for fit, alone in ((together[day]["bgnbd"], lt.fit_bgnbd(cores.filter(F.col("as_of") == F.lit(day)))), (together[day]["gamma_gamma"], lt.fit_gamma_gamma(cores.filter(F.col("as_of") == F.lit(day))))):
            assert fit.status == "fitted" and fit.value == pytest.approx(alone.value, rel=1e-9)
            assert [v for _, v in fit.params] == pytest.approx([v for k, v in alone.params if not k.startswith("spearman")], rel=1e-4)


# -- clusters


def blobs(spark, n=240, groups=("g",), seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for g in groups:
        for i in range(n):
            c = i % 4
            rows.append((g, f"C{i}", float(np.exp(rng.normal((0, 2, 0, 2)[c], 0.2))), float(np.clip(rng.normal((0.2, 0.9, 0.9, 0.2)[c], 0.05), 0, 1)), float(np.exp(rng.normal(3 + c % 2, 0.3))), float(rng.random() * 0.2), float(rng.gamma(2.0)), float(rng.random()), int(rng.integers(1, 300)), int(rng.integers(1, 9)), 1.0))
    return spark.createDataFrame(rows, "day string, customer_id string, expected_trips double, p_alive double, expected_trip_value double, return_value_ratio double, regularity_shape_shrunk double, promo_spend_share double, recency_days int, n_trips long, gross_spend double").withColumn("expected_value", F.col("expected_trips") * F.col("expected_trip_value"))


def test_clusters_of_many_groups_equal_those_of_each_and_any_partitioning(spark):
    df = blobs(spark, groups=("a", "b", "c"), seed=4).unionByName(blobs(spark, 20, ("few",)))
    labels, table = cl.choose_clusters(df, "day", ks=(3, 4), bootstraps=4)
    got = {(r["day"], r["customer_id"]): (r["cluster"], r["cluster_label"]) for r in labels.collect()}
    rows = table.toPandas()
    assert len(got) == 720 and set(rows[rows.status == "skipped"].day) == {"few"} and (rows[rows.chosen].groupby("day").size() == 1).all()
    assert (rows[rows.status == "candidate"].bootstrap_ari_p05 <= rows[rows.status == "candidate"].bootstrap_ari).all()
    for n, gathered in ((1, 20_000), (5, 0)):  # groups in tasks of their own, and a job for each step
        again, _ = cl.choose_clusters(df.repartition(n), "day", ks=(3, 4), bootstraps=4, gathered=gathered)
        assert {(r["day"], r["customer_id"]): (r["cluster"], r["cluster_label"]) for r in again.collect()} == got
    alone, own = cl.choose_clusters(df.filter("day = 'b'").drop("day"), ks=(3, 4), bootstraps=4)
    assert {r["customer_id"]: r["cluster"] for r in alone.collect()} == {c: v[0] for (d, c), v in got.items() if d == "b"}
    b = rows[rows.day == "b"].set_index("k")
    for r in own.collect():
        assert r["silhouette"] == pytest.approx(b.loc[r["k"], "silhouette"]) and r["inertia"] == b.loc[r["k"], "inertia"] and r["bootstrap_ari"] == b.loc[r["k"], "bootstrap_ari"]


def matrix(spark, x, s=0):
    return spark.createDataFrame([(s, int(i) * 7919, [int(round(v * cl.SCALE)) for v in row]) for i, row in enumerate(x)], "s int, h long, x array<long>")


def test_lloyd_bootstraps_and_agreement_by_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.round(np.concatenate([rng.normal(m, 0.3, (40, 2)) for m in (0, 3, 6)]) * cl.SCALE) / cl.SCALE
    rows = matrix(spark, x)
    h = np.arange(len(x)) * 7919
    start = x[[0, 40, 80]]
    models = cl.lloyd(rows, {(0, 3, 0): start, (0, 3, 1): start, (0, 3, 2): start}, 1, 42, close=1e-9)
    for run in range(3):
        w, c = cl.run_weights(h, run, 1, 42), start
        for _ in range(50):
            label = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([np.average(x[label == i], axis=0, weights=w[label == i]) for i in range(3)])
        assert np.allclose(models[0, 3, run], c, atol=1e-6)
    assert 0.8 < cl.run_weights(np.arange(5000), 1, 1, 42).mean() < 1.2
    inertia, cells = cl.compared(rows, models, 1)
    label = ((x[:, None] - models[0, 3, 0][None]) ** 2).sum(axis=2)
    assert inertia[0, 3, 0] == pytest.approx(label.min(axis=1).sum(), rel=1e-4)
    assert cells[0, 3, 0, 1].sum() == len(x) and cl.agreement(cells[0, 3, 0, 1]) == pytest.approx(1.0)


def test_seeds_come_from_all_rows_and_not_from_partitions(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.1, (n, 2)) for m, n in ((0, 900), (5, 60), (-5, 12))])
    rows = matrix(spark, x)
    first = cl.seeds(rows, [0], [3], 2, 1, 42)
    for n in (1, 6):
        again = cl.seeds(rows.repartition(n), [0], [3], 2, 1, 42)
        assert all(np.array_equal(first[m], again[m]) for m in first)
    for m in ((0, 3, 0), (0, 3, 1)):
        assert sorted(round(float(v)) // 5 for v in first[m][:, 0]) == [-1, 0, 1]  # the rare groups too


def test_silhouette_by_brute_force(spark):
    rng = np.random.default_rng(6)
    x = np.round(np.concatenate([rng.normal(m, 1.0, (1000, 3)) for m in (0, 2, 4)]) * cl.SCALE) / cl.SCALE
    rows = matrix(spark, x)
    centres = {2: np.array([[0.5] * 3, [3.5] * 3]), 3: np.array([[0.0] * 3, [2.0] * 3, [4.0] * 3])}
    got = cl.silhouettes(rows, {(0, k): c for k, c in centres.items()}, {0: len(x)}, None, tile=700)
    part = cl.silhouettes(rows, {(0, k): c for k, c in centres.items()}, {0: len(x)}, 800)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for k, c in centres.items():
        label = cl.nearest(x, c)
        means = np.stack([d[:, label == j].sum(axis=1) for j in range(k)], axis=1)
        size = np.bincount(label, minlength=k)
        own = np.arange(len(x)), label
        a, b = means[own] / (size[label] - 1), means / size
        b[own] = np.inf
        b = b.min(axis=1)
        want = ((b - a) / np.maximum(a, b)).mean()
        assert got[0, k] == pytest.approx(want, abs=1e-5) and part[0, k] == pytest.approx(want, abs=0.05)


def test_silhouette_counts_every_customer(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = np.round(np.repeat(np.concatenate([rng.normal(m, 1.0, (500, 2)) for m in (0, 2)]), rng.integers(1, 5, 1000), axis=0) * cl.SCALE) / cl.SCALE
    centres = {2: np.array([[0.0] * 2, [2.0] * 2]), 3: np.array([[-1.0] * 2, [1.0] * 2, [3.0] * 2])}
    monkeypatch.setattr(cl, "BLOCK", 150)  # more blocks than usual
    got = cl.silhouettes(matrix(spark, x).unionByName(matrix(spark, x[:9], 1)), {(s, k): c for k, c in centres.items() for s in (0, 1)}, {0: len(x), 1: 9}, tile=60)
    for s, p in ((0, x), (1, x[:9])):
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
        for k, c in centres.items():
            label = cl.nearest(p, c)
            size = np.bincount(label, minlength=k)
            if (size > 0).sum() < 2:
                continue
            sums, own = np.stack([d[:, label == j].sum(axis=1) for j in range(k)], axis=1), (np.arange(len(p)), label)
            a, b = sums[own] / np.maximum(size[label] - 1, 1), np.where(size > 0, sums / np.maximum(size, 1), np.inf)
            b[own] = np.inf
            b = b.min(axis=1)
            assert got[s, k] == pytest.approx(np.where(size[label] > 1, (b - a) / np.maximum(a, b), 0).mean(), abs=1e-6)


def test_clusters_are_chosen_by_all_customers(spark):
    df = blobs(spark, 3200)
    found = [{r["k"]: r["silhouette"] for r in cl.choose_clusters(df, "day", ks=(3, 4), bootstraps=1, **more)[1].collect()} for more in ({}, {"sample": None}, {"sample": 1500})]
    assert found[0] == found[1] and found[0] != found[2]


def test_components_against_a_decomposition_in_memory(spark):
    lines = star_lines(spark, SF)
    days = mo.snapshot_days(lines)[-2:]
    logs, widths = sn.category_logs_at(lines, days, 30)
    got = cl.components(logs).toPandas()
    held = logs.toPandas()
    for day in days:
        part = held[held.as_of == day].sort_values("customer_id")
        x = np.stack(part.logs.to_list())
        assert x.shape[1] == widths[day] and np.allclose(x.sum(axis=1), 0, atol=1e-9)
        y = x - x.mean(axis=0)
        u, s, vt = np.linalg.svd(y, full_matrices=False)
        mine = np.stack(got[got.as_of == day].sort_values("customer_id").pc.to_list())
        for i in range(3):
            sign = np.sign(vt[i][np.argmax(np.abs(vt[i]))])
            assert np.allclose(mine[:, i], sign * u[:, i] * s[i], atol=1e-3 * s[i])


def test_snapshots_cover_all_quarters_with_agreement_and_persistence(spark):
    lines = star_lines(spark, SF)
    days = mo.snapshot_days(lines)
    assert len(days) > 20 and (days[0].month, days[0].day) in {(3, 31), (6, 30), (9, 30), (12, 31)}
    labels, table = mo.cluster_snapshots(lines, days[-3:], ks=range(3, 5), bootstraps=2)
    got = mo.stability_of(labels).toPandas()
    pairs, parts = got[got.cluster.isna()], got[got.cluster.notna()]
    assert len(pairs) == 2 and pairs.label_agreement.between(0, 1).all() and (pairs.ari > -0.5).all()
    last = pairs.iloc[-1]
    assert parts[parts.to_day == last.to_day].customers.sum() == last.common_customers and parts.persistence.between(1 / 4 - 1e-9, 1).all()
    features = set(table.toPandas().features_used.iloc[0].split(","))
    assert {"promo_spend_share", "category_mix_pc1", "category_mix_pc3"} <= features
    assert mo.snapshot_labels(labels).columns == ["customer_id", "cluster", "cluster_label", "snapshot"]
    assert mo.snapshot_stability(lines, []).count() == 0


def test_cluster_names_follow_their_medians(spark):
    rows = [(0, "a", 0.9, 5, 10.0), (0, "b", 0.8, 5, 12.0), (1, "c", 0.1, 200, 1.0), (2, "d", None, 10, 50.0), (3, "e", 0.95, 1, 11.0)]
    df = spark.createDataFrame([("x", *r) for r in rows], "g string, cluster int, customer_id string, p_alive double, recency_days int, expected_value double")
    got = {r["cluster"]: r["cluster_label"] for r in cl.label_clusters(df, "g").collect()}
    assert got == {0: "Active / higher expected value", 1: "Lapsed / low expected value", 2: "Active / higher expected value (cluster 2)", 3: "Active / higher expected value (cluster 3)"}


def test_origins_share_one_pass_and_equal_single_holdouts(spark):
    lines = star_lines(spark, SF)
    day = ev.latest_day(lines)
    rows = mo.rolling_origins(lines, day, origins=3).toPandas()
    assert rows.as_of.nunique() == 2 and len(rows) == 14
    at = dt.date.fromisoformat(sorted(rows.as_of)[0])
    alone = mo.holdout_metrics(lines, at).toPandas().set_index(["model", "target"])
    for _, r in rows[rows.as_of == str(at)].iterrows():
        want = alone.loc[(r.model, r.target)]
        assert r.n == want.n and r.mae == pytest.approx(want.mae, rel=1e-4) and r.actual_total == pytest.approx(want.actual_total)
    tenths = mo.rolling_calibration(lines, day, origins=3).toPandas()
    assert tenths.groupby("as_of").decile.nunique().tolist() == [10, 10]


def test_ranks_of_groups_equal_those_of_each(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(g, float(rng.integers(0, 20)), float(rng.random()), bool(rng.integers(0, 2))) for g in "ab" for _ in range(200)], "g string, s double, t double, y boolean")
    area = {r["g"]: r["auc"] for r in sc.auc(df, "s", "y", ["g"]).collect()}
    rho = {r["g"]: r["spearman"] for r in sc.spearman(df, "s", "t", ["g"]).collect()}
    for g in "ab":
        part = df.filter(F.col("g") == g)
        p = part.toPandas()
        assert area[g] == sc.auc(part, "s", "y").first()["auc"] and rho[g] == pytest.approx(p.s.rank().corr(p.t.rank()))


def test_hashed_pair_counts_by_brute_force(spark):
    rng = np.random.default_rng(9)
    baskets = [(f"C{i % 40}", f"B{i}", [f"P{j}" for j in np.unique(rng.zipf(1.6, 9) % 60)]) for i in range(400)]
    held = spark.createDataFrame(baskets, "customer_id string, basket_key string, items array<string>")
    counts = {}
    for _, _, items in baskets:
        for a in sorted(items):
            for b in sorted(items):
                if a < b:
                    counts[a, b] = counts.get((a, b), 0) + 1
    whole = {(r["a"], r["b"]): tuple(r) for r in af.pair_counts(held).collect()}
    assert {k: v[2] for k, v in whole.items()} == counts
    for buckets in (7, 1 << 20):
        got = {(r["a"], r["b"]): tuple(r) for r in af.frequent_pairs(held, 5, buckets=buckets).collect()}
        assert got == {k: v for k, v in whole.items() if v[2] >= 5}


def test_summaries_of_many_dimensions_equal_each(spark):
    lines = star_lines(spark, SF).withColumn("category", F.when(F.col("category") != "STANDARD", F.col("category")))
    together = sm.report_summaries(lines)
    for k, f in sm.DIMENSIONS.items():
        order = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
        assert order(together[k]) == order(sm.dimension_summary(lines, **{k: f(k)})), k


def test_segment_overview_by_hand(spark):
    rows = [("Active / higher x", 0.9, 2.0, 10.0, 20.0, 5, "A"), ("Active / higher x", 0.7, 4.0, 20.0, 80.0, 7, "B"), ("Active / higher x", 0.8, 0.0, 0.0, 0.0, 9, "B"), (None, 0.1, 1.0, 1.0, 100.0, 300, None)]
    df = spark.createDataFrame(rows, "cluster_label string, p_alive double, expected_trips double, expected_trip_value double, expected_value double, recency_days int, top_category string")
    got = {r["segment"]: r for r in ov.segment_overview(df).collect()}
    a = got["Active / higher x"]
    assert (a["customers"], a["total_expected_revenue"], a["most_common_top_category"], a["share_of_customers"], a["share_of_expected_revenue"], a["mean_recency_days"]) == (3, 100.0, "B", 0.75, 0.5, 7.0)
    assert a["hypothesis_to_test"].startswith("Hypothesis: protect") and got["Unclustered"]["hypothesis_to_test"].startswith("Describe")
