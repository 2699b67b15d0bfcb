"""Registered queries against their SQL oracles on the smoke tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from ledgerline import registry
from ledgerline.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["issue_counts", "category_summary", "returns_asof", "rfm_scores", "window_features", "gated_promo_features", "trend_features", "period_kpis", "retention_metrics", "anomaly_daily", "affinity_pair_stats", "repeat_survival", "cohort_retention", "dimension_summaries", "affinity_pairs_product", "affinity_significance", "action_matrix", "basket_pairs", "basket_products", "rfm_app", "rfm_segment_profile", "lorenz_segments"])
def test_query_equals_oracle(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    columns = sorted(got.columns)
    clean = lambda d: sorted(tuple(None if v != v or v is None else (round(float(v), 4) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)) for v in r) for r in d[columns].astype(object).itertuples(index=False))
    assert list(map(str, clean(got))) == list(map(str, clean(want)))


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and len(names) > 90


def test_affinity_queries_take_all_baskets(spark, monkeypatch):
    from ledgerline.operators import affinity as af

    real, used = af.candidate_baskets, []

    def spied(lines, c):
        used.append((c.max_baskets, c.max_pair_operations))
        return real(lines, c)

    monkeypatch.setattr(af, "candidate_baskets", spied)
    for name in ("affinity_filtered", "transition_significance"):
        assert registry.queries()[name](spark, SF).count() >= 0
    assert used == [(None, None)] * 2


def test_transition_significance_follows_the_counts_of_all_baskets(spark):
    sf = "/root/testdata/sf0.01"
    n = registry.queries()["next_trip_transitions"](spark, sf).toPandas().set_index(["from_item", "to_item"])
    got = registry.queries()["transition_significance"](spark, sf).toPandas().set_index(["from_item", "to_item"])
    assert len(got) == len(n)
    ab, a, b, total = (n[c].astype(float) for c in ("n_pair", "n_from_item", "n_to_item", "N"))
    want = (abs(ab * total - a * b) - total / 2) ** 2 * total / (a * b * (total - a) * (total - b))
    assert (abs(want - got.chi2.reindex(n.index)) <= 1e-6 * (1 + want)).all()


@pytest.fixture(scope="module")
def derived(tmp_path_factory):
    """The smoke tables with products whose metadata conflict, and customers who keep to a group of categories."""
    folder = tmp_path_factory.mktemp("derived")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW src_{t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    con.sql("CREATE TABLE kinds AS SELECT p_partkey, row_number() OVER (PARTITION BY p_type IN (SELECT p_type FROM src_part GROUP BY 1 ORDER BY 1 LIMIT 2) ORDER BY p_partkey) - 1 AS i, p_type IN (SELECT p_type FROM src_part GROUP BY 1 ORDER BY 1 LIMIT 2) AS few FROM src_part")
    made = {
        "part": "SELECT * FROM src_part UNION ALL SELECT * REPLACE (p_name || ' II' AS p_name, CASE WHEN p_partkey % 2 = 0 THEN 'Brand#99' ELSE p_brand END AS p_brand) FROM src_part WHERE p_partkey <= 6",
        "lineitem": "SELECT l.* REPLACE (k.p_partkey AS l_partkey) FROM src_lineitem l JOIN src_orders o ON l_orderkey = o_orderkey JOIN kinds k ON k.few = (o_custkey % 4 = 0) AND k.i = l_partkey % (SELECT count(*) FROM kinds x WHERE x.few = (o_custkey % 4 = 0))",
    }
    for t in TABLES:
        con.sql(f"COPY ({made.get(t, f'SELECT * FROM src_{t}')}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return str(folder), con


@pytest.mark.parametrize("name", ["product_variants", "affinity_filtered", "product_summary"])
def test_query_equals_oracle_with_rows(spark, derived, name):
    folder, con = derived
    got = registry.queries()[name](spark, folder).toPandas()
    want = con.sql(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want) > 0
    clean = lambda d: sorted(str(tuple(None if v != v or v is None else (round(float(v), 4) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)) for v in r)) for r in d[columns].astype(object).itertuples(index=False))
    assert clean(got) == clean(want)
