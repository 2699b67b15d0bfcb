"""Named queries over the star-schema tables, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from ledgerline.plans import basket_queries, catalog, core_queries, model_queries, period_queries  # noqa: F401  they register


def queries() -> dict[str, catalog.Query]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.ORACLES)
