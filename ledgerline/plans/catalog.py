"""Where queries and their oracles are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources.star import LINES_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, dates: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` is a SELECT, or further CTEs and a SELECT, over lines, cutoff and trips.

    The ``dates`` are given out as text by both, since engines hand dates over as different types.
    """

    def register(f: Query) -> Query:
        QUERIES[name] = (lambda spark, d: f(spark, d).withColumns({c: F.col(c).cast("string") for c in dates})) if dates else f
        if oracle:
            body = oracle.strip()
            whole = f"WITH {LINES_SQL}{', ' if not body.upper().startswith('SELECT') else ' '}{body}"
            texts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
            ORACLES[name] = f"SELECT * REPLACE ({texts}) FROM ({whole})" if dates else whole
        return f

    return register
