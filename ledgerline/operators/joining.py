"""Joins that check what they assume about their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("one_to_one", "one_to_many", "many_to_one", "many_to_many")


def repeated_keys(df: DataFrame, on: list[str]) -> DataFrame:
    """Keys that more than one row has, with their number of rows."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def checked_join(left: DataFrame, right: DataFrame, on: list[str], expect: str, how: str = "inner") -> DataFrame:
    """The join, after a look for repeated keys on the sides that must not have any; raises ValueError with one of them."""
    if expect not in KINDS:
        raise ValueError(f"expect must be one of {KINDS}")
    of_left, of_right = expect.split("_to_")
    for side, name, kind in ((left, "left", of_left), (right, "right", of_right)):
        if kind == "one" and (found := repeated_keys(side, on).first()) is not None:
            raise ValueError(f"{name} keys are not unique: {found.asDict()}")
    return left.join(right, on, how)


def optional_join(left: DataFrame | None, right: DataFrame | None, on: list[str], how: str = "inner") -> DataFrame | None:
    """An inner, left or outer join; where a side is missing, the other one, or nothing if the join needs it."""
    if how not in ("inner", "left", "outer"):
        raise ValueError(f"unknown join {how!r}")
    if left is not None and right is not None:
        return left.join(right, on, how)
    if left is None:
        return right if how == "outer" else None
    return left if how in ("left", "outer") else None
