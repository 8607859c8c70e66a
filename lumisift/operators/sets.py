"""Unions by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_sectors(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts; columns by name, missing ones null; an id in two parts stays two rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_catalogs(parts: list[DataFrame], key: str = "tic_id") -> DataFrame:
    """All ids of several catalogs, with how many of their rows hold each."""
    return union_sectors([p.select(key) for p in parts]).filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
