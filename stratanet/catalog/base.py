"""Registry of catalogue queries and rounding shared by them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a name, with the SQL it must equal."""

    def add(fn):
        REGISTRY[name] = (fn, sql)
        return fn

    return add


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.nanvl(c, F.lit(None)), 6) + F.lit(0.0)


def r6_of_many(c: Column | str) -> Column:
    """``r6`` for large tables: only values beside a half, and large ones, are rounded as decimals.

    Below a million a product with 1e6 is off by less than 1e-3, so that the nearest
    whole number is certain elsewhere; whole / 1e6 is the double nearest to the decimal.
    """
    c = F.col(c) if isinstance(c, str) else c
    scaled = c * F.lit(1e6)
    whole = F.rint(scaled)
    certain = (F.abs(c) < 1e6) & (F.abs(scaled - whole) < 0.499)
    return F.when(certain, whole / F.lit(1e6) + F.lit(0.0)).otherwise(r6(c))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})
