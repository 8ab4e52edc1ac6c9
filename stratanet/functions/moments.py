"""Aggregates that stay defined where the built-in raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson; null without variance, where the built-in divides by zero."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 0) & (sy > 0), F.covar_pop(x, y) / sx / sy)
