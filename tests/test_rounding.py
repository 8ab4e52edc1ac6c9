"""Rounding of large tables gives the very doubles of ``r6``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stratanet.catalog.base import r6, r6_of_many


def test_many_values_round_as_decimals_do(spark):
    rng = np.random.default_rng(3)
    halves = (rng.integers(-10**7, 10**7, 3000) + 0.5) / 1e6
    beside = np.concatenate([np.nextafter(halves, 9.0), np.nextafter(halves, -9.0), halves + 4e-10, halves - 4e-10])
    odd = [0.0, -0.0, -1e-9, 5e-7, -5e-7, 1.0, -1.0, 999999.9999995, 1e6, 1e15, -1e22, float("inf"), float("-inf"), float("nan"), None]
    values = [*halves, *beside, *rng.uniform(-1, 1, 3000), *rng.uniform(-1e6, 1e6, 3000), *odd]
    table = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    rows = table.select(r6("v").alias("a"), r6_of_many("v").alias("b")).select(
        "a", "b", F.hex(F.col("a").cast("string")).alias("x"), F.hex(F.col("b").cast("string")).alias("y")
    ).collect()
    assert len(rows) == len(values)
    assert [r["x"] for r in rows] == [r["y"] for r in rows]
    assert rows[-1]["b"] is None and rows[-2]["b"] is None


def test_pair_tables_take_the_decimal_form_for_few_values(spark, sf_dir):
    from stratanet.catalog.measures import m1_sparse

    assert "rint" in m1_sparse(spark, sf_dir)._jdf.queryExecution().executedPlan().toString().lower()
