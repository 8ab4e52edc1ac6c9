"""Blocks of Spearman are as wide as those for sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratanet.operators import pairs as X
from stratanet.operators.pairs import Roles


def test_rank_blocks_are_wide_and_those_of_others_are_not(spark, monkeypatch):
    panel = X.written(spark.range(2000).select(F.lit("a").alias("layer"), F.col("id").alias("node"), F.lit(1).alias("dt"), F.rand(2).alias("value")), "panel")
    cut, seen = X.tile_sizes, []
    monkeypatch.setattr(X, "tile_sizes", lambda *a, **k: seen.append(cut(*a, **k)) or seen[-1])
    for name in ("pearson_correlation", "spearman_correlation", "kendall_tau"):
        X.MEASURES[name].build(panel, Roles())
    sums, ranks, signs = (s.first()["_blocks"] for s in seen)
    assert ranks == sums and signs > 3 * ranks
