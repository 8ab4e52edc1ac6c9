"""Rolling and expanding windows counted in observed dates.

A row at date index t belongs to windows k_min..k_max.  Rows with the same pair
of bounds belong to exactly the same windows, so sums can be taken per bound
pair first and spread over the windows afterwards; rows are copied only where a
measure needs whole series.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratanet.operators import pairs as X
from stratanet.operators.pairs import Roles
from stratanet.session import cut_lineage


@dataclass(frozen=True)
class Schedule:
    size: int = 252
    step: int = 21
    expanding: bool = False

    def __post_init__(self):
        if self.size < 3:
            raise ValueError("a window holds at least 3 observations")
        if self.step < 1:
            raise ValueError("step is at least 1")


def date_index(
    df: DataFrame, date: str, by: tuple[str, ...] = ()
) -> DataFrame:
    """(by, date, t, n_dates): position among the distinct dates of each subject."""
    w = Window.partitionBy(*by)
    return (
        df.select(*by, date)
        .distinct()
        .withColumn("t", (F.row_number().over(w.orderBy(date)) - 1).cast("bigint"))
        .withColumn("n_dates", F.count(F.lit(1)).over(w))
    )


def window_table(index: DataFrame, date: str, s: Schedule, by: tuple[str, ...] = ()):
    """(by, window_idx, date_start, date_end)."""
    w = Window.partitionBy(*by).orderBy(date)
    start = F.first(date).over(w) if s.expanding else F.lag(date, s.size - 1).over(w)
    ends = F.col("t") - (s.size - 1)
    return (
        index.withColumn("date_start", start)
        .where((ends >= 0) & (ends % s.step == 0))
        .select(
            *by,
            F.floor(ends / s.step).cast("bigint").alias("window_idx"),
            "date_start",
            F.col(date).alias("date_end"),
        )
    )


def window_bounds(s: Schedule) -> tuple[Column, Column]:
    """k_min and k_max of a row from its t and the subject's n_dates."""
    t = F.col("t")
    last = F.floor((F.col("n_dates") - s.size) / s.step)
    lo = F.greatest(F.lit(0), F.ceil((t - s.size + 1) / F.lit(s.step)))
    hi = last if s.expanding else F.least(F.floor(t / s.step), last)
    return lo.cast("bigint"), hi.cast("bigint")


def bounded_rows(
    df: DataFrame, date: str, s: Schedule, by: tuple[str, ...] = (), index: DataFrame | None = None
) -> DataFrame:
    """Add t, k_min and k_max; rows in no window are dropped."""
    index = date_index(df, date, by) if index is None else index
    lo, hi = window_bounds(s)
    placed = df.join(index, [*by, date]).withColumn("k_min", lo).withColumn("k_max", hi)
    return placed.where(F.col("k_min") <= F.col("k_max")).drop("n_dates")


def spread(df: DataFrame) -> DataFrame:
    """One copy per window of a row (or of a partial sum)."""
    copies = F.explode(F.sequence("k_min", "k_max"))
    return df.withColumn("window_idx", copies).drop("k_min", "k_max")


def assign_windows(
    df: DataFrame, date: str, s: Schedule, by: tuple[str, ...] = ()
) -> DataFrame:
    return spread(bounded_rows(df, date, s, by)).drop("t")


def window_node_counts(bounded: DataFrame, roles: Roles) -> DataFrame:
    """(window_idx, keys, node, n): observations of each node in each window."""
    part = bounded.groupBy(
        *roles.keys, F.col(roles.node).alias("node"), "k_min", "k_max"
    ).agg(F.count(F.lit(1)).alias("n"))
    return (
        spread(part)
        .groupBy("window_idx", *roles.keys, "node")
        .agg(F.sum("n").alias("n"))
    )


def _merge_blocks(parts: Column) -> Column:
    """Counts, means and co-moments of two series over several blocks of dates.

    Blocks are added one by one by the pairwise update, which only uses the
    distance of means, so that a level far above the scatter costs no digits.
    """

    def step(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        dx, dy = b["mx"] - a["mx"], b["my"] - a["my"]
        weight = a["n"] * b["n"] / n
        return F.struct(
            n.alias("n"),
            (a["mx"] + dx * b["n"] / n).alias("mx"),
            (a["my"] + dy * b["n"] / n).alias("my"),
            (a["cxx"] + b["cxx"] + dx * dx * weight).alias("cxx"),
            (a["cyy"] + b["cyy"] + dy * dy * weight).alias("cyy"),
            (a["cxy"] + b["cxy"] + dx * dy * weight).alias("cxy"),
        )

    names = ("n", "mx", "my", "cxx", "cyy", "cxy")
    zero = F.struct(*[F.lit(0.0).alias(k) for k in names])
    return F.aggregate(parts, zero, lambda a, b: step(a, b))


def windowed_pearson(bounded: DataFrame, roles: Roles, min_obs: int = X.MIN_OBS) -> DataFrame:
    """Pearson of every pair in every window without copying panel rows.

    Moments are taken per block of dates, about the node's mean in the block,
    and merged over the blocks of a window. A series counts as flat when its
    deviation in the window is below what rounding leaves of its level.
    """
    block = ("k_min", "k_max")
    columns = [*roles.keys, roles.node, roles.date, roles.value, *block]
    bounded = cut_lineage(bounded.select(*columns))
    own = [*roles.keys, roles.node, *block]
    means = bounded.groupBy(*own).agg(F.avg(roles.value).alias("_mean"))
    local = (
        bounded.join(means, own)
        .withColumn(roles.value, F.col(roles.value) - F.col("_mean"))
        .drop("_mean")
    )
    sums = X.pair_totals(local, roles, extra_keys=block, sizing=bounded)
    for side in ("i", "j"):
        named = means.withColumnRenamed(roles.node, f"node_{side}").withColumnRenamed("_mean", f"_mean_{side}")
        sums = sums.join(named, [*roles.keys, *block, f"node_{side}"])
    n = F.col("n").cast("double")
    moments = F.struct(
        *block,
        n.alias("n"),
        (F.col("_mean_i") + F.col("sx") / n).alias("mx"),
        (F.col("_mean_j") + F.col("sy") / n).alias("my"),
        (F.col("sxx") - F.col("sx") * F.col("sx") / n).alias("cxx"),
        (F.col("syy") - F.col("sy") * F.col("sy") / n).alias("cyy"),
        (F.col("sxy") - F.col("sx") * F.col("sy") / n).alias("cxy"),
    )
    group = ["window_idx", *roles.keys, "node_i", "node_j"]
    merged = (
        spread(sums.withColumn("_part", moments))
        .groupBy(*group)
        .agg(_merge_blocks(F.array_sort(F.collect_list("_part"))).alias("m"))
    )
    m = {k: F.col(f"m.{k}") for k in ("n", "mx", "my", "cxx", "cyy", "cxy")}
    least = F.lit(1e-13)
    moves = [
        m[c] > m["n"] * (least * m[level]) * (least * m[level])
        for c, level in (("cxx", "mx"), ("cyy", "my"))
    ]
    r = m["cxy"] / F.sqrt(m["cxx"]) / F.sqrt(m["cyy"])
    defined = (m["n"] >= min_obs) & moves[0] & moves[1]
    return merged.select(
        *group,
        m["n"].cast("bigint").alias("n_obs"),
        F.when(defined, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("measure"),
    )


def windowed_measure(
    bounded: DataFrame, measure: str, roles: Roles, min_values: int = 3, **settings
) -> DataFrame:
    """Any measure per window; nodes with too few values in a window take no part."""
    if measure == "pearson_correlation":
        return windowed_pearson(bounded, roles)
    keys = ("window_idx", *roles.keys)
    rows = spread(bounded)
    enough = (
        window_node_counts(bounded, roles)
        .where(F.col("n") >= min_values)
        .withColumnRenamed("node", roles.node)
        .drop("n")
    )
    rows = rows.join(enough, [*keys, roles.node], "left_semi")
    return X.measure_pairs(
        rows, measure, Roles(keys, roles.node, roles.date, roles.value), **settings
    )
