"""From a stored table to a clean long panel, and the small table operations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratanet.functions.maturity import term_order, term_years, years_of_name
from stratanet.operators.pairs import Roles
from stratanet.sources.tables import type_family


class NetworkKind(str, Enum):
    """Which panel axis becomes the layer."""

    ISSUER_BY_TERM = "issuer_by_term"
    TERM_BY_ISSUER = "term_by_issuer"


@dataclass(frozen=True)
class CurvePanel:
    """Column roles of a wide curve table."""

    date: str
    issuer: str | None
    terms: tuple[str, ...]
    term_column: str = "term"
    rate_column: str = "rate"

    @property
    def usable(self) -> bool:
        return self.issuer is not None and len(self.terms) >= 2

    def roles(self, kind: NetworkKind) -> Roles:
        axes = (self.term_column, self.issuer)
        layer, node = axes if kind is NetworkKind.ISSUER_BY_TERM else axes[::-1]
        return Roles((layer,), node, self.date, self.rate_column)


def _free_name(name: str, taken: set[str]) -> str:
    candidate, n = name, 1
    while candidate in taken:
        n += 1
        candidate = f"{name}_{n}"
    return candidate


def detect_panel(df: DataFrame, date: str) -> CurvePanel:
    """Roles from the schema alone: numeric columns named like maturities are terms."""
    kinds = {f.name: type_family(f.dataType) for f in df.schema.fields if f.name != date}
    terms = [
        c
        for c, k in kinds.items()
        if k in ("INTEGER", "REAL") and years_of_name(c) is not None
    ]
    rest = [c for c in kinds if c not in terms]
    texts = [c for c in rest if kinds[c] == "TEXT"]
    issuer = (texts or rest or [None])[0]
    taken = set(df.columns)
    return CurvePanel(
        date,
        issuer,
        tuple(sorted(terms, key=years_of_name)),
        _free_name("term", taken),
        _free_name("rate", taken),
    )


def date_range(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    day = F.col(column)
    if start is not None:
        df = df.where(day >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(day <= F.lit(end).cast("date"))
    return df


def cell_mask(df: DataFrame, mask: DataFrame, columns: list[str]) -> DataFrame:
    """Keep the cells in the mask; an empty mask keeps nothing."""
    return df.join(mask.select(*columns).distinct(), columns, "left_semi")


def load_long_panel(
    df: DataFrame,
    panel: CurvePanel,
    *,
    where: str | None = None,
    start=None,
    end=None,
    mask: DataFrame | None = None,
) -> DataFrame:
    """where, date range, unpivot, drop nulls, mask; in that order.

    The first two run before the unpivot, so they reach the file scan.
    """
    if where:
        df = df.where(F.expr(where))
    df = df.withColumn(panel.date, F.col(panel.date).try_cast("date"))
    df = date_range(df, panel.date, start, end)
    wide = df.select(
        panel.date,
        panel.issuer,
        *[
            F.nanvl(F.col(f"`{t}`").try_cast("double"), F.lit(None)).alias(t)
            for t in panel.terms
        ],
    )
    long = wide.unpivot(
        [panel.date, panel.issuer],
        list(panel.terms),
        panel.term_column,
        panel.rate_column,
    ).dropna()
    if mask is not None:
        long = cell_mask(long, mask, [panel.term_column, panel.issuer])
    return long


def prepare_long(
    df: DataFrame, date: str, node: str, value: str, layer: str, *, start=None, end=None
) -> DataFrame:
    """Four columns of an already long table as (dt, layer, node, value)."""
    picked = df.select(
        F.col(date).try_cast("date").alias("dt"),
        F.col(layer).cast("string").alias("layer"),
        F.col(node).alias("node"),
        F.nanvl(F.col(value).try_cast("double"), F.lit(None)).alias("value"),
    )
    return date_range(picked, "dt", start, end).dropna()


def available_cells(long: DataFrame, term: str, issuer: str) -> DataFrame:
    return long.select(term, issuer).distinct()


def selection_counts(
    cells: DataFrame, mask: DataFrame, term: str, issuer: str
) -> DataFrame:
    """Checked and available cells per term, per issuer and in total."""
    checked = mask.select(term, issuer).distinct().withColumn("_on", F.lit(1))
    marked = cells.join(checked, [term, issuer], "left")
    return marked.groupingSets(
        [[F.col(term)], [F.col(issuer)], []], F.col(term), F.col(issuer)
    ).agg(F.count("_on").alias("checked"), F.count(F.lit(1)).alias("available"))


def invert_selection(
    cells: DataFrame, mask: DataFrame, term: str, issuer: str
) -> DataFrame:
    return cells.select(term, issuer).distinct().join(mask, [term, issuer], "left_anti")


def layer_values(df: DataFrame, layer: str) -> DataFrame:
    """Distinct layer labels in maturity order, with their position."""
    labels = df.select(F.col(layer).cast("string").alias("layer")).distinct()
    return sort_terms(labels, "layer")


def sort_terms(df: DataFrame, term: str) -> DataFrame:
    """Add term_pos over the (few) distinct labels of a small label table."""
    order = Window.orderBy(*term_order(F.col(term)))
    return df.withColumn("term_years", term_years(F.col(term))).withColumn(
        "term_pos", F.row_number().over(order).cast("bigint")
    )


def pivot_to_wide(
    panel: DataFrame, roles: Roles, nodes: list[str] | None = None
) -> DataFrame:
    """(keys, date) x nodes, one column each; duplicated (keys, date, node) cells raise.

    Names of columns are part of the plan, so there must be few enough nodes to
    name; where there aren't, keep the long form.
    """
    cell = F.when(
        F.count(F.lit(1)) > 1,
        F.raise_error(F.lit("duplicate (date, node) cell")).cast("double"),
    ).otherwise(F.first(roles.value))
    flat = panel.groupBy(*roles.keys, roles.date, roles.node).agg(cell.alias(roles.value))
    if nodes is None:
        nodes = sorted(r[0] for r in panel.select(roles.node).distinct().collect())
    return flat.groupBy(*roles.keys, roles.date).pivot(roles.node, nodes).agg(F.first(roles.value))


def daily_returns(panel: DataFrame, roles: Roles) -> DataFrame:
    """x / previous x - 1 within each (keys, node); undefined rows are dropped."""
    w = Window.partitionBy(*roles.keys, roles.node).orderBy(roles.date)
    prev = F.lag(roles.value).over(w)
    return (
        panel.withColumn("_prev", prev)
        .withColumn(roles.value, F.try_divide(F.col(roles.value), F.col("_prev")) - 1.0)
        .drop("_prev")
        .where(F.col(roles.value).isNotNull())
    )


Transform = Callable[[DataFrame, Roles], DataFrame]
TRANSFORMS: dict[str, Transform] = {"daily_returns": daily_returns}


#: A panel is in percent if this share of its sizes does not stay below the size.
PERCENT_SIZE, PERCENT_SHARE = 0.5, 0.9


def register_transform(name: str, fn: Transform) -> None:
    TRANSFORMS[name] = fn


def apply_transforms(panel: DataFrame, names: list[str], roles: Roles) -> DataFrame:
    """In the given order, always within the keys of ``roles``."""
    for name in names:
        if name not in TRANSFORMS:
            raise ValueError(f"unknown transform {name!r}")
        panel = TRANSFORMS[name](panel, roles)
    return panel


def detect_scale(panel: DataFrame, value: str = "rate") -> DataFrame:
    """One row: 0.01 when the panel is quoted in percent, else 1.0.

    In percent, nine tenths of the way up the sorted sizes lies above 0.5. How
    many sizes lie below settles that, and where the place falls between the
    last below and the first above, these two; no list of values is kept.
    """
    size = F.abs(F.col(value))
    below = size <= PERCENT_SIZE
    counted = panel.agg(
        F.count(size).alias("n"), F.count(F.when(below, 1)).alias("below"),
        F.max(F.when(below, size)).alias("last"), F.min(F.when(~below, size)).alias("first"),
    )
    place = (F.col("n") - 1) * PERCENT_SHARE
    low = F.floor(place)
    between = (low + 1 - place) * F.col("last") + (place - low) * F.col("first")
    percent = (F.col("below") <= low) | ((F.col("below") == low + 1) & (place > low) & (between > PERCENT_SIZE))
    return counted.select(F.when((F.col("n") > 0) & percent, 0.01).otherwise(1.0).alias("yield_scale"))


def dense_rows(curve: DataFrame, issuer: str, date: str, term: str) -> DataFrame:
    """Dates on which an issuer quotes every term it ever quotes."""
    have = curve.groupBy(issuer, date).agg(F.count(F.lit(1)).alias("_have"))
    want = (
        curve.select(issuer, term)
        .distinct()
        .groupBy(issuer)
        .agg(F.count(F.lit(1)).alias("_want"))
    )
    full = have.join(want, issuer).where(F.col("_have") == F.col("_want"))
    return curve.join(full.select(issuer, date), [issuer, date], "left_semi")


def _displayed(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def filter_displayed(df: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Per-column sets of displayed strings, combined with AND; null shows as ''."""
    tests = [_displayed(c).isin(list(v)) for c, v in allowed.items()]
    return df.where(reduce(Column.__and__, tests)) if tests else df


def facet_values(
    df: DataFrame, column: str, allowed: dict[str, list[str]]
) -> DataFrame:
    """Values of a column still reachable under the other columns' filters."""
    others = {c: v for c, v in allowed.items() if c != column}
    return (
        filter_displayed(df, others)
        .select(_displayed(column).alias("value"))
        .distinct()
        .orderBy("value")
    )


def sort_table(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    c = F.col(column)
    return df.orderBy(c.asc_nulls_first() if ascending else c.desc_nulls_last())
