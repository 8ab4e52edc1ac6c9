"""Networks of curve residuals and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratanet.operators import metrics as H
from stratanet.operators.pairs import Roles, complete_dates, pearson
from stratanet.operators.panel import NetworkKind
from stratanet.session import cut_lineage
from stratanet.sources.tables import type_family

DEFAULT_THRESHOLD = 0.3
MAX_SHAPE_LEVELS = 10


def residual_panel(
    residuals: DataFrame, kind: NetworkKind, keys: tuple[str, ...] = ()
) -> DataFrame:
    """(keys, label, node, date, residual) for one network per term or per issuer."""
    axes = ("term", "issuer") if kind is NetworkKind.ISSUER_BY_TERM else ("issuer", "term")
    return residuals.select(
        *keys, F.col(axes[0]).alias("label"), F.col(axes[1]).alias("node"), "date", "residual"
    )


def residual_networks(
    residuals: DataFrame,
    kind: NetworkKind = NetworkKind.ISSUER_BY_TERM,
    threshold: float = DEFAULT_THRESHOLD,
    keys: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every label: |corr| > threshold on complete dates, signed weight."""
    panel = residual_panel(residuals, kind, keys)
    on = (*keys, "label")
    roles = Roles(on, "node", "date", "residual")
    nodes = panel.select(*on, "node").distinct()
    pairs = pearson(cut_lineage(complete_dates(panel, roles)), roles)
    strong = F.round(F.abs(F.coalesce("measure", F.lit(0.0))), 9) > threshold
    edges = pairs.where(strong).select(
        *on, F.col("node_i").alias("src"), F.col("node_j").alias("dst"),
        F.col("measure").alias("weight"), F.col("measure").alias("strength"),
    )
    return nodes, edges


def residual_summary(
    nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ("label",), weighted: bool = True
) -> DataFrame:
    """The 21 network metrics of every label."""
    on = list(keys)
    row = H.network_summary(nodes, edges, keys)
    parts = H.greedy_communities(nodes, edges, keys)
    return (
        row.join(H.modularity(edges, parts, keys, "weight" if weighted else None), on, "left")
        .join(H.degree_mixing(nodes, edges, keys), on, "left")
        .join(H.maximal_cliques(nodes, edges, keys), on, "left")
        .join(H.spectral_radius(nodes, edges, keys), on, "left")
    )


def coverage(curve: DataFrame, issuer: str = "source", date: str = "date") -> DataFrame:
    """First and last date, span in days and rows per issuer, longest first."""
    return (
        curve.groupBy(F.col(issuer).alias("issuer"))
        .agg(
            F.min(date).alias("min_date"),
            F.max(date).alias("max_date"),
            F.count(F.lit(1)).alias("n_obs"),
        )
        .withColumn(
            "coverage_days", F.datediff("max_date", "min_date").cast("bigint")
        )
        .orderBy(F.desc("coverage_days"), "issuer")
    )


def chart_columns(metrics: DataFrame, label: str = "label") -> DataFrame:
    """(column, numeric, discrete): which chart roles a metric column may take."""
    kinds = {
        f.name: ("BOOLEAN" if f.dataType.simpleString() == "boolean" else type_family(f.dataType))
        for f in metrics.schema.fields
        if f.name != label
    }
    ints = [c for c, k in kinds.items() if k == "INTEGER"]
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(k in ("INTEGER", "REAL")).alias("numeric"),
            (
                F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))) <= MAX_SHAPE_LEVELS
                if c in ints
                else F.lit(k in ("BOOLEAN", "TEXT"))
            ).alias("discrete"),
        )
        for c, k in kinds.items()
    ]
    return metrics.agg(F.array(*rows).alias("_r")).select(F.explode("_r").alias("r")).select("r.*")
