"""Layer graphs and the multiplex as tables of nodes and edges.

A graph is a pair of frames: nodes(keys, node) and edges(keys, src, dst, weight,
strength) with src < dst.  Keys name the graph (layer, window, model, ...), so
one job builds every graph at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratanet.operators.keyless import keyless
from stratanet.operators.pairs import Roles

DEFAULT_THRESHOLD = 0.33


def passes(measure: Column, threshold: Column | float) -> Column:
    """Undefined counts as zero; nine decimals keep engines from disagreeing."""
    t = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    return F.round(F.coalesce(measure, F.lit(0.0)), 9) >= t


def threshold_edges(
    pairs: DataFrame, threshold: float = DEFAULT_THRESHOLD, keys: tuple[str, ...] = ("layer",)
) -> DataFrame:
    strength = F.coalesce(F.col("measure"), F.lit(0.0))
    return pairs.where(passes(F.col("measure"), threshold)).select(
        *keys,
        F.col("node_i").alias("src"),
        F.col("node_j").alias("dst"),
        (1.0 - strength).alias("weight"),
        strength.alias("strength"),
    )


def sweep_thresholds(
    pairs: DataFrame, thresholds: list[float], keys: tuple[str, ...] = ("layer",)
) -> DataFrame:
    """Edges of one pair table at several thresholds, read once."""
    listed = F.filter(
        F.array(*[F.lit(float(t)) for t in thresholds]),
        lambda t: passes(F.col("measure"), t),
    )
    tagged = pairs.withColumn("threshold", F.explode(listed))
    return tagged.select(
        "threshold",
        *keys,
        F.col("node_i").alias("src"),
        F.col("node_j").alias("dst"),
        (1.0 - F.coalesce("measure", F.lit(0.0))).alias("weight"),
    )


def with_strength(edges: DataFrame) -> DataFrame:
    """strength = 1 - weight; edges without a weight are dropped."""
    weight = F.nanvl("weight", F.lit(None))
    return edges.where(weight.isNotNull()).withColumn("strength", 1.0 - weight)


@keyless
def graph_nodes(panel: DataFrame, roles: Roles, min_rows: int = 3) -> DataFrame:
    """Nodes of every key that has enough rows and at least two nodes.

    Counting is per (key, node) first, so a hot key is reduced before it meets
    the per-key test.
    """
    keys = list(roles.keys)
    per_node = panel.groupBy(*keys, F.col(roles.node).alias("node")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    usable = (
        per_node.groupBy(*keys)
        .agg(F.sum("n_rows").alias("_rows"), F.count(F.lit(1)).alias("_nodes"))
        .where((F.col("_rows") >= min_rows) & (F.col("_nodes") >= 2))
    )
    return per_node.select(*keys, "node").join(usable.select(*keys), keys, "left_semi")


def both_ways(edges: DataFrame, *columns: str) -> DataFrame:
    """Each undirected edge once from either end: (…, node, other, columns)."""
    ends = F.array(
        F.struct(F.col("src").alias("node"), F.col("dst").alias("other")),
        F.struct(F.col("dst").alias("node"), F.col("src").alias("other")),
    )
    keys = [c for c in edges.columns if c not in ("src", "dst", "weight", "strength")]
    return edges.select(*keys, *columns, F.explode(ends).alias("_end")).select(
        *keys, "_end.*", *columns
    )


@keyless
def degrees(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, node, degree, weighted_degree); isolated nodes have 0."""
    per_node = (
        both_ways(edges, "strength")
        .groupBy(*keys, "node")
        .agg(
            F.count(F.lit(1)).alias("degree"),
            F.sum("strength").alias("weighted_degree"),
        )
    )
    return (
        nodes.select(*keys, "node")
        .join(per_node, [*keys, "node"], "left")
        .fillna(0, ["degree"])
        .fillna(0.0, ["weighted_degree"])
    )


# -- multiplex ----------------------------------------------------------------


def inter_edges(
    nodes: DataFrame, keys: tuple[str, ...] = (), weight: float = 1.0
) -> DataFrame:
    """(keys, node, layer_a, layer_b, weight) for every pair of a node's layers.

    Pairs come from one row per (key, node) holding the node's layer labels,
    whose number is bounded by the layer column, not by the data.
    """
    per_node = nodes.groupBy(*keys, "node").agg(F.sort_array(F.collect_set("layer")).alias("ls"))
    start = F.explode(
        F.transform(
            "ls", lambda a, i: F.struct(a.alias("layer_a"), F.slice("ls", i + 2, F.size("ls")).alias("rest"))
        )
    )
    first = per_node.select(*keys, "node", start.alias("p")).select(*keys, "node", "p.*")
    return first.select(
        *keys,
        "node",
        "layer_a",
        F.explode("rest").alias("layer_b"),
        F.lit(weight).alias("weight"),
    )


def multiplex_tables(
    nodes: DataFrame,
    edges: DataFrame,
    keys: tuple[str, ...] = (),
    terms: list[str] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes(issuer, term), intra(source_issuer, target_issuer, term, weight) and
    inter(source_issuer, target_issuer, term_from, term_to, weight).

    Intra edges carry the measure, inter edges 1.
    """
    n = nodes.select(*keys, F.col("node").alias("issuer"), F.col("layer").alias("term"))
    intra = edges.select(
        *keys,
        F.col("src").alias("source_issuer"),
        F.col("dst").alias("target_issuer"),
        F.col("layer").alias("term"),
        F.col("strength").alias("weight"),
    )
    inter = inter_edges(nodes, keys).select(
        *keys,
        F.col("node").alias("source_issuer"),
        F.col("node").alias("target_issuer"),
        F.col("layer_a").alias("term_from"),
        F.col("layer_b").alias("term_to"),
        "weight",
    )
    return filter_tables(n, intra, inter, terms) if terms is not None else (n, intra, inter)


def filter_tables(nodes, intra, inter, terms: list[str]):
    """Keep some layers; an inter edge needs both of its ends."""
    return (
        nodes.where(F.col("term").isin(terms)),
        intra.where(F.col("term").isin(terms)),
        inter.where(F.col("term_from").isin(terms) & F.col("term_to").isin(terms)),
    )


def available_terms(nodes: DataFrame) -> DataFrame:
    return nodes.select("term").distinct().orderBy("term")


def edge_table(intra: DataFrame, inter: DataFrame) -> DataFrame:
    return intra.withColumn("edge_type", F.lit("intra")).unionByName(
        inter.withColumn("edge_type", F.lit("inter")), allowMissingColumns=True
    )


def multiplex_edges(
    intra: DataFrame, inter: DataFrame, keys: tuple[str, ...] = ()
) -> DataFrame:
    """One edge list over (node, layer) vertices."""
    a = intra.select(
        *keys,
        F.struct(F.col("source_issuer").alias("node"), F.col("term").alias("layer")).alias("u"),
        F.struct(F.col("target_issuer").alias("node"), F.col("term").alias("layer")).alias("v"),
        "weight",
        F.lit("intra").alias("edge_type"),
    )
    b = inter.select(
        *keys,
        F.struct(F.col("source_issuer").alias("node"), F.col("term_from").alias("layer")).alias("u"),
        F.struct(F.col("target_issuer").alias("node"), F.col("term_to").alias("layer")).alias("v"),
        "weight",
        F.lit("inter").alias("edge_type"),
    )
    return a.unionByName(b)


def count_edge_types(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return edges.groupBy(*keys, "edge_type").agg(F.count(F.lit(1)).alias("n_edges"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)


def layer_edge_metrics(
    nodes: DataFrame, edges: DataFrame, inter: DataFrame, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Edge mix per layer; an inter edge counts under both of its layers."""
    per_intra = edges.groupBy(*keys, "layer").agg(F.count(F.lit(1)).alias("intra_edges"))
    per_inter = (
        inter.select(*keys, F.explode(F.array("layer_a", "layer_b")).alias("layer"))
        .groupBy(*keys, "layer")
        .agg(F.count(F.lit(1)).alias("inter_edges"))
    )
    on = [*keys, "layer"]
    mix = (
        nodes.select(*on)
        .distinct()
        .join(per_intra, on, "left")
        .join(per_inter, on, "left")
        .fillna(0, ["intra_edges", "inter_edges"])
    )
    total = F.col("intra_edges") + F.col("inter_edges")
    return mix.withColumn("pct_intra", percent(F.col("intra_edges"), total)).withColumn(
        "pct_inter", percent(F.col("inter_edges"), total)
    )


def layer_subgraph(nodes: DataFrame, intra: DataFrame, term: str):
    """One layer from stored tables; its isolated nodes stay."""
    return nodes.where(F.col("term") == term), intra.where(F.col("term") == term)


@keyless
def degree_histogram(
    degree: DataFrame, keys: tuple[str, ...] = ("layer",), bins: int = 15
) -> DataFrame:
    """Equal-width bins between the least and the largest degree of each graph.

    Degrees are counted per value first, so the join against the range of the
    graph sees one row per distinct degree.  A flat graph gets bins of width
    1/bins around its degree, as a histogram of a constant does.
    """
    per_value = degree.groupBy(*keys, "degree").agg(F.count(F.lit(1)).alias("n"))
    span = per_value.groupBy(*keys).agg(
        F.min("degree").cast("double").alias("_lo"), F.max("degree").cast("double").alias("_hi")
    )
    flat = F.col("_lo") == F.col("_hi")
    lo = F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo"))
    hi = F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi"))
    step = (hi - lo) / F.lit(float(bins))
    slot = F.least(F.lit(bins - 1), F.floor((F.col("degree") - lo) / step)).cast("bigint")
    counted = (
        per_value.join(span, list(keys))
        .groupBy(*keys, "_lo", "_hi", slot.alias("bin"))
        .agg(F.sum("n").alias("count"))
    )
    return counted.select(
        *keys,
        "bin",
        (lo + F.col("bin") * step).alias("bin_start"),
        (lo + (F.col("bin") + 1) * step).alias("bin_end"),
        "count",
    )


@keyless
def degree_landmarks(degree: DataFrame, keys: tuple[str, ...] = ("layer",)) -> DataFrame:
    """Mean degree, and the first node by name at the min, max and modal degree."""
    per_value = degree.groupBy(*keys, "degree").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("first_node")
    )
    low = F.struct("degree", "first_node")
    common = F.struct(F.col("n"), -F.col("degree"))
    return per_value.groupBy(*keys).agg(
        (F.sum(F.col("degree") * F.col("n")) / F.sum("n")).alias("mean_degree"),
        F.min("degree").alias("min_degree"),
        F.max("degree").alias("max_degree"),
        F.max_by("degree", common).alias("mode_degree"),
        F.min_by("first_node", "degree").alias("min_node"),
        F.max_by("first_node", "degree").alias("max_node"),
        F.max_by("first_node", common).alias("mode_node"),
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def rank_in(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")
    )
