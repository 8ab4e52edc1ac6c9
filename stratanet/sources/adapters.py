"""Panels derived from the test tables.

Cell means are taken over whole cents, so the sum is exact and does not depend
on the order in which partitions arrive; two engines then agree to the last bit
and ties stay ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound of each maturity bucket, in years; anything larger is "50Y".
MATURITY_BUCKETS = (1, 2, 3, 5, 7, 10, 15, 20, 30)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cent_mean(column: str) -> Column:
    cents = F.sum(F.round(F.col(column) * 100).cast("long"))
    return cents.cast("double") / (F.count(column) * F.lit(100.0))


def month_of(column: str) -> Column:
    return F.trunc(F.col(column).cast("date"), "month")


def net_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dt, layer, node, value): month, return flag, supplier nation, mean price.

    lineitem is reduced per supplier before the dimension joins, so only
    months x flags x suppliers rows meet supplier and nation.
    """
    items = table(spark, sf_dir, "lineitem")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    per_supplier = (
        items.where(F.col("l_extendedprice").isNotNull())
        .groupBy(
            month_of("l_shipdate").alias("dt"),
            F.col("l_returnflag").alias("layer"),
            "l_suppkey",
        )
        .agg(
            F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"),
            F.count("l_extendedprice").alias("n"),
        )
    )
    return (
        per_supplier.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("dt", "layer", F.col("n_name").alias("node"))
        .agg(
            (
                F.sum("cents").cast("double") / (F.sum("n") * F.lit(100.0))
            ).alias("value")
        )
    )


def supplier_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dt, layer, node, value) with one node per supplier: the wide variant."""
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy(
        month_of("l_shipdate").alias("dt"),
        F.col("l_returnflag").alias("layer"),
        F.col("l_suppkey").alias("node"),
    ).agg(cent_mean("l_extendedprice").alias("value"))


def event_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dt, layer, node, value): day, event type, user, mean value. Sparse."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("ts").cast("date").alias("dt"),
            F.col("event_type").alias("layer"),
            F.col("user_id").alias("node"),
        )
        .agg(cent_mean("value").alias("value"))
    )


def bucket_term(size: Column) -> Column:
    label = F.when(size <= MATURITY_BUCKETS[0], F.lit(f"{MATURITY_BUCKETS[0]}Y"))
    for bound in MATURITY_BUCKETS[1:]:
        label = label.when(size <= bound, F.lit(f"{bound}Y"))
    return label.otherwise(F.lit("50Y"))


def curve_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, source, term, rate): month, supplier region, size bucket, mean discount."""
    items = table(spark, sf_dir, "lineitem").where(F.col("l_discount").isNotNull())
    part = table(spark, sf_dir, "part").select(
        "p_partkey", bucket_term(F.col("p_size")).alias("term")
    )
    source = (
        table(spark, sf_dir, "supplier")
        .select("s_suppkey", "s_nationkey")
        .join(
            table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"),
            F.col("s_nationkey") == F.col("n_nationkey"),
        )
        .join(
            table(spark, sf_dir, "region").select("r_regionkey", "r_name"),
            F.col("n_regionkey") == F.col("r_regionkey"),
        )
        .select("s_suppkey", F.col("r_name").alias("source"))
    )
    return (
        items.select(
            month_of("l_shipdate").alias("date"), "l_partkey", "l_suppkey", "l_discount"
        )
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(source, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("date", "source", "term")
        .agg(cent_mean("l_discount").alias("rate"))
    )


def curve_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column per maturity bucket, the storage form of a curve table."""
    labels = [f"{b}Y" for b in MATURITY_BUCKETS] + ["50Y"]
    return (
        curve_long(spark, sf_dir)
        .groupBy("date", "source")
        .pivot("term", labels)
        .agg(F.first("rate"))
    )
