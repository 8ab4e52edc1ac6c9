"""Result store: a folder of Parquet tables with a manifest."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratanet.sources.tables import QueryError, path_exists

FORMAT_VERSION = 1


def save_results(
    spark: SparkSession,
    path: str,
    frames: dict[str, DataFrame],
    settings: dict | None = None,
    scalars: dict | None = None,
) -> None:
    """Frames first, the manifest last, so a manifest means a whole store."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    manifest = {
        "format_version": FORMAT_VERSION,
        "settings": settings or {},
        "scalars": scalars or {},
        "frames": sorted(frames),
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(
        1
    ).write.mode("overwrite").text(f"{path}/_manifest")


def load_manifest(spark: SparkSession, path: str) -> dict:
    manifest = json.loads(spark.read.text(f"{path}/_manifest").first()[0])
    if manifest.get("format_version") != FORMAT_VERSION:
        raise QueryError(f"store version {manifest.get('format_version')} is not supported")
    return manifest


def load_results(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Lazy frames by name; one that was listed but is gone comes back empty."""
    frames = {}
    for name in load_manifest(spark, path)["frames"]:
        folder = f"{path}/{name}"
        frames[name] = (
            spark.read.parquet(folder)
            if path_exists(spark, folder)
            else spark.createDataFrame([], "missing string")
        )
    return frames


def describe(frames: dict[str, DataFrame]) -> DataFrame:
    """(stage, frame, n_rows); the stage is the part before the first '_'."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name.split("_", 1)[0]).alias("stage"),
            F.lit(name).alias("frame"),
            "n_rows",
        )
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def flatten(frames: dict[str, DataFrame], id_column: str) -> DataFrame:
    tagged = [df.withColumn(id_column, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def unflatten(df: DataFrame, id_column: str, name: str) -> DataFrame:
    return df.where(F.col(id_column) == F.lit(name)).drop(id_column)


def export(df: DataFrame, path: str) -> None:
    """CSV or Parquet by suffix."""
    writer = df.write.mode("overwrite")
    if path.endswith(".csv"):
        writer.option("header", True).csv(path)
    elif path.endswith(".parquet"):
        writer.parquet(path)
    else:
        raise QueryError(f"cannot export to {path!r}")


def load_multiplex(spark: SparkSession, path: str) -> tuple[DataFrame, ...]:
    """Stored nodes, intra and inter tables; nothing has to be rebuilt."""
    frames = load_results(spark, path)
    return frames["mln_nodes"], frames["mln_intra"], frames["mln_inter"]
