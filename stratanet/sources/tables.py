"""Reading tables, looking at their columns, and appending to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How many distinct values make a column usable as a layer.
MAX_TEXT_LAYERS = 50
MAX_INTEGER_LAYERS = 20

_INTEGER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
_REAL = (T.FloatType, T.DoubleType, T.DecimalType)
_TIME = (T.DateType, T.TimestampType, T.TimestampNTZType)


class QueryError(ValueError):
    """A request the table cannot satisfy."""


def type_family(data_type: T.DataType) -> str:
    if isinstance(data_type, _INTEGER):
        return "INTEGER"
    if isinstance(data_type, _REAL):
        return "REAL"
    if isinstance(data_type, _TIME):
        return "DATE" if isinstance(data_type, T.DateType) else "TIMESTAMP"
    return "TEXT"


def load_table(
    source: DataFrame, columns: list[str] | None = None, where: str | None = None
) -> DataFrame:
    """Filter by a SQL condition over any column, then project."""
    picked = source.where(F.expr(where)) if where else source
    return picked.select(*columns) if columns else picked


def read(spark: SparkSession, path_or_table: str) -> DataFrame:
    """A Parquet or CSV path, or a catalogue table name."""
    if path_or_table.endswith(".csv"):
        return spark.read.csv(path_or_table, header=True, inferSchema=True)
    if "/" in path_or_table or path_or_table.endswith(".parquet"):
        return spark.read.parquet(path_or_table)
    return spark.table(path_or_table)


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def list_columns(df: DataFrame) -> list[str]:
    return df.columns


def describe_schema(df: DataFrame) -> DataFrame:
    """(name, type, family, nullable), one row per column."""
    rows = [
        (f.name, f.dataType.simpleString(), type_family(f.dataType), f.nullable)
        for f in df.schema.fields
    ]
    return df.sparkSession.createDataFrame(
        rows, "name string, type string, family string, nullable boolean"
    )


def distinct_values(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Values in order, all of them unless the caller sets a limit."""
    text = F.col(column).cast("string").alias("value")
    found = (
        df.where(F.col(column).isNotNull())
        .select(F.col(column).alias("_key"), text)
        .distinct()
        .orderBy("_key")
    )
    return (found if limit is None else found.limit(limit)).select("value")


def date_bounds(df: DataFrame, column: str) -> DataFrame:
    day = F.col(column).try_cast("date")
    return df.agg(F.min(day).alias("min_date"), F.max(day).alias("max_date"))


def eligible_layer_columns(df: DataFrame, exclude: set[str] = frozenset()) -> DataFrame:
    """Discrete columns with few enough values, in one pass over the table."""
    skip = {c.lower() for c in exclude}
    bound = {"TEXT": MAX_TEXT_LAYERS, "INTEGER": MAX_INTEGER_LAYERS - 1}
    wanted = {
        f.name: bound[type_family(f.dataType)]
        for f in df.schema.fields
        if f.name.lower() not in skip and type_family(f.dataType) in bound
    }
    if not wanted:
        return df.sparkSession.createDataFrame([], "name string, n_distinct bigint")
    # Distinct values first (one Expand over all candidates), then count them:
    # map-side combine keeps at most the distinct values of a file per task.
    stacked = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("name"),
                        F.col(c).cast("string").alias("value"),
                        F.lit(most).alias("most"),
                    )
                    for c, most in wanted.items()
                ]
            )
        ).alias("cell")
    ).select("cell.*")
    return (
        stacked.where(F.col("value").isNotNull())
        .distinct()
        .groupBy("name", "most")
        .agg(F.count(F.lit(1)).alias("n_distinct"))
        .where((F.col("n_distinct") >= 2) & (F.col("n_distinct") <= F.col("most")))
        .select("name", "n_distinct")
        .orderBy("name")
    )


def run_query(spark: SparkSession, sql: str, views: dict[str, DataFrame]) -> DataFrame:
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def select_where(
    df: DataFrame, columns: list[str] | None = None, where: dict | None = None
) -> DataFrame:
    conditions = [F.col(c) == F.lit(v) for c, v in (where or {}).items()]
    picked = df.where(reduce(Column.__and__, conditions)) if conditions else df
    return picked.select(*columns) if columns else picked


def save_table(df: DataFrame, path: str, overwrite: bool = False) -> bool:
    """False, and nothing written, when the target exists and may not be replaced."""
    if not overwrite and path_exists(df.sparkSession, path):
        return False
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    return True


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
    except Exception as problem:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(problem) or "UNABLE_TO_INFER_SCHEMA" in str(problem):
            return False
        raise
    return True


def check_append(target: DataFrame, batch: DataFrame) -> dict[str, str]:
    """Map of batch column to target column; raises when one does not fit."""
    known = {f.name.lower(): f for f in target.schema.fields}
    mapping = {}
    for f in batch.schema.fields:
        home = known.get(f.name.lower())
        if home is None:
            raise QueryError(f"no column {f.name!r} in the target")
        have, want = type_family(f.dataType), type_family(home.dataType)
        if have != want and not isinstance(f.dataType, T.NullType):
            raise QueryError(f"column {f.name!r} is {have}, the target has {want}")
        mapping[f.name] = home.name
    return mapping


def append(
    target: DataFrame, batch: DataFrame, keys: list[str] | None = None
) -> DataFrame:
    """Target plus batch; with keys, rows whose key the target holds are skipped.

    A null key matches nothing, and the batch is not de-duplicated itself.
    """
    named = batch.withColumnsRenamed(check_append(target, batch))
    if keys:
        named = named.join(target.select(*keys).distinct(), keys, "left_anti")
    return target.unionByName(named, allowMissingColumns=True)


def remove_duplicates(
    df: DataFrame, columns: list[str], order_by: list[str], keep: str = "first"
) -> DataFrame:
    """One row per key.  min_by/max_by combine map-side, so a hot key is one row
    per task before the shuffle, unlike row_number over the key."""
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first' or 'last'")
    pick = F.min_by if keep == "first" else F.max_by
    others = [c for c in df.columns if c not in columns]
    chosen = df.groupBy(*columns).agg(
        pick(F.struct(*others), F.struct(*order_by)).alias("_row")
    )
    return chosen.select(*columns, "_row.*").select(*df.columns)
