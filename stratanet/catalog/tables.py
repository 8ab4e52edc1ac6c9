"""S: sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratanet.catalog.base import query, rounded
from stratanet.catalog.sql import CURVE, with_
from stratanet.catalog.sql import r6 as q6
from stratanet.sources import adapters as A
from stratanet.sources import tables as S
from stratanet.session import scratch_path


@query(
    "s1_load_table",
    """SELECT l_orderkey, l_linenumber, l_discount FROM lineitem
       WHERE l_quantity > 30 AND l_returnflag = 'R'""",
)
def s1(spark, d):
    return S.load_table(
        A.table(spark, d, "lineitem"),
        ["l_orderkey", "l_linenumber", "l_discount"],
        "l_quantity > 30 AND l_returnflag = 'R'",
    )


@query("s2_schema")
def s2(spark, d):
    return S.describe_schema(A.table(spark, d, "lineitem"))


@query(
    "s3_distinct_values",
    """SELECT CAST(v AS VARCHAR) AS value FROM (
         SELECT DISTINCT p_size AS v FROM part WHERE p_size IS NOT NULL
         ORDER BY v LIMIT 500)""",
)
def s3(spark, d):
    return S.distinct_values(A.table(spark, d, "part"), "p_size")


@query(
    "s4_date_bounds",
    """SELECT CAST(min(l_shipdate) AS DATE) AS min_date,
              CAST(max(l_shipdate) AS DATE) AS max_date FROM lineitem""",
)
def s4(spark, d):
    return S.date_bounds(A.table(spark, d, "lineitem"), "l_shipdate")


_COUNTS = " UNION ALL ".join(
    f"SELECT '{c}' AS name, count(DISTINCT {c}) AS n, {most} AS most FROM lineitem"
    for c, most in (
        ("l_partkey", 19),
        ("l_suppkey", 19),
        ("l_linenumber", 19),
        ("l_returnflag", 50),
        ("l_linestatus", 50),
    )
)


@query(
    "s5_eligible_layer_columns",
    f"""SELECT name, CAST(n AS BIGINT) AS n_distinct FROM ({_COUNTS})
        WHERE n >= 2 AND n <= most""",
)
def s5(spark, d):
    return S.eligible_layer_columns(A.table(spark, d, "lineitem"), {"l_orderkey"})


_SQL6 = """SELECT n_name, count(*) AS n_suppliers FROM supplier
           JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"""


@query("s6_run_query", _SQL6)
def s6(spark, d):
    views = {n: A.table(spark, d, n) for n in ("supplier", "nation")}
    return S.run_query(spark, _SQL6, views)


@query(
    "s7_select_where",
    """SELECT l_orderkey, l_extendedprice FROM lineitem
       WHERE l_returnflag = 'A' AND l_linenumber = 1""",
)
def s7(spark, d):
    return S.select_where(
        A.table(spark, d, "lineitem"),
        ["l_orderkey", "l_extendedprice"],
        {"l_returnflag": "A", "l_linenumber": 1},
    )


_TARGET = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'"
_BATCH = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000"


@query("s10_append", f"{_TARGET} UNION ALL {_BATCH}")
def s10(spark, d):
    return S.append(*_target_and_batch(spark, d))


def _target_and_batch(spark, d):
    orders = A.table(spark, d, "orders")
    columns = ["o_orderkey", "o_custkey", "o_totalprice"]
    return (
        orders.where("o_orderstatus = 'F'").select(*columns),
        orders.where("o_totalprice > 200000").select(*columns),
    )


@query(
    "s11_append_skip_duplicates",
    f"""WITH t AS ({_TARGET}), b AS ({_BATCH})
        SELECT * FROM t UNION ALL SELECT * FROM b
        WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.o_custkey = b.o_custkey)""",
)
def s11(spark, d):
    return S.append(*_target_and_batch(spark, d), keys=["o_custkey"])


for _keep, _dir in (("first", "ASC"), ("last", "DESC")):

    @query(
        f"s12_remove_duplicates_{_keep}",
        f"""SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity FROM (
              SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey
                ORDER BY l_orderkey {_dir}, l_linenumber {_dir}, l_quantity {_dir}) AS rn
              FROM lineitem) WHERE rn = 1""",
    )
    def s12(spark, d, keep=_keep):
        df = A.table(spark, d, "lineitem").select(
            "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity"
        )
        order = ["l_orderkey", "l_linenumber", "l_quantity"]
        return S.remove_duplicates(df, ["l_partkey", "l_suppkey"], order, keep)


@query(
    "s8_save_table",
    "SELECT n_nationkey, n_name, false AS replaced FROM nation",
)
def s8(spark, d):
    """Write, try again without overwriting (nothing happens), read back."""
    nation = A.table(spark, d, "nation").select("n_nationkey", "n_name")
    path = scratch_path(spark, "nation")
    S.save_table(nation, path)
    replaced = S.save_table(nation.limit(1), path)
    return spark.read.parquet(path).withColumn("replaced", F.lit(replaced))


@query(
    "s9_append_checked",
    """SELECT s_suppkey, s_name, s_acctbal FROM supplier
       UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier""",
)
def s9(spark, d):
    """Batch columns are matched by name whatever their case; a bad batch raises."""
    target = A.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    batch = target.withColumnsRenamed({"s_name": "S_NAME"})
    try:
        S.check_append(target, target.withColumn("s_acctbal", F.col("s_name")))
    except S.QueryError:
        return S.append(target, batch)
    raise AssertionError("a text batch column was accepted for a number")


@query(
    "s13_store_round_trip",
    with_(CURVE)
    + """SELECT 'stage1' AS stage, 'stage1_curve' AS frame, count(*) AS n_rows FROM curve
         UNION ALL SELECT 'stage2', 'stage2_cells', count(*) FROM
           (SELECT DISTINCT source, term FROM curve)""",
)
def s13(spark, d):
    """Save two frames with a manifest, load them, describe rows per stage (S14)."""
    from stratanet.sources import store

    curve = A.curve_long(spark, d)
    path = scratch_path(spark, "store")
    frames = {"stage1_curve": curve, "stage2_cells": curve.select("source", "term").distinct()}
    store.save_results(spark, path, frames, settings={"threshold": 0.33})
    return store.describe(store.load_results(spark, path))


@query("s13_loaded_rows", with_(CURVE) + f"SELECT date, source, term, {q6('rate')} AS rate FROM curve")
def s13_rows(spark, d):
    """The rows of a frame as they come back from the store."""
    from stratanet.sources import store

    path = scratch_path(spark, "store")
    store.save_results(spark, path, {"stage1_curve": A.curve_long(spark, d)}, settings={"threshold": 0.33})
    return rounded(store.load_results(spark, path)["stage1_curve"].select("date", "source", "term", "rate"), "rate")


@query("s16_export", "SELECT r_regionkey, r_name FROM region")
def s16(spark, d):
    from stratanet.sources import store

    path = scratch_path(spark, "region") + ".csv"
    store.export(A.table(spark, d, "region").select("r_regionkey", "r_name"), path)
    return S.read(spark, path)


@query("s15_flatten", with_(CURVE) + "SELECT date, term, rate, source FROM curve")
def s15(spark, d):
    """Per-issuer frames stacked back into one; the inverse is a filter."""
    from stratanet.sources.store import flatten, unflatten

    curve = A.curve_long(spark, d)
    names = sorted(r[0] for r in A.table(spark, d, "region").select("r_name").distinct().collect())
    return flatten({n: unflatten(curve, "source", n) for n in names}, "source")
