"""P: projections, filters and panel shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratanet.catalog.base import query, r6
from stratanet.catalog.sql import (
    BUCKET,
    CURVE,
    NET,
    RETURNS,
    WIDE,
    with_,
    years,
)
from stratanet.catalog.sql import r6 as q6
from stratanet.functions.maturity import canonical_term, term_years
from stratanet.operators import panel as P
from stratanet.operators.pairs import Roles
from stratanet.sources import adapters as A

NET_ROLES = Roles()

#: Labels in several spellings, made from the part sizes of the test table.
_LABELS = """labels_in AS (
  SELECT p_size, CASE p_size % 6 WHEN 0 THEN p_size || 'Y' WHEN 1 THEN p_size || ' months'
    WHEN 2 THEN p_size || 'w' WHEN 3 THEN ' ' || p_size || 'D '
    WHEN 4 THEN 'Y0' || p_size || 'p5' ELSE 'size ' || p_size END AS label,
    p_partkey FROM part)"""


def _labels(spark, d):
    size = F.col("p_size").cast("string")
    kind = F.col("p_size") % 6
    label = (
        F.when(kind == 0, F.concat(size, F.lit("Y")))
        .when(kind == 1, F.concat(size, F.lit(" months")))
        .when(kind == 2, F.concat(size, F.lit("w")))
        .when(kind == 3, F.concat(F.lit(" "), size, F.lit("D ")))
        .when(kind == 4, F.concat(F.lit("Y0"), size, F.lit("p5")))
        .otherwise(F.concat(F.lit("size "), size))
    )
    return A.table(spark, d, "part").select("p_partkey", label.alias("label"))


@query(
    "p1_parse_term",
    with_(_LABELS) + f"SELECT p_partkey, label, {q6(years('label'))} AS years FROM labels_in",
)
def p1(spark, d):
    return _labels(spark, d).withColumn("years", r6(term_years(F.col("label"))))


@query(
    "p2_sort_terms",
    with_(_LABELS)
    + f"""SELECT label, row_number() OVER (
            ORDER BY y IS NULL, y, label) AS term_pos
          FROM (SELECT DISTINCT label, {years('label')} AS y FROM labels_in)""",
)
def p2(spark, d):
    labels = _labels(spark, d).select("label").distinct()
    return P.sort_terms(labels, "label").select("label", "term_pos")


@query(
    "p3_detect_panel",
    with_(CURVE) + "SELECT term, 'source' AS issuer_column, 'rate' AS rate_column, count(rate) AS n FROM curve GROUP BY 1",
)
def p3(spark, d):
    """Roles of the wide curve table, then one row per detected term column."""
    wide = A.curve_wide(spark, d)
    panel = P.detect_panel(wide, "date")
    long = P.load_long_panel(wide, panel)
    return long.groupBy(panel.term_column).agg(
        F.lit(panel.issuer).alias("issuer_column"),
        F.lit(panel.rate_column).alias("rate_column"),
        F.count(F.lit(1)).alias("n"),
    )


_CELLS = "SELECT DISTINCT term, source FROM curve WHERE term IN ('1Y', '5Y', '50Y')"


@query(
    "p4_load_long_panel",
    with_(CURVE)
    + """SELECT date, source, term, """
    + q6("rate")
    + """ AS rate FROM curve WHERE source <> 'ASIA'
      AND date >= DATE '1994-01-01' AND date <= DATE '1997-12-31'
      AND term IN ('1Y', '5Y', '50Y')""",
)
def p4(spark, d):
    wide = A.curve_wide(spark, d)
    panel = P.detect_panel(wide, "date")
    mask = (
        A.curve_long(spark, d)
        .where(F.col("term").isin("1Y", "5Y", "50Y"))
        .select("term", "source")
        .distinct()
    )
    long = P.load_long_panel(
        wide,
        panel,
        where="source <> 'ASIA'",
        start="1994-01-01",
        end="1997-12-31",
        mask=mask,
    )
    return long.select("date", "source", "term", r6("rate").alias("rate"))


@query(
    "p5_safe_cast",
    """SELECT conv_id, turn, TRY_CAST(text AS DOUBLE) AS value,
              TRY_CAST(substr(text, 1, 10) AS DATE) AS day FROM conversations""",
)
def p5(spark, d):
    text = F.col("text")
    return A.table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        F.nanvl(text.try_cast("double"), F.lit(None)).alias("value"),
        F.when(
            F.substring(text, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"),
            F.substring(text, 1, 10).try_cast("date"),
        ).alias("day"),
    )


@query(
    "p6_date_range",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders
       WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate <= DATE '1996-06-30'""",
)
def p6(spark, d):
    orders = A.table(spark, d, "orders")
    inside = P.date_range(orders, "o_orderdate", "1995-01-01", "1996-06-30")
    return inside.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


@query(
    "p7_drop_nulls",
    with_(WIDE) + "SELECT date, source, " + q6('"1Y"') + ' AS y1, '
    + q6('"30Y"') + ' AS y30 FROM wide WHERE "1Y" IS NOT NULL AND "30Y" IS NOT NULL',
)
def p7(spark, d):
    wide = A.curve_wide(spark, d).dropna(subset=["1Y", "30Y"])
    return wide.select("date", "source", r6("1Y").alias("y1"), r6("30Y").alias("y30"))


@query(
    "p8_cell_mask",
    with_(CURVE, f"mask AS ({_CELLS} AND source < 'B')")
    + f"""SELECT date, source, term, {q6('rate')} AS rate FROM curve
          WHERE (term, source) IN (SELECT term, source FROM mask)""",
)
def p8(spark, d):
    curve = A.curve_long(spark, d)
    mask = curve.where(
        F.col("term").isin("1Y", "5Y", "50Y") & (F.col("source") < "B")
    ).select("term", "source")
    kept = P.cell_mask(curve, mask, ["term", "source"])
    return kept.select("date", "source", "term", r6("rate").alias("rate"))


@query("p9_available_cells", with_(CURVE) + "SELECT DISTINCT term, source FROM curve")
def p9(spark, d):
    return P.available_cells(A.curve_long(spark, d), "term", "source")


def _selection(spark, d):
    curve = A.curve_long(spark, d)
    cells = P.available_cells(curve, "term", "source")
    mask = cells.where(F.col("term").isin("1Y", "5Y", "50Y") & (F.col("source") < "B"))
    return cells, mask


@query(
    "p10_selection_counts",
    with_(CURVE, f"mask AS ({_CELLS} AND source < 'B')",
          "cells AS (SELECT DISTINCT term, source FROM curve)")
    + """SELECT c.term, c.source, count(m.term) AS checked, count(*) AS available
         FROM cells c LEFT JOIN mask m ON c.term = m.term AND c.source = m.source
         GROUP BY GROUPING SETS ((c.term), (c.source), ())""",
)
def p10(spark, d):
    return P.selection_counts(*_selection(spark, d), "term", "source")


@query(
    "p10_invert_selection",
    with_(CURVE, f"mask AS ({_CELLS} AND source < 'B')")
    + "SELECT DISTINCT term, source FROM curve EXCEPT SELECT term, source FROM mask",
)
def p10_invert(spark, d):
    return P.invert_selection(*_selection(spark, d), "term", "source")


@query(
    "p11_prepare_long",
    """SELECT CAST(ts AS DATE) AS dt, event_type AS layer, user_id AS node, value
       FROM events WHERE value IS NOT NULL AND ts IS NOT NULL
       AND CAST(ts AS DATE) >= DATE '2024-01-05' AND CAST(ts AS DATE) <= DATE '2024-01-20'""",
)
def p11(spark, d):
    return P.prepare_long(
        A.table(spark, d, "events"),
        "ts", "user_id", "value", "event_type",
        start="2024-01-05", end="2024-01-20",
    )


@query(
    "p12_layer_values",
    f"""SELECT layer, row_number() OVER (ORDER BY {years('layer')} IS NULL,
            {years('layer')}, layer) AS term_pos
        FROM (SELECT DISTINCT {BUCKET} AS layer FROM part)""",
)
def p12(spark, d):
    part = A.table(spark, d, "part").select(A.bucket_term(F.col("p_size")).alias("term"))
    return P.layer_values(part, "term").select("layer", "term_pos")


@query(
    "p13_pivot_to_wide",
    with_(CURVE)
    + "SELECT term, date, "
    + ", ".join(
        f"{q6(f'max(CASE WHEN source = {chr(39)}{s}{chr(39)} THEN rate END)')} AS \"{s}\""
        for s in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
    )
    + " FROM curve GROUP BY term, date",
)
def p13(spark, d):
    wide = P.pivot_to_wide(A.curve_long(spark, d), Roles(("term",), "source", "date", "rate"))
    return wide.select("term", "date", *[r6(f"`{c}`").alias(c) for c in wide.columns[2:]])


_RET = with_(NET, RETURNS) + f"SELECT dt, layer, node, {q6('value')} AS value FROM ret"


@query("p14_daily_returns", _RET)
def p14(spark, d):
    ret = P.daily_returns(A.net_long(spark, d), NET_ROLES)
    return ret.withColumn("value", r6("value"))


@query("p15_transforms_per_layer", _RET)
def p15(spark, d):
    ret = P.apply_transforms(A.net_long(spark, d), ["daily_returns"], NET_ROLES)
    return ret.withColumn("value", r6("value"))


@query(
    "p16_transform_chain",
    with_(
        NET, RETURNS,
        "base AS (SELECT * FROM ret)",
        """scaled AS (SELECT dt, layer, node,
             value - avg(value) OVER (PARTITION BY layer, node) AS value FROM base)""",
    )
    + f"SELECT dt, layer, node, {q6('value')} AS value FROM scaled",
)
def p16(spark, d):
    """A user transform registered next to the built-in one."""
    from stratanet.operators.pairs import centre

    P.register_transform("centre", centre)
    chain = P.apply_transforms(
        A.net_long(spark, d), ["daily_returns", "centre"], NET_ROLES
    )
    return chain.select("dt", "layer", "node", r6("value").alias("value"))


@query(
    "p17_yield_scale",
    with_(CURVE)
    + """SELECT CASE WHEN quantile_cont(abs(rate), 0.9) > 0.5 THEN CAST(0.01 AS DOUBLE)
         ELSE CAST(1 AS DOUBLE) END AS yield_scale FROM curve""",
)
def p17(spark, d):
    return P.detect_scale(A.curve_long(spark, d))


DENSE = """dense AS (
  SELECT c.* FROM curve c
  JOIN (SELECT source, date, count(*) AS have FROM curve GROUP BY 1, 2) h
    USING (source, date)
  JOIN (SELECT source, count(DISTINCT term) AS want FROM curve GROUP BY 1) w USING (source)
  WHERE have = want)"""


@query(
    "p18_dense_rows",
    with_(CURVE, DENSE) + f"SELECT date, source, term, {q6('rate')} AS rate FROM dense",
)
def p18(spark, d):
    dense = P.dense_rows(A.curve_long(spark, d), "source", "date", "term")
    return dense.select("date", "source", "term", r6("rate").alias("rate"))


@query(
    "p19_canonical_term",
    with_(_LABELS)
    + f"SELECT DISTINCT label, printf('%.6g', {years('label')}) || 'Y' AS term FROM labels_in",
)
def p19(spark, d):
    labels = _labels(spark, d).select("label").distinct()
    return labels.withColumn("term", canonical_term(F.col("label")))


@query(
    "p20_filter_displayed",
    """SELECT l_orderkey, l_linenumber FROM lineitem
       WHERE coalesce(CAST(l_returnflag AS VARCHAR), '') IN ('A', '')
       AND coalesce(CAST(l_linestatus AS VARCHAR), '') IN ('O')""",
)
def p20(spark, d):
    kept = P.filter_displayed(
        A.table(spark, d, "lineitem"), {"l_returnflag": ["A", ""], "l_linestatus": ["O"]}
    )
    return kept.select("l_orderkey", "l_linenumber")


@query(
    "p21_facet_values",
    """SELECT DISTINCT coalesce(CAST(l_linenumber AS VARCHAR), '') AS value FROM lineitem
       WHERE coalesce(l_returnflag, '') IN ('A')""",
)
def p21(spark, d):
    return P.facet_values(
        A.table(spark, d, "lineitem"),
        "l_linenumber",
        {"l_returnflag": ["A"], "l_linenumber": ["1"]},
    )


@query(
    "p22_sort_table",
    "SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal NULLS FIRST",
)
def p22(spark, d):
    table = A.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return P.sort_table(table, "s_acctbal")

