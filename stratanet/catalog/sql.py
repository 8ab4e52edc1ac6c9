"""SQL fragments shared by the checks: adapters and small expressions."""

from __future__ import annotations

from stratanet.sources.adapters import MATURITY_BUCKETS


def cent_mean(c: str) -> str:
    return (
        f"CAST(sum(CAST(round({c} * 100) AS BIGINT)) AS DOUBLE)"
        f" / (CAST(count({c}) AS DOUBLE) * 100.0)"
    )


def r6(expr: str) -> str:
    """Round for comparison; adding zero turns -0.0 into 0.0."""
    return f"(round({expr}, 6) + 0.0)"


MONTH = "CAST(date_trunc('month', l_shipdate) AS DATE)"

NET = f"""net AS (
  SELECT {MONTH} AS dt, l_returnflag AS layer, n_name AS node,
         {cent_mean('l_extendedprice')} AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2, 3)"""

EVENT = f"""net AS (
  SELECT CAST(ts AS DATE) AS dt, event_type AS layer, user_id AS node,
         {cent_mean('value')} AS value
  FROM events GROUP BY 1, 2, 3)"""

SUPPLIER = f"""net AS (
  SELECT {MONTH} AS dt, l_returnflag AS layer, l_suppkey AS node,
         {cent_mean('l_extendedprice')} AS value
  FROM lineitem GROUP BY 1, 2, 3)"""

BUCKET = (
    "CASE "
    + " ".join(f"WHEN p_size <= {b} THEN '{b}Y'" for b in MATURITY_BUCKETS)
    + " ELSE '50Y' END"
)

CURVE = f"""curve AS (
  SELECT {MONTH} AS date, r_name AS source, {BUCKET} AS term,
         {cent_mean('l_discount')} AS rate
  FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3)"""

TERMS = [f"{b}Y" for b in MATURITY_BUCKETS] + ["50Y"]

WIDE = (
    CURVE
    + ",\nwide AS (SELECT date, source, "
    + ", ".join(f"max(CASE WHEN term = '{t}' THEN rate END) AS \"{t}\"" for t in TERMS)
    + " FROM curve GROUP BY 1, 2)"
)

#: Simple returns within (layer, node).
RETURNS = """ret AS (
  SELECT dt, layer, node, value / prev - 1.0 AS value FROM (
    SELECT *, lag(value) OVER (PARTITION BY layer, node ORDER BY dt) AS prev FROM net)
  WHERE prev <> 0)"""


def pair_rows(source: str, name: str = "pr", key: str = "layer") -> str:
    return f"""{name} AS (
  SELECT a.{key}, a.node AS node_i, b.node AS node_j, a.dt, a.value AS x, b.value AS y
  FROM {source} a JOIN {source} b
    ON a.{key} = b.{key} AND a.dt = b.dt AND a.node < b.node)"""


CORR = (
    "CASE WHEN count(*) >= 3 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0"
    " THEN corr(x, y) END"
)


def years(t: str) -> str:
    u = f"upper(trim({t}))"

    def unit(letters: str, per: str) -> str:
        pattern = rf"^(\d+(?:\.\d+)?)\s*{letters}$"
        return (
            f"WHEN regexp_matches({u}, '{pattern}') THEN"
            f" CAST(regexp_extract({u}, '{pattern}', 1) AS DOUBLE) / {per}"
        )

    point = r"^Y(\d+)P(\d+)$"
    return (
        f"CASE WHEN regexp_matches({u}, '{point}') THEN"
        f" CAST(regexp_extract({u}, '{point}', 1) || '.' ||"
        f" regexp_extract({u}, '{point}', 2) AS DOUBLE) "
        + unit("Y(?:R|RS|EAR|EARS)?", "1.0")
        + " "
        + unit("M(?:O|OS|ONTH|ONTHS)?", "12.0")
        + " "
        + unit("W(?:K|KS|EEK|EEKS)?", "52.0")
        + " "
        + unit("D(?:AY|AYS)?", "365.0")
        + " END"
    )


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
