"""A sea world derived from the star-schema tables: the same SQL runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Views over the driver tables; braces name what a view reads.
VIEWS: dict[str, str] = {
    "w_nodes": """
SELECT CAST(p_partkey AS BIGINT) AS node_id, CAST(p_partkey % 50 AS BIGINT) AS c, CAST(FLOOR(p_partkey / 5e1) AS BIGINT) AS r,
  4.95e1 + 5e-2 * FLOOR(p_partkey / 5e1) AS lat,
  -1.1e1 + 1e-1 * (p_partkey % 50) + 5e-2 * (CAST(FLOOR(p_partkey / 5e1) AS BIGINT) % 2) AS lng,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size * 6e-1 END AS bathymetry,
  3e-1 + 1e-1 * (p_partkey % 7) AS daylight_ratio,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_retailprice - 9e2) * 4e2 END AS clear_land
FROM {part} WHERE (p_partkey * 7919) % 11 <> 0""",
    "w_land": """
SELECT CAST(p_partkey AS BIGINT) AS node_id, 4.95e1 + 5e-2 * FLOOR(p_partkey / 5e1) AS lat,
  -1.1e1 + 1e-1 * (p_partkey % 50) + 5e-2 * (CAST(FLOOR(p_partkey / 5e1) AS BIGINT) % 2) AS lng, p_size * 1e1 AS max_elevation_m
FROM {part} WHERE (p_partkey * 7919) % 11 = 0""",
    "w_edges": """
SELECT s AS source, t AS target, a.lat AS lat1, a.lng AS lng1, b.lat AS lat2, b.lng AS lng2
FROM (SELECT node_id AS s, node_id + 1 AS t FROM {w_nodes} WHERE c < 49
  UNION ALL SELECT node_id, node_id + 50 FROM {w_nodes}
  UNION ALL SELECT node_id, node_id + 51 FROM {w_nodes} WHERE r % 2 = 1 AND c < 49
  UNION ALL SELECT node_id, node_id + 49 FROM {w_nodes} WHERE r % 2 = 0 AND c > 0) cand
JOIN {w_nodes} a ON a.node_id = s JOIN {w_nodes} b ON b.node_id = t""",
    "w_env": """
SELECT node_id, month, (q / n - 2.55e1) / 3e0 AS wind_x, (d / n - 5e0) * 2e0 AS wind_y, (x / n - 4e0) * 1e-1 AS current_x,
  (d / n - 5e0) * 1e-1 AS current_y, q / n / 2.5e1 AS swell_height, x / n * 2e-1 AS wave_height, p / n / 1e2 AS visibility_m
FROM (SELECT CAST(l_partkey AS BIGINT) AS node_id, CAST(month(l_shipdate) AS INT) AS month, CAST(COUNT(*) AS DOUBLE) AS n,
    CAST(SUM(CAST(ROUND(l_quantity) AS BIGINT)) AS DOUBLE) AS q, CAST(SUM(CAST(ROUND(l_discount * 1e2) AS BIGINT)) AS DOUBLE) AS d,
    CAST(SUM(CAST(ROUND(l_tax * 1e2) AS BIGINT)) AS DOUBLE) AS x, CAST(SUM(CAST(ROUND(l_extendedprice * 1e2) AS BIGINT)) AS DOUBLE) AS p
  FROM {lineitem} GROUP BY l_partkey, month(l_shipdate)) g""",
    "w_obs": """
SELECT event_id, CAST(user_id % 50 AS BIGINT) AS cell, ts, 2.7315e2 + value / 2e1 AS t2m, 2.7315e2 + value / 2e1 - (event_id % 7) AS d2m,
  value / 1e3 AS tp, CASE WHEN event_id % 23 = 0 THEN NULL ELSE (event_id % 11) / 1e1 END AS lcc
FROM {events}""",
    "w_pixels": """
SELECT CAST(l_partkey AS BIGINT) AS cell, l_orderkey, l_linenumber, CAST(127 + l_partkey % 4 AS INT) AS red,
  CAST(l_quantity * 5 AS INT) AS green, CAST((l_orderkey * 37) % 256 AS INT) AS blue
FROM {lineitem}""",
    "w_ports": """
SELECT CAST(c_custkey AS BIGINT) AS port_id,
  CASE WHEN c_custkey % 17 = 0 THEN CONCAT('Q', CAST(c_custkey AS VARCHAR(20))) ELSE c_name END AS name, n_name AS country,
  4.95e1 + 1e-2 * (c_custkey % 997) AS lat, -1.1e1 + 1e-2 * (c_custkey % 1301) AS lng
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "w_port_types": """
SELECT CAST(o_custkey AS BIGINT) AS port_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'naval base' WHEN '2-HIGH' THEN 'port' WHEN '3-MEDIUM' THEN 'town'
    WHEN '4-NOT SPECIFIED' THEN 'lighthouse' ELSE 'marina' END AS type
FROM {orders}""",
}

_NAMED = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a driver table, as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs = set(_NAMED.findall(VIEWS[name]))
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in needs})


def with_views(body: str) -> str:
    """DuckDB SQL: ``body``, a SELECT or the ctes and SELECT after a WITH, behind the views that it names."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(body)
    ctes = ", ".join(f"{n} AS ({_NAMED.sub(r'\1', VIEWS[n])})" for n in order)
    rest = body.strip()
    recursive = "RECURSIVE " if "USING KEY" in body or rest.upper().startswith("WITH RECURSIVE ") else ""
    if rest.upper().startswith("WITH "):
        rest = rest[5:].removeprefix("RECURSIVE ")
        return f"WITH {recursive}{ctes + ', ' if ctes else ''}{rest}"
    return f"WITH {ctes} {rest}" if ctes else rest
