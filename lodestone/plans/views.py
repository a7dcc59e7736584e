"""Deterministic geographic views over the generic tables, in SQL that Spark and DuckDB both run.

Coordinates are integers (thousandths of a degree), so both engines agree on
every comparison.  {div} stands for integer division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "addr_pts": "SELECT c_custkey AS id, (c_custkey * 104729) % 360000 - 180000 AS x, (c_custkey * 15487) % 170000 - 85000 AS y, c_custkey % 200 + 1 AS hn, concat('Street ', CAST(c_custkey % 37 AS STRING)) AS street, CAST(c_nationkey AS BIGINT) AS nation FROM {customer}",
    "nation_box": "SELECT CAST(n_nationkey AS BIGINT) AS bid, n_name AS bname, 4 AS lvl, CAST(n_regionkey AS BIGINT) AS region, -180000 + 72000 * (CAST(n_nationkey AS BIGINT) % 5) AS minx, -85000 + 34000 * (CAST(n_nationkey AS BIGINT) {div} 5) AS miny, -180000 + 72000 * (CAST(n_nationkey AS BIGINT) % 5) + 72000 AS maxx, -85000 + 34000 * (CAST(n_nationkey AS BIGINT) {div} 5) + 34000 AS maxy FROM {nation}",
    "places": "SELECT s_suppkey AS rid, (s_suppkey * 87383) % 360000 - 180000 AS rx, (s_suppkey * 32909) % 170000 - 85000 AS ry, s_suppkey % 5 AS kind, s_name AS name FROM {supplier}",
    "pois": "SELECT p_partkey AS pid, (p_partkey * 50021) % 360000 - 180000 AS x, (p_partkey * 30011) % 170000 - 85000 AS y, p_type AS cls, p_size AS size, p_name AS name FROM {part}",
    "segs": "SELECT l_orderkey * 8 + l_linenumber AS way, min(l_partkey) AS a, min(l_suppkey) AS b, concat('Street ', CAST(min(l_partkey) % 37 AS STRING)) AS name FROM {lineitem} GROUP BY l_orderkey, l_linenumber",
    "seg_lines": "SELECT way, name, (a * 50021) % 360000 - 180000 AS x1, (a * 30011) % 170000 - 85000 AS y1, (a * 50021) % 360000 - 180000 + (b * 7919) % 4001 - 2000 AS x2, (a * 30011) % 170000 - 85000 + (b * 5557) % 4001 - 2000 AS y2 FROM {segs}",
    "snap_old": "SELECT o_orderkey AS id, o_orderdate AS ts, md5(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS STRING)) AS hash FROM {orders} WHERE o_orderkey % 10 <> 0",
    "snap_new": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS ts, md5(CAST(CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 5 = 0 THEN 100 ELSE 0 END AS STRING)) AS hash FROM {orders} WHERE o_orderkey % 7 <> 0",
}
_SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in _SOURCES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    uses = {n: frame(spark, sf_dir, n) for n in (*_SOURCES, *VIEWS) if "{" + n + "}" in text}
    return spark.sql(text.replace("{div}", "div"), **uses)


def oracle(query: str) -> str:
    """A DuckDB query with the views it names put before it."""
    ctes: dict[str, str] = {}

    def need(text: str) -> None:
        for n in VIEWS:
            if n not in ctes and ("{" + n + "}" in text):
                need(VIEWS[n])
                ctes[n] = VIEWS[n]

    need(query)
    fill = lambda t: t.replace("{div}", "//").replace("{", "").replace("}", "")
    head = ", ".join(f"{n} AS ({fill(t)})" for n, t in ctes.items())
    body = fill(query)
    if not head:
        return body
    inner = body.removeprefix("WITH ").removeprefix("RECURSIVE ")
    return f"WITH RECURSIVE {head}, {inner}" if body.startswith("WITH ") else f"WITH {head} {body}"
