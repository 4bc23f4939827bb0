"""Input tables and the derived views of the test data; the SQL text of a view is the same for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
VIEWS = {
    "fx_points": "SELECT c_custkey AS id, CAST((c_custkey*7919)%36000 AS DOUBLE)/100.0-180.0 AS lon, CAST((c_custkey*104729)%17000 AS DOUBLE)/100.0-85.0 AS lat, c_nationkey AS grp, c_acctbal AS value FROM customer",
    "fx_sites": "SELECT s_suppkey AS id, CAST((s_suppkey*3571)%36000 AS DOUBLE)/100.0-180.0 AS lon, CAST((s_suppkey*1299)%17000 AS DOUBLE)/100.0-85.0 AS lat, s_acctbal AS value FROM supplier",
    "fx_boxes": "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS grp, CAST(-180+72*(n_nationkey%5) AS DOUBLE) AS minx, -85.0+34.0*CAST(FLOOR(n_nationkey/5.0) AS DOUBLE) AS miny, CAST(-100+72*(n_nationkey%5) AS DOUBLE) AS maxx, -85.0+34.0*CAST(FLOOR(n_nationkey/5.0) AS DOUBLE)+38.0 AS maxy FROM nation",
    "fx_edges": "SELECT n_nationkey AS src, (n_nationkey+1)%25 AS dst, CAST(1+(n_nationkey*7)%13 AS DOUBLE) AS cost FROM nation UNION ALL SELECT n_nationkey, (n_nationkey+5)%25, CAST(2+(n_nationkey*11)%17 AS DOUBLE) FROM nation",
    "fx_dem": "SELECT CAST(FLOOR(p_partkey/40.0) AS BIGINT) AS r, p_partkey%40 AS c, p_retailprice AS elev, p_size AS zone FROM part",
    "fx_pixels": "SELECT d.scene, CAST(FLOOR(p.p_partkey/40.0) AS BIGINT) AS r, p.p_partkey%40 AS c, CAST((p.p_partkey*13+d.scene*7)%97 AS DOUBLE)/100.0 AS blue, CAST((p.p_partkey*17+d.scene*11)%97 AS DOUBLE)/100.0 AS green, CAST((p.p_partkey*19+d.scene*5)%97 AS DOUBLE)/100.0 AS red, CAST((p.p_partkey*29+d.scene*3)%97 AS DOUBLE)/100.0 AS nir, CAST((p.p_partkey*31+d.scene)%97 AS DOUBLE)/100.0 AS swir1, CAST((p.p_partkey*37+d.scene)%97 AS DOUBLE)/100.0 AS swir2 FROM part p CROSS JOIN (SELECT 0 AS scene UNION ALL SELECT 1 AS scene) d",
    "fx_metrics": "SELECT event_id, event_type AS name, user_id%5 AS host, ts, value FROM events",
    "fx_gps": "SELECT event_id, user_id AS tracker, ts, CAST((event_id*37)%3600 AS DOUBLE)/10.0-180.0 AS lon, CAST((event_id*53)%1700 AS DOUBLE)/10.0-85.0 AS lat, value AS speed FROM events",
    "fx_audit": "SELECT event_id AS id, ts, user_id AS actor, event_id%40 AS resource, event_type AS action, CASE WHEN event_type='error' THEN 'Failure' ELSE 'Success' END AS result FROM events",
    "fx_replica_log": "SELECT user_id%50 AS k, event_id%3 AS replica, event_id AS seq, ts, value, CASE WHEN event_type='error' THEN 'remove' ELSE 'set' END AS op FROM events",
    "fx_plans": "SELECT DISTINCT c_mktsegment AS plan_id, CAST(10+LENGTH(c_mktsegment) AS DECIMAL(18,6)) AS amount, CASE LENGTH(c_mktsegment)%3 WHEN 0 THEN 'monthly' WHEN 1 THEN 'quarterly' ELSE 'yearly' END AS billing_interval FROM customer",
    "fx_subscriptions": "SELECT c.c_custkey AS id, c.c_mktsegment AS plan_id, 1+c.c_custkey%9 AS quantity, o.first_ts AS created_at, CASE WHEN c.c_custkey%4=0 THEN o.last_ts END AS canceled_at, CASE WHEN c.c_custkey%4=0 THEN 'canceled' WHEN c.c_custkey%7=0 THEN 'trial' ELSE 'active' END AS status FROM customer c JOIN (SELECT o_custkey, MIN(o_orderdate) AS first_ts, MAX(o_orderdate) AS last_ts FROM orders GROUP BY o_custkey) o ON o.o_custkey=c.c_custkey",
    "fx_usage": "SELECT o.o_custkey AS tenant, l.l_returnflag AS component, l.l_quantity AS quantity, l.l_shipdate AS ts, l.l_orderkey*8+l.l_linenumber AS rec_id, l.l_orderkey*8+l.l_linenumber%5 AS idem_key FROM lineitem l JOIN orders o ON o.o_orderkey=l.l_orderkey",
    "fx_rects": "SELECT s_suppkey AS id, s_nationkey AS grp, CAST((s_suppkey*3571)%33000 AS DOUBLE)/100.0-180.0 AS minx, CAST((s_suppkey*1299)%14000 AS DOUBLE)/100.0-85.0 AS miny, CAST((s_suppkey*3571)%33000 AS DOUBLE)/100.0-180.0+4+s_suppkey%23 AS maxx, CAST((s_suppkey*1299)%14000 AS DOUBLE)/100.0-85.0+3+s_suppkey%17 AS maxy FROM supplier",
    "fx_quads": "SELECT c_custkey AS id, c_nationkey AS grp, lon AS x1, lat AS y1, lon+2+c_custkey%5 AS x2, lat+CAST(c_custkey%3 AS DOUBLE)/4 AS y2, lon+1.5+c_custkey%4 AS x3, lat+2+c_custkey%6 AS y3, lon-CAST(c_custkey%7 AS DOUBLE)/8 AS x4, lat+1.25+c_custkey%3 AS y4 FROM (SELECT c_custkey, c_nationkey, CAST((c_custkey*7919)%36000 AS DOUBLE)/100.0-180.0 AS lon, CAST((c_custkey*104729)%16000 AS DOUBLE)/100.0-85.0 AS lat FROM customer) q",
    "fx_lots": "SELECT s_suppkey AS id, s_nationkey AS grp, CAST((s_suppkey*3571)%300 AS DOUBLE) AS minx, CAST((s_suppkey*1299)%140 AS DOUBLE) AS miny, CAST((s_suppkey*3571)%300+2+s_suppkey%9 AS DOUBLE) AS maxx, CAST((s_suppkey*1299)%140+2+s_suppkey%7 AS DOUBLE) AS maxy FROM supplier",
    "fx_tree": "SELECT CAST(FLOOR((s_suppkey-1)/2.0) AS BIGINT) AS src, s_suppkey AS dst FROM supplier WHERE s_suppkey > 0",
    "fx_roads": "SELECT s_suppkey AS src, CAST(FLOOR(s_suppkey/2.0) AS BIGINT) AS dst, CAST(1+(s_suppkey*7)%13 AS DOUBLE) AS cost, s_suppkey%3 AS class FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT CAST(FLOOR(s_suppkey/2.0) AS BIGINT), s_suppkey, CAST(1+(s_suppkey*5)%11 AS DOUBLE), s_suppkey%3 FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT s_suppkey-1, s_suppkey, CAST(2+(s_suppkey*11)%17 AS DOUBLE), s_suppkey%4 FROM supplier WHERE s_suppkey > 0",
    "fx_snap_a": "SELECT o_orderkey AS k, o_totalprice AS v, o_orderstatus AS s FROM orders WHERE o_orderkey%10<>1",
    "fx_snap_b": "SELECT o_orderkey AS k, CASE WHEN o_orderkey%10=2 THEN o_totalprice+1.0 ELSE o_totalprice END AS v, o_orderstatus AS s FROM orders WHERE o_orderkey%10<>3",
    "fx_predictions": "SELECT doc_id, quality AS y_true, CASE WHEN doc_id%5=0 THEN 1-quality ELSE quality END AS y_pred FROM labels",
    "fx_lineage": "SELECT n_nationkey AS src, n_nationkey*2+1 AS dst FROM nation WHERE n_nationkey*2+1<25 UNION ALL SELECT n_nationkey, n_nationkey*2+2 FROM nation WHERE n_nationkey*2+2<25",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a derived view over the tables, of `sf_dir`."""
    if name in VIEWS:
        text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", rf"\1 parquet.`{sf_dir}/\2.parquet`", VIEWS[name])
        return spark.sql(text)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(sql: str) -> str:
    """`sql` for DuckDB with the derived views it names put in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    lead = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    return f"WITH {lead[1] or ''}{head}, {sql[lead.end():]}" if lead else f"WITH {head} {sql}"
