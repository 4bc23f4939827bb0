"""Registered queries: scans, builders, pipelines, cubes and profiles (families A, B and C, the rest)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..checkpoint import checkpoint_dir
from ..fixtures import load
from ..operators import pipelines as P
from ..operators import relational as R
from ..registry import query
from ..sources.files import write_table

c = F.col
r2, r4, r6 = (lambda x: F.round(x, 2)), (lambda x: F.round(x, 4)), (lambda x: F.round(x, 6))
ntz = lambda x: x.cast("timestamp_ntz")


@query("a15_tile_paths", "SELECT id, '7/' || x || '/' || y AS zxy, '7/' || x || '/' || (127-y) AS tms FROM (SELECT id, greatest(0, least(127, floor((lon+180)/360*128)))::BIGINT AS x, greatest(0, least(127, floor((1-asinh(tan(radians(lat)))/pi())/2*128)))::BIGINT AS y FROM fx_points)")
def a15(s, d):
    from ..functions import geo

    x, y = geo.tile(c("lon"), c("lat"), 7)
    p = load(s, d, "fx_points").select("id", x.alias("x"), y.alias("y"))
    path = lambda row: F.concat_ws("/", F.lit("7"), c("x").cast("string"), row.cast("string"))
    return p.select("id", path(c("y")).alias("zxy"), path(127 - c("y")).alias("tms"))


@query("a16_bulk_index", """SELECT b.k, b.op, CASE WHEN b.op='create' AND a.k IS NOT NULL THEN 'exists' WHEN b.op='update' AND a.k IS NULL THEN 'missing' ELSE 'indexed' END AS state, CASE WHEN b.op='create' AND a.k IS NOT NULL THEN a.v WHEN b.op='update' AND a.k IS NULL THEN NULL ELSE b.v END AS v
  FROM (SELECT *, CASE WHEN k%3=0 THEN 'create' WHEN k%3=1 THEN 'update' ELSE 'index' END AS op FROM fx_snap_b) b LEFT JOIN fx_snap_a a ON a.k=b.k""")
def a16(s, d):
    """A batch of creates, updates and upserts against an index: what each does, and what the index then holds under its key."""
    there = load(s, d, "fx_snap_a").select("k", c("v").alias("old"), F.lit(True).alias("there"))
    batch = load(s, d, "fx_snap_b").withColumn("op", F.when(c("k") % 3 == 0, "create").when(c("k") % 3 == 1, "update").otherwise("index")).join(there, "k", "left")
    state = F.when((c("op") == "create") & c("there"), "exists").when((c("op") == "update") & c("there").isNull(), "missing").otherwise("indexed")
    return batch.withColumn("state", state).select("k", "op", "state", F.when(c("state") == "exists", c("old")).when(c("state") == "indexed", c("v")).alias("v"))


@query("b1_scan", "SELECT l.l_orderkey, l.l_shipdate FROM lineitem l WHERE l.l_shipdate >= TIMESTAMP '1997-01-01' AND l.l_returnflag='R'")
def b1(s, d):
    return load(s, d, "lineitem").alias("l").where("l.l_shipdate >= TIMESTAMP_NTZ '1997-01-01' AND l.l_returnflag = 'R'").select("l.l_orderkey", "l.l_shipdate")


@query("b4_theta_join", "SELECT s_suppkey, r_regionkey FROM supplier CROSS JOIN region WHERE s_nationkey%5 < r_regionkey")
def b4(s, d):
    r = load(s, d, "region")
    return load(s, d, "supplier").join(F.broadcast(r), c("s_nationkey") % 5 < c("r_regionkey")).select("s_suppkey", "r_regionkey")


@query("b6_implicit_join", "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey=c_custkey AND o_totalprice > 200000")
def b6(s, d):
    return s.sql("SELECT o_orderkey, c_name FROM {o}, {c} WHERE o_custkey = c_custkey AND o_totalprice > 200000", o=load(s, d, "orders"), c=load(s, d, "customer"))


@query("b10_array_agg", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def b10(s, d):
    return load(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"))


@query("b12_order_nulls", "SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size > 40 THEN NULL ELSE p_size END DESC NULLS LAST, p_partkey) AS place FROM part")
def b12(s, d):
    p = load(s, d, "part").select("p_partkey", F.when(c("p_size") > 40, None).otherwise(c("p_size")).alias("z"))
    return R.placed(p, [c("z").desc_nulls_last(), c("p_partkey").asc()]).select("p_partkey", "place")


@query("b14_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def b14(s, d):
    return load(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("b18_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def b18(s, d):
    return load(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("b20_correlated", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey=c.c_custkey AND o.o_totalprice > c.c_acctbal*20) AND c_nationkey IN (SELECT s_nationkey FROM supplier)")
def b20(s, d):
    o, sup = load(s, d, "orders"), load(s, d, "supplier")
    cust = load(s, d, "customer")
    big = cust.join(o, (c("o_custkey") == c("c_custkey")) & (c("o_totalprice") > c("c_acctbal") * 20), "left_semi")
    return big.join(sup, c("s_nationkey") == c("c_nationkey"), "left_semi").select("c_custkey")


@query("b22_three_valued", "SELECT p_partkey, x > 10 AS gt, x IS NULL AS missing, NOT (x > 10) AS not_gt, (x > 10 OR p_size < 5) AS either, x IS NOT DISTINCT FROM p_size AS same FROM (SELECT *, CASE WHEN p_size%7=0 THEN NULL ELSE p_size END AS x FROM part)")
def b22(s, d):
    p = load(s, d, "part").withColumn("x", F.when(c("p_size") % 7 != 0, c("p_size")))
    x = c("x")
    return p.select("p_partkey", (x > 10).alias("gt"), x.isNull().alias("missing"), (~(x > 10)).alias("not_gt"), ((x > 10) | (c("p_size") < 5)).alias("either"), x.eqNullSafe(c("p_size")).alias("same"))


@query("b24_simple_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS state FROM orders")
def b24(s, d):
    return load(s, d, "orders").select("o_orderkey", F.expr("CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END").alias("state"))


@query("b25_not_in_not_between", "SELECT p_partkey FROM part WHERE p_size NOT IN (1,2,3) AND p_retailprice NOT BETWEEN 950 AND 1050")
def b25(s, d):
    return load(s, d, "part").where(~c("p_size").isin(1, 2, 3) & ~c("p_retailprice").between(950, 1050)).select("p_partkey")


@query("b26_named_functions", "SELECT p_partkey, upper(p_name) AS u, length(p_type) AS n, round(sqrt(p_retailprice), 6) AS r FROM part")
def b26(s, d):
    return load(s, d, "part").select("p_partkey", P.named("upper", "p_name").alias("u"), P.named("length", "p_type").alias("n"), r6(P.named("sqrt", "p_retailprice")).alias("r"))


@query("b27_builder_filters", "SELECT p_partkey FROM part WHERE p_type LIKE '%BRASS%' AND NOT p_name LIKE '%1%' AND p_brand LIKE 'Brand#%' AND p_size BETWEEN 3 AND 45 AND p_size <> 7 AND p_type IS NOT NULL")
def b27(s, d):
    rules = [("p_type", "contains", "BRASS"), ("p_name", "not_contains", "1"), ("p_brand", "starts_with", "Brand#"), ("p_size", "between", (3, 45)), ("p_size", "ne", 7), ("p_type", "is_not_null", None)]
    return load(s, d, "part").where(R.condition({"and": [{"field": f, "op": o, "value": v} for f, o, v in rules]})).select("p_partkey")


@query("b28_time_dimension", "SELECT date_trunc('week', ts) AS week, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 14 DAY AND ts < TIMESTAMP '2024-01-30' GROUP BY 1")
def b28(s, d):
    e = load(s, d, "events").where("ts >= TIMESTAMP_NTZ '2024-01-30' - INTERVAL 14 DAYS AND ts < TIMESTAMP_NTZ '2024-01-30'")
    return R.build(e, metrics=[("n", "count", "*")], time=("ts", "week", "week")).withColumn("week", ntz(c("week")))


@query("b29_calculated_metric", "SELECT l_returnflag, round(sum(l_extendedprice*l_discount)/sum(l_extendedprice)*100, 6) AS discount_pct FROM lineitem GROUP BY 1")
def b29(s, d):
    return load(s, d, "lineitem").groupBy("l_returnflag").agg(r6(F.expr("sum(l_extendedprice*l_discount)/sum(l_extendedprice)*100")).alias("discount_pct"))


SPEC = {"source": "lineitem", "steps": [
    {"kind": "filter", "where": {"field": "l_quantity", "op": "gt", "value": 10}}, {"kind": "map", "columns": {"net": "l_extendedprice*(1-l_discount)"}},
    {"kind": "group", "by": ["l_linestatus"], "metrics": [("n", "count", "*"), ("total", "sum", "net")]}, {"kind": "sort", "by": [("n", True)]}, {"kind": "map", "columns": {"total": "round(total, 2)"}},
]}


@query("b32_etl_steps", "SELECT l_linestatus, count(*) AS n, round(sum(l_extendedprice*(1-l_discount)), 2) AS total FROM lineitem WHERE l_quantity > 10 GROUP BY 1")
def b32(s, d):
    return P.run_steps(load(s, d, SPEC["source"]), SPEC)[0]


@query("b33_reduce", "SELECT o_custkey, list_sum(v) AS total, list_avg(v) AS mean, list_min(v) AS least, list_max(v) AS most FROM (SELECT o_custkey, list(round(o_totalprice)::BIGINT::DOUBLE) AS v FROM orders GROUP BY 1)")
def b33(s, d):
    g = load(s, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.round("o_totalprice").cast("double")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return g.select("o_custkey", total.alias("total"), (total / F.size("v")).alias("mean"), F.array_min("v").alias("least"), F.array_max("v").alias("most"))


@query("b36_transform_chain", "SELECT p_brand, count(*) AS n FROM part WHERE p_size > 5 GROUP BY 1 HAVING count(*) > 2")
def b36(s, d):
    large = lambda df: df.where("p_size > 5")
    counted = lambda df: df.groupBy("p_brand").agg(F.count("*").alias("n"))
    return load(s, d, "part").transform(large).transform(counted).transform(lambda df: df.where("n > 2"))


@query("b41_user_functions", "SELECT c_nationkey, round(avg(sign(c_acctbal)*ln(1+abs(c_acctbal))), 6) AS mean_log, round((max(c_acctbal)-min(c_acctbal))/avg(c_acctbal), 4) AS spread FROM customer GROUP BY 1")
def b41(s, d):
    cust = load(s, d, "customer").select("c_nationkey", "c_acctbal", P.log1p_abs("c_acctbal").alias("x"))
    means = cust.groupBy("c_nationkey").agg(r6(F.avg("x")).alias("mean_log"))
    return means.join(cust.groupBy("c_nationkey").agg(P.spread("c_acctbal").alias("s")), "c_nationkey").select("c_nationkey", "mean_log", r4("s").alias("spread"))


@query("c1_load_cube", "SELECT l_returnflag, l_linestatus, l_linenumber, arg_max(l_quantity, struct_pack(a := l_shipdate, b := l_orderkey, d := l_quantity)) AS quantity FROM lineitem GROUP BY 1, 2, 3")
def c1(s, d):
    return load(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.max_by("l_quantity", F.struct("l_shipdate", "l_orderkey", "l_quantity")).alias("quantity"))


@query("c3_dice", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS qty FROM lineitem WHERE l_returnflag IN ('A','R') AND l_linenumber IN (1,3,5) GROUP BY 1, 2")
def c3(s, d):
    return load(s, d, "lineitem").where(c("l_returnflag").isin("A", "R") & c("l_linenumber").isin(1, 3, 5)).groupBy("l_returnflag", "l_linestatus").agg(r4(F.sum("l_quantity")).alias("qty"))


@query("c5_drill_down", "SELECT n_name, c_mktsegment, round(sum(c_acctbal), 2) AS bal FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE n_regionkey=1 GROUP BY 1, 2")
def c5(s, d):
    j = load(s, d, "customer").join(load(s, d, "nation").where("n_regionkey = 1"), c("c_nationkey") == c("n_nationkey"))
    return j.groupBy("n_name", "c_mktsegment").agg(r2(F.sum("c_acctbal")).alias("bal"))


@query("c9_kpi_days", "SELECT day, n, lag(n) OVER (ORDER BY day) AS day_before, lag(n, 7) OVER (ORDER BY day) AS week_before FROM (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1)")
def c9(s, d):
    g = load(s, d, "events").groupBy(ntz(F.date_trunc("day", "ts")).alias("day")).agg(F.count("*").alias("n"))
    w = Window.orderBy("day")  # one row a day is left
    return g.select("day", "n", F.lag("n").over(w).alias("day_before"), F.lag("n", 7).over(w).alias("week_before"))


@query("c10_widget", "SELECT event_type, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def c10(s, d):
    w = R.build(load(s, d, "events"), ["event_type"], [("total", "sum", "value"), ("mean", "avg", "value"), ("least", "min", "value"), ("most", "max", "value"), ("n", "count", "*"), ("users", "count_distinct", "user_id")])
    return w.withColumn("total", r4("total")).withColumn("mean", r6("mean"))


@query("c11_common_values", "SELECT p_brand AS value, n, rank FROM (SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rank FROM part GROUP BY 1) WHERE rank <= 5")
def c11(s, d):
    top = load(s, d, "part").groupBy(c("p_brand").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(5)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "value")))


@query("c13_equi_depth", "SELECT bucket, count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most FROM (SELECT o_totalprice, ntile(10) OVER (ORDER BY o_totalprice, o_orderkey) AS bucket FROM orders) GROUP BY 1")
def c13(s, d):
    return R.equi_depth(load(s, d, "orders"), "o_totalprice", "o_orderkey", 10)


@query("c15_key_advice", "SELECT k AS \"column\", round(used*(1-1.0/distinct_values), 6) AS score FROM (SELECT 'o_custkey' AS k, count(*) FILTER (WHERE o_orderkey%3=0) AS used, count(DISTINCT o_custkey) AS distinct_values FROM orders UNION ALL SELECT 'o_orderstatus', count(*) FILTER (WHERE o_orderkey%2=0), count(DISTINCT o_orderstatus) FROM orders)")
def c15(s, d):
    o = load(s, d, "orders")
    # a query log: which column each of the queries filters
    log = o.select(F.explode(F.array_compact(F.array(F.when(c("o_orderkey") % 3 == 0, "o_custkey"), F.when(c("o_orderkey") % 2 == 0, "o_orderstatus")))).alias("column")).groupBy("column").agg(F.count("*").alias("used"))
    return log.join(R.profile(o.select("o_custkey", "o_orderstatus")), "column").select("column", r6(c("used") * (1 - 1.0 / c("n_distinct"))).alias("score"))


@query("c16_array_helpers", "SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS kinds, (count(*)-1)//3+1 AS chunks, round(median(o_totalprice), 4) AS med FROM orders GROUP BY 1")
def c16(s, d):
    g = load(s, d, "orders").groupBy("o_custkey")
    return g.agg(F.array_sort(F.collect_set("o_orderpriority")).alias("kinds"), F.expr("(count(*) - 1) div 3 + 1").alias("chunks"), r4(F.median("o_totalprice")).alias("med"))


def written(s, df, form, **settings):
    """`df` written to the shared folder in a declared mode and read again."""
    at = f"{checkpoint_dir(s)}/files-{uuid.uuid4().hex}"
    write_table(df, at, form, **settings)
    return s.read.schema(df.schema).format(form).load(at)


@query("a1_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def a1(s, d):
    return written(s, load(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "csv")


@query("a3_parquet", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def a3(s, d):
    o = written(s, load(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), "parquet", by=("o_orderstatus",))
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), r2(F.sum("o_totalprice")).alias("total"))


@query("a10_sink_options", "SELECT p_partkey, p_name FROM part")
def a10(s, d):
    return written(s, load(s, d, "part").select("p_partkey", "p_name"), "json", mode="Overwrite", compression="gzip")


@query("b40_stage_metrics", "SELECT 'step 0 filter' AS step, count(*) AS rows FROM lineitem WHERE l_quantity > 10 UNION ALL SELECT 'step 1 map', count(*) FROM lineitem WHERE l_quantity > 10 UNION ALL SELECT 'step 2 group', count(DISTINCT l_linestatus) FROM lineitem WHERE l_quantity > 10")
def b40(s, d):
    out, seen = P.run_steps(load(s, d, SPEC["source"]), {**SPEC, "steps": SPEC["steps"][:3]}, observe=True)
    out.write.format("noop").mode("overwrite").save()
    names = [f"step {k} {x['kind']}" for k, x in enumerate(SPEC["steps"][:3])]
    return s.createDataFrame([(n, o.get["rows"]) for n, o in zip(names, seen)], "step string, rows long")
