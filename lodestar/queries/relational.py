"""Registered queries: relational core and cube (families B and C)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import load
from ..operators import relational as R
from ..registry import query

r6 = lambda c: F.round(c, 6)


@query("b2_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount BETWEEN 0.05 AND 0.07 AND l_returnflag = 'N'")
def b2(s, d):
    return load(s, d, "lineitem").where((F.col("l_quantity") > 45) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_returnflag") == "N")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("b3_project", "SELECT l_orderkey AS k, round(l_extendedprice*(1-l_discount), 6) AS net FROM lineitem")
def b3(s, d):
    return load(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), r6(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query("b4_joins", """SELECT 'inner' AS how, count(*) AS n FROM customer JOIN orders ON c_custkey=o_custkey UNION ALL SELECT 'left', count(*) FROM customer LEFT JOIN orders ON c_custkey=o_custkey
  UNION ALL SELECT 'right', count(*) FROM customer RIGHT JOIN orders ON c_custkey=o_custkey UNION ALL SELECT 'full', count(*) FROM customer FULL JOIN orders ON c_custkey=o_custkey AND o_totalprice > 100000""")
def b4(s, d):
    c, o = load(s, d, "customer"), load(s, d, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    parts = [c.join(o, on & (F.col("o_totalprice") > 100000) if how == "full" else on, how).agg(F.count("*").alias("n")).select(F.lit(how).alias("how"), "n") for how in ("inner", "left", "right", "full")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("b5_semi_anti", "SELECT c_custkey, true AS has_orders FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='F') UNION ALL SELECT c_custkey, false FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='F')")
def b5(s, d):
    c, o = load(s, d, "customer").select("c_custkey"), load(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("has_orders", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("has_orders", F.lit(False)))


@query("b7_group_having", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS sum_qty, round(avg(l_extendedprice), 6) AS avg_price, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 10")
def b7(s, d):
    return load(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(r6(F.sum("l_quantity")).alias("sum_qty"), r6(F.avg("l_extendedprice")).alias("avg_price"), F.count("*").alias("n")).where("n > 10")


@query("b8_aggregates", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_orderstatus='O') AS n_open, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1")
def b8(s, d):
    return load(s, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


@query("b9_stddev", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS variance FROM lineitem GROUP BY 1")
def b9(s, d):
    return load(s, d, "lineitem").groupBy("l_returnflag").agg(r6(F.stddev("l_quantity")).alias("sd"), r6(F.variance("l_quantity")).alias("variance"))


@query("b10_string_agg", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def b10(s, d):
    return load(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("b11_median_first_last", "SELECT o_orderpriority, round(median(o_totalprice), 6) AS med, round(quantile_cont(o_totalprice, 0.9), 6) AS p90, arg_min(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS first_order, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS last_order FROM orders GROUP BY 1")
def b11(s, d):
    at = F.struct("o_orderdate", "o_orderkey")
    return load(s, d, "orders").groupBy("o_orderpriority").agg(r6(F.median("o_totalprice")).alias("med"), r6(F.percentile("o_totalprice", 0.9)).alias("p90"), F.min_by("o_orderkey", at).alias("first_order"), F.max_by("o_orderkey", at).alias("last_order"))


@query("b13_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10 OFFSET 20")
def b13(s, d):
    return load(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").offset(20).limit(10)


@query("b15_top_n_per_group", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY revenue DESC, o_month) AS rank FROM (SELECT r_name AS region, date_trunc('month', o_orderdate) AS o_month, round(sum(o_totalprice), 2) AS revenue, count(DISTINCT o_custkey) AS customers
  FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY 1, 2)) WHERE rank <= 3""")
def b15(s, d):
    o, c, n, r = (load(s, d, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    m = j.groupBy(F.col("r_name").alias("region"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("o_month")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count_distinct("o_custkey").alias("customers"))
    return R.top_n(m, ["region"], [F.desc("revenue"), F.col("o_month")], 3)


@query("b16_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def b16(s, d):
    return load(s, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(load(s, d, "supplier").select(F.col("s_nationkey").alias("k"))).distinct()


@query("b17_except_intersect", "SELECT 'both' AS side, c_nationkey AS k FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers_only', c_nationkey FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def b17(s, d):
    a, b = load(s, d, "customer").select(F.col("c_nationkey").alias("k")), load(s, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).select(F.lit("both").alias("side"), "k").unionByName(a.subtract(b).select(F.lit("customers_only").alias("side"), "k"))


@query("b19_keep_first", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def b19(s, d):
    return R.keep_first(load(s, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("b20_subquery", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def b20(s, d):
    o, c = load(s, d, "orders"), load(s, d, "customer")
    return s.sql("SELECT o_orderkey FROM {o} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {o}) AND o_custkey IN (SELECT c_custkey FROM {c} WHERE c_acctbal > 0)", o=o, c=c)


@query("b21_arithmetic", "SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey // 7 AS q, l_orderkey % 7 AS m, round(l_extendedprice / l_quantity, 6) AS unit, -l_linenumber AS neg FROM lineitem")
def b21(s, d):
    return load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr("l_orderkey div 7").alias("q"), (F.col("l_orderkey") % 7).alias("m"), r6(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"), (-F.col("l_linenumber")).alias("neg"))


@query("b23_like_regex", "SELECT p_partkey, p_type LIKE '%BRASS%' AS brass, p_name ILIKE 'p%' AS starts_p, regexp_matches(p_brand, '[1-3]$') AS low_brand FROM part")
def b23(s, d):
    return load(s, d, "part").select("p_partkey", F.col("p_type").like("%BRASS%").alias("brass"), F.col("p_name").ilike("p%").alias("starts_p"), F.col("p_brand").rlike("[1-3]$").alias("low_brand"))


@query("b24_case_in_between", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size IN (11,12,13) THEN 'odd' ELSE 'large' END AS class FROM part")
def b24(s, d):
    z = F.col("p_size")
    return load(s, d, "part").select("p_partkey", F.when(z.between(1, 10), "small").when(z.isin(11, 12, 13), "odd").otherwise("large").alias("class"))


@query("b30_query_builder", "SELECT l_returnflag, l_shipmode_month, n, qty, round(qty/n, 6) AS per_row FROM (SELECT l_returnflag, date_trunc('month', l_shipdate) AS l_shipmode_month, count(*) AS n, sum(l_quantity) AS qty FROM lineitem WHERE l_quantity >= 10 AND l_linestatus IN ('O','F') GROUP BY 1, 2) WHERE n > 5")
def b30(s, d):
    out = R.build(load(s, d, "lineitem"), ["l_returnflag"], [("n", "count", "*"), ("qty", "sum", "l_quantity")], [{"field": "l_quantity", "op": "gte", "value": 10}, {"field": "l_linestatus", "op": "in", "value": ["O", "F"]}],
                  {"field": "n", "op": "gt", "value": 5}, time=("l_shipdate", "month", "l_shipmode_month"), derived={"per_row": "round(qty/n, 6)"})
    return out.withColumn("l_shipmode_month", F.col("l_shipmode_month").cast("timestamp_ntz"))


@query("b31_window", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events")
def b31(s, d):
    w = Window.partitionBy("user_id").orderBy("ts")
    return load(s, d, "events").select("event_id", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"), F.lag("event_type").over(w).alias("before"))


@query("b33_array_transform", "SELECT o_custkey, list_sum(list_filter(v, lambda x: x > 50000)) AS big, len(v) AS n FROM (SELECT o_custkey, list(round(o_totalprice)::BIGINT) AS v FROM orders GROUP BY 1)")
def b33(s, d):
    g = load(s, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.round("o_totalprice").cast("long")).alias("v"))
    big = F.filter("v", lambda x: x > 50000)
    return g.select("o_custkey", F.when(F.size(big) > 0, F.aggregate(big, F.lit(0).cast("long"), lambda a, x: a + x)).alias("big"), F.size("v").cast("long").alias("n"))


@query("b34_condition_tree", "SELECT c_custkey FROM customer WHERE (c_acctbal < 0 OR (c_mktsegment = 'BUILDING' AND NOT c_nationkey > 12))")
def b34(s, d):
    tree = {"or": [{"field": "c_acctbal", "op": "lt", "value": 0}, {"and": [{"field": "c_mktsegment", "op": "eq", "value": "BUILDING"}, {"not": {"field": "c_nationkey", "op": "gt", "value": 12}}]}]}
    return load(s, d, "customer").where(R.condition(tree)).select("c_custkey")


@query("b35_lookup", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey=c_nationkey")
def b35(s, d):
    return R.lookup(load(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k")), load(s, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), "k").select("c_custkey", "n_name")


@query("c2_slice_dice", "SELECT l_linestatus, sum(l_quantity) AS qty FROM lineitem WHERE l_returnflag='A' AND l_linenumber IN (1,2,3) GROUP BY 1")
def c2(s, d):
    return load(s, d, "lineitem").where((F.col("l_returnflag") == "A") & F.col("l_linenumber").isin(1, 2, 3)).groupBy("l_linestatus").agg(F.sum("l_quantity").alias("qty"))


@query("c4_rollup", "SELECT r_name, n_name, round(sum(c_acctbal), 2) AS bal FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY ROLLUP(r_name, n_name)")
def c4(s, d):
    j = load(s, d, "customer").join(load(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.round(F.sum("c_acctbal"), 2).alias("bal"))


@query("c6_pivot", "SELECT l_returnflag, sum(l_quantity) FILTER (WHERE l_linestatus='F') AS f, sum(l_quantity) FILTER (WHERE l_linestatus='O') AS o FROM lineitem GROUP BY 1")
def c6(s, d):
    return load(s, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).sum("l_quantity").select("l_returnflag", F.col("F").alias("f"), F.col("O").alias("o"))


@query("c7_cube", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, sum(l_quantity) AS qty, grouping(l_returnflag)*4+grouping(l_linestatus)*2+grouping(l_linenumber) AS level FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus, l_linenumber)")
def c7(s, d):
    return load(s, d, "lineitem").cube("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), F.grouping_id().alias("level"))


@query("c8_sparsity", "SELECT round(1 - count(*) / (max(a) * max(b) * 1.0), 6) AS sparsity FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders), (SELECT count(DISTINCT o_custkey) AS a, count(DISTINCT o_orderpriority) AS b FROM orders)")
def c8(s, d):
    return load(s, d, "orders").agg(r6(1 - F.count_distinct("o_custkey", "o_orderpriority") / (F.count_distinct("o_custkey") * F.count_distinct("o_orderpriority"))).alias("sparsity"))


@query("c9_kpi_period", "SELECT m, revenue, lag(revenue) OVER (ORDER BY m) AS previous, round((revenue / lag(revenue) OVER (ORDER BY m) - 1) * 100, 4) AS change_pct FROM (SELECT date_trunc('month', o_orderdate) AS m, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1)")
def c9(s, d):
    m = load(s, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("m")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    before = F.lag("revenue").over(Window.orderBy("m"))
    return m.select("m", "revenue", before.alias("previous"), F.round((F.col("revenue") / before - 1) * 100, 4).alias("change_pct"))


@query("c11_profile", """SELECT 'c_custkey' AS "column", count(*) AS n_rows, count(DISTINCT c_custkey) AS n_distinct, count(*)-count(c_custkey) AS n_null, min(c_custkey)::VARCHAR AS least, max(c_custkey)::VARCHAR AS most FROM customer
  UNION ALL SELECT 'c_mktsegment', count(*), count(DISTINCT c_mktsegment), count(*)-count(c_mktsegment), min(c_mktsegment), max(c_mktsegment) FROM customer""")
def c11(s, d):
    return R.profile(load(s, d, "customer").select("c_custkey", "c_mktsegment"))


@query("c12_equi_width", "SELECT least(floor((o_totalprice-lo)/((hi-lo)/10)), 9)::INT AS bucket, count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1")
def c12(s, d):
    return R.equi_width(load(s, d, "orders"), "o_totalprice", 10)


@query("c14_skew", "SELECT round(max(n) / avg(n), 6) AS skew, max(n) AS most, count(*) AS keys FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def c14(s, d):
    return load(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).agg(r6(F.max("n") / F.avg("n")).alias("skew"), F.max("n").alias("most"), F.count("*").alias("keys"))
