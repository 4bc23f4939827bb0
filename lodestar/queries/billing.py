"""Registered queries: tenants, usage, prices, invoices and revenue (family O, the rest)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import load
from ..operators import billing as B
from ..operators import relational as R
from ..registry import query

r2, r4, r6 = (lambda c: F.round(c, 2)), (lambda c: F.round(c, 4)), (lambda c: F.round(c, 6))
ntz = lambda c: c.cast("timestamp_ntz")
TS = lambda text: F.expr(f"TIMESTAMP_NTZ '{text}'")
PER_MONTH = "(CASE billing_interval WHEN 'monthly' THEN 1 WHEN 'quarterly' THEN 3 ELSE 12 END)"
SUBS = "fx_subscriptions JOIN fx_plans USING (plan_id)"
MRR = f"CAST(amount*quantity AS DOUBLE)/{PER_MONTH}"


def subscriptions(s, d):
    j = load(s, d, "fx_subscriptions").join(load(s, d, "fx_plans"), "plan_id")
    return j.withColumn("mrr", (F.col("amount") * F.col("quantity")).cast("double") / B.months(F.col("billing_interval")))


def quantities(s, d):
    return load(s, d, "fx_usage").groupBy("tenant").agg(F.sum("quantity").alias("q"))


@query("o1_tenant_activity", "SELECT user_id%20 AS tenant, event_type, date_trunc('hour', ts) AS hour, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2, 3")
def o1(s, d):
    return load(s, d, "events").groupBy((F.col("user_id") % 20).alias("tenant"), "event_type", ntz(F.date_trunc("hour", "ts")).alias("hour")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))


@query("o2_user_activity", "SELECT u.user_id, n, first_ts, last_ts, event_type AS top_feature FROM (SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1) u JOIN (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY 1, 2) t ON t.user_id=u.user_id AND k=1")
def o2(s, d):
    g = load(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("c"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    top = F.min_by("event_type", F.struct(-F.col("c"), "event_type"))
    return g.groupBy("user_id").agg(F.sum("c").alias("n"), F.min("a").alias("first_ts"), F.max("b").alias("last_ts"), top.alias("top_feature"))


@query("o3_funnel", "SELECT count(*) AS viewed, count(*) FILTER (WHERE c > v) AS clicked, count(*) FILTER (WHERE c > v AND p > c) AS bought FROM (SELECT user_id, v, min(ts) FILTER (WHERE event_type='click' AND ts > v) AS c, min(ts) FILTER (WHERE event_type='purchase' AND ts > c1) AS p FROM (SELECT *, min(ts) FILTER (WHERE event_type='click' AND ts > v) OVER (PARTITION BY user_id) AS c1 FROM (SELECT *, min(ts) FILTER (WHERE event_type='view') OVER (PARTITION BY user_id) AS v FROM events)) GROUP BY 1, 2) WHERE v IS NOT NULL")
def o3(s, d):
    # per user the times of each step, in order: few rows, as one array a step
    at = lambda kind: F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, F.col("ts"))))
    g = load(s, d, "events").groupBy("user_id").agg(at("view").alias("vs"), at("click").alias("cs"), at("purchase").alias("ps")).withColumn("v", F.get("vs", F.lit(0)))
    g = g.withColumn("c", F.get(F.filter("cs", lambda x: x > F.col("v")), F.lit(0)))
    g = g.withColumn("p", F.get(F.filter("ps", lambda x: x > F.col("c")), F.lit(0))).where("v IS NOT NULL")
    return g.agg(F.count("*").alias("viewed"), F.count("c").alias("clicked"), F.count("p").alias("bought"))


@query("o3_retention", "SELECT age, count(DISTINCT user_id) AS users FROM (SELECT user_id, date_diff('day', min(ts) OVER (PARTITION BY user_id), ts) AS age FROM events) GROUP BY 1")
def o3_retention(s, d):
    first = F.min("ts").over(Window.partitionBy("user_id"))
    return load(s, d, "events").select("user_id", F.date_diff(F.to_date("ts"), first.cast("date")).cast("long").alias("age")).groupBy("age").agg(F.count_distinct("user_id").alias("users"))


@query("o4_usage_once", "SELECT tenant, idem_key, quantity FROM (SELECT *, row_number() OVER (PARTITION BY tenant, idem_key ORDER BY ts, rec_id, quantity, component) AS n FROM fx_usage) WHERE n = 1")
def o4(s, d):
    return R.keep_first(load(s, d, "fx_usage"), ["tenant", "idem_key"], [F.col(c) for c in ("ts", "rec_id", "quantity", "component")]).select("tenant", "idem_key", "quantity")


@query("o6_daily_usage", "SELECT date_trunc('day', ts) AS day, component, round(sum(quantity), 4) AS total, count(DISTINCT tenant) AS tenants, round(avg(quantity), 6) AS mean, max(quantity) AS most FROM fx_usage GROUP BY 1, 2")
def o6(s, d):
    return load(s, d, "fx_usage").groupBy(ntz(F.date_trunc("day", "ts")).alias("day"), "component").agg(r4(F.sum("quantity")).alias("total"), F.count_distinct("tenant").alias("tenants"), r6(F.avg("quantity")).alias("mean"), F.max("quantity").alias("most"))


@query("o6_top_tenants", "SELECT component, tenant, total, rank FROM (SELECT component, tenant, round(sum(quantity), 4) AS total, row_number() OVER (PARTITION BY component ORDER BY round(sum(quantity), 4) DESC, tenant) AS rank FROM fx_usage GROUP BY 1, 2) WHERE rank <= 5")
def o6_top(s, d):
    g = load(s, d, "fx_usage").groupBy("component", "tenant").agg(r4(F.sum("quantity")).alias("total"))
    return R.top_n(g, ["component"], [F.desc("total"), F.col("tenant")], 5)


@query("o7_quota", "SELECT tenant, round(used, 4) AS used, lim, round(100*used/lim, 4) AS pct, used > lim AS exceeded, used > 0.8*lim AND used <= lim AS near_limit FROM (SELECT tenant, sum(quantity) AS used, (CASE tenant%3 WHEN 0 THEN 300 WHEN 1 THEN 900 ELSE 2000 END)::DOUBLE AS lim FROM fx_usage WHERE ts >= TIMESTAMP '1995-01-01' GROUP BY 1)")
def o7(s, d):
    used = load(s, d, "fx_usage").where(F.col("ts") >= TS("1995-01-01")).groupBy("tenant").agg(F.sum("quantity").alias("used"))
    lim = F.when(F.col("tenant") % 3 == 0, 300.0).when(F.col("tenant") % 3 == 1, 900.0).otherwise(2000.0)
    u = F.col("used")
    return used.withColumn("lim", lim).select("tenant", r4(u).alias("used"), "lim", r4(100 * u / F.col("lim")).alias("pct"), (u > F.col("lim")).alias("exceeded"), ((u > 0.8 * F.col("lim")) & (u <= F.col("lim"))).alias("near_limit"))


@query("o8_flat_and_seat", f"SELECT id, CASE WHEN id%2=0 THEN amount::DOUBLE ELSE (amount*quantity)::DOUBLE END AS price FROM {SUBS}")
def o8(s, d):
    return subscriptions(s, d).select("id", F.when(F.col("id") % 2 == 0, F.col("amount").cast("double")).otherwise((F.col("amount") * F.col("quantity")).cast("double")).alias("price"))


@query("o9_tiers_with_flat", "SELECT tenant, round(sum(greatest(0, least(q, hi)-lo)*unit + CASE WHEN q > lo THEN flat ELSE 0 END), 4) AS price FROM (SELECT tenant, sum(quantity) AS q FROM fx_usage GROUP BY 1), (VALUES (0, 100, 0.5, 5), (100, 500, 0.3, 3), (500, 1000000000, 0.1, 1)) t(lo, hi, unit, flat) GROUP BY 1")
def o9(s, d):
    return quantities(s, d).select("tenant", r4(B.graduated(F.col("q"), [(0, 100, 0.5, 5.0), (100, 500, 0.3, 3.0), (500, 1e9, 0.1, 1.0)])).alias("price"))


@query("o10_volume_price", "SELECT tenant, round(CASE WHEN q <= 100 THEN q*0.5+5 WHEN q <= 500 THEN q*0.3+3 ELSE q*0.1 END, 4) AS price FROM (SELECT tenant, sum(quantity) AS q FROM fx_usage GROUP BY 1)")
def o10(s, d):
    return quantities(s, d).select("tenant", r4(B.volume(F.col("q"), [(100, 0.5, 5), (500, 0.3, 3)], 0.1)).alias("price"))


@query("o11_metered_hybrid", "SELECT tenant, round(sum(quantity*CASE component WHEN 'A' THEN 0.5 WHEN 'N' THEN 0.2 ELSE 0.1 END), 4) AS metered, round(20+sum(quantity*CASE component WHEN 'A' THEN 0.5 WHEN 'N' THEN 0.2 ELSE 0.1 END), 4) AS hybrid FROM fx_usage GROUP BY 1")
def o11(s, d):
    unit = F.when(F.col("component") == "A", 0.5).when(F.col("component") == "N", 0.2).otherwise(0.1)
    total = F.sum(F.col("quantity") * unit)
    return load(s, d, "fx_usage").groupBy("tenant").agg(r4(total).alias("metered"), r4(20 + total).alias("hybrid"))


@query("o12_discount_tax", "SELECT id, round(net, 4) AS net, round(net*0.19, 4) AS tax, round(net+net*0.19, 4) AS total FROM (SELECT id, CASE id%4 WHEN 0 THEN (amount*quantity)::DOUBLE*0.9 WHEN 1 THEN greatest(0, (amount*quantity)::DOUBLE-30) WHEN 2 THEN 0 ELSE (amount*quantity)::DOUBLE END AS net FROM " + SUBS + ")")
def o12(s, d):
    k = F.col("id") % 4
    kind = F.when(k == 0, "percent").when(k == 1, "fixed").when(k == 2, "trial").otherwise("none")
    net = B.discounted((F.col("amount") * F.col("quantity")).cast("double"), kind, F.when(k == 0, 10.0).otherwise(30.0))
    return subscriptions(s, d).select("id", net.alias("n")).select("id", r4("n").alias("net"), r4(F.col("n") * 0.19).alias("tax"), r4(F.col("n") + F.col("n") * 0.19).alias("total"))


@query("o13_plan_comparison", "SELECT tenant, arg_min(plan, struct_pack(p := price, n := plan)) AS best, round(min(price), 4) AS price, round(12*(max(price)-min(price)), 4) AS annual_saving FROM (SELECT tenant, unnest([struct_pack(plan := 'flat', price := 250.0), struct_pack(plan := 'seat', price := q*0.4), struct_pack(plan := 'volume', price := CASE WHEN q <= 500 THEN q*0.3+50 ELSE q*0.1+50 END)], recursive := true) FROM (SELECT tenant, sum(quantity) AS q FROM fx_usage GROUP BY 1)) GROUP BY 1")
def o13(s, d):
    q = F.col("q")
    plans = {"flat": F.lit(250.0), "seat": q * 0.4, "volume": B.volume(q, [(500, 0.3, 0)], 0.1) + 50}
    each = F.array(*[F.struct(p.alias("price"), F.lit(n).alias("plan")) for n, p in plans.items()])
    b, w = F.array_min("p"), F.array_max(F.transform("p", lambda x: x["price"]))
    return quantities(s, d).select("tenant", each.alias("p")).select("tenant", b["plan"].alias("best"), r4(b["price"]).alias("price"), r4(12 * (w - b["price"])).alias("annual_saving"))


@query("o14_proration", f"SELECT id, round(old*share, 4) AS credit, round(new*share, 4) AS charge, round((new-old)*share, 4) AS net FROM (SELECT id, {MRR} AS old, {MRR}*1.5 AS new, date_diff('day', created_at::DATE + (id%28)::INT, (created_at + INTERVAL 1 MONTH)::DATE)/date_diff('day', created_at::DATE, (created_at + INTERVAL 1 MONTH)::DATE) AS share FROM {SUBS})")
def o14(s, d):
    begin = F.col("created_at").cast("date")
    credit, charge, net = B.prorated(F.col("mrr"), F.col("mrr") * 1.5, begin, F.add_months(begin, 1), F.date_add(begin, (F.col("id") % 28).cast("int")))
    return subscriptions(s, d).select("id", r4(credit).alias("credit"), r4(charge).alias("charge"), r4(net).alias("net"))


@query("o15_invoices", """SELECT tenant, round(sum(x), 4) AS subtotal, count(*) AS lines, round(sum(x)*1.2, 4) AS total, tenant%5=0 AS overdue FROM (SELECT o_custkey AS tenant, 20.0::DOUBLE AS x FROM orders GROUP BY 1 UNION ALL SELECT tenant, sum(quantity)*0.25 FROM fx_usage GROUP BY tenant, component) GROUP BY 1""")
def o15(s, d):
    base = load(s, d, "orders").select(F.col("o_custkey").alias("tenant")).distinct().select("tenant", F.lit("base").alias("line"), F.lit(20.0).alias("x"))
    metered = load(s, d, "fx_usage").groupBy("tenant", F.col("component").alias("line")).agg((F.sum("quantity") * 0.25).alias("x"))
    g = base.unionByName(metered).groupBy("tenant").agg(r4(F.sum("x")).alias("subtotal"), F.count("*").alias("lines"), r4(F.sum("x") * 1.2).alias("total"))
    return g.withColumn("overdue", F.col("tenant") % 5 == 0)


@query("o16_renewals", f"SELECT id, (created_at + {PER_MONTH} * INTERVAL 1 MONTH)::DATE AS period_end, (created_at + {PER_MONTH} * INTERVAL 1 MONTH)::DATE <= DATE '1994-01-01' AS due FROM {SUBS} WHERE status='active'")
def o16(s, d):
    end = B.period_end(F.col("created_at"), F.col("billing_interval"))
    return subscriptions(s, d).where("status = 'active'").select("id", end.alias("period_end"), (end <= F.lit("1994-01-01").cast("date")).alias("due"))


@query("o17_arr", f"SELECT plan_id, round(sum({MRR}), 4) AS mrr, round(12*sum({MRR}), 4) AS arr FROM {SUBS} WHERE status IN ('active','trial') GROUP BY 1")
def o17_arr(s, d):
    return subscriptions(s, d).where("status IN ('active', 'trial')").groupBy("plan_id").agg(r4(F.sum("mrr")).alias("mrr"), r4(12 * F.sum("mrr")).alias("arr"))


@query("o18_movements", f"SELECT m, round(sum(n), 4) AS new_mrr, round(sum(c), 4) AS churned_mrr, round(sum(n)-sum(c), 4) AS net FROM (SELECT date_trunc('month', created_at) AS m, {MRR} AS n, 0 AS c FROM {SUBS} UNION ALL SELECT date_trunc('month', canceled_at), 0, {MRR} FROM {SUBS} WHERE canceled_at IS NOT NULL) GROUP BY 1")
def o18(s, d):
    j = subscriptions(s, d)
    month = lambda c: ntz(F.date_trunc("month", c)).alias("m")
    both = j.select(month("created_at"), F.col("mrr").alias("n"), F.lit(0.0).alias("c")).unionByName(j.where("canceled_at IS NOT NULL").select(month("canceled_at"), F.lit(0.0).alias("n"), F.col("mrr").alias("c")))
    return both.groupBy("m").agg(r4(F.sum("n")).alias("new_mrr"), r4(F.sum("c")).alias("churned_mrr"), r4(F.sum("n") - F.sum("c")).alias("net"))


@query("o19_churn", f"SELECT plan_id, count(*) FILTER (WHERE gone) AS lost, round(coalesce(count(*) FILTER (WHERE gone)/nullif(count(*) FILTER (WHERE there), 0), 0), 6) AS customer_churn, round(coalesce(sum(mrr) FILTER (WHERE gone)/nullif(sum(mrr) FILTER (WHERE there), 0), 0), 6) AS revenue_churn FROM (SELECT plan_id, {MRR} AS mrr, created_at < TIMESTAMP '1996-01-01' AND (canceled_at IS NULL OR canceled_at >= TIMESTAMP '1996-01-01') AS there, created_at < TIMESTAMP '1996-01-01' AND coalesce(canceled_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31', false) AS gone FROM {SUBS}) GROUP BY 1")
def o19(s, d):
    old = F.col("created_at") < TS("1996-01-01")
    there = old & (F.col("canceled_at").isNull() | (F.col("canceled_at") >= TS("1996-01-01")))
    gone = old & F.coalesce(F.col("canceled_at").between(TS("1996-01-01"), TS("1997-12-31")), F.lit(False))
    j = subscriptions(s, d).select("plan_id", "mrr", there.alias("there"), gone.alias("gone"))
    part = lambda x, y: r6(F.coalesce(F.try_divide(x, y), F.lit(0.0)))
    money = lambda c: F.sum(F.when(F.col(c), F.col("mrr")))
    return j.groupBy("plan_id").agg(F.count_if("gone").alias("lost"), part(F.count_if("gone"), F.count_if("there")).alias("customer_churn"), part(money("gone"), money("there")).alias("revenue_churn"))


@query("o20_cohort_rates", "SELECT cohort, age, active, round(active/size, 6) AS rate, round(revenue, 2) AS revenue FROM (SELECT cohort, age, count(DISTINCT o_custkey) AS active, sum(o_totalprice) AS revenue FROM (SELECT o_custkey, o_totalprice, strftime(f, '%Y-%m') AS cohort, ((year(o_orderdate)-year(f))*12+month(o_orderdate)-month(f))::BIGINT AS age FROM orders JOIN (SELECT o_custkey, min(o_orderdate) AS f FROM orders GROUP BY 1) USING (o_custkey)) WHERE age BETWEEN 0 AND 12 GROUP BY 1, 2) JOIN (SELECT strftime(f, '%Y-%m') AS cohort, count(*) AS size FROM (SELECT min(o_orderdate) AS f FROM orders GROUP BY o_custkey) GROUP BY 1) USING (cohort)")
def o20(s, d):
    o = load(s, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    first = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("f")).withColumn("cohort", F.date_format("f", "yyyy-MM"))
    age = (F.year("o_orderdate") - F.year("f")) * 12 + F.month("o_orderdate") - F.month("f")
    g = o.join(first, "o_custkey").withColumn("age", age.cast("long")).where("age BETWEEN 0 AND 12").groupBy("cohort", "age").agg(F.count_distinct("o_custkey").alias("active"), F.sum("o_totalprice").alias("revenue"))
    return g.join(first.groupBy("cohort").agg(F.count("*").alias("size")), "cohort").select("cohort", "age", "active", r6(F.col("active") / F.col("size")).alias("rate"), r2("revenue").alias("revenue"))


@query("o21_ratios", f"SELECT plan_id, round(arpu, 6) AS arpu, round(CASE WHEN churn > 0 THEN arpu/churn ELSE 0 END, 4) AS ltv, round(CASE WHEN early > 0 THEN 100*(total-early)/early ELSE 0 END, 4) AS growth_pct FROM (SELECT plan_id, sum({MRR})/count(*) AS arpu, count(*) FILTER (WHERE status='canceled')/count(*) AS churn, count(*) AS total, count(*) FILTER (WHERE created_at < TIMESTAMP '1994-01-01') AS early FROM {SUBS} GROUP BY 1)")
def o21(s, d):
    g = subscriptions(s, d).groupBy("plan_id").agg((F.sum("mrr") / F.count("*")).alias("arpu"), (F.count_if(F.col("status") == "canceled") / F.count("*")).alias("churn"), F.count("*").alias("total"), F.count_if(F.col("created_at") < TS("1994-01-01")).alias("early"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return g.select("plan_id", r6("arpu").alias("arpu"), r4(zero(F.try_divide(F.col("arpu"), F.col("churn")))).alias("ltv"), r4(zero(F.try_divide(100 * (F.col("total") - F.col("early")), F.col("early")))).alias("growth_pct"))


@query("o22_revenue_by_plan", f"SELECT plan_id, round(m, 4) AS mrr, n AS subscribers, round(100*m/sum(m) OVER (), 4) AS share FROM (SELECT plan_id, sum({MRR}) AS m, count(*) AS n FROM {SUBS} WHERE status <> 'canceled' GROUP BY 1)")
def o22(s, d):
    g = subscriptions(s, d).where("status <> 'canceled'").groupBy("plan_id").agg(F.sum("mrr").alias("m"), F.count("*").alias("subscribers"))
    return B.share_of_total(g, "m").select("plan_id", r4("m").alias("mrr"), "subscribers", r4("share").alias("share"))


@query("o23_webhooks", "SELECT user_id%30 AS endpoint, count(*) FILTER (WHERE event_type IN ('view','click','signup')) AS success, count(*) FILTER (WHERE event_type='error') AS failed, count(*) FILTER (WHERE event_type='purchase') AS pending FROM events GROUP BY 1")
def o23(s, d):
    n = lambda *k: F.count_if(F.col("event_type").isin(*k))
    return load(s, d, "events").groupBy((F.col("user_id") % 30).alias("endpoint")).agg(n("view", "click", "signup").alias("success"), n("error").alias("failed"), n("purchase").alias("pending"))


@query("o24_hierarchy_usage", "WITH RECURSIVE w(node, up, depth) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier UNION ALL SELECT w.node, e.src, depth+1 FROM w JOIN fx_tree e ON e.dst=w.up) SELECT up AS tenant, count(*) AS members, max(depth)::BIGINT AS depth, round(sum(s_acctbal), 2) AS usage FROM w JOIN supplier ON s_suppkey=node GROUP BY 1")
def o24(s, d):
    from ..operators.graph import reach

    own = load(s, d, "supplier").select(F.col("s_suppkey").alias("origin"), "s_acctbal")
    up = reach(load(s, d, "fx_tree"), own.select("origin"), backward=True)
    return up.join(own, "origin").groupBy(F.col("node").alias("tenant")).agg(F.count("*").alias("members"), F.max("hops").cast("long").alias("depth"), r2(F.sum("s_acctbal")).alias("usage"))


@query("o25_rollout", "SELECT c_custkey, c_custkey%50=0 OR (c_custkey%17<>0 AND ('0x'||left(md5('new_map:'||c_custkey), 4))::INT%100 < 30) AS enabled FROM customer")
def o25(s, d):
    bucket = F.conv(F.left(F.md5(F.concat(F.lit("new_map:"), F.col("c_custkey").cast("string")).cast("binary")), F.lit(4)), 16, 10).cast("long") % 100
    return load(s, d, "customer").select("c_custkey", ((F.col("c_custkey") % 50 == 0) | ((F.col("c_custkey") % 17 != 0) & (bucket < 30))).alias("enabled"))
