"""Registered queries: events, metrics, governance, billing, audit, replicas (families L to P and R)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import load
from ..operators import relational as R
from ..registry import query

r6 = lambda c: F.round(c, 6)
ntz = lambda c: c.cast("timestamp_ntz")


@query("l2_read_stream", "SELECT event_id, event_type FROM events WHERE user_id = 7 ORDER BY ts DESC LIMIT 20")
def l2(s, d):
    return load(s, d, "events").where("user_id = 7").orderBy(F.desc("ts")).limit(20).select("event_id", "event_type")


@query("l4_replay_statistics", "SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def l4(s, d):
    return load(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("l5_fold_state", "SELECT user_id, arg_max(value, ts) AS last_value, arg_max(event_type, ts) AS last_type, count(*) AS version FROM events GROUP BY 1")
def l5(s, d):
    return load(s, d, "events").groupBy("user_id").agg(F.max_by("value", "ts").alias("last_value"), F.max_by("event_type", "ts").alias("last_type"), F.count("*").alias("version"))


@query("l8_snapshots", "SELECT user_id, n AS version, round(total, 4) AS total FROM (SELECT user_id, row_number() OVER w AS n, sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE n % 5 = 0")
def l8(s, d):
    w = Window.partitionBy("user_id").orderBy("ts")
    return load(s, d, "events").select("user_id", F.row_number().over(w).alias("version"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("total")).where("version % 5 = 0")


@query("l12_idempotent", "SELECT idem_key, rec_id, quantity FROM (SELECT *, row_number() OVER (PARTITION BY idem_key ORDER BY ts, rec_id, quantity, component) AS n FROM fx_usage) WHERE n = 1")
def l12(s, d):
    return R.keep_first(load(s, d, "fx_usage"), ["idem_key"], [F.col(c) for c in ("ts", "rec_id", "quantity", "component")]).select("idem_key", "rec_id", "quantity")


@query("l16_tumbling", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def l16(s, d):
    return load(s, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(ntz(F.col("window.start")).alias("hour"), "event_type", "n", "total")


@query("l17_sliding", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1")
def l17(s, d):
    return load(s, d, "events").groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count("*").alias("n")).select(ntz(F.col("window.start")).alias("start"), "n")


@query("l18_sessions", "SELECT user_id, session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (SELECT *, CASE WHEN epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 86400e6 THEN 1 ELSE 0 END AS new FROM events)) GROUP BY 1, 2")
def l18(s, d):
    return R.sessions(load(s, d, "events"), ["user_id"], "ts", 86400).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("l20_latest_position", "SELECT tracker, arg_max(lon, ts) AS lon, arg_max(lat, ts) AS lat, max(ts) AS ts FROM fx_gps GROUP BY 1")
def l20(s, d):
    return load(s, d, "fx_gps").groupBy("tracker").agg(F.max_by("lon", "ts").alias("lon"), F.max_by("lat", "ts").alias("lat"), F.max("ts").alias("ts"))


@query("m1_rollup_rules", "SELECT name, date_trunc('day', ts) AS bucket, count(*) AS n, round(avg(value), 6) AS mean, list_sort(list(value))[(least(floor(count(*)*0.95)::INT, count(*)-1)+1)::INT] AS p95, round(median(value), 6) AS med FROM fx_metrics GROUP BY 1, 2")
def m1(s, d):
    g = load(s, d, "fx_metrics").groupBy("name", F.window("ts", "1 day"))
    return g.agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), R.nearest_index("value", 0.95).alias("p95"), r6(F.median("value")).alias("med")).select("name", ntz(F.col("window.start")).alias("bucket"), "n", "mean", "p95", "med")


@query("m4_counter_rate", "SELECT event_id, CASE WHEN before IS NULL THEN NULL WHEN value < before THEN value ELSE round(value-before, 6) END AS increase FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY name, host ORDER BY ts) AS before FROM fx_metrics)")
def m4(s, d):
    before = F.lag("value").over(Window.partitionBy("name", "host").orderBy("ts"))
    return load(s, d, "fx_metrics").select("event_id", F.when(before.isNull(), None).when(F.col("value") < before, F.col("value")).otherwise(r6(F.col("value") - before)).alias("increase"))


@query("m6_sla_violations", "SELECT name, count(*) AS runs, max(n) AS longest FROM (SELECT name, grp, count(*) AS n FROM (SELECT name, row_number() OVER (PARTITION BY name ORDER BY ts) - row_number() OVER (PARTITION BY name, value > 50 ORDER BY ts) AS grp, value > 50 AS b FROM fx_metrics) WHERE b GROUP BY 1, 2) WHERE n >= 3 GROUP BY 1")
def m6(s, d):
    runs = R.islands(load(s, d, "fx_metrics"), ["name"], ["ts"], F.col("value") > 50).groupBy("name", "island").agg(F.count("*").alias("n")).where("n >= 3")
    return runs.groupBy("name").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


@query("m10_baseline_threshold", "SELECT event_id, value > 1.5*base AS breach FROM (SELECT event_id, value, avg(value) OVER (PARTITION BY name ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS base FROM fx_metrics) WHERE base IS NOT NULL")
def m10(s, d):
    base = F.avg("value").over(Window.partitionBy("name").orderBy("ts").rowsBetween(-10, -1))
    return load(s, d, "fx_metrics").withColumn("base", base).where("base IS NOT NULL").select("event_id", (F.col("value") > 1.5 * F.col("base")).alias("breach"))


@query("m19_rate_limit", "SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts) <= 2 AS allowed FROM events")
def m19(s, d):
    return load(s, d, "events").select("event_id", (F.row_number().over(Window.partitionBy("user_id", F.date_trunc("day", "ts")).orderBy("ts")) <= 2).alias("allowed"))


@query("n1_quality_rules", """SELECT 'acctbal_range' AS rule, count(*) AS checked, count(*) FILTER (WHERE NOT c_acctbal BETWEEN 0 AND 9000) AS failed FROM customer UNION ALL SELECT 'segment_values', count(*), count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING','MACHINERY')) FROM customer
  UNION ALL SELECT 'name_format', count(*), count(*) FILTER (WHERE NOT regexp_matches(c_name, '^Customer')) FROM customer UNION ALL SELECT 'line_unique', count(*), count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem UNION ALL SELECT 'order_customer', count(*), count(*) FILTER (WHERE c_custkey IS NULL) FROM orders LEFT JOIN customer ON o_custkey=c_custkey""")
def n1(s, d):
    c, o, l = load(s, d, "customer"), load(s, d, "orders"), load(s, d, "lineitem")  # noqa: E741
    bad = lambda name, ok: (F.lit(name), F.count("*"), F.coalesce(F.sum((~ok).cast("long")), F.lit(0)))
    rules = [bad("acctbal_range", F.col("c_acctbal").between(0, 9000)), bad("segment_values", F.col("c_mktsegment").isin("BUILDING", "MACHINERY")), bad("name_format", F.col("c_name").rlike("^Customer"))]
    one = c.agg(F.array(*[F.struct(a.alias("rule"), b.alias("checked"), e.alias("failed")) for a, b, e in rules]).alias("x")).select(F.inline("x"))
    unique = l.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).agg(F.sum("n").alias("checked"), F.sum(F.col("n") - 1).alias("failed")).select(F.lit("line_unique").alias("rule"), "checked", "failed")
    key = o.join(c.select(F.col("c_custkey").alias("k")), F.col("o_custkey") == F.col("k"), "left").agg(F.count("*").alias("checked"), F.count_if(F.col("k").isNull()).alias("failed")).select(F.lit("order_customer").alias("rule"), "checked", "failed")
    return one.unionByName(unique).unionByName(key)


@query("n7_masking", "SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN c_name ELSE left(c_name, 2) || repeat('*', length(c_name)-4) || right(c_name, 2) END AS masked, sha256(c_name || 'salt') AS hashed, floor(c_acctbal/1000)*1000 AS band FROM customer")
def n7(s, d):
    n = F.length("c_name")
    partial = F.when(n <= 4, F.col("c_name")).otherwise(F.concat(F.left("c_name", F.lit(2)), F.expr("repeat('*', length(c_name) - 4)"), F.right("c_name", F.lit(2))))
    return load(s, d, "customer").select("c_custkey", partial.alias("masked"), F.sha2(F.concat("c_name", F.lit("salt")), 256).alias("hashed"), (F.floor(F.col("c_acctbal") / 1000) * 1000).cast("double").alias("band"))


@query("n14_detect_personal", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9]+[.][a-z]+')) AS emails, len(regexp_extract_all(text, '[0-9]{3}-[0-9]{2}-[0-9]{4}')) AS ssns FROM documents")
def n14(s, d):
    return load(s, d, "documents").select("doc_id", F.regexp_count("text", F.lit("[A-Za-z0-9._]+@[A-Za-z0-9]+[.][a-z]+")).cast("long").alias("emails"), F.regexp_count("text", F.lit("[0-9]{3}-[0-9]{2}-[0-9]{4}")).cast("long").alias("ssns"))


@query("n17_retention", "SELECT o_orderkey, CASE WHEN o_orderdate + INTERVAL 365 DAY < TIMESTAMP '1996-01-01' THEN 'expired' WHEN o_orderdate + INTERVAL 365 DAY < TIMESTAMP '1996-01-31' THEN 'near' ELSE 'kept' END AS state FROM orders")
def n17(s, d):
    end = F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS")
    return load(s, d, "orders").select("o_orderkey", F.when(end < F.expr("TIMESTAMP_NTZ '1996-01-01'"), "expired").when(end < F.expr("TIMESTAMP_NTZ '1996-01-31'"), "near").otherwise("kept").alias("state"))


@query("n23_lineage_closure", "WITH RECURSIVE w(root, node, depth) AS (SELECT 0, 0, 0 UNION ALL SELECT root, e.dst, depth+1 FROM w JOIN fx_lineage e ON e.src=w.node) SELECT node::BIGINT AS node, depth::BIGINT AS depth FROM w")
def n23(s, d):
    from ..operators.spatial import shortest_paths

    e = load(s, d, "fx_lineage").select("src", "dst", F.lit(1.0).alias("cost"))
    return shortest_paths(e, s.createDataFrame([(0,)], "origin int")).select(F.col("node").cast("long").alias("node"), F.col("cost").cast("long").alias("depth"))


@query("n32_duplicate_savings", "SELECT sha256(text) AS h, count(*) AS copies, sum(octet_length(encode(text))) - max(octet_length(encode(text))) AS saved FROM documents GROUP BY 1 HAVING count(*) > 1")
def n32(s, d):
    z = F.octet_length("text")
    return load(s, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.count("*").alias("copies"), (F.sum(z) - F.max(z)).alias("saved")).where("copies > 1")


@query("o5_usage_aggregation", "SELECT tenant, component, round(sum(quantity), 4) AS total, greatest(0, max(quantity)) AS most, arg_max(quantity, struct_pack(a := ts, b := rec_id, c := quantity)) AS last_value FROM fx_usage GROUP BY 1, 2")
def o5(s, d):
    return load(s, d, "fx_usage").groupBy("tenant", "component").agg(F.round(F.sum("quantity"), 4).alias("total"), F.greatest(F.lit(0.0), F.max("quantity")).alias("most"), F.max_by("quantity", F.struct("ts", "rec_id", "quantity")).alias("last_value"))


@query("o9_tiered_price", "SELECT tenant, round(sum(greatest(0, least(q, hi)-lo)*unit), 4) AS price FROM (SELECT tenant, sum(quantity) AS q FROM fx_usage GROUP BY 1), (VALUES (0, 100, 0.5), (100, 500, 0.3), (500, 1000000000, 0.1)) t(lo, hi, unit) GROUP BY 1")
def o9(s, d):
    q = load(s, d, "fx_usage").groupBy("tenant").agg(F.sum("quantity").alias("q"))
    tiers = [(0, 100, 0.5), (100, 500, 0.3), (500, 10**9, 0.1)]
    price = sum((F.greatest(F.lit(0.0), F.least(F.col("q"), F.lit(float(hi))) - lo) * unit for lo, hi, unit in tiers), F.lit(0.0))
    return q.select("tenant", F.round(price, 4).alias("price"))


PER_MONTH = "CASE billing_interval WHEN 'monthly' THEN 1 WHEN 'quarterly' THEN 3 ELSE 12 END"


@query("o17_mrr", f"SELECT plan_id, round(sum(amount*quantity/({PER_MONTH}))::DOUBLE, 4) AS mrr, count(*) AS subscribers FROM fx_subscriptions JOIN fx_plans USING (plan_id) WHERE status IN ('active','trial') GROUP BY 1")
def o17(s, d):
    j = load(s, d, "fx_subscriptions").where("status IN ('active', 'trial')").join(load(s, d, "fx_plans"), "plan_id")
    return j.groupBy("plan_id").agg(F.round(F.sum(F.expr(f"CAST(amount*quantity/({PER_MONTH}) AS DOUBLE)")), 4).alias("mrr"), F.count("*").alias("subscribers"))


@query("o20_cohorts", "SELECT cohort, age, count(DISTINCT o_custkey) AS active FROM (SELECT o_custkey, strftime(f, '%Y-%m') AS cohort, ((year(o_orderdate)-year(f))*12+month(o_orderdate)-month(f))::BIGINT AS age FROM orders JOIN (SELECT o_custkey, min(o_orderdate) AS f FROM orders GROUP BY 1) USING (o_custkey)) WHERE age BETWEEN 0 AND 12 GROUP BY 1, 2")
def o20(s, d):
    o = load(s, d, "orders").select("o_custkey", "o_orderdate")
    j = o.join(o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("f")), "o_custkey")
    age = (F.year("o_orderdate") - F.year("f")) * 12 + F.month("o_orderdate") - F.month("f")
    return j.select("o_custkey", F.date_format("f", "yyyy-MM").alias("cohort"), age.cast("long").alias("age")).where("age BETWEEN 0 AND 12").groupBy("cohort", "age").agg(F.count_distinct("o_custkey").alias("active"))


@query("p2_audit_statistics", "SELECT action, count(*) AS n, count(DISTINCT actor) AS actors, count(DISTINCT resource) AS resources, round(avg((result='Success')::INT), 6) AS success FROM fx_audit GROUP BY 1")
def p2(s, d):
    return load(s, d, "fx_audit").groupBy("action").agg(F.count("*").alias("n"), F.count_distinct("actor").alias("actors"), F.count_distinct("resource").alias("resources"), r6(F.avg((F.col("result") == "Success").cast("int"))).alias("success"))


@query("p4_hash_chain", "SELECT id, sha256(coalesce(lag(id) OVER (PARTITION BY resource ORDER BY id), -1)::VARCHAR || action) AS h FROM fx_audit")
def p4(s, d):
    before = F.coalesce(F.lag("id").over(Window.partitionBy("resource").orderBy("id")), F.lit(-1))
    return load(s, d, "fx_audit").select("id", F.sha2(F.concat(before.cast("string"), "action"), 256).alias("h"))


@query("p5_brute_force", "SELECT actor, date_trunc('day', ts) AS day, count(*) AS failures FROM fx_audit WHERE result='Failure' GROUP BY 1, 2 HAVING count(*) >= 2")
def p5(s, d):
    return load(s, d, "fx_audit").where("result = 'Failure'").groupBy("actor", ntz(F.date_trunc("day", "ts")).alias("day")).agg(F.count("*").alias("failures")).where("failures >= 2")


@query("r1_lww_merge", "SELECT k, value FROM (SELECT k, arg_max(value, struct_pack(a := ts, b := replica)) AS value, arg_max(op, struct_pack(a := ts, b := replica)) AS op FROM fx_replica_log GROUP BY 1) WHERE op <> 'remove'")
def r1(s, d):
    at = F.struct("ts", "replica")
    return load(s, d, "fx_replica_log").groupBy("k").agg(F.max_by("value", at).alias("value"), F.max_by("op", at).alias("op")).where("op <> 'remove'").select("k", "value")


@query("r3_counters", "SELECT k, round(sum(m), 4) AS value FROM (SELECT k, replica, max(value) AS m FROM fx_replica_log GROUP BY 1, 2) GROUP BY 1")
def r3(s, d):
    return load(s, d, "fx_replica_log").groupBy("k", "replica").agg(F.max("value").alias("m")).groupBy("k").agg(F.round(F.sum("m"), 4).alias("value"))


@query("r7_snapshot_diff", "SELECT k, CASE WHEN a.v IS NULL THEN 'Added' WHEN b.v IS NULL THEN 'Deleted' ELSE 'Modified' END AS change FROM fx_snap_a a FULL JOIN fx_snap_b b USING (k) WHERE a.v IS DISTINCT FROM b.v OR a.s IS DISTINCT FROM b.s")
def r7(s, d):
    return R.diff(load(s, d, "fx_snap_a"), load(s, d, "fx_snap_b"), "k")


@query("r10_retention_gfs", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts DESC) AS a FROM events) WHERE a = 1")
def r10(s, d):
    return R.keep_first(load(s, d, "events").withColumn("day", F.date_trunc("day", "ts")), ["day"], [F.desc("ts")]).select("event_id")
