"""Registered queries: the event store, sagas, notifications, metrics and alerts (families L and M, the rest)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import load
from ..functions import geo
from ..operators import events as E
from ..operators import relational as R
from ..registry import query

r4, r6 = (lambda c: F.round(c, 4)), (lambda c: F.round(c, 6))
ntz = lambda c: c.cast("timestamp_ntz")
AT = "TIMESTAMP_NTZ '2024-01-20 00:00:00'"
DAY = 86400


@query("l1_append_expected", """SELECT s.stream, s.expected, coalesce(v.n, 0) AS version, CASE WHEN s.expected=-2 OR (s.expected=-1 AND v.n IS NULL) OR (s.expected=-3 AND v.n>0) OR (s.expected>=0 AND s.expected=coalesce(v.n,0)) THEN 'accepted' ELSE 'conflict' END AS outcome
  FROM (SELECT c_custkey AS stream, c_custkey%9-3 AS expected FROM customer) s LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) v ON v.user_id=s.stream""")
def l1(s, d):
    batch = load(s, d, "customer").select(F.col("c_custkey").alias("stream"), (F.col("c_custkey") % 9 - 3).alias("expected"))
    return E.append_check(load(s, d, "events").withColumnRenamed("user_id", "stream"), batch, "stream", "expected")


@query("l3_replay_range", "SELECT user_id, version, event_type FROM (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS version FROM events) WHERE version BETWEEN 3 AND 8 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def l3(s, d):
    e = load(s, d, "events").withColumn("version", F.row_number().over(Window.partitionBy("user_id").orderBy("ts")))
    return e.where(F.col("version").between(3, 8) & F.col("ts").between(F.expr("TIMESTAMP_NTZ '2024-01-05'"), F.expr(AT))).select("user_id", "version", "event_type")


@query("l6_projection", "SELECT k, value FROM (SELECT k, arg_max(value, seq) AS value, arg_max(op, seq) AS op FROM fx_replica_log GROUP BY 1) WHERE op='set'")
def l6(s, d):
    return load(s, d, "fx_replica_log").groupBy("k").agg(F.max_by("value", "seq").alias("value"), F.max_by("op", "seq").alias("op")).where("op = 'set'").select("k", "value")


@query("l8_keep_snapshots", "SELECT user_id, version FROM (SELECT user_id, version, row_number() OVER (PARTITION BY user_id ORDER BY version DESC) AS n FROM (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS version FROM events) WHERE version%5=0 AND ts >= TIMESTAMP '2024-01-10') WHERE n <= 2")
def l8_keep(s, d):
    e = load(s, d, "events").withColumn("version", F.row_number().over(Window.partitionBy("user_id").orderBy("ts"))).where("version % 5 = 0 AND ts >= TIMESTAMP_NTZ '2024-01-10'")
    return R.top_n(e, ["user_id"], [F.desc("version")], 2, "n").select("user_id", "version")


@query("l9_state_at", "SELECT user_id, arg_max(value, ts) AS value, arg_max(event_type, ts) AS event_type, count(*) AS version FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1")
def l9(s, d):
    return E.as_of(load(s, d, "events"), "user_id", "ts", F.expr(AT), ["value", "event_type"])


@query("l10_archive", "SELECT user_id, count(*) FILTER (WHERE old) AS archived, count(*) FILTER (WHERE NOT old) AS kept, round(count(*) FILTER (WHERE old)/count(*), 6) AS ratio FROM (SELECT user_id, ts < TIMESTAMP '2024-01-10' AND row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) > 3 AS old FROM events) GROUP BY 1")
def l10(s, d):
    old = (F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-10'")) & (F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"))) > 3)
    return load(s, d, "events").select("user_id", old.alias("old")).groupBy("user_id").agg(F.count_if("old").alias("archived"), F.count_if(~F.col("old")).alias("kept"), r6(F.count_if("old") / F.count("*")).alias("ratio"))


@query("l11_upgrade_events", "SELECT event_id, CASE WHEN event_id%3=0 THEN 'v1:'||event_type ELSE event_type END AS name, CASE WHEN event_id%3=2 THEN value ELSE value*100 END AS amount_cents, 3 AS schema_version FROM events")
def l11(s, d):
    # version 1 had no prefix split and a decimal amount, version 2 only the decimal amount
    e = load(s, d, "events").withColumn("schema_version", (F.col("event_id") % 3 + 1).cast("int"))
    two = e.withColumn("name", F.when(F.col("schema_version") == 1, F.concat(F.lit("v1:"), "event_type")).otherwise(F.col("event_type"))).withColumn("schema_version", F.greatest(F.col("schema_version"), F.lit(2)))
    cents = F.when(F.col("event_id") % 3 == 2, F.col("value")).otherwise(F.col("value") * 100)
    return two.select("event_id", "name", cents.alias("amount_cents"), F.lit(3).alias("schema_version"))


@query("l13_causation", "WITH RECURSIVE w(id, root, depth) AS (SELECT event_id, event_id, 0 FROM events WHERE event_id < 10 UNION ALL SELECT e.event_id, w.root, depth+1 FROM w JOIN events e ON e.event_id//10=w.id AND e.event_id>=10) SELECT id, root, depth FROM w")
def l13(s, d):
    # the cause of event n is event n div 10; each round joins the last level only
    from ..operators.graph import tree_levels

    e = load(s, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") >= 10, F.expr("event_id div 10")).alias("parent"))
    return tree_levels(e, "id", "parent")


@query("l14_saga_state", """SELECT user_id, steps, CASE WHEN failed > 0 AND undone >= done THEN 'Compensated' WHEN failed > 0 THEN 'Compensating' WHEN done >= 3 THEN 'Completed' WHEN age > 5 THEN 'TimedOut' ELSE 'Running' END AS state FROM
  (SELECT user_id, count(*) AS steps, count(*) FILTER (WHERE event_type='error') AS failed, count(*) FILTER (WHERE event_type='view') AS undone, count(*) FILTER (WHERE event_type='purchase') AS done, date_diff('day', max(ts), TIMESTAMP '2024-01-30') AS age FROM events GROUP BY 1)""")
def l14(s, d):
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    g = load(s, d, "events").groupBy("user_id").agg(F.count("*").alias("steps"), n("error").alias("failed"), n("view").alias("undone"), n("purchase").alias("done"), F.date_diff(F.lit("2024-01-30").cast("date"), F.max("ts").cast("date")).alias("age"))
    state = F.when((F.col("failed") > 0) & (F.col("undone") >= F.col("done")), "Compensated").when(F.col("failed") > 0, "Compensating").when(F.col("done") >= 3, "Completed").when(F.col("age") > 5, "TimedOut").otherwise("Running")
    return g.select("user_id", "steps", state.alias("state"))


@query("l15_compensation_order", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS undo FROM events e WHERE event_type <> 'error' AND ts < (SELECT min(ts) FROM events f WHERE f.user_id=e.user_id AND f.event_type='error')")
def l15(s, d):
    e = load(s, d, "events")
    fail = F.min(F.when(F.col("event_type") == "error", F.col("ts"))).over(Window.partitionBy("user_id"))
    done = e.withColumn("fail", fail).where("event_type <> 'error' AND ts < fail")
    return done.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"))).alias("undo"))


@query("l17_sliding_per_key", "SELECT event_id, (SELECT count(*) FROM events f WHERE f.user_id=e.user_id AND f.ts <= e.ts AND f.ts >= e.ts - INTERVAL 3 DAY) AS n FROM events e")
def l17(s, d):
    e = load(s, d, "events").withColumn("t", E.micros("ts"))
    return e.select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("t").rangeBetween(-3 * DAY * 10**6, 0)).alias("n"))


@query("l20_fresh_positions", "SELECT tracker, lon, lat FROM (SELECT tracker, arg_max(lon, ts) AS lon, arg_max(lat, ts) AS lat, max(ts) AS ts FROM fx_gps GROUP BY 1) WHERE ts >= TIMESTAMP '2024-01-20' AND lon BETWEEN -90 AND 90 AND lat BETWEEN -45 AND 45")
def l20(s, d):
    g = load(s, d, "fx_gps").groupBy("tracker").agg(F.max_by("lon", "ts").alias("lon"), F.max_by("lat", "ts").alias("lat"), F.max("ts").alias("ts"))
    return g.where(F.col("ts") >= F.expr(AT)).where("lon BETWEEN -90 AND 90 AND lat BETWEEN -45 AND 45").select("tracker", "lon", "lat")


@query("l21_track", """SELECT tracker, event_id, round(2*6371000*atan2(sqrt(a), sqrt(1-a)), 1) AS metres, round(2*6371000*atan2(sqrt(a), sqrt(1-a))/secs, 3) AS mps FROM (SELECT *, pow(sin(radians(lat-la)/2),2)+cos(radians(la))*cos(radians(lat))*pow(sin(radians(lon-lo)/2),2) AS a FROM
  (SELECT tracker, event_id, lon, lat, lag(lon) OVER w AS lo, lag(lat) OVER w AS la, (epoch_us(ts)-epoch_us(lag(ts) OVER w))/1e6 AS secs FROM fx_gps WINDOW w AS (PARTITION BY tracker ORDER BY ts)) WHERE lo IS NOT NULL)""")
def l21(s, d):
    w = Window.partitionBy("tracker").orderBy("ts")
    g = load(s, d, "fx_gps").select("tracker", "event_id", "lon", "lat", F.lag("lon").over(w).alias("lo"), F.lag("lat").over(w).alias("la"), ((E.micros("ts") - F.lag(E.micros("ts")).over(w)) / 1e6).alias("secs")).where("lo IS NOT NULL")
    m = geo.haversine(F.col("lo"), F.col("la"), F.col("lon"), F.col("lat"))
    return g.select("tracker", "event_id", F.round(m, 1).alias("metres"), F.round(m / F.col("secs"), 3).alias("mps"))


@query("l22_sensors", "SELECT kind, count(*) AS sensors, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-20') AS fresh, round(avg(value), 6) AS mean FROM (SELECT user_id, event_type AS kind, arg_max(value, ts) AS value, max(ts) AS ts FROM events GROUP BY 1, 2) GROUP BY 1")
def l22(s, d):
    last = load(s, d, "events").groupBy("user_id", F.col("event_type").alias("kind")).agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))
    return last.groupBy("kind").agg(F.count("*").alias("sensors"), F.count_if(F.col("ts") >= F.expr(AT)).alias("fresh"), r6(F.avg("value")).alias("mean"))


@query("l23_event_queries", "SELECT event_id, severity FROM (SELECT *, CASE WHEN value > 90 THEN 'critical' WHEN value > 60 THEN 'warning' ELSE 'info' END AS severity, [event_type, 'user'||user_id%10] AS tags FROM events) WHERE severity IN ('critical','warning') AND list_contains(tags, 'user3') AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28'")
def l23(s, d):
    v = F.col("value")
    e = load(s, d, "events").withColumn("severity", F.when(v > 90, "critical").when(v > 60, "warning").otherwise("info")).withColumn("tags", F.array("event_type", F.concat(F.lit("user"), (F.col("user_id") % 10).cast("string"))))
    return e.where(F.col("severity").isin("critical", "warning") & F.array_contains("tags", "user3") & F.col("ts").between(F.expr("TIMESTAMP_NTZ '2024-01-03'"), F.expr("TIMESTAMP_NTZ '2024-01-28'"))).select("event_id", "severity")


@query("l24_viewers", "SELECT g.event_id, b.id AS viewer FROM fx_gps g JOIN fx_rects b ON g.lon BETWEEN b.minx AND b.maxx AND g.lat BETWEEN b.miny AND b.maxy")
def l24(s, d):
    from ..operators.spatial import points_in_boxes

    return points_in_boxes(load(s, d, "fx_gps").select("event_id", "lon", "lat"), load(s, d, "fx_rects").select(F.col("id").alias("viewer"), "minx", "miny", "maxx", "maxy"), 6.0).select("event_id", "viewer")


@query("l25_fan_out", "SELECT event_type AS channel, subscribers, count(*) AS messages, count(*)*subscribers AS deliveries FROM events JOIN (SELECT event_type AS channel, count(DISTINCT user_id) AS subscribers FROM events GROUP BY 1) s ON s.channel=event_type GROUP BY 1, 2")
def l25(s, d):
    g = load(s, d, "events").groupBy(F.col("event_type").alias("channel")).agg(F.count_distinct("user_id").alias("subscribers"), F.count("*").alias("messages"))
    return g.withColumn("deliveries", F.col("messages") * F.col("subscribers"))


@query("l26_presence", "SELECT user_id, CASE WHEN age <= 86400 THEN 'active' WHEN age <= 5*86400 THEN 'idle' ELSE 'away' END AS status FROM (SELECT user_id, (epoch_us(TIMESTAMP '2024-01-31')-epoch_us(max(ts)))/1e6 AS age FROM events GROUP BY 1)")
def l26(s, d):
    age = (F.lit(1706659200 * 10**6) - E.micros(F.max("ts"))) / 1e6
    return load(s, d, "events").groupBy("user_id").agg(age.alias("age")).select("user_id", F.when(F.col("age") <= DAY, "active").when(F.col("age") <= 5 * DAY, "idle").otherwise("away").alias("status"))


@query("l27_fingerprints", "SELECT print, series, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(new) OVER (PARTITION BY print ORDER BY ts) AS series FROM (SELECT print, ts, CASE WHEN epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY print ORDER BY ts)) > 3600e6 THEN 1 ELSE 0 END AS new FROM (SELECT sha256(event_type || '|' || (user_id%10)) AS print, ts FROM events))) GROUP BY 1, 2")
def l27(s, d):
    e = load(s, d, "events").select(F.sha2(F.concat_ws("|", "event_type", (F.col("user_id") % 10).cast("string")), 256).alias("print"), "ts")
    return E.by_gap(e, ["print"], "ts", 3600).groupBy("print", "series").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("l28_batches", "SELECT user_id, batch, count(*) AS n, min(event_id) AS first_id FROM (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts)-1)//4 AS batch FROM events) GROUP BY 1, 2")
def l28(s, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts"))
    return load(s, d, "events").select("user_id", "event_id", F.floor((n - 1) / 4).alias("batch")).groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("l29_quiet_hours", "SELECT event_id, event_type <> 'error' AND dayofweek(ts) IN (1,2,3,4,5) AND (strftime(ts, '%H:%M') >= '22:00' OR strftime(ts, '%H:%M') <= '06:00') AS suppressed FROM events")
def l29(s, d):
    at = F.date_format("ts", "HH:mm")
    return load(s, d, "events").select("event_id", ((F.col("event_type") != "error") & F.dayofweek("ts").between(2, 6) & ((at >= "22:00") | (at <= "06:00"))).alias("suppressed"))


@query("l30_delivery", "SELECT date_trunc('day', ts) AS day, count(*) AS sent, count(*) FILTER (WHERE event_type<>'error') AS delivered, count(*) FILTER (WHERE event_type IN ('click','purchase')) AS opened, round(count(*) FILTER (WHERE event_type<>'error')/count(*), 6) AS rate FROM events GROUP BY 1")
def l30(s, d):
    ok, opened = F.count_if(F.col("event_type") != "error"), F.count_if(F.col("event_type").isin("click", "purchase"))
    return load(s, d, "events").groupBy(ntz(F.date_trunc("day", "ts")).alias("day")).agg(F.count("*").alias("sent"), ok.alias("delivered"), opened.alias("opened"), r6(ok / F.count("*")).alias("rate"))


@query("l31_dead_letters", "SELECT event_type AS reason, count(*) AS n, count(*) FILTER (WHERE value < 50) AS unprocessed, count(*) FILTER (WHERE user_id%2=0) AS retryable, min(ts) AS oldest FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY 1")
def l31(s, d):
    e = load(s, d, "events").where("ts >= TIMESTAMP_NTZ '2024-01-05'")
    return e.groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n"), F.count_if(F.col("value") < 50).alias("unprocessed"), F.count_if(F.col("user_id") % 2 == 0).alias("retryable"), F.min("ts").alias("oldest"))


@query("l32_run_progress", "SELECT user_id, round(100*count(*) FILTER (WHERE event_type<>'error')/count(*), 4) AS pct, CASE WHEN slope > 0.5 THEN 'degrading' WHEN slope < -0.5 THEN 'improving' ELSE 'stable' END AS trend FROM (SELECT *, regr_slope(value, n) OVER (PARTITION BY user_id) AS slope FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts)::DOUBLE AS n FROM events)) GROUP BY user_id, slope")
def l32(s, d):
    e = load(s, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts")).cast("double"))
    g = e.groupBy("user_id").agg(r4(100 * F.count_if(F.col("event_type") != "error") / F.count("*")).alias("pct"), F.regr_slope("value", "n").alias("slope"))
    return g.select("user_id", "pct", F.when(F.col("slope") > 0.5, "degrading").when(F.col("slope") < -0.5, "improving").otherwise("stable").alias("trend"))


@query("l33_dag_levels", "WITH RECURSIVE w(node, level) AS (SELECT s_suppkey, 0 FROM supplier WHERE s_suppkey NOT IN (SELECT dst FROM fx_tree) UNION ALL SELECT e.dst, level+1 FROM w JOIN fx_tree e ON e.src=w.node) SELECT node, max(level) AS level, max(node) NOT IN (SELECT src FROM fx_tree) AS leaf FROM w GROUP BY 1")
def l33(s, d):
    from ..operators.graph import dag_levels

    return dag_levels(load(s, d, "supplier").select(F.col("s_suppkey").alias("node")), load(s, d, "fx_tree"))


RULES = [("calls_hour", "click*", "1 hour", "Count"), ("view_day", "view", "1 day", "Sum"), ("all_day_max", "*", "1 day", "Max"), ("all_day_last", "*", "1 day", "Last"), ("p_week", "p*", "1 day", "Median")]


@query("m1_rule_table", """SELECT 'calls_hour' AS rule, name, date_trunc('hour', ts) AS bucket, count(*)::DOUBLE AS value FROM fx_metrics WHERE name LIKE 'click%' GROUP BY ALL UNION ALL SELECT 'view_day', name, date_trunc('day', ts), round(sum(value), 6) FROM fx_metrics WHERE name='view' GROUP BY ALL
  UNION ALL SELECT 'all_day_max', name, date_trunc('day', ts), max(value) FROM fx_metrics GROUP BY ALL UNION ALL SELECT 'all_day_last', name, date_trunc('day', ts), arg_max(value, ts) FROM fx_metrics GROUP BY ALL UNION ALL SELECT 'p_week', name, date_trunc('day', ts), round(median(value), 6) FROM fx_metrics WHERE name LIKE 'p%' GROUP BY ALL""")
def m1_rules(s, d):
    return E.rolled_up(load(s, d, "fx_metrics"), RULES).withColumn("value", r6("value"))


@query("m2_default_rollups", "SELECT 'avg_1m' AS rule, name, date_trunc('minute', ts) AS bucket, round(avg(value), 6) AS value FROM fx_metrics GROUP BY ALL UNION ALL SELECT 'avg_5m', name, time_bucket(INTERVAL 5 MINUTE, ts), round(avg(value), 6) FROM fx_metrics GROUP BY ALL UNION ALL SELECT 'max_1h', name, date_trunc('hour', ts), max(value) FROM fx_metrics GROUP BY ALL UNION ALL SELECT 'p95_1d', name, date_trunc('day', ts), round(quantile_cont(value, 0.95), 6) FROM fx_metrics GROUP BY ALL")
def m2(s, d):
    return E.rolled_up(load(s, d, "fx_metrics"), [("avg_1m", "*", "1 minute", "Avg"), ("avg_5m", "*", "5 minutes", "Avg"), ("max_1h", "*", "1 hour", "Max"), ("p95_1d", "*", "1 day", "P95")]).withColumn("value", r6("value"))


@query("m3_metric_values", "SELECT name, CASE name WHEN 'click' THEN 'counter' WHEN 'view' THEN 'gauge' WHEN 'purchase' THEN 'histogram' ELSE 'summary' END AS kind, round(CASE name WHEN 'click' THEN sum(value) WHEN 'view' THEN arg_max(value, ts) ELSE avg(value) END, 4) AS value FROM fx_metrics GROUP BY 1")
def m3(s, d):
    kind = F.when(F.col("name") == "click", "counter").when(F.col("name") == "view", "gauge").when(F.col("name") == "purchase", "histogram").otherwise("summary")
    g = load(s, d, "fx_metrics").groupBy("name").agg(F.sum("value").alias("t"), F.max_by("value", "ts").alias("l"), F.avg("value").alias("a")).withColumn("kind", kind)
    return g.select("name", "kind", r4(F.when(F.col("kind") == "counter", F.col("t")).when(F.col("kind") == "gauge", F.col("l")).otherwise(F.col("a"))).alias("value"))


@query("m4_rate_per_second", "SELECT event_id, round(CASE WHEN value < b THEN value ELSE value-b END / secs, 9) AS rate FROM (SELECT event_id, value, lag(value) OVER w AS b, (epoch_us(ts)-epoch_us(lag(ts) OVER w))/1e6 AS secs FROM fx_metrics WINDOW w AS (PARTITION BY name, host, date_trunc('day', ts) ORDER BY ts)) WHERE b IS NOT NULL")
def m4(s, d):
    """Events of one time are taken in the order of their ids. A rise in no time is an infinite rate, and no rise in no time is not a number, as in the SQL."""
    w = Window.partitionBy("name", "host", F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    m = load(s, d, "fx_metrics").select("event_id", "value", F.lag("value").over(w).alias("b"), ((E.micros("ts") - F.lag(E.micros("ts")).over(w)) / 1e6).alias("secs")).where("b IS NOT NULL")
    rise = F.when(F.col("value") < F.col("b"), F.col("value")).otherwise(F.col("value") - F.col("b"))
    return m.select("event_id", F.round(F.when(F.col("secs") == 0, F.signum(rise) * float("inf")).otherwise(F.try_divide(rise, F.col("secs"))), 9).alias("rate"))


@query("m5_retention", "SELECT event_id FROM fx_metrics WHERE ts >= TIMESTAMP '2024-01-30' - CASE name WHEN 'click' THEN INTERVAL 7 DAY WHEN 'view' THEN INTERVAL 14 DAY ELSE INTERVAL 21 DAY END")
def m5(s, d):
    days = F.when(F.col("name") == "click", 7).when(F.col("name") == "view", 14).otherwise(21)
    return load(s, d, "fx_metrics").where(E.micros("ts") >= F.lit(1706572800 * 10**6) - days.cast("long") * DAY * 10**6).select("event_id")


@query("m6_alerts", "SELECT event_id FROM (SELECT event_id, value > 50 AS b, row_number() OVER (PARTITION BY name, host, value > 50, grp ORDER BY ts) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY name, host ORDER BY ts) - row_number() OVER (PARTITION BY name, host, value > 50 ORDER BY ts) AS grp FROM fx_metrics)) WHERE b AND nth >= 3")
def m6(s, d):
    hits = R.islands(load(s, d, "fx_metrics"), ["name", "host"], ["ts"], F.col("value") > 50)
    return hits.withColumn("nth", F.row_number().over(Window.partitionBy("name", "host", "island").orderBy("ts"))).where("nth >= 3").select("event_id")


@query("m7_alert_states", "SELECT severity, count(*) FILTER (WHERE state IN ('click','view')) AS active, count(*) FILTER (WHERE state='signup') AS acknowledged, count(*) FILTER (WHERE state IN ('purchase','error')) AS resolved FROM (SELECT user_id, arg_max(event_type, ts) AS state, CASE WHEN max(value) > 95 THEN 'critical' ELSE 'warning' END AS severity FROM events GROUP BY 1) GROUP BY 1")
def m7(s, d):
    a = load(s, d, "events").groupBy("user_id").agg(F.max_by("event_type", "ts").alias("state"), F.when(F.max("value") > 95, "critical").otherwise("warning").alias("severity"))
    n = lambda *k: F.count_if(F.col("state").isin(*k))
    return a.groupBy("severity").agg(n("click", "view").alias("active"), n("signup").alias("acknowledged"), n("purchase", "error").alias("resolved"))


@query("m8_health", "SELECT host, ['healthy','degraded','unhealthy'][max(CASE WHEN value > 98 THEN 3 WHEN value > 90 THEN 2 ELSE 1 END)] AS status FROM (SELECT event_type, user_id%50 AS host, arg_max(value, ts) AS value FROM events GROUP BY 1, 2) GROUP BY 1")
def m8(s, d):
    last = load(s, d, "events").groupBy(F.col("event_type").alias("name"), (F.col("user_id") % 50).alias("host")).agg(F.max_by("value", "ts").alias("value"))
    rank = F.max(F.when(F.col("value") > 98, 3).when(F.col("value") > 90, 2).otherwise(1))
    return last.groupBy("host").agg(F.element_at(F.array(*map(F.lit, ("healthy", "degraded", "unhealthy"))), rank).alias("status"))


@query("m9_alert_rules", "SELECT event_id, 'hot_purchase' AS rule FROM events WHERE event_type='purchase' AND value > 80 UNION ALL SELECT event_id, 'odd' FROM events WHERE event_type='error' OR value < 5 OR (user_id%7=0 AND value BETWEEN 40 AND 45)")
def m9(s, d):
    rules = {
        "hot_purchase": {"and": [{"field": "event_type", "op": "eq", "value": "purchase"}, {"field": "value", "op": "gt", "value": 80}]},
        "odd": {"or": [{"field": "event_type", "op": "eq", "value": "error"}, {"field": "value", "op": "lt", "value": 5}, {"and": [{"field": "sevens", "op": "eq", "value": 0}, {"field": "value", "op": "between", "value": (40, 45)}]}]},
    }
    e = load(s, d, "events").withColumn("sevens", F.col("user_id") % 7)
    return e.select("event_id", F.explode(F.array_compact(F.array(*[F.when(R.condition(t), F.lit(n)) for n, t in rules.items()]))).alias("rule"))


@query("m10_thresholds", "SELECT event_id, value > 95 AS static, value > 1.5*base AS dynamic, round(100*value/base, 4) AS pct FROM (SELECT event_id, value, avg(value) OVER (PARTITION BY name, host, date_trunc('day', ts) ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS base FROM fx_metrics) WHERE base > 0")
def m10(s, d):
    w = Window.partitionBy("name", "host", F.date_trunc("day", "ts")).orderBy("ts").rowsBetween(-10, -1)
    v, b = F.col("value"), F.col("base")
    return load(s, d, "fx_metrics").withColumn("base", F.avg("value").over(w)).where("base > 0").select("event_id", (v > 95).alias("static"), (v > 1.5 * b).alias("dynamic"), r4(100 * v / b).alias("pct"))


@query("m11_breaches", "SELECT name, host, begin_ts, end_ts, n FROM (SELECT name, host, min(ts) AS begin_ts, max(nxt) AS end_ts, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY name, host ORDER BY ts) - row_number() OVER (PARTITION BY name, host, value > 70 ORDER BY ts) AS g, lead(ts) OVER (PARTITION BY name, host ORDER BY ts) AS nxt FROM fx_metrics) WHERE value > 70 GROUP BY name, host, g)")
def m11(s, d):
    return E.runs(load(s, d, "fx_metrics"), ["name", "host"], "ts", F.col("value") > 70).select("name", "host", F.col("begin").alias("begin_ts"), F.col("end").alias("end_ts"), "n")


@query("m12_alert_dedup", "SELECT user_id, event_type, series, count(*) AS occurrences FROM (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS series FROM (SELECT user_id, event_type, ts, CASE WHEN epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts)) > 172800e6 THEN 1 ELSE 0 END AS new FROM events)) GROUP BY 1, 2, 3")
def m12(s, d):
    return E.by_gap(load(s, d, "events"), ["user_id", "event_type"], "ts", 2 * DAY).groupBy("user_id", "event_type", "series").agg(F.count("*").alias("occurrences"))


@query("m13_auto_resolve", "SELECT user_id, max(ts) + INTERVAL 2 DAY AS resolved_at FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 2 DAY <= TIMESTAMP '2024-01-30'")
def m13(s, d):
    return load(s, d, "events").groupBy("user_id").agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("resolved_at")).where("resolved_at <= TIMESTAMP_NTZ '2024-01-30'")


@query("m14_escalation", "SELECT user_id, count(l.lo) AS level FROM (SELECT user_id, (epoch_us(TIMESTAMP '2024-01-31')-epoch_us(max(ts)))/60e6 AS mins FROM events GROUP BY 1) LEFT JOIN (VALUES (30), (720), (1440), (4320)) l(lo) ON mins >= lo GROUP BY 1")
def m14(s, d):
    mins = (F.lit(1706659200 * 10**6) - E.micros(F.max("ts"))) / 60e6
    a = load(s, d, "events").groupBy("user_id").agg(mins.alias("mins"))
    return a.select("user_id", sum(((F.col("mins") >= lo).cast("long") for lo in (30, 720, 1440, 4320)), F.lit(0)).cast("long").alias("level"))


@query("m15_on_call", "SELECT event_id, CASE WHEN event_type='error' AND dayofmonth(ts)=15 THEN 'override' ELSE ['ann','bob','cid'][(date_diff('day', TIMESTAMP '2024-01-01', ts)//7)%3+1] END AS who FROM events")
def m15(s, d):
    week = F.floor(F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7) % 3
    who = F.element_at(F.array(*map(F.lit, ("ann", "bob", "cid"))), (week + 1).cast("int"))
    return load(s, d, "events").select("event_id", F.when((F.col("event_type") == "error") & (F.dayofmonth("ts") == 15), "override").otherwise(who).alias("who"))


@query("m16_incidents", "SELECT count(*) AS incidents, round(avg(ack), 4) AS mtta_s, round(avg(res), 4) AS mttr_s FROM (SELECT user_id, (min(epoch_us(ts)) FILTER (WHERE event_type='view')-min(epoch_us(ts)))/1e6 AS ack, (max(epoch_us(ts))-min(epoch_us(ts)))/1e6 AS res FROM events GROUP BY 1)")
def m16(s, d):
    t = E.micros("ts")
    g = load(s, d, "events").groupBy("user_id").agg(((F.min(F.when(F.col("event_type") == "view", t)) - F.min(t)) / 1e6).alias("ack"), ((F.max(t) - F.min(t)) / 1e6).alias("res"))
    return g.agg(F.count("*").alias("incidents"), r4(F.avg("ack")).alias("mtta_s"), r4(F.avg("res")).alias("mttr_s"))


@query("m17_request_metrics", "SELECT event_type AS route, user_id%20 AS consumer, count(*) AS n, count(*) FILTER (WHERE value > 90) AS errors, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1, 2")
def m17(s, d):
    g = load(s, d, "events").groupBy(F.col("event_type").alias("route"), (F.col("user_id") % 20).alias("consumer"))
    return g.agg(F.count("*").alias("n"), F.count_if(F.col("value") > 90).alias("errors"), r6(F.avg("value")).alias("mean"), *[r6(F.percentile("value", p)).alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)])


@query("m18_log_search", "SELECT conv_id, turn FROM conversations WHERE role='user' AND text ILIKE '%the%' AND turn <= 4")
def m18(s, d):
    return load(s, d, "conversations").where((F.col("role") == "user") & F.col("text").ilike("%the%") & (F.col("turn") <= 4)).select("conv_id", "turn")


@query("m19_sliding_limit", "SELECT event_id, (SELECT count(*) FROM events f WHERE f.user_id=e.user_id AND f.ts <= e.ts AND f.ts > e.ts - INTERVAL 2 DAY) <= 2 AS allowed FROM events e")
def m19(s, d):
    e = load(s, d, "events").withColumn("t", E.micros("ts"))
    return e.select("event_id", (F.count("*").over(Window.partitionBy("user_id").orderBy("t").rangeBetween(-2 * DAY * 10**6 + 1, 0)) <= 2).alias("allowed"))


@query("m20_token_bucket", """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  b(user_id, n, event_id, t, allowed, rest) AS (SELECT user_id, n, event_id, t, true, 1.0::DOUBLE FROM e WHERE n = 1
    UNION ALL SELECT user_id, n, event_id, t, lvl >= 1, CASE WHEN lvl >= 1 THEN lvl-1 ELSE lvl END FROM (SELECT e.*, least(2.0::DOUBLE, b.rest+(e.t-b.t)/1e6::DOUBLE*(1.0::DOUBLE/14400)) AS lvl FROM b JOIN e ON e.user_id=b.user_id AND e.n=b.n+1))
  SELECT event_id AS id, allowed FROM b""")
def m20(s, d):
    return E.token_bucket(load(s, d, "events"), "user_id", "ts", 2, 1 / 14400)


@query("m21_cache_hits", "SELECT event_type AS layer, round(avg((value < 60)::INT), 6) AS hit_rate, count(*) FILTER (WHERE value >= 95) AS evictions FROM events GROUP BY 1")
def m21(s, d):
    return load(s, d, "events").groupBy(F.col("event_type").alias("layer")).agg(r6(F.avg((F.col("value") < 60).cast("int"))).alias("hit_rate"), F.count_if(F.col("value") >= 95).alias("evictions"))
