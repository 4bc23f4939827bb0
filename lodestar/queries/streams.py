"""Registered queries that run the table events as a stream of files, with what is there now, and read the result (families A, B and L)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..checkpoint import checkpoint_dir
from ..fixtures import load
from ..operators import pipelines as P
from ..registry import query

c = F.col


def stream(s, d):
    """The table events as a file stream; its times as instants, as streams need them."""
    rows = s.readStream.schema(load(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return rows.withColumn("ts", c("ts").cast("timestamp"))


def folder(s):
    return f"{checkpoint_dir(s)}/stream-{uuid.uuid4().hex}"


def done(s, df, mode="append"):
    at = folder(s)
    P.run_once(df, f"{at}/out", f"{at}/state", mode)
    return s.read.schema(df.schema).parquet(f"{at}/out")


@query("a13_file_stream", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE value > 10 GROUP BY 1")
def a13(s, d):
    got = done(s, stream(s, d).where("value > 10").select("event_type", "value"))
    return got.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("b38_stream_mode", "SELECT event_id, value*2 AS doubled FROM events WHERE event_type='view'")
def b38(s, d):
    spec = {"source": "events", "steps": [{"kind": "filter", "where": {"field": "event_type", "op": "eq", "value": "view"}}, {"kind": "map", "columns": {"doubled": "value*2"}}, {"kind": "select", "columns": ["event_id", "doubled"]}]}
    return done(s, P.run_steps(stream(s, d), spec)[0])


@query("l19_watermark", "SELECT start, event_type, n FROM (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def l19(s, d):
    got = done(s, P.late_tolerant_counts(stream(s, d), "ts", "2 days", "1 day", "event_type"))
    return got.select(c("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("l27_stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def l27(s, d):
    once = P.once_per_key(stream(s, d), "ts", ["user_id", "event_type"], "60 days")
    return done(s, once.select("user_id", "event_type"))


@query("l6_stream_projection", "SELECT user_id, arg_max(value, ts) AS value, arg_max(event_type, ts) AS event_type FROM events GROUP BY 1")
def l6(s, d):
    at = folder(s)
    rows = stream(s, d).select("user_id", "ts", "value", "event_type")
    q = rows.writeStream.foreachBatch(P.merge_into(f"{at}/table", "user_id", "ts")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    last = max((p["batchId"] for p in q.recentProgress if p["numInputRows"]), default=0)
    return s.read.schema(rows.schema).parquet(f"{at}/table/v={last}").select("user_id", "value", "event_type")


@query("l7_router", "SELECT event_id, CASE WHEN event_type='error' THEN 'alerts' WHEN value > 90 THEN 'large' ELSE 'rest' END AS route FROM events")
def l7(s, d):
    route = F.when(c("event_type") == "error", "alerts").when(c("value") > 90, "large").otherwise("rest")
    return done(s, stream(s, d).select("event_id", route.alias("route")))


@query("l24_stream_viewers", "SELECT e.event_id, c.c_custkey AS viewer FROM events e JOIN customer c ON c.c_custkey=e.user_id WHERE e.value > c.c_acctbal/100")
def l24(s, d):
    viewers = load(s, d, "customer").select(c("c_custkey").alias("user_id"), "c_acctbal")
    seen = stream(s, d).join(viewers, "user_id").where("value > c_acctbal/100").select("event_id", c("user_id").alias("viewer"))
    return done(s, seen)
