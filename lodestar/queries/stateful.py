"""Registered queries: streams with state per key (families G, L and M)."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from ..fixtures import load
from ..operators import stateful as T
from ..registry import query
from .streams import done, stream

c = F.col
CLOSED = "ts <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY"


@contextmanager
def rocks(s):
    """The session keeps the state of streams that start here in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(name)
    s.conf.set(name, T.ROCKS)
    try:
        yield
    finally:
        s.conf.set(name, before)


@query("m20_stream_bucket", f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE {CLOSED}),
  b(user_id, n, event_id, t, allowed, rest) AS (SELECT user_id, n, event_id, t, true, 1.0::DOUBLE FROM e WHERE n = 1
    UNION ALL SELECT user_id, n, event_id, t, lvl >= 1, CASE WHEN lvl >= 1 THEN lvl-1 ELSE lvl END FROM (SELECT e.*, least(2.0::DOUBLE, b.rest+(e.t-b.t)/1e6::DOUBLE*(1.0::DOUBLE/14400)) AS lvl FROM b JOIN e ON e.user_id=b.user_id AND e.n=b.n+1))
  SELECT event_id AS id, allowed FROM b""")
def m20_stream(s, d):
    """The token bucket over the stream of events; what is younger than the watermark still waits."""
    with rocks(s):
        got = done(s, T.fold_stream(stream(s, d), "user_id", "ts", "event_id", "value", "2 days", (2.0,), T.token_step(2.0, 1 / 14400)))
    return got.select("id", (c("result") == 1).alias("allowed"))


@query("g29_stream_scores", f"""SELECT event_id AS id, CASE WHEN sd > 1e-9 THEN round((value-mean)/sd, 4) END AS score FROM (SELECT event_id, value, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sd FROM events WHERE {CLOSED}
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def g29(s, d):
    """Values scored against a model of their own kind that learns from the stream."""
    kind = F.dense_rank  # kinds of events are numbered by name on the side of the table
    from pyspark.sql import Window

    names = load(s, d, "events").select("event_type").distinct().withColumn("kind", kind().over(Window.orderBy("event_type")))
    with rocks(s):
        got = done(s, T.fold_stream(stream(s, d).join(F.broadcast(names), "event_type"), "kind", "ts", "event_id", "value", "2 days", (0.0, 0.0, 0.0), T.score_step))
    return got.select("id", F.round("result", 4).alias("score"))


@query("g29_stream_model", "SELECT event_id, round(a+b*epoch(ts)/86400, 3) AS expected, abs(value-(a+b*epoch(ts)/86400)) > 40 AS odd FROM events, (SELECT regr_slope(value, epoch(ts)/86400) AS b, regr_intercept(value, epoch(ts)/86400) AS a FROM events)")
def g29_model(s, d):
    """A line fitted on the table scores the stream."""
    day = F.unix_micros(c("ts").cast("timestamp")) / 86400e6
    a, b = load(s, d, "events").agg(F.regr_intercept("value", day), F.regr_slope("value", day)).first()
    return done(s, stream(s, d).select("event_id", F.round(a + b * day, 3).alias("expected"), (F.abs(c("value") - (a + b * day)) > 40).alias("odd")))
