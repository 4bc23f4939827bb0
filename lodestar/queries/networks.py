"""Registered queries: networks and routing (family F, the rest); nodes are suppliers, roads the tree and chain between them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import load
from ..operators import events as E
from ..operators import graph as N
from ..operators import spatial as S
from ..registry import query

c = F.col
r4, r6 = (lambda x: F.round(x, 4)), (lambda x: F.round(x, 6))
BEST = "WITH RECURSIVE e AS (SELECT src, dst, min(cost) AS cost FROM fx_roads GROUP BY 1, 2), w(origin, node, cost) AS (SELECT s_suppkey, s_suppkey, 0.0::DOUBLE FROM supplier WHERE s_suppkey IN ({o}) UNION SELECT w.origin, e.dst, w.cost+e.cost FROM w JOIN e ON e.src=w.node WHERE w.cost+e.cost <= {m}), best AS (SELECT origin, node, min(cost) AS cost FROM w GROUP BY 1, 2)"


def roads(s, d):
    """One edge, the cheapest, for each ordered pair of nodes."""
    return load(s, d, "fx_roads").groupBy("src", "dst").agg(F.min("cost").alias("cost"))


def origins(s, d, *ids):
    return load(s, d, "supplier").where(c("s_suppkey").isin(*ids)).select(c("s_suppkey").alias("origin"))


@query("f1_network", "SELECT count(*) AS edges, count(DISTINCT src) AS sources, round(sum(cost), 4) AS cost FROM (SELECT src, dst, cost FROM fx_roads UNION ALL SELECT dst, src, cost FROM fx_roads)")
def f1(s, d):
    e = load(s, d, "fx_roads").select("src", "dst", "cost")
    both = e.unionByName(e.select(c("dst").alias("src"), c("src").alias("dst"), "cost"))
    return both.agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"), r4(F.sum("cost")).alias("cost"))


@query("f2_snap", "SELECT id, node, round(dist, 6) AS distance FROM (SELECT p.id, q.id AS node, sqrt(pow(p.lon-q.lon,2)+pow(p.lat-q.lat,2)) AS dist, row_number() OVER (PARTITION BY p.id ORDER BY sqrt(pow(p.lon-q.lon,2)+pow(p.lat-q.lat,2)), q.id) AS n FROM fx_points p, fx_sites q) WHERE n = 1 AND dist <= 10")
def f2(s, d):
    nodes = load(s, d, "fx_sites").select(c("id").alias("id2"), c("lon").alias("lon2"), c("lat").alias("lat2"))
    return S.nearest(load(s, d, "fx_points").select("id", "lon", "lat"), nodes, 1, 10.0, most=10.0).select("id", c("id2").alias("node"), r6("distance").alias("distance"))


@query("f3_edge_cost", "SELECT src, dst, class, round(cost/CASE class WHEN 0 THEN 110.0 WHEN 1 THEN 80.0 WHEN 2 THEN 50.0 ELSE 30.0 END * CASE WHEN src%2=0 THEN 1.5 ELSE 1 END, 9) AS hours FROM fx_roads")
def f3(s, d):
    cost = N.edge_cost(c("cost"), c("class").cast("string"), {"0": 110.0, "1": 80.0, "2": 50.0, "3": 30.0}, F.when(c("src") % 2 == 0, 1.5).otherwise(1.0))
    return load(s, d, "fx_roads").select("src", "dst", "class", F.round(cost, 9).alias("hours"))


@query("f4_access", "SELECT src, dst FROM fx_roads WHERE class<>3 AND NOT (class=1 AND dst%5=0) AND 10+src%30 >= 18")
def f4(s, d):
    allowed = (c("class") != 3) & ~((c("class") == 1) & (c("dst") % 5 == 0)) & (10 + c("src") % 30 >= 18)
    return load(s, d, "fx_roads").where(allowed).select("src", "dst")


@query("f5_roads_from_one", BEST.format(o="0", m=45) + " SELECT node, cost FROM best")
def f5(s, d):
    return S.shortest_paths(roads(s, d), origins(s, d, 0), cutoff=45.0).select("node", "cost")


@query("f6_path", BEST.format(o="0", m=45) + ", p(node, cost, path) AS (SELECT 0::BIGINT, 0.0::DOUBLE, [0::BIGINT] UNION ALL SELECT e.dst, b.cost, list_append(p.path, e.dst) FROM p JOIN e ON e.src=p.node JOIN best b ON b.node=e.dst AND b.cost=p.cost+e.cost) SELECT node, cost, arg_min(path, struct_pack(n := len(path), p := path)) AS path FROM p GROUP BY 1, 2")
def f6(s, d):
    return S.shortest_paths(roads(s, d), origins(s, d, 0), cutoff=45.0).select("node", "cost", "path")


@query("f7_simple_paths", "WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM fx_roads), p(path, n) AS (SELECT [s_suppkey], 0 FROM supplier WHERE s_suppkey < 10 UNION ALL SELECT list_append(path, dst), n+1 FROM p JOIN e ON e.src=path[-1] WHERE n < 3 AND NOT list_contains(path, dst)) SELECT path FROM p WHERE n > 0")
def f7(s, d):
    starts = load(s, d, "supplier").where("s_suppkey < 10").select(c("s_suppkey").alias("node"))
    return N.simple_paths(load(s, d, "fx_roads"), starts, 3)


@query("f8_od_costs", BEST.format(o="0, 1, 2", m=40) + " SELECT origin, node, cost FROM best WHERE node%3=0")
def f8(s, d):
    # origins, destinations and a cut-off bound the result
    return S.shortest_paths(roads(s, d), origins(s, d, 0, 1, 2), cutoff=40.0).where("node % 3 = 0").select("origin", "node", "cost")


@query("f9_service_area", BEST.format(o="0, 3", m=30) + " SELECT origin, node, CASE WHEN cost <= 10 THEN 10 WHEN cost <= 20 THEN 20 ELSE 30 END AS band FROM best")
def f9(s, d):
    x = c("cost")
    return S.shortest_paths(roads(s, d), origins(s, d, 0, 3), cutoff=30.0).select("origin", "node", F.when(x <= 10, 10).when(x <= 20, 20).otherwise(30).alias("band"))


@query("f10_isochrone_hull")
def f10(s, d):
    from ..functions import geometry as Y

    near = S.shortest_paths(roads(s, d), origins(s, d, 0, 3), cutoff=30.0).select("origin", c("node").alias("id"))
    line = F.array_sort(F.collect_list(Y.point(c("lon"), c("lat"))))
    g = near.join(load(s, d, "fx_sites"), "id").groupBy("origin").agg(line.alias("line"))
    return g.select("origin", Y.on_lines(Y.hull)("line").alias("hull")).select("origin", F.size("hull").alias("corners"), F.abs(Y.area(c("hull"))).alias("area"))


@query("f11_closest_facility", BEST.format(o="0, 3, 5", m=60) + " SELECT node, arg_min(origin, struct_pack(a := cost, b := origin)) AS facility, min(cost) AS cost FROM best GROUP BY 1")
def f11(s, d):
    p = S.shortest_paths(roads(s, d), origins(s, d, 0, 3, 5), cutoff=60.0)
    return N.cheapest_by(p, "node").select("node", c("origin").alias("facility"), "cost")


@query("f12_trace", "WITH RECURSIVE w(origin, node, hops) AS (SELECT 1, 1::BIGINT, 0 UNION ALL SELECT origin, e.dst, hops+1 FROM w JOIN fx_tree e ON e.src=w.node) SELECT node, hops FROM w WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey=1)")
def f12(s, d):
    return N.reach(load(s, d, "fx_tree"), origins(s, d, 1)).select("node", "hops")


@query("f13_connectivity", "WITH RECURSIVE e AS (SELECT s_suppkey AS src, s_suppkey+3 AS dst FROM supplier WHERE s_suppkey+3 IN (SELECT s_suppkey FROM supplier)), b AS (SELECT * FROM e UNION SELECT dst, src FROM e), w AS (SELECT s_suppkey AS node, s_suppkey AS l FROM supplier UNION SELECT b.dst, w.l FROM w JOIN b ON b.src=w.node WHERE w.l < b.dst) SELECT node, min(l) AS component FROM w GROUP BY 1")
def f13(s, d):
    n = load(s, d, "supplier").select(c("s_suppkey").alias("node"))
    e = n.select(c("node").alias("src"), (c("node") + 3).alias("dst")).join(n.select(c("node").alias("dst")), "dst", "left_semi")
    return N.components(e, n)


@query("f13_graph_summary", "SELECT count(DISTINCT src) AS nodes, count(*) AS edges, round(count(*)/count(DISTINCT src), 6) AS mean_degree FROM fx_roads")
def f13_summary(s, d):
    return load(s, d, "fx_roads").agg(F.count_distinct("src").alias("nodes"), F.count("*").alias("edges"), r6(F.count("*") / F.count_distinct("src")).alias("mean_degree"))


CELL = "floor(CAST(({k}*3571)%36000 AS DOUBLE)/6000)::BIGINT"


@query("f14_partition", f"SELECT a, b, count(*) AS crossing FROM (SELECT {CELL.format(k='src')} AS a, {CELL.format(k='dst')} AS b FROM fx_roads) WHERE a<>b GROUP BY 1, 2")
def f14(s, d):
    cell = lambda k: F.floor(((c(k) * 3571) % 36000).cast("double") / 6000)
    return load(s, d, "fx_roads").select(cell("src").alias("a"), cell("dst").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("crossing"))


@query("f15_traffic_profile", "SELECT user_id%10 AS edge, dayofweek(ts)+1 AS dow, hour(ts) AS hour, round(avg(value)/50, 6) AS factor, count(*) AS n FROM events GROUP BY 1, 2, 3")
def f15(s, d):
    return load(s, d, "events").groupBy((c("user_id") % 10).alias("edge"), F.dayofweek("ts").alias("dow"), F.hour("ts").alias("hour")).agg(r6(F.avg("value") / 50).alias("factor"), F.count("*").alias("n"))


@query("f16_live_traffic", "SELECT user_id AS edge, arg_max(value, ts) AS speed, count(*) FILTER (WHERE event_type='error' AND ts >= TIMESTAMP '2024-01-25') AS incidents FROM events WHERE ts <= TIMESTAMP '2024-01-28' GROUP BY 1")
def f16(s, d):
    e = load(s, d, "events").where("ts <= TIMESTAMP_NTZ '2024-01-28'")
    return e.groupBy(c("user_id").alias("edge")).agg(F.max_by("value", "ts").alias("speed"), F.count_if((c("event_type") == "error") & (c("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-25'"))).alias("incidents"))


@query("f17_departures", "SELECT event_id, (SELECT min(o.ts) FROM events o WHERE o.event_type='view' AND o.user_id=e.user_id AND o.ts > e.ts) AS departs FROM events e WHERE event_type='signup'")
def f17(s, d):
    # the first departure after an arrival: an as-of look ahead within the stop's rows
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.min(F.when(c("event_type") == "view", c("ts"))).over(w)
    return load(s, d, "events").select("event_id", "event_type", nxt.alias("departs")).where("event_type = 'signup'").select("event_id", "departs")


@query("f18_route_summary", "SELECT tracker, count(*) AS segments, round(sum(sqrt(pow(lon-lo,2)+pow(lat-la,2))), 4) AS length, round(sum(secs), 3) AS seconds, round(sum(sqrt(pow(lon-lo,2)+pow(lat-la,2)))/sum(secs), 9) AS speed FROM (SELECT *, lag(lon) OVER w AS lo, lag(lat) OVER w AS la, (epoch_us(ts)-epoch_us(lag(ts) OVER w))/1e6 AS secs FROM fx_gps WINDOW w AS (PARTITION BY tracker ORDER BY ts)) WHERE lo IS NOT NULL GROUP BY 1")
def f18(s, d):
    w = Window.partitionBy("tracker").orderBy("ts")
    g = load(s, d, "fx_gps").select("tracker", "lon", "lat", F.lag("lon").over(w).alias("lo"), F.lag("lat").over(w).alias("la"), ((E.micros("ts") - F.lag(E.micros("ts")).over(w)) / 1e6).alias("secs")).where("lo IS NOT NULL")
    x = F.hypot(c("lon") - c("lo"), c("lat") - c("la"))
    return g.groupBy("tracker").agg(F.count("*").alias("segments"), r4(F.sum(x)).alias("length"), F.round(F.sum("secs"), 3).alias("seconds"), F.round(F.sum(x) / F.sum("secs"), 9).alias("speed"))
