"""Registered queries: geometry and spatial statistics (families A in part, D and E, the rest)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..fixtures import load
from ..functions import geo
from ..functions import geometry as Y
from ..operators import geostat as T
from ..operators import nearby as N
from ..operators import spatial as S
from ..registry import query

r3, r4, r5, r6 = ((lambda c, n=n: F.round(c, n)) for n in (3, 4, 5, 6))
c = F.col
SHOELACE = "((x1*y2-x2*y1)+(x2*y3-x3*y2)+(x3*y4-x4*y3)+(x4*y1-x1*y4))/2"
PERIMETER = "sqrt(pow(x2-x1,2)+pow(y2-y1,2))+sqrt(pow(x3-x2,2)+pow(y3-y2,2))+sqrt(pow(x4-x3,2)+pow(y4-y3,2))+sqrt(pow(x1-x4,2)+pow(y1-y4,2))"
NEAR = "SELECT p.id, q.id AS id2, p.value AS v, q.value AS v2, sqrt(pow(p.lon-q.lon,2)+pow(p.lat-q.lat,2)) AS dist FROM fx_points p JOIN fx_points q ON p.id<>q.id AND abs(p.lon-q.lon) <= {r} AND abs(p.lat-q.lat) <= {r} AND sqrt(pow(p.lon-q.lon,2)+pow(p.lat-q.lat,2)) <= {r}"


def quads(s, d):
    return load(s, d, "fx_quads").withColumn("ring", Y.ring((c("x1"), c("y1")), (c("x2"), c("y2")), (c("x3"), c("y3")), (c("x4"), c("y4"))))


def tasks(s):
    """Tasks for the pairs of boxes, of which there are more than the size of the boxes tells."""
    return 8 * s.sparkContext.defaultParallelism


def rects(s, d, n=""):
    return load(s, d, "fx_rects").select(*[c(k).alias(k + n) for k in ("id", "minx", "miny", "maxx", "maxy", "grp")])


def points(s, d):
    return load(s, d, "fx_points").select("id", "lon", "lat", "value")


@query("a6_wkt", f"SELECT id, round({SHOELACE}, 6) AS area, 5 AS n FROM fx_quads")
def a6(s, d):
    again = Y.from_wkt(Y.to_wkt(c("ring")))
    return quads(s, d).select("id", again.alias("r")).select("id", r6(Y.area(c("r"))).alias("area"), F.size("r").alias("n"))


@query("a2_geojson", f"SELECT id, round({SHOELACE}, 6) AS area FROM fx_quads")
def a2(s, d):
    return quads(s, d).select("id", Y.from_geojson(Y.to_geojson(c("ring"))).alias("r")).select("id", r6(Y.area(c("r"))).alias("area"))


@query("d1_bbox", "SELECT id, least(x1,x2,x3,x4) AS minx, least(y1,y2,y3,y4) AS miny, greatest(x1,x2,x3,x4) AS maxx, greatest(y1,y2,y3,y4) AS maxy FROM fx_quads")
def d1(s, d):
    return quads(s, d).select("id", Y.bbox(c("ring")).alias("b")).select("id", "b.*")


@query("d2_bbox_operations", "SELECT id, minx<=10 AND maxx>=10 AND miny<=10 AND maxy>=10 AS holds_point, minx<=60 AND maxx>=-50 AND miny<=50 AND maxy>=-40 AS meets, round(greatest(0, least(maxx,60)-greatest(minx,-50))*greatest(0, least(maxy,50)-greatest(miny,-40)), 6) AS shared, round((greatest(maxx,60)-least(minx,-50))*(greatest(maxy,50)-least(miny,-40)), 6) AS united, round((maxx-minx+2)*(maxy-miny+2), 6) AS grown FROM fx_rects")
def d2(s, d):
    b = rects(s, d).select("*", *[F.lit(float(v)).alias(k) for k, v in (("minx2", -50), ("miny2", -40), ("maxx2", 60), ("maxy2", 50))])
    united = (F.greatest("maxx", "maxx2") - F.least("minx", "minx2")) * (F.greatest("maxy", "maxy2") - F.least("miny", "miny2"))
    point = F.lit(10.0).between(c("minx"), c("maxx")) & F.lit(10.0).between(c("miny"), c("maxy"))
    return b.select("id", point.alias("holds_point"), (T.box_relation() != "disjoint").alias("meets"), r6(T.shared_area()).alias("shared"), r6(united).alias("united"), r6((c("maxx") - c("minx") + 2) * (c("maxy") - c("miny") + 2)).alias("grown"))


@query("d3_planar_distances", "SELECT id, round(sqrt(lon*lon+lat*lat), 6) AS euclidean, round(abs(lon)+abs(lat), 6) AS manhattan FROM fx_points")
def d3(s, d):
    return points(s, d).select("id", r6(F.hypot("lon", "lat")).alias("euclidean"), r6(F.abs("lon") + F.abs("lat")).alias("manhattan"))


@query("d5_destination", "SELECT id, round(degrees(la), 5) AS lat, round(lon + degrees(atan2(sin(radians(60))*sin(0.05)*cos(radians(lat)), cos(0.05)-sin(radians(lat))*sin(la))), 5) AS lon FROM (SELECT *, asin(sin(radians(lat))*cos(0.05)+cos(radians(lat))*sin(0.05)*cos(radians(60))) AS la FROM fx_points)")
def d5(s, d):
    lon, lat = geo.destination(c("lon"), c("lat"), F.lit(60.0), F.lit(0.05 * geo.EARTH))
    return points(s, d).select("id", r5(lat).alias("lat"), r5(lon).alias("lon"))


@query("d6_from_mercator", "SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM fx_points")
def d6(s, d):
    x, y = geo.to_mercator(c("lon"), c("lat"))
    lon, lat = geo.from_mercator(c("mx"), c("my"))
    return points(s, d).select("id", x.alias("mx"), y.alias("my")).select("id", r6(lon).alias("lon"), r6(lat).alias("lat"))


UTM = """SELECT id, zone, round(500000+0.9996*n*(a+(1-t+cc)*pow(a,3)/6+(5-18*t+t*t+72*cc-58*e2)*pow(a,5)/120), 2) AS easting, round(0.9996*(m+n*tan(phi)*(a*a/2+(5-t+9*cc+4*cc*cc)*pow(a,4)/24+(61-58*t+t*t+600*cc-330*e2)*pow(a,6)/720)), 2) AS northing
  FROM (SELECT *, 6378137.0/sqrt(1-0.00669437999014*pow(sin(phi),2)) AS n, pow(tan(phi),2) AS t, e2*pow(cos(phi),2) AS cc, cos(phi)*radians(lon-(zone*6-183)) AS a, 6378137.0*(0.99832429843134*phi-0.00251460707284*sin(2*phi)+0.00000263904662*sin(4*phi)-0.00000000341804*sin(6*phi)) AS m
  FROM (SELECT id, lon, radians(lat) AS phi, floor((lon+180)/6)::INT%60+1 AS zone, 0.00669437999014/(1-0.00669437999014) AS e2 FROM fx_points))"""


@query("d7_utm", UTM)
def d7(s, d):
    zone, x, y = geo.to_utm(c("lon"), c("lat"))
    return points(s, d).select("id", zone.alias("zone"), F.round(x, 2).alias("easting"), F.round(y, 2).alias("northing"))


@query("d8_datum_shift")
def d8(s, d):
    lon, lat, h = geo.datum_shift(c("lon"), c("lat"), F.lit(0.0), (-446.448, 125.157, -542.06), (-0.1502, -0.247, -0.8421), 20.4894)
    return points(s, d).select("id", lon.alias("lon"), lat.alias("lat"), h.alias("height"))


@query("d9_length", f"SELECT id, round({PERIMETER}, 6) AS length FROM fx_quads")
def d9(s, d):
    return quads(s, d).select("id", r6(Y.length(c("ring"))).alias("length"))


@query("d10_area_holes", f"SELECT id, round(abs({SHOELACE})*0.75, 6) AS area FROM fx_quads")
def d10(s, d):
    hole = F.transform("ring", lambda p: Y.point(c("x1") + (p["x"] - c("x1")) / 2, c("y1") + (p["y"] - c("y1")) / 2))
    return quads(s, d).select("id", r6(Y.area_with_holes(c("ring"), F.array(hole))).alias("area"))


@query("d11_centroids", f"SELECT id, round((x1+x2+x3+x4)/4, 6) AS vx, round((y1+y2+y3+y4)/4, 6) AS vy, round(((x1+x2)*(x1*y2-x2*y1)+(x2+x3)*(x2*y3-x3*y2)+(x3+x4)*(x3*y4-x4*y3)+(x4+x1)*(x4*y1-x1*y4))/(6*{SHOELACE}), 4) AS ax FROM fx_quads")
def d11(s, d):
    (vx, vy), (ax, _) = Y.vertex_centroid(c("ring")), Y.area_centroid(c("ring"))
    return quads(s, d).select("id", r6(vx).alias("vx"), r6(vy).alias("vy"), r4(ax).alias("ax"))


@query("d12_envelope_reverse", f"SELECT id, round((greatest(x1,x2,x3,x4)-least(x1,x2,x3,x4))*(greatest(y1,y2,y3,y4)-least(y1,y2,y3,y4)), 6) AS envelope, round(-{SHOELACE}, 6) AS reversed FROM fx_quads")
def d12(s, d):
    q = quads(s, d).withColumn("b", Y.bbox(c("ring")))
    return q.select("id", r6(Y.area(Y.box_ring(c("b.minx"), c("b.miny"), c("b.maxx"), c("b.maxy")))).alias("envelope"), r6(Y.area(F.reverse("ring"))).alias("reversed"))


@query("d13_convex_hull")
def d13(s, d):
    hull = Y.on_lines(Y.hull)
    return quads(s, d).select("id", hull("ring").alias("ring")).select("id", Y.area(c("ring")).alias("area"), F.size("ring").alias("n"))


@query("d14_shapes", "SELECT id, round(0.5*6*pow(1+id%5,2)*sin(2*pi()/6), 6) AS hexagon, round(5*(2+id%3)*(1+id%2)*sin(pi()/5), 6) AS star, round(0.5*16*(1+id%4)*(2+id%7)*sin(2*pi()/16), 6) AS ellipse FROM fx_sites")
def d14(s, d):
    x, y = c("lon"), c("lat")
    return load(s, d, "fx_sites").select("id", r6(Y.area(Y.regular(x, y, 1.0 + c("id") % 5, 6))).alias("hexagon"), r6(Y.area(Y.regular(x, y, 2.0 + c("id") % 3, 5, 1.0 + c("id") % 2))).alias("star"), r6(Y.area(Y.ellipse(x, y, 1.0 + c("id") % 4, 2.0 + c("id") % 7, 16))).alias("ellipse"))


@query("d15_buffer_vertices", "SELECT id, k, round(lon+2*cos(2*pi()*k/8), 6) AS x, round(lat+2*sin(2*pi()*k/8), 6) AS y FROM fx_sites, (SELECT unnest(range(8))::INT AS k)")
def d15(s, d):
    ring = F.slice(geo.circle(c("lon"), c("lat"), F.lit(2.0), 8), 1, 8)
    return load(s, d, "fx_sites").select("id", F.posexplode(ring).alias("k", "p")).select("id", "k", r6("p.x").alias("x"), r6("p.y").alias("y"))


@query("d17_ring_buffers", "SELECT id, dist, round(0.5*16*dist*dist*sin(2*pi()/16), 6) AS area FROM (SELECT id, unnest([1.0, 2.5, id%5+1.0])::DOUBLE AS dist FROM fx_sites)")
def d17(s, d):
    each = F.explode(F.array(F.lit(1.0), F.lit(2.5), (c("id") % 5 + 1).cast("double"))).alias("dist")
    return load(s, d, "fx_sites").select("id", "lon", "lat", each).select("id", "dist", r6(Y.area(geo.circle(c("lon"), c("lat"), c("dist"), 16))).alias("area"))


def side(a, b):
    return f"(CASE WHEN (y{a}>p.lat)<>(y{b}>p.lat) AND p.lon < (x{b}-x{a})*(p.lat-y{a})/(y{b}-y{a})+x{a} THEN 1 ELSE 0 END)"


@query("d18_points_in_quads", f"SELECT q.id AS quad, p.id FROM fx_sites p JOIN fx_quads q ON ({side(1, 2)}+{side(2, 3)}+{side(3, 4)}+{side(4, 1)})%2=1")
def d18(s, d):
    q = quads(s, d).select(c("id").alias("quad"), "ring", Y.bbox(c("ring")).alias("b")).select("quad", "ring", "b.*")
    return S.points_in_boxes(load(s, d, "fx_sites").select("id", "lon", "lat"), q, 4.0).where(Y.inside(c("lon"), c("lat"), c("ring"))).select("quad", "id")


RELATION = "CASE WHEN a.minx=b.minx AND a.miny=b.miny AND a.maxx=b.maxx AND a.maxy=b.maxy THEN 'equals' WHEN a.minx<=b.minx AND a.miny<=b.miny AND a.maxx>=b.maxx AND a.maxy>=b.maxy THEN 'contains' WHEN b.minx<=a.minx AND b.miny<=a.miny AND b.maxx>=a.maxx AND b.maxy>=a.maxy THEN 'within' WHEN a.maxx=b.minx OR b.maxx=a.minx OR a.maxy=b.miny OR b.maxy=a.miny THEN 'touches' ELSE 'overlaps' END"
MEET = "a.minx<=b.maxx AND b.minx<=a.maxx AND a.miny<=b.maxy AND b.miny<=a.maxy"


@query("d20_relate", f"SELECT a.id, b.id AS id2, {RELATION} AS relation FROM fx_rects a JOIN fx_rects b ON {MEET}")
def d20(s, d):
    return T.box_pairs(rects(s, d), rects(s, d, "2"), 20.0).select("id", "id2", T.box_relation().alias("relation"))


@query("d21_segment_crossing", "SELECT id, round(x1+t*(x3-x1), 5) AS x, round(y1+t*(y3-y1), 5) AS y FROM (SELECT *, ((x2-x1)*(y4-y2)-(y2-y1)*(x4-x2))/den AS t, ((x2-x1)*(y3-y1)-(y2-y1)*(x3-x1))/den AS u FROM (SELECT *, (x3-x1)*(y4-y2)-(y3-y1)*(x4-x2) AS den FROM fx_quads)) WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1")
def d21(s, d):
    p = Y.segment_crossing(*[c(k) for k in ("x1", "y1", "x3", "y3", "x2", "y2", "x4", "y4")])
    return quads(s, d).select("id", p.alias("p")).where("p IS NOT NULL").select("id", r5("p.x").alias("x"), r5("p.y").alias("y"))


def seg(a, b):
    t = f"greatest(0, least(1, (-x{a}*(x{b}-x{a})-y{a}*(y{b}-y{a}))/(pow(x{b}-x{a},2)+pow(y{b}-y{a},2))))"
    return f"sqrt(pow(x{a}+{t}*(x{b}-x{a}),2)+pow(y{a}+{t}*(y{b}-y{a}),2))"


@query("d22_nearest_on_ring", f"SELECT id, round(least({seg(1, 2)}, {seg(2, 3)}, {seg(3, 4)}, {seg(4, 1)}), 5) AS distance FROM fx_quads")
def d22(s, d):
    return quads(s, d).select("id", r5(Y.nearest_on(c("ring"), F.lit(0.0), F.lit(0.0))["distance"]).alias("distance"))


@query("d23_box_overlay", f"SELECT a.id, b.id AS id2, round(i, 4) AS intersection, round(aa+ba-i, 4) AS united, round(aa-i, 4) AS difference, round(aa+ba-2*i, 4) AS symmetric FROM (SELECT a.id AS aid, b.id AS bid, greatest(0, least(a.maxx,b.maxx)-greatest(a.minx,b.minx))*greatest(0, least(a.maxy,b.maxy)-greatest(a.miny,b.miny)) AS i, (a.maxx-a.minx)*(a.maxy-a.miny) AS aa, (b.maxx-b.minx)*(b.maxy-b.miny) AS ba FROM fx_rects a JOIN fx_rects b ON a.id<b.id AND {MEET}) x JOIN fx_rects a ON a.id=aid JOIN fx_rects b ON b.id=bid")
def d23(s, d):
    p = T.box_pairs(rects(s, d), rects(s, d, "2"), 20.0, parts=tasks(s)).where("id < id2")
    # what two boxes share is a box
    i = T.shared_area()
    a, b = (c("maxx") - c("minx")) * (c("maxy") - c("miny")), (c("maxx2") - c("minx2")) * (c("maxy2") - c("miny2"))
    return p.select("id", "id2", r4(i).alias("intersection"), r4(a + b - i).alias("united"), r4(a - i).alias("difference"), r4(a + b - 2 * i).alias("symmetric"))


@query("d24_clip")
def d24(s, d):
    q = quads(s, d).withColumn("part", Y.clip_to_box(c("ring"), F.lit(-50.0), F.lit(-40.0), F.lit(60.0), F.lit(50.0)))
    return q.where(F.size("part") > 0).select("id", Y.area(c("part")).alias("area"), F.size("part").alias("n"))


def track(s, d):
    """Fixes in the order of their times, those of one time in that of their ids."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "lon", "lat"))), lambda p: Y.point(p["lon"], p["lat"]))
    return load(s, d, "fx_gps").groupBy("tracker").agg(line.alias("line"))


@query("d25_simplify")
def d25(s, d):
    return track(s, d).select("tracker", F.size("line").alias("n"), Y.on_lines(lambda x: Y.far_points(x, 20.0))("line").alias("few"), Y.thinned(c("line"), 40.0).alias("thin")).select("tracker", "n", F.size("few").alias("n_far"), F.size("thin").alias("n_thin"), Y.length(c("few")).alias("length"))


@query("d26_smooth", "SELECT tracker, round(sum(x), 4) AS sx, round(sum(y), 4) AS sy, count(*) AS n FROM (SELECT tracker, CASE WHEN k=1 OR k=n THEN lon ELSE avg(lon) OVER w END AS x, CASE WHEN k=1 OR k=n THEN lat ELSE avg(lat) OVER w END AS y FROM (SELECT *, row_number() OVER (PARTITION BY tracker ORDER BY ts) AS k, count(*) OVER (PARTITION BY tracker) AS n FROM fx_gps) WINDOW w AS (PARTITION BY tracker ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) GROUP BY 1")
def d26(s, d):
    return track(s, d).select("tracker", Y.moving_average(c("line"), 1).alias("l")).select("tracker", *[r4(Y.total(F.transform("l", Y.coordinate(k)))).alias(f"s{k}") for k in "xy"], F.size("l").cast("long").alias("n"))


@query("d26_chaikin", "SELECT tracker, CASE WHEN count(*) > 1 THEN 2*count(*) ELSE 2 END::BIGINT AS n FROM fx_gps GROUP BY 1")
def d26_chaikin(s, d):
    return track(s, d).select("tracker", F.size(Y.chaikin(c("line"))).cast("long").alias("n"))


@query("d27_densify", "SELECT tracker, (1+sum(greatest(1, ceil(sqrt(pow(lon-lo,2)+pow(lat-la,2))/10))))::BIGINT AS n, round(sum(sqrt(pow(lon-lo,2)+pow(lat-la,2))), 4) AS length FROM (SELECT *, lag(lon) OVER w AS lo, lag(lat) OVER w AS la FROM fx_gps WINDOW w AS (PARTITION BY tracker ORDER BY ts)) WHERE lo IS NOT NULL GROUP BY 1")
def d27(s, d):
    return track(s, d).where(F.size("line") > 1).select("tracker", Y.densify(c("line"), 10.0).alias("l")).select("tracker", F.size("l").cast("long").alias("n"), r4(Y.length(c("l"))).alias("length"))


def odd_rings(s, d):
    """Rings with planted faults: every fifth is open, clockwise or repeats a corner."""
    k = c("id") % 5
    r = F.when(k == 0, F.slice("ring", 1, 4)).when(k == 1, F.reverse("ring")).when(k == 2, F.concat(F.slice("ring", 1, 1), c("ring"))).otherwise(c("ring"))
    return quads(s, d).select("id", r.alias("ring"))


@query("d29_validate", "SELECT id, issue FROM (SELECT id, unnest(CASE id%5 WHEN 0 THEN ['not_closed'] WHEN 1 THEN ['clockwise'] WHEN 2 THEN ['repeated_point'] ELSE [] END) AS issue FROM fx_quads) UNION ALL SELECT id, 'out_of_range' FROM fx_quads WHERE greatest(abs(x1),abs(x2),abs(x3),abs(x4)) > 180 OR greatest(abs(y1),abs(y2),abs(y3),abs(y4)) > 90")
def d29(s, d):
    return odd_rings(s, d).select("id", F.explode(Y.issues(c("ring"))).alias("issue"))


@query("d30_validation_action", "SELECT id, id%5 >= 3 AND greatest(abs(x1),abs(x2),abs(x3),abs(x4)) <= 180 AND greatest(abs(y1),abs(y2),abs(y3),abs(y4)) <= 90 AS valid FROM fx_quads")
def d30(s, d):
    return odd_rings(s, d).select("id", (F.size(Y.issues(c("ring"))) == 0).alias("valid"))


@query("d31_repair", f"SELECT id, 5 AS n, round(abs({SHOELACE}), 6) AS area FROM fx_quads")
def d31(s, d):
    return odd_rings(s, d).select("id", Y.repaired(c("ring")).alias("r")).select("id", F.size("r").alias("n"), r6(Y.area(c("r"))).alias("area"))


@query("d33_shape_features", f"SELECT id, round(abs({SHOELACE}), 6) AS area, round({PERIMETER}, 6) AS perimeter, round(4*pi()*abs({SHOELACE})/pow({PERIMETER}, 2), 6) AS compactness, 4 AS vertices FROM fx_quads")
def d33(s, d):
    a, p = F.abs(Y.area(c("ring"))), Y.length(c("ring"))
    return quads(s, d).select("id", a.alias("a"), p.alias("p"), (F.size("ring") - 1).alias("vertices")).select("id", r6("a").alias("area"), r6("p").alias("perimeter"), r6(4 * math.pi * c("a") / (c("p") * c("p"))).alias("compactness"), "vertices")


@query("e1_bbox_query", "SELECT id FROM fx_rects WHERE minx<=60 AND maxx>=-50 AND miny<=50 AND maxy>=-40")
def e1(s, d):
    return rects(s, d).where("minx <= 60 AND maxx >= -50 AND miny <= 50 AND maxy >= -40").select("id")


@query("e2_attribute_and_space", "SELECT id FROM fx_points WHERE value > 1000 AND sqrt(pow(lon-10,2)+pow(lat-20,2)) <= 45")
def e2(s, d):
    near = c("lon").between(-35, 55) & c("lat").between(-25, 65) & (F.hypot(c("lon") - 10, c("lat") - 20) <= 45)
    return points(s, d).where((c("value") > 1000) & near).select("id")


@query("e3_feature_service", "SELECT id, value FROM fx_points WHERE lon BETWEEN -90 AND 90 AND lat BETWEEN -60 AND 60 AND value > 0 ORDER BY value DESC, id LIMIT 15 OFFSET 5")
def e3(s, d):
    return points(s, d).where("lon BETWEEN -90 AND 90 AND lat BETWEEN -60 AND 60 AND value > 0").orderBy(F.desc("value"), "id").offset(5).limit(15).select("id", "value")


@query("e4_bulk_upsert", "SELECT c_custkey AS id, CASE WHEN c_custkey%4=1 THEN c_acctbal+1 ELSE c_acctbal END AS value, CASE WHEN c_custkey%4=1 THEN 2 ELSE 1 END AS version FROM customer WHERE c_custkey%4<>2 UNION ALL SELECT 1000000+s_suppkey, s_acctbal, 1 FROM supplier")
def e4(s, d):
    old = load(s, d, "customer").select(c("c_custkey").alias("id"), c("c_acctbal").alias("value"), F.lit(1).alias("version"))
    k = c("id") % 4
    changes = old.where(k.isin(1, 2, 3)).select("id", (c("value") + 1).alias("value"), F.when(k == 3, 0).otherwise(2).alias("version"), F.when(k == 2, "delete").otherwise("update").alias("op"))
    new = load(s, d, "supplier").select((c("s_suppkey") + 1000000).alias("id"), c("s_acctbal").alias("value"), F.lit(1).alias("version"), F.lit("create").alias("op"))
    return T.upsert(old, changes.unionByName(new), "id", "version")


@query("e5_box_join", f"SELECT a.id, b.id AS id2, coalesce({RELATION}='contains', false) AS contains FROM fx_rects a LEFT JOIN fx_rects b ON a.grp<>b.grp AND {MEET}")
def e5(s, d):
    """Pairs are written as they are met; boxes that meet none are found apart, so pairs are not sent to their boxes again."""
    hits = T.box_pairs(rects(s, d), rects(s, d, "2"), 20.0, parts=tasks(s)).where("grp <> grp2").select("id", "id2", (T.box_relation() == "contains").alias("contains"))
    alone = T.boxes_alone(rects(s, d), rects(s, d, "2"), 20.0, "grp", tasks(s))
    return hits.unionByName(alone.select("id", F.lit(None).cast("long").alias("id2"), F.lit(False).alias("contains")))


def near_sites(s, d):
    return load(s, d, "fx_sites").select(c("id").alias("id2"), c("lon").alias("lon2"), c("lat").alias("lat2"))


PQ = "sqrt(pow(p.lon-q.lon,2)+pow(p.lat-q.lat,2))"
FIRST = f"SELECT p.id, q.id AS id2, {PQ} AS dist, row_number() OVER (PARTITION BY p.id ORDER BY {PQ}, q.id) AS n FROM fx_points p, fx_sites q"


@query("e7_nearest", f"SELECT id, id2, round(dist, 6) AS distance FROM ({FIRST}) WHERE n = 1")
def e7(s, d):
    return S.nearest(points(s, d).select("id", "lon", "lat"), near_sites(s, d), 1, 20.0).select("id", "id2", r6("distance").alias("distance"))


@query("e9_near_table", f"SELECT id, id2, round(dist, 6) AS distance FROM ({FIRST}) WHERE n = 1 AND dist <= 15")
def e9(s, d):
    return S.nearest(points(s, d), near_sites(s, d), 1, 15.0, most=15.0).select("id", "id2", r6("distance").alias("distance"))


@query("e10_distance_matrix", "SELECT a.id, b.id AS id2, round(sqrt(pow(a.lon-b.lon,2)+pow(a.lat-b.lat,2)), 6) AS distance FROM fx_sites a JOIN fx_sites b ON sqrt(pow(a.lon-b.lon,2)+pow(a.lat-b.lat,2)) <= 60")
def e10(s, d):
    # all pairs up to a cut-off, which bounds what a place can be paired with
    return S.within_distance(load(s, d, "fx_sites").select("id", "lon", "lat"), near_sites(s, d), 60.0).select("id", "id2", r6("distance").alias("distance"))


@query("e11_allocate", f"SELECT id2 AS facility, count(*) AS n, round(sum(value), 2) AS demand, round(avg(dist), 6) AS mean FROM ({FIRST.replace('p.id,', 'p.id, p.value,', 1)}) WHERE n = 1 AND dist <= 25 GROUP BY 1")
def e11(s, d):
    got = S.nearest(points(s, d), near_sites(s, d), 1, 25.0, most=25.0)
    return got.groupBy(c("id2").alias("facility")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("demand"), r6(F.avg("distance")).alias("mean"))


@query("e12_zones", f"SELECT id, CASE WHEN dist <= 5 THEN 'near' WHEN dist <= 12 THEN 'middle' ELSE 'far' END AS zone FROM ({FIRST}) WHERE n = 1")
def e12(s, d):
    x = c("distance")
    return S.nearest(points(s, d), near_sites(s, d), 1, 20.0).select("id", F.when(x <= 5, "near").when(x <= 12, "middle").otherwise("far").alias("zone"))


@query("e13_along_route", "SELECT id, round(dist, 6) AS distance, round(t*sqrt(100*100+60*60), 6) AS place FROM (SELECT id, t, sqrt(pow(lon+50-t*100,2)+pow(lat+20-t*60,2)) AS dist FROM (SELECT *, greatest(0, least(1, ((lon+50)*100+(lat+20)*60)/(100.0*100+60*60))) AS t FROM fx_points)) WHERE dist <= 10")
def e13(s, d):
    line = F.array(Y.point(F.lit(-50.0), F.lit(-20.0)), Y.point(F.lit(50.0), F.lit(40.0)))
    p = points(s, d).withColumn("n", Y.nearest_on(line, c("lon"), c("lat"))).where("n.distance <= 10")
    return p.select("id", r6("n.distance").alias("distance"), r6(F.hypot(c("n.x") + 50, c("n.y") + 20)).alias("place"))


@query("e15_voronoi_cells", "SELECT gx, gy, site FROM (SELECT g.gx, g.gy, q.id AS site, row_number() OVER (PARTITION BY g.gx, g.gy ORDER BY sqrt(pow(g.gx*10-q.lon,2)+pow(g.gy*10-q.lat,2)), q.id) AS n FROM (SELECT DISTINCT floor(lon/10)::BIGINT AS gx, floor(lat/10)::BIGINT AS gy FROM fx_points) g, fx_sites q) WHERE n = 1")
def e15(s, d):
    cells = points(s, d).select(F.floor(c("lon") / 10).alias("gx"), F.floor(c("lat") / 10).alias("gy")).distinct()
    grid = cells.select("gx", "gy", ((c("gx") + 1000) * 10000 + c("gy") + 1000).alias("id"), (c("gx") * 10.0).alias("lon"), (c("gy") * 10.0).alias("lat"))
    return S.nearest(grid, near_sites(s, d), 1, 20.0).select("gx", "gy", c("id2").alias("site"))


@query("e16_layer_intersect", f"SELECT a.id, b.id AS id2, a.grp, b.grp AS grp2, round(greatest(0, least(a.maxx,b.maxx)-greatest(a.minx,b.minx))*greatest(0, least(a.maxy,b.maxy)-greatest(a.miny,b.miny)), 4) AS area FROM fx_rects a JOIN fx_rects b ON a.grp<b.grp AND {MEET}")
def e16(s, d):
    return T.box_pairs(rects(s, d), rects(s, d, "2"), 20.0, parts=tasks(s)).where("grp < grp2").select("id", "id2", "grp", "grp2", r4(T.shared_area()).alias("area"))


@query("e17_clip_layer", "SELECT id, round((least(maxx,60)-greatest(minx,-50))*(least(maxy,50)-greatest(miny,-40)), 4) AS clipped, round((maxx-minx)*(maxy-miny)-(least(maxx,60)-greatest(minx,-50))*(least(maxy,50)-greatest(miny,-40)), 4) AS erased FROM fx_rects WHERE minx<60 AND maxx>-50 AND miny<50 AND maxy>-40")
def e17(s, d):
    box = tuple(map(F.lit, (-50.0, -40.0, 60.0, 50.0)))
    r = rects(s, d).where("minx < 60 AND maxx > -50 AND miny < 50 AND maxy > -40")
    inner = Y.area(Y.clip_to_box(Y.box_ring(c("minx"), c("miny"), c("maxx"), c("maxy")), *box))
    return r.select("id", inner.alias("i"), ((c("maxx") - c("minx")) * (c("maxy") - c("miny"))).alias("a")).select("id", r4("i").alias("clipped"), r4(c("a") - c("i")).alias("erased"))


@query("e18_overlap_share", f"SELECT a.id, count(*) AS n, round(sum(greatest(0, least(a.maxx,b.maxx)-greatest(a.minx,b.minx))*greatest(0, least(a.maxy,b.maxy)-greatest(a.miny,b.miny))/((a.maxx-a.minx)*(a.maxy-a.miny)))*100, 4) AS pct FROM fx_rects a JOIN fx_rects b ON a.id<>b.id AND {MEET} GROUP BY 1")
def e18(s, d):
    p = T.box_pairs(rects(s, d), rects(s, d, "2"), 20.0).where("id <> id2")
    return p.groupBy("id").agg(F.count("*").alias("n"), r4(F.sum(T.shared_area() / ((c("maxx") - c("minx")) * (c("maxy") - c("miny")))) * 100).alias("pct"))


@query("e20_dissolve_cells", "SELECT grp, count(*) AS cells FROM (SELECT DISTINCT grp, x, y FROM fx_rects, range(-180, 221) a(x), range(-85, 106) b(y) WHERE x+1 > minx AND x < maxx AND y+1 > miny AND y < maxy) GROUP BY 1")
def e20(s, d):
    r = rects(s, d).withColumn("x", F.explode(F.sequence(F.floor("minx"), F.ceil("maxx") - 1))).withColumn("y", F.explode(F.sequence(F.floor("miny"), F.ceil("maxy") - 1)))
    return r.select("grp", "x", "y").distinct().groupBy("grp").agg(F.count("*").alias("cells"))


@query("e22_layer_aggregates", "SELECT grp, count(*) AS n, min(lon) AS minx, min(lat) AS miny, max(lon) AS maxx, max(lat) AS maxy, round(avg(lon), 6) AS cx, round(avg(lat), 6) AS cy FROM fx_points GROUP BY 1")
def e22(s, d):
    return load(s, d, "fx_points").groupBy("grp").agg(F.count("*").alias("n"), F.min("lon").alias("minx"), F.min("lat").alias("miny"), F.max("lon").alias("maxx"), F.max("lat").alias("maxy"), r6(F.avg("lon")).alias("cx"), r6(F.avg("lat")).alias("cy"))


@query("e25_nn_index", "SELECT count(*) AS n, round(avg(dist), 6) AS observed, round(avg(dist)*2*sqrt(count(*)/(360.0*170)), 6) AS index FROM (SELECT id, min(dist) AS dist FROM (SELECT p.id, sqrt(pow(p.lon-q.lon,2)+pow(p.lat-q.lat,2)) AS dist FROM fx_points p JOIN fx_points q ON p.id<>q.id) GROUP BY 1)")
def e25(s, d):
    b = points(s, d).select(c("id").alias("id2"), c("lon").alias("lon2"), c("lat").alias("lat2"))
    # of the two nearest at most one is the point itself
    near = S.nearest(points(s, d).select("id", "lon", "lat"), b, 2, 8.0).where("id <> id2").groupBy("id").agg(F.min("distance").alias("x"))
    return near.agg(F.count("*").alias("n"), r6(F.avg("x")).alias("observed"), r6(F.avg("x") * 2 * F.sqrt(F.count("*") / (360.0 * 170))).alias("index"))


MORAN = "SELECT count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM fx_points"


@query("e27_morans_i", f"SELECT max(a.n) AS n, round(max(a.n)*sum((b.v-a.m)*(v2-a.m))/count(*)/(max(a.n)*max(a.v)), 6) AS i, round(-1.0/(max(a.n)-1), 9) AS expected FROM ({NEAR.format(r=12)}) b, ({MORAN}) a")
def e27(s, d):
    return T.morans_i(points(s, d), 12.0).select("n", r6("i").alias("i"), F.round("expected", 9).alias("expected"))


@query("e28_morans_inverse", f"SELECT round(max(a.n)*sum((v-a.m)*(v2-a.m)/dist)/sum(1/dist)/(max(a.n)*max(a.v)), 6) AS i FROM ({NEAR.format(r=12)} AND sqrt(pow(p.lon-q.lon,2)+pow(p.lat-q.lat,2)) > 0) b, ({MORAN}) a".replace("(v-a.m)", "(b.v-a.m)"))
def e28(s, d):
    return T.morans_i(points(s, d), 12.0, inverse=True).select(r6("i").alias("i"))


@query("e29_local_moran", f"SELECT id, round((max(b.v)-max(a.m))/sqrt(max(a.v))*avg((v2-a.m)/sqrt(a.v)), 6) AS local, round(avg(pow((b.v-v2)/sqrt(a.v), 2)), 6) AS geary, (CASE WHEN max(b.v) >= max(a.m) THEN 'H' ELSE 'L' END) || (CASE WHEN avg(v2-a.m) >= 0 THEN 'H' ELSE 'L' END) AS class FROM ({NEAR.format(r=12)}) b, ({MORAN}) a GROUP BY 1")
def e29(s, d):
    return T.local_moran(points(s, d), 12.0).select("id", r6("local").alias("local"), r6("geary").alias("geary"), "class")


@query("e30_weights", f"SELECT id, id2, round(1.0/count(*) OVER (PARTITION BY id), 6) AS w FROM ({NEAR.format(r=6)})")
def e30(s, d):
    return T.weights(points(s, d), 6.0).select("id", "id2", r6("w").alias("w"))


@query("e31_dbscan", f"WITH RECURSIVE p AS ({NEAR.format(r=6)}), core AS (SELECT id FROM p GROUP BY 1 HAVING count(*) >= 3), e AS (SELECT id, id2 FROM p WHERE id IN (FROM core) AND id2 IN (FROM core)), w AS (SELECT id, id AS l FROM core UNION SELECT e.id2, w.l FROM w JOIN e ON e.id=w.id WHERE w.l < e.id2), lab AS (SELECT id, min(l) AS cluster FROM w GROUP BY 1), b AS (SELECT p.id, arg_min(lab.cluster, struct_pack(a := dist, b := p.id2)) AS cluster FROM p JOIN lab ON lab.id=p.id2 WHERE p.id NOT IN (FROM core) GROUP BY 1) SELECT f.id, lab.id IS NOT NULL AS core, coalesce(lab.cluster, b.cluster) AS cluster FROM fx_points f LEFT JOIN lab ON lab.id=f.id LEFT JOIN b ON b.id=f.id")
def e31(s, d):
    return T.dbscan(points(s, d), 6.0, 4)


CENTRES = [(-90.0, -40.0), (0.0, 0.0), (90.0, 40.0), (60.0, -60.0)]
NEAREST = "arg_min(k, struct_pack(a := pow(lon-x,2)+pow(lat-y,2), b := k)) AS cluster FROM fx_points, (VALUES (0, -90.0, -40.0), (1, 0.0, 0.0), (2, 90.0, 40.0), (3, 60.0, -60.0)) t(k, x, y) GROUP BY"


@query("e32_kmeans_step", f"SELECT cluster, count(*) AS n, round(avg(lon), 6) AS x, round(avg(lat), 6) AS y FROM (SELECT id, any_value(lon) AS lon, any_value(lat) AS lat, {NEAREST} id) GROUP BY 1")
def e32(s, d):
    return T.assign(points(s, d), CENTRES).groupBy("cluster").agg(F.count("*").alias("n"), r6(F.avg("lon")).alias("x"), r6(F.avg("lat")).alias("y"))


@query("e32_kmeans")
def e32_full(s, d):
    p = points(s, d)
    return T.assign(p, T.kmeans(p, CENTRES, 12)).select("id", "cluster", "d2")


@query("e33_single_linkage", f"WITH RECURSIVE e AS ({NEAR.format(r=5)}), w AS (SELECT id, id AS l FROM fx_points UNION SELECT e.id2, w.l FROM w JOIN e ON e.id=w.id WHERE w.l < e.id2) SELECT id, min(l) AS cluster FROM w GROUP BY 1")
def e33(s, d):
    return N.linked(points(s, d), 5.0).select("id", c("component").alias("cluster"))


@query("e34_silhouette", f"WITH a AS (SELECT id, any_value(lon) AS lon, any_value(lat) AS lat, {NEAREST} id), p AS (SELECT p.id, p.cluster AS c1, q.cluster AS c2, sum(pow(p.lon-q.lon,2)+pow(p.lat-q.lat,2)) AS t, count(*) AS n FROM a p, a q GROUP BY 1, 2, 3), m AS (SELECT id, max(CASE WHEN c1=c2 THEN t/greatest(n-1, 1) END) AS a, min(CASE WHEN c1<>c2 THEN t/n END) AS b FROM p GROUP BY 1) SELECT round(avg((b-a)/greatest(a, b)), 6) AS score FROM m")
def e34(s, d):
    a = T.assign(points(s, d), CENTRES)
    return a.agg(r6(T.silhouette(a, 4)).alias("score"))


GRID = "(SELECT gx, gy FROM range(-17, 18) a(gx), range(-8, 9) b(gy))"


def grid(s):
    return s.range(-17, 18).select(c("id").alias("gx")).crossJoin(F.broadcast(s.range(-8, 9).select(c("id").alias("gy")))).select("gx", "gy", ((c("gx") + 100) * 1000 + c("gy") + 100).alias("id"), (c("gx") * 10.0).alias("lon"), (c("gy") * 10.0).alias("lat"))


def grid_pairs(s, d, radius):
    b = points(s, d).select(c("id").alias("id2"), c("lon").alias("lon2"), c("lat").alias("lat2"), c("value").alias("v2"))
    return S.within_distance(grid(s), b, radius)


GP = "sqrt(pow(gx*10-p.lon,2)+pow(gy*10-p.lat,2))"


@query("e36_point_density", f"SELECT gx, gy, count(*) AS n, round(count(*)/(pi()*225), 9) AS density FROM {GRID}, fx_points p WHERE {GP} <= 15 GROUP BY 1, 2")
def e36(s, d):
    return grid_pairs(s, d, 15.0).groupBy("gx", "gy").agg(F.count("*").alias("n"), F.round(F.count("*") / (math.pi * 225), 9).alias("density"))


@query("e37_kernel_density", f"SELECT gx, gy, round(sum(value*exp(-pow({GP}/15,2)/2)), 3) AS gaussian, round(sum(value*pow(1-pow({GP}/15,2),2)), 3) AS quartic, round(sum(value*(1-{GP}/15)), 3) AS triangular FROM {GRID}, fx_points p WHERE {GP} <= 15 GROUP BY 1, 2")
def e37(s, d):
    return grid_pairs(s, d, 15.0).groupBy("gx", "gy").agg(*[r3(F.sum(c("v2") * T.kernel(c("distance"), 15.0, k))).alias(k) for k in ("gaussian", "quartic", "triangular")])


@query("e38_density_hot_spots", f"SELECT gx, gy, round((n-avg(n) OVER ())/stddev_pop(n) OVER (), 6) AS z FROM (SELECT gx, gy, count(*) AS n FROM {GRID}, fx_points p WHERE {GP} <= 15 GROUP BY 1, 2)")
def e38(s, d):
    g = grid_pairs(s, d, 15.0).groupBy("gx", "gy").agg(F.count("*").alias("n"))
    m, sd = g.agg(F.avg("n"), F.stddev_pop("n")).first()
    return g.select("gx", "gy", r6((c("n") - m) / sd).alias("z"))


@query("e39_idw_exact", f"SELECT gx, gy, round(CASE WHEN min({GP})=0 THEN avg(value) FILTER (WHERE {GP}=0) ELSE sum(value/nullif(pow({GP},2),0))/sum(1/nullif(pow({GP},2),0)) END, 4) AS v FROM {GRID}, fx_points p WHERE {GP} <= 15 GROUP BY 1, 2")
def e39(s, d):
    w = F.when(c("distance") > 0, 1 / F.pow("distance", F.lit(2)))
    exact = F.avg(F.when(c("distance") == 0, c("v2")))
    return grid_pairs(s, d, 15.0).groupBy("gx", "gy").agg(r4(F.coalesce(exact, F.sum(c("v2") * w) / F.sum(w))).alias("v"))


@query("e40_nearest_value", f"SELECT gx, gy, value AS v FROM (SELECT gx, gy, value, row_number() OVER (PARTITION BY gx, gy ORDER BY {GP}, p.id) AS n FROM {GRID}, fx_points p) WHERE n = 1")
def e40(s, d):
    b = points(s, d).select(c("id").alias("id2"), c("lon").alias("lon2"), c("lat").alias("lat2"), c("value").alias("v"))
    return S.nearest(grid(s), b, 1, 15.0).select("gx", "gy", "v")


@query("e42_variogram_models", "SELECT id, round(CASE WHEN h=0 THEN 0 ELSE 1+4*least(h/50,1) END, 6) AS linear, round(CASE WHEN h=0 THEN 0 WHEN h<50 THEN 1+4*(1.5*h/50-0.5*pow(h/50,3)) ELSE 5 END, 6) AS spherical, round(CASE WHEN h=0 THEN 0 ELSE 1+4*(1-exp(-3*h/50)) END, 6) AS exponential, round(CASE WHEN h=0 THEN 0 ELSE 1+4*(1-exp(-3*pow(h/50,2))) END, 6) AS gaussian FROM (SELECT id, sqrt(lon*lon+lat*lat) AS h FROM fx_points)")
def e42(s, d):
    h = F.hypot("lon", "lat")
    return points(s, d).select("id", *[r6(T.variogram_model(h, k, 1.0, 5.0, 50.0)).alias(k) for k in ("linear", "spherical", "exponential", "gaussian")])


@query("e43_kriging")
def e43(s, d):
    b = points(s, d).select(c("id").alias("id2"), c("lon").alias("lon2"), c("lat").alias("lat2"), c("value").alias("v2"))
    near = S.nearest(grid(s), b, 8, 15.0)
    swapped = near.select(c("id").alias("cell"), c("id2").alias("id"), c("lon2").alias("lon"), c("lat2").alias("lat"), c("v2").alias("value"), c("lon").alias("lon2"), c("lat").alias("lat2"))
    return T.kriging(swapped, "cell", 1.0, 40.0)


@query("e44_gwr", "SELECT id, round((w*xy-x*y)/nullif(w*xx-x*x, 0), 4) AS slope FROM (SELECT q.id, sum(k) AS w, sum(k*p.lat) AS x, sum(k*p.value) AS y, sum(k*p.lat*p.value) AS xy, sum(k*p.lat*p.lat) AS xx FROM (SELECT p.*, q.id AS qid, pow(1-pow(sqrt(pow(p.lon-q.lon,2)+pow(p.lat-q.lat,2))/30,2),2) AS k FROM fx_points p JOIN fx_sites q ON sqrt(pow(p.lon-q.lon,2)+pow(p.lat-q.lat,2)) < 30) p JOIN fx_sites q ON q.id=p.qid GROUP BY 1) WHERE w*xx-x*x > 1")
def e44(s, d):
    g = T.regression_around(points(s, d), near_sites(s, d), 30.0).where("w*xx - x*x > 1")
    fit = g.select("id2", ((c("w") * c("xy") - c("x") * c("y")) / (c("w") * c("xx") - c("x") * c("x"))).alias("slope"))
    return fit.select(c("id2").alias("id"), r4("slope").alias("slope"))


@query("e45_reverse_geocode", f"SELECT id, s_name AS place, round(dist, 6) AS distance FROM ({FIRST}) JOIN supplier ON s_suppkey=id2 WHERE n = 1")
def e45(s, d):
    near = S.nearest(points(s, d).select("id", "lon", "lat"), near_sites(s, d), 1, 20.0).select("id", "id2", r6("distance").alias("distance"))
    return near.join(load(s, d, "supplier").select(c("s_suppkey").alias("id2"), c("s_name").alias("place")), "id2").select("id", "place", "distance")


@query("e24_standard_distance", "SELECT grp, count(*) AS n, round(sqrt(var_pop(lon)+var_pop(lat)), 6) AS distance FROM fx_points GROUP BY 1")
def e24(s, d):
    return load(s, d, "fx_points").groupBy("grp").agg(F.count("*").alias("n"), r6(F.sqrt(F.var_pop("lon") + F.var_pop("lat"))).alias("distance"))
