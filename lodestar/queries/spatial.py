"""Registered queries: geometry, spatial joins and statistics, networks, pixels, terrain, tiles (families D to F, H to J)."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import load
from ..functions import geo
from ..operators import spatial as S
from ..registry import query

r6 = lambda c: F.round(c, 6)
HAV = "2*6371000*atan2(sqrt(a), sqrt(1-a))"
A = "pow(sin(radians({la2}-{la1})/2),2)+cos(radians({la1}))*cos(radians({la2}))*pow(sin(radians({lo2}-{lo1})/2),2)"


@query("d2_bbox_algebra", "SELECT id, round((maxx-minx)*(maxy-miny), 6) AS area, round((minx+maxx)/2, 6) AS cx, round((miny+maxy)/2, 6) AS cy, minx-1 AS bx, maxy+1 AS by_ FROM fx_boxes")
def d2(s, d):
    b = load(s, d, "fx_boxes")
    return b.select("id", r6((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))).alias("area"), r6((F.col("minx") + F.col("maxx")) / 2).alias("cx"), r6((F.col("miny") + F.col("maxy")) / 2).alias("cy"), (F.col("minx") - 1).alias("bx"), (F.col("maxy") + 1).alias("by_"))


@query("d4_haversine", f"SELECT id, round({HAV}, 3) AS metres FROM (SELECT id, {A.format(la1='lat', lo1='lon', la2='48.8', lo2='2.3')} AS a FROM fx_points)")
def d4(s, d):
    return load(s, d, "fx_points").select("id", F.round(geo.haversine(F.col("lon"), F.col("lat"), F.lit(2.3), F.lit(48.8)), 3).alias("metres"))


@query("d5_bearing", "SELECT id, round(fmod(degrees(atan2(sin(radians(2.3-lon))*cos(radians(48.8)), cos(radians(lat))*sin(radians(48.8))-sin(radians(lat))*cos(radians(48.8))*cos(radians(2.3-lon))))+360, 360), 5) AS azimuth FROM fx_points")
def d5(s, d):
    return load(s, d, "fx_points").select("id", F.round(geo.bearing(F.col("lon"), F.col("lat"), F.lit(2.3), F.lit(48.8)), 5).alias("azimuth"))


@query("d6_mercator", "SELECT id, round(radians(lon)*6378137, 3) AS x, round(ln(tan(pi()/4+radians(lat)/2))*6378137, 3) AS y FROM fx_points")
def d6(s, d):
    x, y = geo.to_mercator(F.col("lon"), F.col("lat"))
    return load(s, d, "fx_points").select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("d10_area_length", "SELECT id, round((maxx-minx)*(maxy-miny), 6) AS area, round(2*((maxx-minx)+(maxy-miny)), 6) AS perimeter FROM fx_boxes")
def d10(s, d):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(p("minx", "miny"), p("maxx", "miny"), p("maxx", "maxy"), p("minx", "maxy"), p("minx", "miny"))
    return load(s, d, "fx_boxes").select("id", r6(geo.ring_area(ring)).alias("area"), r6(geo.path_length(ring)).alias("perimeter"))


@query("d15_point_buffer", "SELECT id, round(0.5*8*4*sin(2*pi()/8), 6) AS area FROM fx_sites")
def d15(s, d):
    return load(s, d, "fx_sites").select("id", r6(geo.ring_area(geo.circle(F.col("lon"), F.col("lat"), F.lit(2.0), 8))).alias("area"))


@query("d18_point_in_polygon", "SELECT p.id, count(b.id) AS n FROM fx_points p LEFT JOIN fx_boxes b ON (b.miny > p.lat) <> (b.maxy > p.lat) AND p.lon >= b.minx AND p.lon < b.maxx GROUP BY 1")
def d18(s, d):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(p("minx", "miny"), p("maxx", "miny"), p("maxx", "maxy"), p("minx", "maxy"), p("minx", "miny"))
    points, boxes = load(s, d, "fx_points"), load(s, d, "fx_boxes").withColumnRenamed("id", "box")
    hits = S.points_in_boxes(points.select("id", "lon", "lat"), boxes, 10.0).where(geo.in_ring(F.col("lon"), F.col("lat"), ring)).groupBy("id").agg(F.count("*").alias("n"))
    return points.select("id").join(hits, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query("d22_segment_distance", "SELECT id, round(CASE WHEN t<=0 THEN sqrt(pow(lon+50,2)+pow(lat+20,2)) WHEN t>=1 THEN sqrt(pow(lon-50,2)+pow(lat-40,2)) ELSE sqrt(pow(lon+50-t*100,2)+pow(lat+20-t*60,2)) END, 6) AS dist FROM (SELECT *, ((lon+50)*100+(lat+20)*60)/(100.0*100+60*60) AS t FROM fx_points)")
def d22(s, d):
    return load(s, d, "fx_points").select("id", r6(geo.segment_distance(F.col("lon"), F.col("lat"), *map(F.lit, (-50.0, -20.0, 50.0, 40.0)))).alias("dist"))


@query("d32_coordinate_checks", "SELECT id, lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AS valid, abs(lat) > 80 AS polar FROM fx_points")
def d32(s, d):
    return load(s, d, "fx_points").select("id", (F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)).alias("valid"), (F.abs("lat") > 80).alias("polar"))


@query("e5_spatial_join", "SELECT p.id, b.id AS box FROM fx_points p JOIN fx_boxes b ON p.lon BETWEEN b.minx AND b.maxx AND p.lat BETWEEN b.miny AND b.maxy")
def e5(s, d):
    return S.points_in_boxes(load(s, d, "fx_points").select("id", "lon", "lat"), load(s, d, "fx_boxes").select(F.col("id").alias("box"), "minx", "miny", "maxx", "maxy"), 10.0).select("id", "box")


def sides(s, d):
    a = load(s, d, "fx_points").select("id", "lon", "lat", "value")
    return a, load(s, d, "fx_sites").select(F.col("id").alias("id2"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))


@query("e6_distance_join", "SELECT p.id, q.id AS id2, round(sqrt(pow(p.lon-q.lon,2)+pow(p.lat-q.lat,2)), 6) AS distance FROM fx_points p JOIN fx_sites q ON sqrt(pow(p.lon-q.lon,2)+pow(p.lat-q.lat,2)) <= 5")
def e6(s, d):
    a, b = sides(s, d)
    return S.within_distance(a, b, 5.0).select("id", "id2", r6("distance").alias("distance"))


@query("e8_knn_join", "SELECT * FROM (SELECT p.id, q.id AS id2, round(sqrt(pow(p.lon-q.lon,2)+pow(p.lat-q.lat,2)), 6) AS distance, row_number() OVER (PARTITION BY p.id ORDER BY sqrt(pow(p.lon-q.lon,2)+pow(p.lat-q.lat,2)), q.id) AS rank FROM fx_points p, fx_sites q) WHERE rank <= 3")
def e8(s, d):
    a, b = sides(s, d)
    return S.nearest(a, b, 3, 20.0).select("id", "id2", r6("distance").alias("distance"), "rank")


@query("e14_counts_in_polygons", "SELECT b.id AS box, count(p.id) AS n, round(sum(p.value), 2) AS total FROM fx_boxes b LEFT JOIN fx_points p ON p.lon BETWEEN b.minx AND b.maxx AND p.lat BETWEEN b.miny AND b.maxy GROUP BY 1")
def e14(s, d):
    boxes = load(s, d, "fx_boxes").select(F.col("id").alias("box"), "minx", "miny", "maxx", "maxy")
    got = S.points_in_boxes(load(s, d, "fx_points"), boxes, 10.0).groupBy("box").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return boxes.select("box").join(got, "box", "left").select("box", F.coalesce("n", F.lit(0)).alias("n"), "total")


@query("e23_centers", "SELECT grp, round(avg(lon), 6) AS x, round(avg(lat), 6) AS y, round(sum(lon*abs(value))/sum(abs(value)), 6) AS wx, round(sqrt(var_pop(lon)+var_pop(lat)), 6) AS standard_distance FROM fx_points GROUP BY 1")
def e23(s, d):
    w = F.abs("value")
    return load(s, d, "fx_points").groupBy("grp").agg(r6(F.avg("lon")).alias("x"), r6(F.avg("lat")).alias("y"), r6(F.sum(F.col("lon") * w) / F.sum(w)).alias("wx"), r6(F.sqrt(F.var_pop("lon") + F.var_pop("lat"))).alias("standard_distance"))


@query("e26_hot_spots", "SELECT p.id, round((sum(q.value)-any_value(m)*count(*))/(any_value(sd)*sqrt(count(*))), 6) AS z FROM fx_points p JOIN fx_points q ON sqrt(pow(p.lon-q.lon,2)+pow(p.lat-q.lat,2)) <= 4, (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM fx_points) GROUP BY 1")
def e26(s, d):
    from ..operators.geostat import hot_spots

    return hot_spots(load(s, d, "fx_points"), 4.0).select("id", r6("z").alias("z"))


@query("e35_grid_clusters", "SELECT floor(lon/10)::BIGINT AS cx, floor(lat/10)::BIGINT AS cy, count(*) AS n, round(avg(lon), 6) AS x, round(avg(lat), 6) AS y FROM fx_points GROUP BY 1, 2")
def e35(s, d):
    return load(s, d, "fx_points").groupBy(F.floor(F.col("lon") / 10).alias("cx"), F.floor(F.col("lat") / 10).alias("cy")).agg(F.count("*").alias("n"), r6(F.avg("lon")).alias("x"), r6(F.avg("lat")).alias("y"))


@query("e39_idw", "SELECT g.id, round(sum(p.value/pow(dist,2))/sum(1/pow(dist,2)), 4) AS v FROM (SELECT q.id, p.value, sqrt(pow(p.lon-q.lon,2)+pow(p.lat-q.lat,2)) AS dist FROM fx_points p JOIN fx_sites q ON sqrt(pow(p.lon-q.lon,2)+pow(p.lat-q.lat,2)) <= 12 AND (p.lon<>q.lon OR p.lat<>q.lat)) p JOIN fx_sites g ON g.id=p.id GROUP BY 1")
def e39(s, d):
    a, b = sides(s, d)
    n = S.within_distance(a, b, 12.0).where("distance > 0").withColumn("w", 1 / F.pow("distance", F.lit(2)))
    return n.groupBy(F.col("id2").alias("id")).agg(F.round(F.sum(F.col("value") * F.col("w")) / F.sum("w"), 4).alias("v"))


@query("e41_variogram", "SELECT floor(dist/2)::BIGINT AS lag, count(*) AS n, round(avg(pow(a-b,2))/2, 3) AS gamma FROM (SELECT p.value AS a, q.value AS b, sqrt(pow(p.lon-q.lon,2)+pow(p.lat-q.lat,2)) AS dist FROM fx_points p JOIN fx_points q ON p.id < q.id) WHERE dist <= 12 GROUP BY 1")
def e41(s, d):
    from ..operators.geostat import variogram

    return variogram(load(s, d, "fx_points"), 12.0, 2.0).select("lag", "n", F.round("gamma", 3).alias("gamma"))


@query("f5_shortest_paths", "WITH RECURSIVE w(node, cost, depth) AS (SELECT 0::BIGINT, 0.0::DOUBLE, 0 UNION ALL SELECT e.dst, w.cost+e.cost, depth+1 FROM w JOIN fx_edges e ON e.src=w.node WHERE depth < 9 AND w.cost < 60) SELECT node, min(cost) AS cost FROM w GROUP BY 1")
def f5(s, d):
    e = load(s, d, "fx_edges")
    return S.shortest_paths(e, s.createDataFrame([(0,)], "origin long")).select("node", "cost")


@query("f8_od_matrix")
def f8(s, d):
    e = load(s, d, "fx_edges")
    return S.shortest_paths(e, e.select(F.col("src").cast("long").alias("origin")).distinct()).select("origin", "node", "cost", F.size("path").alias("hops"))


@query("f13_degrees", "SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM fx_edges UNION ALL SELECT dst, 0, 1 FROM fx_edges) GROUP BY 1")
def f13(s, d):
    e = load(s, d, "fx_edges")
    both = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


@query("h3_vegetation_indices", "SELECT scene, r, c, CASE WHEN nir+red=0 THEN 0 ELSE round((nir-red)/(nir+red), 6) END AS ndvi, CASE WHEN abs(nir+6*red-7.5*blue+1) > 0.001 THEN round(2.5*(nir-red)/(nir+6*red-7.5*blue+1), 4) END AS evi, round(1.5*(nir-red)/(nir+red+0.5), 6) AS savi FROM fx_pixels")
def h3(s, d):
    n, r, b = F.col("nir"), F.col("red"), F.col("blue")
    den = n + 6 * r - 7.5 * b + 1
    return load(s, d, "fx_pixels").select("scene", "r", "c", F.when(n + r == 0, 0.0).otherwise(r6((n - r) / (n + r))).alias("ndvi"), F.when(F.abs(den) > 0.001, F.round(2.5 * (n - r) / den, 4)).alias("evi"), r6(1.5 * (n - r) / (n + r + 0.5)).alias("savi"))


@query("h4_water_indices", "SELECT scene, r, c, CASE WHEN green+nir=0 THEN 0 ELSE round((green-nir)/(green+nir), 6) END AS ndwi, round(4*(green-swir1)-(0.25*nir+2.75*swir2), 6) AS awei FROM fx_pixels")
def h4(s, d):
    g, n = F.col("green"), F.col("nir")
    return load(s, d, "fx_pixels").select("scene", "r", "c", F.when(g + n == 0, 0.0).otherwise(r6((g - n) / (g + n))).alias("ndwi"), r6(4 * (g - F.col("swir1")) - (0.25 * n + 2.75 * F.col("swir2"))).alias("awei"))


@query("h10_focal_mean", "SELECT a.r, a.c, round(avg(b.elev), 4) AS mean, max(b.elev) AS most FROM fx_dem a JOIN fx_dem b ON abs(a.r-b.r)<=1 AND abs(a.c-b.c)<=1 GROUP BY 1, 2")
def h10(s, d):
    n = S.neighbours8(load(s, d, "fx_dem"), "elev")
    all_ = F.array_compact(F.array(*[F.col(f"`n_{i}_{j}`") for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    return n.select("r", "c", F.round(F.aggregate(all_, F.lit(0.0), lambda a, x: a + x) / F.size(all_), 4).alias("mean"), F.array_max(all_).alias("most"))


@query("h11_zonal", "SELECT zone, count(*) AS n, round(avg(elev), 4) AS mean, min(elev) AS least, max(elev) AS most, round(stddev_pop(elev), 4) AS sd FROM fx_dem GROUP BY 1")
def h11(s, d):
    return load(s, d, "fx_dem").groupBy("zone").agg(F.count("*").alias("n"), F.round(F.avg("elev"), 4).alias("mean"), F.min("elev").alias("least"), F.max("elev").alias("most"), F.round(F.stddev_pop("elev"), 4).alias("sd"))


@query("h18_mosaic", "SELECT r, c, round(avg(nir), 6) AS mean_nir, min(nir) AS least, max(nir) AS most FROM fx_pixels GROUP BY 1, 2")
def h18(s, d):
    return load(s, d, "fx_pixels").groupBy("r", "c").agg(r6(F.avg("nir")).alias("mean_nir"), F.min("nir").alias("least"), F.max("nir").alias("most"))


@query("h20_change", "SELECT a.r, a.c, round(b.nir-a.nir, 6) AS change, abs(b.nir-a.nir) > 0.05 AS changed FROM fx_pixels a JOIN fx_pixels b ON a.r=b.r AND a.c=b.c AND a.scene=0 AND b.scene=1")
def h20(s, d):
    p = load(s, d, "fx_pixels")
    a, b = p.where("scene = 0").select("r", "c", F.col("nir").alias("a")), p.where("scene = 1").select("r", "c", F.col("nir").alias("b"))
    return a.join(b, ["r", "c"]).select("r", "c", r6(F.col("b") - F.col("a")).alias("change"), (F.abs(F.col("b") - F.col("a")) > 0.05).alias("changed"))


@query("i1_slope", """SELECT r, c, round(degrees(atan(sqrt(dx*dx+dy*dy))), 4) AS slope FROM (SELECT a.r, a.c, sum(CASE b.c-a.c WHEN 1 THEN 1 WHEN -1 THEN -1 ELSE 0 END*(CASE WHEN b.r=a.r THEN 2 ELSE 1 END)*b.elev)/8 AS dx, sum(CASE b.r-a.r WHEN 1 THEN 1 WHEN -1 THEN -1 ELSE 0 END*(CASE WHEN b.c=a.c THEN 2 ELSE 1 END)*b.elev)/8 AS dy
  FROM fx_dem a JOIN fx_dem b ON abs(a.r-b.r)<=1 AND abs(a.c-b.c)<=1 GROUP BY 1, 2 HAVING count(*)=9)""")
def i1(s, d):
    return S.horn_slope(load(s, d, "fx_dem"), "elev").select("r", "c", F.round("slope", 4).alias("slope"))


@query("j1_tiles", "SELECT id, greatest(0, least(1023, floor((lon+180)/360*1024)))::BIGINT AS x, greatest(0, least(1023, floor((1-asinh(tan(radians(lat)))/pi())/2*1024)))::BIGINT AS y FROM fx_points")
def j1(s, d):
    x, y = geo.tile(F.col("lon"), F.col("lat"), 10)
    return load(s, d, "fx_points").select("id", x.alias("x"), y.alias("y"))


@query("j3_quadkey", "SELECT id, (SELECT string_agg(((x>>k)&1)+2*((y>>k)&1), '' ORDER BY k DESC) FROM range(6) t(k)) AS quadkey, x>>1 AS px, y>>1 AS py FROM (SELECT id, greatest(0, least(63, floor((lon+180)/360*64)))::BIGINT AS x, greatest(0, least(63, floor((1-asinh(tan(radians(lat)))/pi())/2*64)))::BIGINT AS y FROM fx_points)")
def j3(s, d):
    x, y = geo.tile(F.col("lon"), F.col("lat"), 6)
    return load(s, d, "fx_points").select("id", x.alias("x"), y.alias("y")).select("id", geo.quadkey(F.col("x"), F.col("y"), 6).alias("quadkey"), F.shiftright("x", 1).alias("px"), F.shiftright("y", 1).alias("py"))


@query("j7_tile_pyramid", "SELECT z, x>>(8-z) AS x, y>>(8-z) AS y, count(*) AS n FROM (SELECT greatest(0, least(255, floor((lon+180)/360*256)))::BIGINT AS x, greatest(0, least(255, floor((1-asinh(tan(radians(lat)))/pi())/2*256)))::BIGINT AS y FROM fx_points), range(9) t(z) GROUP BY 1, 2, 3")
def j7(s, d):
    x, y = geo.tile(F.col("lon"), F.col("lat"), 8)
    leaf = load(s, d, "fx_points").select(x.alias("x"), y.alias("y")).groupBy("x", "y").agg(F.count("*").alias("n"))
    each = leaf.select(F.explode(F.sequence(F.lit(0), F.lit(8))).alias("z"), "x", "y", "n")
    return each.select(F.col("z").cast("long").alias("z"), F.expr("shiftright(x, 8-z)").alias("x"), F.expr("shiftright(y, 8-z)").alias("y"), "n").groupBy("z", "x", "y").agg(F.sum("n").alias("n"))
