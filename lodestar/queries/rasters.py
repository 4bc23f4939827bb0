"""Registered queries: imagery, terrain and tiles (families H, I and J, the rest)."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import load
from ..functions import geo
from ..operators import raster as A
from ..operators import spatial as S
from ..registry import query

c = F.col
r3, r4, r6 = ((lambda x, n=n: F.round(x, n)) for n in (3, 4, 6))
KEYS = ("scene", "r", "c")
div = F.try_divide


def pixels(s, d):
    return load(s, d, "fx_pixels")


def ND(a, b):
    return f"CASE WHEN {a}+{b}=0 THEN 0 ELSE round(({a}-{b})/({a}+{b}), 6) END"


@query("h1_blocks", "SELECT scene, r//16 AS br, c//16 AS bc, count(*) AS n, count(*) FILTER (WHERE r%16 IN (0,15) OR c%16 IN (0,15)) AS rim FROM fx_pixels GROUP BY 1, 2, 3")
def h1(s, d):
    rim = (c("r") % 16).isin(0, 15) | (c("c") % 16).isin(0, 15)
    return pixels(s, d).groupBy("scene", F.expr("r div 16").alias("br"), F.expr("c div 16").alias("bc")).agg(F.count("*").alias("n"), F.count_if(rim).alias("rim"))


@query("h2_normalised_difference", f"SELECT scene, r, c, {ND('nir', 'swir1')} AS nd, round(nir/nullif(red, 0), 6) AS ratio FROM fx_pixels")
def h2(s, d):
    return pixels(s, d).select(*KEYS, r6(A.ratio(c("nir"), c("swir1"))).alias("nd"), r6(div(c("nir"), c("red"))).alias("ratio"))


@query("h3_more_vegetation", f"SELECT scene, r, c, {ND('nir', 'green')} AS gndvi, {ND('nir', 'swir2')} AS ndre, round((nir-(2*red-blue))/nullif(nir+(2*red-blue), 0), 4) AS arvi, round((2*nir+1-sqrt(greatest(0, pow(2*nir+1,2)-8*(nir-red))))/2, 6) AS msavi, CASE WHEN abs(nir+6*red-7.5*blue+1) > 0.001 THEN round(3.618*2.5*(nir-red)/(nir+6*red-7.5*blue+1)-0.118, 4) END AS lai FROM fx_pixels")
def h3(s, d):
    rb, den = 2 * c("red") - c("blue"), c("nir") + 6 * c("red") - 7.5 * c("blue") + 1
    return pixels(s, d).select(*KEYS, r6(A.ratio(c("nir"), c("green"))).alias("gndvi"), r6(A.ratio(c("nir"), c("swir2"))).alias("ndre"), r4(div(c("nir") - rb, c("nir") + rb)).alias("arvi"), r6((2 * c("nir") + 1 - F.sqrt(F.greatest(F.lit(0.0), F.pow(2 * c("nir") + 1, F.lit(2)) - 8 * (c("nir") - c("red"))))) / 2).alias("msavi"),
                               F.when(F.abs(den) > 0.001, r4(3.618 * 2.5 * (c("nir") - c("red")) / den - 0.118)).alias("lai"))


@query("h4_more_water", f"SELECT scene, r, c, {ND('green', 'swir1')} AS mndwi, round((green+red)/nullif(nir+swir1, 0), 6) AS wri, {ND('nir', 'swir1')} AS ndmi, {ND('blue', 'swir1')} AS swi, (CASE WHEN green+swir1=0 THEN 0 ELSE (green-swir1)/(green+swir1) END) > 0.1 AS water FROM fx_pixels")
def h4(s, d):
    return pixels(s, d).select(*KEYS, r6(A.ratio(c("green"), c("swir1"))).alias("mndwi"), r6(div(c("green") + c("red"), c("nir") + c("swir1"))).alias("wri"), r6(A.ratio(c("nir"), c("swir1"))).alias("ndmi"), r6(A.ratio(c("blue"), c("swir1"))).alias("swi"), (A.ratio(c("green"), c("swir1")) > 0.1).alias("water"))


@query("h5_built_up", f"SELECT scene, r, c, {ND('swir1', 'nir')} AS ndbi, {ND('swir2', 'nir')} AS ui, round((swir1-nir)/nullif(10*sqrt(swir1+swir2), 0), 6) AS ebbi, round((CASE WHEN swir1+nir=0 THEN 0 ELSE (swir1-nir)/(swir1+nir) END)-(CASE WHEN nir+red=0 THEN 0 ELSE (nir-red)/(nir+red) END), 6) AS bui FROM fx_pixels")
def h5(s, d):
    return pixels(s, d).select(*KEYS, r6(A.ratio(c("swir1"), c("nir"))).alias("ndbi"), r6(A.ratio(c("swir2"), c("nir"))).alias("ui"), r6(div(c("swir1") - c("nir"), 10 * F.sqrt(c("swir1") + c("swir2")))).alias("ebbi"), r6(A.ratio(c("swir1"), c("nir")) - A.ratio(c("nir"), c("red"))).alias("bui"))


@query("h6_band_math", "SELECT scene, r, c, round(2*red+0.5*nir-blue, 6) AS combined, round(sqrt(red*nir), 6) AS root, round(ln(1+green), 6) AS logged, greatest(red, green, blue) AS most, round(pow(nir, 2), 6) AS squared FROM fx_pixels")
def h6(s, d):
    return pixels(s, d).select(*KEYS, r6(2 * c("red") + 0.5 * c("nir") - c("blue")).alias("combined"), r6(F.sqrt(c("red") * c("nir"))).alias("root"), r6(F.log(1 + c("green"))).alias("logged"), F.greatest(c("red"), c("green"), c("blue")).alias("most"), r6(F.pow(c("nir"), F.lit(2))).alias("squared"))


@query("h7_thresholds", "SELECT scene, r, c, (nir > 0.5)::INT AS above, (red BETWEEN 0.2 AND 0.6)::INT AS within FROM fx_pixels")
def h7(s, d):
    return pixels(s, d).select(*KEYS, (c("nir") > 0.5).cast("int").alias("above"), c("red").between(0.2, 0.6).cast("int").alias("within"))


@query("h8_raster_calculator", "SELECT a.r, a.c, round(a.nir+b.red, 6) AS total, round(a.nir*b.red, 6) AS product, round(sin(a.green)-cos(b.green), 6) AS waves FROM fx_pixels a JOIN fx_pixels b ON a.r=b.r AND a.c=b.c AND a.scene=0 AND b.scene=1")
def h8(s, d):
    a = pixels(s, d).where("scene = 0").select("r", "c", c("nir").alias("an"), c("green").alias("ag"))
    b = pixels(s, d).where("scene = 1").select("r", "c", c("red").alias("br"), c("green").alias("bg"))
    return a.join(b, ["r", "c"]).select("r", "c", r6(F.expr("an + br")).alias("total"), r6(F.expr("an * br")).alias("product"), r6(F.expr("sin(ag) - cos(bg)")).alias("waves"))


@query("h9_reclassify", "SELECT scene, r, c, CASE WHEN nir < 0.3 THEN 1.0 WHEN nir < 0.6 THEN 2.0 WHEN nir < 0.9 THEN 3.0 ELSE 0.0 END AS class, CASE WHEN red=0 THEN NULL ELSE red END AS nodata, coalesce(CASE WHEN red=0 THEN NULL ELSE red END, -1) AS filled FROM fx_pixels")
def h9(s, d):
    none = F.when(c("red") != 0, c("red"))
    return pixels(s, d).select(*KEYS, A.reclassify(c("nir"), [(-1, 0.3, 1.0), (0.3, 0.6, 2.0), (0.6, 0.9, 3.0)], 0.0).alias("class"), none.alias("nodata"), F.coalesce(none, F.lit(-1.0)).alias("filled"))


@query("h10_focal", "SELECT a.r, a.c, round(sum(b.elev), 3) AS total, min(b.elev) AS least, round(stddev_pop(b.elev), 3) AS sd FROM fx_dem a JOIN fx_dem b ON b.r BETWEEN a.r-1 AND a.r+1 AND b.c BETWEEN a.c-1 AND a.c+1 GROUP BY 1, 2")
def h10(s, d):
    return A.focal(load(s, d, "fx_dem"), "elev").select("r", "c", r3("total").alias("total"), "least", r3("sd").alias("sd"))


@query("h12_stretch", "SELECT scene, r, c, round(least(255, greatest(0, 255*(nir-lo)/(hi-lo))), 4) AS v FROM fx_pixels JOIN (SELECT scene, quantile_cont(nir, 0.02) AS lo, quantile_cont(nir, 0.98) AS hi FROM fx_pixels GROUP BY 1) USING (scene)")
def h12(s, d):
    q = pixels(s, d).groupBy("scene").agg(F.percentile("nir", 0.02).alias("lo"), F.percentile("nir", 0.98).alias("hi"))
    return pixels(s, d).join(q, "scene").select(*KEYS, r4(F.least(F.lit(255.0), F.greatest(F.lit(0.0), 255 * (c("nir") - c("lo")) / (c("hi") - c("lo"))))).alias("v"))


@query("h13_radiometric", "SELECT scene, r, c, round(nir*0.02+1.5, 6) AS radiance, round(pi()*(nir*0.02+1.5)/(1500*sin(radians(40))), 9) AS reflectance FROM fx_pixels")
def h13(s, d):
    x = c("nir") * 0.02 + 1.5
    return pixels(s, d).select(*KEYS, r6(x).alias("radiance"), F.round(math.pi * x / (1500 * math.sin(math.radians(40))), 9).alias("reflectance"))


@query("h14_dark_object", "SELECT scene, r, c, round(greatest(0, red-lo), 6) AS red FROM fx_pixels JOIN (SELECT scene, min(red) AS lo FROM fx_pixels WHERE red > 0 GROUP BY 1) USING (scene)")
def h14(s, d):
    lo = pixels(s, d).where("red > 0").groupBy("scene").agg(F.min("red").alias("lo"))
    return pixels(s, d).join(lo, "scene").select(*KEYS, r6(F.greatest(F.lit(0.0), c("red") - c("lo"))).alias("red"))


@query("h15_dead_pixels", "SELECT a.r, a.c, CASE WHEN any_value(a.elev) > 1.5*avg(b.elev) OR any_value(a.elev)=0 THEN list_sort(list(b.elev))[count(*)//2+1] ELSE any_value(a.elev) END AS v FROM fx_dem a JOIN fx_dem b ON b.r BETWEEN a.r-1 AND a.r+1 AND b.c BETWEEN a.c-1 AND a.c+1 GROUP BY 1, 2")
def h15(s, d):
    dem = load(s, d, "fx_dem").select("r", "c", "elev")
    return dem.join(A.focal(dem, "elev"), ["r", "c"]).select("r", "c", F.when((c("elev") > 1.5 * c("mean")) | (c("elev") == 0), c("median")).otherwise(c("elev")).alias("v"))


@query("h17_brovey", "SELECT scene, r, c, round(red*swir1/nullif(red+green+blue, 0), 6) AS red, round(green*swir1/nullif(red+green+blue, 0), 6) AS green FROM fx_pixels")
def h17(s, d):
    t = c("red") + c("green") + c("blue")
    return pixels(s, d).select(*KEYS, r6(div(c("red") * c("swir1"), t)).alias("red"), r6(div(c("green") * c("swir1"), t)).alias("green"))


@query("h17_high_pass", "SELECT a.scene, a.r, a.c, round(max(a.red)+max(a.swir1)-avg(b.swir1), 6) AS red, round(max(a.nir)+max(a.swir1)-avg(b.swir1), 6) AS nir FROM fx_pixels a JOIN fx_pixels b ON b.scene=a.scene AND b.r BETWEEN a.r-1 AND a.r+1 AND b.c BETWEEN a.c-1 AND a.c+1 GROUP BY 1, 2, 3")
def h17_high_pass(s, d):
    p = pixels(s, d).join(A.high_pass(pixels(s, d), "swir1", ["scene"]), ["scene", "r", "c"])
    return p.select(*KEYS, r6(c("red") + c("detail")).alias("red"), r6(c("nir") + c("detail")).alias("nir"))


@query("h16_atmosphere", "SELECT scene, r, c, round(greatest(0, least(1, (red-0.05)/(0.8*0.9))), 6) AS six_s, round(greatest(0, least(1, (nir-0.1*s)/(1+s))), 6) AS flaash FROM fx_pixels, (SELECT 0.008735*pow(0.85, -4.08)+3.91/30*1.3*pow(0.85, -1.3) AS s)")
def h16(s, d):
    return pixels(s, d).select(*KEYS, r6(A.six_s(c("red"), 0.05, 0.8, 0.9)).alias("six_s"), r6(A.flaash(c("nir"), 0.85, 30.0, "urban")).alias("flaash"))


@query("h16_topographic", """SELECT p.scene, p.r, p.c, round(CASE WHEN ci > 0 THEN red*cos(radians(40))/ci ELSE red END, 6) AS red FROM fx_pixels p JOIN (SELECT r, c, cos(radians(40))*cos(slope)+sin(radians(40))*sin(slope)*cos(radians(150)-aspect) AS ci
  FROM (SELECT m.r, m.c, atan(sqrt(pow((e.elev-w.elev)/2, 2)+pow((n.elev-s.elev)/2, 2))) AS slope, atan2((n.elev-s.elev)/2, (e.elev-w.elev)/2) AS aspect FROM fx_dem m JOIN fx_dem e ON e.r=m.r AND e.c=m.c+1 JOIN fx_dem w ON w.r=m.r AND w.c=m.c-1 JOIN fx_dem n ON n.r=m.r+1 AND n.c=m.c JOIN fx_dem s ON s.r=m.r-1 AND s.c=m.c)) t ON t.r=p.r AND t.c=p.c""")
def h16_topographic(s, d):
    lit = A.sunlit(load(s, d, "fx_dem"), "elev", 40.0, 150.0)
    return pixels(s, d).join(lit, ["r", "c"]).select(*KEYS, r6(c("red") * c("factor")).alias("red"))


@query("h18_mosaic_first_last", "SELECT r, c, arg_min(nir, scene) AS first_nir, arg_max(nir, scene) AS last_nir, round(sum(nir/(1+scene))/sum(1.0/(1+scene)), 6) AS weighted FROM fx_pixels GROUP BY 1, 2")
def h18(s, d):
    w = 1.0 / (1 + c("scene"))
    return pixels(s, d).groupBy("r", "c").agg(F.min_by("nir", "scene").alias("first_nir"), F.max_by("nir", "scene").alias("last_nir"), r6(F.sum(c("nir") * w) / F.sum(w)).alias("weighted"))


@query("h19_resample", "SELECT scene, r//2 AS r, c//2 AS c, round(avg(nir), 6) AS mean, arg_min(nir, r*1000+c) AS nearest FROM fx_pixels GROUP BY scene, r//2, c//2")
def h19(s, d):
    return pixels(s, d).groupBy("scene", F.expr("r div 2").alias("r2"), F.expr("c div 2").alias("c2")).agg(r6(F.avg("nir")).alias("mean"), F.min_by("nir", c("r") * 1000 + c("c")).alias("nearest")).withColumnsRenamed({"r2": "r", "c2": "c"})


CHANGE = "fx_pixels a JOIN fx_pixels b ON a.r=b.r AND a.c=b.c AND a.scene=0 AND b.scene=1"


def change(s, d):
    side = lambda k, n: pixels(s, d).where(c("scene") == k).select("r", "c", c("nir").alias("n" + n), c("red").alias("r" + n))
    return side(0, "a").join(side(1, "b"), ["r", "c"])


@query("h20_change_vector", f"SELECT a.r, a.c, round(sqrt(pow(b.nir-a.nir,2)+pow(b.red-a.red,2)), 6) AS magnitude, CASE WHEN sqrt(pow(b.nir-a.nir,2)+pow(b.red-a.red,2)) < 0.05 THEN 'None' WHEN sqrt(pow(b.nir-a.nir,2)+pow(b.red-a.red,2)) < 0.1 THEN 'Minor' WHEN sqrt(pow(b.nir-a.nir,2)+pow(b.red-a.red,2)) < 0.5 THEN 'Moderate' ELSE 'Major' END AS class FROM {CHANGE}")
def h20(s, d):
    m = F.sqrt(F.pow(c("nb") - c("na"), F.lit(2)) + F.pow(c("rb") - c("ra"), F.lit(2)))
    return change(s, d).withColumn("m", m).select("r", "c", r6("m").alias("magnitude"), F.when(c("m") < 0.05, "None").when(c("m") < 0.1, "Minor").when(c("m") < 0.5, "Moderate").otherwise("Major").alias("class"))


@query("h21_transitions", f"SELECT floor(a.nir*4)::BIGINT AS before, floor(b.nir*4)::BIGINT AS after, count(*) AS n FROM {CHANGE} GROUP BY 1, 2")
def h21(s, d):
    return change(s, d).groupBy(F.floor(c("na") * 4).alias("before"), F.floor(c("nb") * 4).alias("after")).agg(F.count("*").alias("n"))


@query("h22_minimum_distance", "WITH m AS (SELECT floor(nir*3)::INT AS k, avg(red) AS mr, avg(green) AS mg FROM fx_pixels WHERE scene=0 GROUP BY 1) SELECT r, c, arg_min(k, struct_pack(a := pow(red-mr,2)+pow(green-mg,2), b := k)) AS class FROM fx_pixels, m WHERE scene=1 GROUP BY 1, 2")
def h22(s, d):
    t = pixels(s, d).where("scene = 0").withColumn("k", F.floor(c("nir") * 3).cast("int"))
    return A.nearest_class(pixels(s, d).where("scene = 1"), t, ["red", "green"], "k").select("r", "c", "class")


@query("h22_likelihood", "WITH m AS (SELECT floor(nir*3)::INT AS k, avg(red) AS mr, avg(green) AS mg, var_pop(red) AS vr, var_pop(green) AS vg FROM fx_pixels WHERE scene=0 GROUP BY 1) SELECT r, c, arg_min(k, struct_pack(a := pow(red-mr,2)/vr+ln(vr)+pow(green-mg,2)/vg+ln(vg), b := k)) AS class FROM fx_pixels, m WHERE scene=1 GROUP BY 1, 2")
def h22_likelihood(s, d):
    t = pixels(s, d).where("scene = 0").withColumn("k", F.floor(c("nir") * 3).cast("int"))
    return A.nearest_class(pixels(s, d).where("scene = 1"), t, ["red", "green"], "k", True).select("r", "c", "class")


@query("h24_class_statistics", "SELECT floor(nir*4)::BIGINT AS class, count(*) AS n, round(100.0*count(*)/(SELECT count(*) FROM fx_pixels), 6) AS pct FROM fx_pixels GROUP BY 1")
def h24(s, d):
    p = pixels(s, d)
    return p.groupBy(F.floor(c("nir") * 4).alias("class")).agg(F.count("*").alias("n")).withColumn("pct", r6(100.0 * c("n") / F.lit(p.count())))


@query("h25_edges", "SELECT a.r, a.c, round(sqrt(pow(sum((b.c-a.c)*(CASE WHEN b.r=a.r THEN 2 ELSE 1 END)*b.elev),2)+pow(sum((b.r-a.r)*(CASE WHEN b.c=a.c THEN 2 ELSE 1 END)*b.elev),2)), 3) AS edge, min(b.elev) AS eroded, max(b.elev) AS dilated FROM fx_dem a JOIN fx_dem b ON b.r BETWEEN a.r-1 AND a.r+1 AND b.c BETWEEN a.c-1 AND a.c+1 GROUP BY 1, 2 HAVING count(*)=9")
def h25(s, d):
    n, v = A.whole_windows(load(s, d, "fx_dem"), "elev")
    gx = sum((j * (2 if i == 0 else 1) * x for (i, j), x in v.items()), F.lit(0.0))
    gy = sum((i * (2 if j == 0 else 1) * x for (i, j), x in v.items()), F.lit(0.0))
    return n.select("r", "c", r3(F.sqrt(gx * gx + gy * gy)).alias("edge"), F.least(*v.values()).alias("eroded"), F.greatest(*v.values()).alias("dilated"))


@query("h26_regions", "WITH RECURSIVE o AS (SELECT r, c, r*2147483648+c AS node FROM fx_dem WHERE zone > 25), w AS (SELECT r, c, node AS l FROM o UNION SELECT o.r, o.c, w.l FROM w JOIN o ON abs(o.r-w.r)+abs(o.c-w.c)=1 WHERE w.l < o.node) SELECT r, c, min(l) AS region FROM w GROUP BY 1, 2")
def h26(s, d):
    return A.regions(load(s, d, "fx_dem"), c("zone") > 25)


@query("h27_scene_search", "SELECT id, lon, lat FROM fx_points WHERE lon BETWEEN -100 AND 100 AND lat BETWEEN -50 AND 50 AND value < 4000 AND grp IN (1,2,3) ORDER BY value, id LIMIT 20")
def h27(s, d):
    return load(s, d, "fx_points").where(c("lon").between(-100, 100) & c("lat").between(-50, 50) & (c("value") < 4000) & c("grp").isin(1, 2, 3)).orderBy("value", "id").limit(20).select("id", "lon", "lat")


GRADIENT = "SELECT a.r, a.c, sum((b.c-a.c)*(CASE WHEN b.r=a.r THEN 2 ELSE 1 END)*b.elev)/8 AS dx, sum((b.r-a.r)*(CASE WHEN b.c=a.c THEN 2 ELSE 1 END)*b.elev)/8 AS dy FROM fx_dem a JOIN fx_dem b ON b.r BETWEEN a.r-1 AND a.r+1 AND b.c BETWEEN a.c-1 AND a.c+1 GROUP BY 1, 2 HAVING count(*)=9"


@query("i1_aspect", f"SELECT r, c, round(fmod(degrees(atan2(dy, -dx))+360, 360), 4) AS aspect FROM ({GRADIENT})")
def i1(s, d):
    return S.horn_slope(load(s, d, "fx_dem"), "elev").select("r", "c", r4("aspect").alias("aspect"))


@query("i2_hillshade", f"SELECT r, c, round(greatest(0, 255*(cos(radians(45))*cos(s)+sin(radians(45))*sin(s)*cos(radians(135)-a))), 3) AS shade FROM (SELECT r, c, atan(sqrt(dx*dx+dy*dy)) AS s, radians(fmod(degrees(atan2(dy, -dx))+360, 360)) AS a FROM ({GRADIENT}))")
def i2(s, d):
    return S.horn_slope(load(s, d, "fx_dem"), "elev").select("r", "c", r3(A.hillshade(c("slope"), c("aspect"))).alias("shade"))


@query("i3_curvature", "SELECT a.r, a.c, round(-2*((w.elev+e.elev)/2-a.elev+(n.elev+s.elev)/2-a.elev)*100, 3) AS curvature FROM fx_dem a JOIN fx_dem w ON w.r=a.r AND w.c=a.c-1 JOIN fx_dem e ON e.r=a.r AND e.c=a.c+1 JOIN fx_dem n ON n.r=a.r-1 AND n.c=a.c JOIN fx_dem s ON s.r=a.r+1 AND s.c=a.c")
def i3(s, d):
    return A.curvature(load(s, d, "fx_dem"), "elev").select("r", "c", r3("curvature").alias("curvature"))


CODES = "(VALUES (0,1,1),(1,1,2),(1,0,4),(1,-1,8),(0,-1,16),(-1,-1,32),(-1,0,64),(-1,1,128)) k(i, j, code)"
DOWN = f"SELECT a.r, a.c, arg_max(struct_pack(code := code, i := i, j := j), struct_pack(x := (a.elev-b.elev)/sqrt(i*i+j*j), y := -code)) AS f FROM fx_dem a, {CODES} JOIN fx_dem b ON b.r=a.r+i AND b.c=a.c+j AND b.elev < a.elev GROUP BY 1, 2".replace(f"fx_dem a, {CODES} JOIN", f"fx_dem a CROSS JOIN {CODES} JOIN")


@query("i4_flow_direction", f"SELECT r, c, coalesce(f.code, 0) AS code FROM fx_dem LEFT JOIN ({DOWN}) USING (r, c)")
def i4(s, d):
    return A.flow_direction(load(s, d, "fx_dem"), "elev").select("r", "c", "code")


@query("i5_flow_accumulation", f"WITH RECURSIVE f AS ({DOWN}), w AS (SELECT r, c, r AS r0, c AS c0 FROM f UNION ALL SELECT w.r+f.f.i, w.c+f.f.j, r0, c0 FROM w JOIN f ON f.r=w.r AND f.c=w.c) SELECT d.r, d.c, count(w.r) AS upstream FROM fx_dem d LEFT JOIN (SELECT r, c FROM w WHERE r<>r0 OR c<>c0) w ON w.r=d.r AND w.c=d.c GROUP BY 1, 2")
def i5(s, d):
    from ..checkpoint import durable

    return A.flow_accumulation(durable(A.flow_direction(load(s, d, "fx_dem"), "elev")))


@query("i6_contours")
def i6(s, d):
    return A.contour_segments(load(s, d, "fx_dem"), "elev", [920.0, 950.0, 1000.0])


@query("i7_profile", "SELECT k, r, c, elev FROM (SELECT k::INT AS k, floor(0+k*0.2+0.5)::BIGINT AS rr, floor(2+k*1.2+0.5)::BIGINT AS cc FROM range(0, 21) t(k)) JOIN fx_dem ON r=rr AND c=cc")
def i7(s, d):
    line = s.range(21).select(c("id").cast("int").alias("k"), F.floor(c("id") * 0.2 + 0.5).alias("r"), F.floor(2 + c("id") * 1.2 + 0.5).alias("c"))
    return load(s, d, "fx_dem").join(F.broadcast(line), ["r", "c"]).select("k", "r", "c", "elev")


@query("i8_viewshed")
def i8(s, d):
    return A.visible(load(s, d, "fx_dem"), "elev", (2, 20), 10.0, 15)


@query("i9_cumulative_viewshed")
def i9(s, d):
    dem = load(s, d, "fx_dem")
    out = None
    for place in ((1, 5), (2, 20), (3, 33)):
        part = A.visible(dem, "elev", place, 10.0, 12)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("r", "c").agg(F.count_if("visible").alias("observers"))


TILE = "greatest(0, least({m}, floor((lon+180)/360*{n})))::BIGINT AS x, greatest(0, least({m}, floor((1-asinh(tan(radians(lat)))/pi())/2*{n})))::BIGINT AS y"


def tiles(s, d, zoom):
    x, y = geo.tile(c("lon"), c("lat"), zoom)
    return load(s, d, "fx_points").select("id", "lon", "lat", x.alias("x"), y.alias("y"))


@query("j2_tile_bounds", f"SELECT id, round(x/64.0*360-180, 6) AS west, round((x+1)/64.0*360-180, 6) AS east, round(degrees(atan(sinh(pi()*(1-2*y/64.0)))), 6) AS north, round(degrees(atan(sinh(pi()*(1-2*(y+1)/64.0)))), 6) AS south FROM (SELECT id, {TILE.format(m=63, n=64)} FROM fx_points)")
def j2(s, d):
    w, so, e, n = geo.tile_bounds(c("x"), c("y"), 6)
    return tiles(s, d, 6).select("id", r6(w).alias("west"), r6(e).alias("east"), r6(n).alias("north"), r6(so).alias("south"))


@query("j3_relatives", f"SELECT id, [2*x, 2*x+1] AS child_x, [2*y, 2*y+1] AS child_y, 63-y AS tms_y, xor(x, 1::BIGINT) AS sibling_x FROM (SELECT id, {TILE.format(m=63, n=64)} FROM fx_points)")
def j3(s, d):
    return tiles(s, d, 6).select("id", F.array(2 * c("x"), 2 * c("x") + 1).alias("child_x"), F.array(2 * c("y"), 2 * c("y") + 1).alias("child_y"), (63 - c("y")).alias("tms_y"), c("x").bitwiseXOR(F.lit(1).cast("long")).alias("sibling_x"))


def tx(v, n):
    return f"greatest(0, least({n - 1}, floor(({v}+180)/360*{n})))::BIGINT"


def ty(v, n):
    return f"greatest(0, least({n - 1}, floor((1-asinh(tan(radians({v})))/pi())/2*{n})))::BIGINT"


@query("j4_covering_tiles", f"SELECT id, x, y FROM (SELECT id, unnest(range({tx('minx', 32)}, {tx('maxx', 32)}+1)) AS x, {ty('maxy', 32)} AS y0, {ty('miny', 32)} AS y1 FROM (SELECT id, minx, maxx, greatest(miny, -85) AS miny, least(maxy, 85) AS maxy FROM fx_rects)), range(32) t(y) WHERE y BETWEEN y0 AND y1")
def j4(s, d):
    r = load(s, d, "fx_rects")
    x0, y1 = geo.tile(c("minx"), F.greatest("miny", F.lit(-85.0)), 5)
    x1, y0 = geo.tile(c("maxx"), F.least("maxy", F.lit(85.0)), 5)
    return r.select("id", y0.alias("y0"), y1.alias("y1"), F.explode(F.sequence(x0, x1)).alias("x")).select("id", "x", F.explode(F.sequence("y0", "y1")).alias("y"))


@query("j5_seeding", f"SELECT DISTINCT z, x>>(6-z) AS x, y>>(6-z) AS y FROM (SELECT {TILE.format(m=63, n=64)} FROM fx_points), (SELECT unnest([3, 4, 5, 6])::INT AS z)")
def j5(s, d):
    each = tiles(s, d, 6).select("x", "y").distinct().withColumn("z", F.explode(F.sequence(F.lit(3), F.lit(6))))
    return each.select("z", F.expr("shiftright(x, 6 - z)").alias("x"), F.expr("shiftright(y, 6 - z)").alias("y")).distinct()


@query("j6_features_to_tiles", f"SELECT id, x, y FROM (SELECT id, unnest(range({tx('lon-0.5', 128)}, {tx('lon+0.5', 128)}+1)) AS x, {ty('least(lat+0.5, 85)', 128)} AS y0, {ty('greatest(lat-0.5, -85)', 128)} AS y1 FROM fx_points), range(128) t(y) WHERE y BETWEEN y0 AND y1")
def j6(s, d):
    x0, y1 = geo.tile(c("lon") - 0.5, F.greatest(c("lat") - 0.5, F.lit(-85.0)), 7)
    x1, y0 = geo.tile(c("lon") + 0.5, F.least(c("lat") + 0.5, F.lit(85.0)), 7)
    p = load(s, d, "fx_points").select("id", y0.alias("y0"), y1.alias("y1"), F.explode(F.sequence(x0, x1)).alias("x"))
    return p.select("id", "x", F.explode(F.sequence("y0", "y1")).alias("y"))


@query("j8_tile_pixels", f"SELECT id, floor(4096*((lon+180)/360*64-x))::BIGINT AS px, floor(4096*((1-asinh(tan(radians(lat)))/pi())/2*64-y))::BIGINT AS py FROM (SELECT id, lon, lat, {TILE.format(m=63, n=64)} FROM fx_points)")
def j8(s, d):
    fx, fy = (c("lon") + 180) / 360 * 64, (1 - F.asinh(F.tan(F.radians("lat"))) / math.pi) / 2 * 64
    return tiles(s, d, 6).select("id", F.floor(4096 * (fx - c("x"))).alias("px"), F.floor(4096 * (fy - c("y"))).alias("py"))


@query("j10_overzoom", f"SELECT id, x>>3 AS source_x, y>>3 AS source_y, x%8 AS dx, y%8 AS dy, 8 AS scale FROM (SELECT id, {TILE.format(m=511, n=512)} FROM fx_points)")
def j10(s, d):
    return tiles(s, d, 9).select("id", F.shiftright("x", 3).alias("source_x"), F.shiftright("y", 3).alias("source_y"), (c("x") % 8).alias("dx"), (c("y") % 8).alias("dy"), F.lit(8).alias("scale"))


@query("j11_attributes", "SELECT k, count(*) AS n, count(DISTINCT v) AS distinct_values, max(length(v)) AS longest FROM (SELECT unnest(['name', 'brand', 'size']) AS k, unnest([left(p_name, 12), p_brand, p_size::VARCHAR]) AS v FROM part) GROUP BY 1")
def j11(s, d):
    m = F.create_map(F.lit("name"), F.left("p_name", F.lit(12)), F.lit("brand"), c("p_brand"), F.lit("size"), c("p_size").cast("string"), F.lit("kind"), c("p_type"))
    keep = F.map_filter(m, lambda k, v: k.isin("name", "brand", "size"))
    return load(s, d, "part").select(F.explode(keep).alias("k", "v")).groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("v").alias("distinct_values"), F.max(F.length("v")).cast("long").alias("longest"))


@query("j13_tilejson", "SELECT '3.0.0' AS tilejson, 0 AS minzoom, 8 AS maxzoom, round(min(lon), 6) AS west, round(min(lat), 6) AS south, round(max(lon), 6) AS east, round(max(lat), 6) AS north FROM fx_points")
def j13(s, d):
    p = load(s, d, "fx_points").agg(*[r6(f(k)).alias(n) for n, f, k in (("west", F.min, "lon"), ("south", F.min, "lat"), ("east", F.max, "lon"), ("north", F.max, "lat"))])
    return p.select(F.lit("3.0.0").alias("tilejson"), F.lit(0).alias("minzoom"), F.lit(8).alias("maxzoom"), "west", "south", "east", "north")
