import math
import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions import geo
from lodestar.functions import geometry as Y
from lodestar.operators import geostat as T
from lodestar.operators import graph as G
from lodestar.operators import raster as A


def regular(n, r, x, y, turn=0.0):
    ring = [(x + r * math.cos(turn + 2 * math.pi * k / n), y + r * math.sin(turn + 2 * math.pi * k / n)) for k in range(n)]
    return ring + ring[:1]


def test_clipping_agrees_with_counting_points(spark):
    rnd = random.Random(1)
    rings = [(k, regular(rnd.randrange(3, 9), rnd.uniform(1, 4), rnd.uniform(-3, 3), rnd.uniform(-3, 3), rnd.random())) for k in range(20)]
    df = spark.createDataFrame(rings, f"id int, ring {Y.RING}").withColumn("part", Y.clip_to_box(F.col("ring"), *map(F.lit, (-1.0, -2.0, 2.0, 1.5))))
    got = {r.id: r.a or 0.0 for r in df.select("id", Y.area(F.col("part")).alias("a")).collect()}
    grid = spark.range(40_000).select((-1 + 3 * ((F.col("id") % 200) + 0.5) / 200).alias("x"), (-2 + 3.5 * (F.floor(F.col("id") / 200) + 0.5) / 200).alias("y"))
    counted = {r.id: r.n for r in df.join(grid, Y.inside(F.col("x"), F.col("y"), F.col("ring"))).groupBy("id").agg(F.count("*").alias("n")).collect()}
    for k in got:
        assert abs(got[k] - counted.get(k, 0) * 3 * 3.5 / 40_000) < 0.05


def test_hull_simplification_and_smoothing(spark):
    rnd = random.Random(2)
    pts = [(rnd.random(), rnd.random()) for _ in range(60)]
    hull = Y.hull(pts)
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    assert hull[0] == hull[-1] and all(turn(a, b, p) >= -1e-12 for a, b in zip(hull, hull[1:]) for p in pts)
    assert Y.hull([(1, 1), (1, 1)]) == [(1, 1), (1, 1)]
    line = [(k / 10, math.sin(k / 10)) for k in range(100)]
    few = Y.far_points(line, 0.01)
    assert 3 < len(few) < 40 and few[0] == line[0] and few[-1] == line[-1]
    near = lambda p: min(abs((b[0] - a[0]) * (a[1] - p[1]) - (a[0] - p[0]) * (b[1] - a[1])) / math.dist(a, b) for a, b in zip(few, few[1:]) if a[0] <= p[0] <= b[0])
    assert all(near(p) <= 0.01 + 1e-9 for p in line)
    df = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)],)], f"l {Y.RING}")
    r = df.select(Y.chaikin(F.col("l")).alias("c"), Y.densify(F.col("l"), 1.5).alias("d"), Y.thinned(F.col("l"), 5.0).alias("t")).first()
    assert [tuple(p) for p in r.c] == [(0, 0), (1, 0), (3, 0), (4, 1), (4, 3), (4, 4)] and len(r.d) == 7 and [tuple(p) for p in r.t] == [(0, 0), (4, 4)]


def test_repair_mends_what_validation_finds(spark):
    good = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    rings = [(1, good[:3]), (2, good[::-1]), (3, good[:1] + good), (4, good), (5, [(0.0, 0.0), (200.0, 0.0), (4.0, 4.0), (0.0, 0.0)])]
    df = spark.createDataFrame(rings, f"id int, ring {Y.RING}")
    found = {r.id: set(r.i) for r in df.select("id", Y.issues(F.col("ring")).alias("i")).collect()}
    assert found == {1: {"not_closed", "too_few_points"}, 2: {"clockwise"}, 3: {"repeated_point"}, 4: set(), 5: {"out_of_range"}}
    again = df.where("id < 5").select(Y.repaired(F.col("ring")).alias("r")).select(Y.issues(F.col("r")).alias("i"), Y.area(F.col("r")).alias("a")).collect()
    assert all(r.i == [] and r.a == 8.0 for r in again)


def test_datum_shift_there_and_back(spark):
    move, turn, ppm = (-446.448, 125.157, -542.06), (-0.1502, -0.247, -0.8421), 20.4894
    df = spark.createDataFrame([(-1.5, 52.0), (10.0, -40.0)], "lon double, lat double")
    lon, lat, h = geo.datum_shift(F.col("lon"), F.col("lat"), F.lit(0.0), move, turn, ppm)
    one = df.select("lon", "lat", lon.alias("a"), lat.alias("b"), h.alias("h"))
    lon, lat, h = geo.datum_shift(F.col("a"), F.col("b"), F.col("h"), tuple(-v for v in move), tuple(-v for v in turn), -ppm)
    for r in one.select("lon", "lat", "a", "b", lon.alias("x"), lat.alias("y")).collect():
        assert 1e-4 < abs(r.a - r.lon) + abs(r.b - r.lat) < 0.02 and abs(r.x - r.lon) < 1e-6 and abs(r.y - r.lat) < 1e-6


def test_kriging_gives_samples_back_and_its_variance_grows(spark):
    rows = [(t, i, float(x), float(y), float(v), tx, ty) for t, (tx, ty) in enumerate([(0.0, 0.0), (0.5, 0.5), (9.0, 9.0)]) for i, (x, y, v) in enumerate([(0, 0, 5), (1, 0, 7), (0, 1, 9), (1, 1, 3)])]
    got = {r.t: r for r in T.kriging(spark.createDataFrame(rows, "t long, id long, lon double, lat double, value double, lon2 double, lat2 double"), "t", 1.0, 10.0).collect()}
    assert abs(got[0].estimate - 5) < 1e-6 and abs(got[1].estimate - 6) < 1e-6 and got[0].variance < got[1].variance < got[2].variance


def test_kmeans_finds_two_groups(spark):
    pts = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 1.0), (2, 10.0, 10.0), (3, 11.0, 11.0)], "id long, lon double, lat double")
    assert sorted(T.kmeans(pts, [(0.0, 0.0), (1.0, 1.0)], 10)) == [(0.5, 0.5), (10.5, 10.5)]


def test_contours_lie_on_their_level_and_views_are_blocked(spark):
    dem = spark.createDataFrame([(r, c, float(r + 2 * c)) for r in range(6) for c in range(6)], "r long, c long, z double")
    rows = A.contour_segments(dem, "z", [4.5]).collect()
    assert rows and all(abs(x["y1"] + 2 * x["x1"] - 4.5) < 1e-9 and abs(x["y2"] + 2 * x["x2"] - 4.5) < 1e-9 for x in rows)
    wall = spark.createDataFrame([(0, c, 9.0 if c == 3 else 0.0) for c in range(7)], "r long, c long, z double")
    assert {x.c: x.visible for x in A.visible(wall, "z", (0, 0), 1.0, 10).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False}


def test_graph_errors_and_components(spark):
    nodes = spark.range(60).select(F.col("id").alias("node"))
    links = spark.range(59).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).where("src % 20 <> 19")
    got = {r.node: r.component for r in G.components(links, nodes).collect()}
    assert got == {k: k // 20 * 20 for k in range(60)}
    ring = spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "src long, dst long")
    with pytest.raises(RuntimeError):
        G.dag_levels(spark.range(3).select(F.col("id").alias("node")), ring)
    assert sorted(tuple(r.path) for r in G.simple_paths(ring, spark.createDataFrame([(0,)], "node long"), 3).collect()) == [(0, 1), (0, 1, 2)]
