"""Neighbourhoods by sums: many points in few places, whose pairs would be 2.5 billion or more, and plain loops over a few points."""

import math

import pytest
from pyspark.sql import functions as F

from lodestar.operators import geostat as T

N = 100_000


@pytest.fixture(scope="module")
def crowd(spark):
    """Half of the points in one place with the value 1, half a step of 1 away with the value 3, and one far off."""
    p = spark.range(N).select("id", F.when(F.col("id") % 2 == 0, 0.0).otherwise(1.0).alias("lon"), F.lit(0.0).alias("lat"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(3.0).alias("value"))
    return p.unionByName(spark.createDataFrame([(N, 500.0, 0.0, 2.0)], "id long, lon double, lat double, value double"))


@pytest.fixture(scope="module")
def few(spark):
    rows = [(k, (k * 37 % 101) / 7.0, (k * 53 % 89) / 7.0, None if k == 5 else float(k % 11)) for k in range(150)] + [(150, None, 1.0, 4.0), (151, 1.0, 1.0, 2.0), (152, 1.0, 1.0, 7.0)]
    return rows, spark.createDataFrame(rows, "id long, lon double, lat double, value double")


def near(rows, r):
    return [(a, b, d) for a in rows for b in rows if a[0] != b[0] and None not in (a[1], b[1]) and (d := math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2)) <= r]


def test_morans_i_of_a_crowd(crowd):
    got = T.morans_i(crowd, 0.5).first()
    assert got.i == pytest.approx((N + 1) / N) and got.n == N + 1


def test_inverse_weights_leave_out_pairs_in_one_place(crowd):
    assert T.morans_i(crowd, 1.5, inverse=True).first().i == pytest.approx(-(N + 1) / N)


def test_local_moran_of_a_crowd(crowd):
    got = {r.id: r for r in T.local_moran(crowd, 0.5).where("id < 2 OR id = 100000").collect()}
    assert set(got) == {0, 1} and got[0]["class"] == "LL" and got[1]["class"] == "HH" and got[0].geary == pytest.approx(0, abs=1e-9)


def test_weights_of_neighbours(few):
    rows, df = few
    pairs = near(rows, 3.0)
    n = {}
    for a, _, _ in pairs:
        n[a[0]] = n.get(a[0], 0) + 1
    assert {(r.id, r.id2): r.w for r in T.weights(df, 3.0).collect()} == {(a[0], b[0]): 1 / n[a[0]] for a, b, _ in pairs}


def test_dbscan_of_a_crowd(crowd):
    got = T.dbscan(crowd, 1.5, 4).groupBy("core", "cluster").count().collect()
    assert {(r.core, r.cluster, r["count"]) for r in got} == {(True, 0, N), (False, None, 1)}


def test_others_around_a_point(few):
    rows, df = few
    want = {}
    for a, b, _ in near(rows, 4.0):
        want.setdefault(a[0], []).append(b[3])
    got = {r.id: r for r in T.around(df, 4.0, 2.0).collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        have = [x - 2 for x in v if x is not None]
        assert (got[k].n, got[k].k) == (len(v), len(have)) and got[k].s == pytest.approx(sum(have)) and got[k].q == pytest.approx(sum(x * x for x in have))


def test_regression_sums_of_a_crowd(spark, crowd):
    site = spark.createDataFrame([(7, 0.0, 0.0)], "id2 long, lon2 double, lat2 double")
    got = T.regression_around(crowd.withColumn("lat", F.col("lon")), site, 2.0).first()
    assert got.w == pytest.approx(N / 2 * 1.25) and got.x == pytest.approx(N / 2 * 0.25) and got.xy == pytest.approx(3 * N / 2 * 0.25) and got.y == pytest.approx(N / 2 * 1.75)


def test_variogram_of_a_crowd(crowd):
    got = {r.lag: (r.n, round(r.gamma, 9)) for r in T.variogram(crowd, 4.0, 1.0).collect()}
    half = N // 2
    assert got == {0: (half * (half - 1), 0.0), 1: (half * half, 2.0)}


def test_linked_points_against_a_plain_search(few):
    from lodestar.operators.nearby import linked

    rows, df = few
    up = {r[0]: r[0] for r in rows}
    for _ in rows:
        for a, b, _ in near(rows, 0.9):
            up[a[0]] = up[b[0]] = min(up[a[0]], up[b[0]])
    assert {r.id: r.component for r in linked(df, 0.9).collect()} == up and len(set(up.values())) > 3


def test_hot_spots_of_a_crowd(crowd):
    got = {r.id: r.z for r in T.hot_spots(crowd, 0.5).where("id < 2 OR id = 100000").collect()}
    assert got[1] == pytest.approx(math.sqrt(N / 2), rel=1e-4) and got[0] == pytest.approx(-got[1]) and got[100000] == pytest.approx(0, abs=1e-9)


def test_nearest_of_a_crowd_and_ties(spark, crowd):
    from lodestar.operators import spatial as S

    p = crowd.select("id", "lon", "lat")
    b = p.select(F.col("id").alias("id2"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    got = S.nearest(p, b, 2, 8.0).where("id > 99997").orderBy("id", "rank").collect()
    assert [(r.id, r.id2, r.distance) for r in got] == [(99998, 0, 0.0), (99998, 2, 0.0), (99999, 1, 0.0), (99999, 3, 0.0), (100000, 100000, 0.0), (100000, 1, 499.0)]
    assert [r.id2 for r in S.nearest(p.where("id = 100000"), b.where("id2 < 9"), 2, 8.0, most=15.0).collect()] == []


def test_box_overlay_builds_no_rings(spark):
    from lodestar.registry import QUERIES

    plan = QUERIES["d23_box_overlay"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_phrase_splits_a_text_a_fixed_number_of_times(spark):
    import time

    from lodestar.operators.search import phrase

    df = spark.createDataFrame([(1, "of the " * 20_000), (2, "of of the, OF The x of"), (3, "of"), (4, None), (5, "the the the")], "id long, t string")
    start = time.time()
    assert {r.id: r.n for r in phrase(df, "id", "t", ["of", "the"]).collect()} == {1: 20_000, 2: 2}
    assert {r.id: r.n for r in phrase(df, "id", "t", ["the", "the"]).collect()} == {5: 2} and time.time() - start < 30
