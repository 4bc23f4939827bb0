import pytest
from pyspark.sql import functions as F

from lodestar.operators import relational as R
from lodestar.operators import spatial as S


def test_condition_refuses_unknown_operators():
    with pytest.raises(KeyError):
        R.condition({"field": "a", "op": "nope", "value": 1})


def test_build_offset_and_nulls_last(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 1.0)], "k int, v double")
    assert [r.k for r in R.build(df, sort=[("v", True)], limit=3).collect()] == [2, 3, 1]
    assert [r.k for r in R.build(df, sort=[("v", False)], offset=1).collect()] == [2, 1]


def test_nearest_index_is_cut_to_the_last(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5)], "v double")
    assert df.agg(R.nearest_index("v", 0.5).alias("a"), R.nearest_index("v", 1.0).alias("b")).first() == (3.0, 5.0)


def test_knn_equals_all_pairs(spark):
    pts = spark.range(200).select("id", ((F.col("id") * 37) % 100).cast("double").alias("lon"), ((F.col("id") * 53) % 90).cast("double").alias("lat"))
    other = pts.select(F.col("id").alias("id2"), (F.col("lon") + 0.25).alias("lon2"), (F.col("lat") * 0.9).alias("lat2")).where("id2 % 4 = 0")
    got = {(r.id, r.rank, r.id2) for r in S.nearest(pts, other, 2, 1.0).collect()}
    p, q = pts.collect(), other.collect()
    for a in p:
        best = sorted((((a.lon - b.lon2) ** 2 + (a.lat - b.lat2) ** 2) ** 0.5, b.id2) for b in q)[:2]
        assert {(a.id, k + 1, i) for k, (_, i) in enumerate(best)} <= got


def test_spatial_join_is_an_equi_join(spark):
    pts = spark.createDataFrame([(1, 5.0, 5.0)], "id long, lon double, lat double")
    boxes = spark.createDataFrame([(7, 0.0, 0.0, 25.0, 25.0)], "box long, minx double, miny double, maxx double, maxy double")
    out = S.points_in_boxes(pts, boxes, 10.0)
    assert out.count() == 1 and "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_rounds_that_end_too_early_are_an_error(spark):
    from lodestar.operators.graph import components

    chain = spark.createDataFrame([(k, k + 1, 1.0) for k in range(8)], "src long, dst long, cost double")
    one, nodes = spark.createDataFrame([(0,)], "origin long"), spark.range(9).select(F.col("id").alias("node"))
    for short, enough, n in ((lambda: S.shortest_paths(chain, one, rounds=2), lambda: S.shortest_paths(chain, one), 9), (lambda: components(chain, nodes, 1), lambda: components(chain, nodes), 9)):
        with pytest.raises(RuntimeError):
            short()
        assert enough().count() == n
