"""Cases that once came out wrong: places shared by several points, and a bucket that a new day must not refill."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.operators import relational as R
from lodestar.operators import spatial as S
from lodestar.operators.events import token_bucket


def test_points_that_share_a_place_keep_their_nearest_neighbour(spark):
    a = spark.createDataFrame([(1, 5.0, 5.0), (2, 5.0, 5.0), (3, 5.0, 5.0), (4, 6.0, 5.0), (5, 9.0, 9.0)], "id long, lon double, lat double")
    b = a.select(F.col("id").alias("id2"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    got = {r.id: round(r.x, 6) for r in S.nearest(a, b, 2, 8.0).where("id <> id2").groupBy("id").agg(F.min("distance").alias("x")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1, 5: 5}


def test_a_bucket_is_not_refilled_at_midnight(spark):
    rows = [(k, 1, t) for k, t in enumerate(("2024-01-01 23:59:58", "2024-01-01 23:59:59", "2024-01-02 00:00:00", "2024-01-02 00:00:01", "2024-01-02 12:00:00"))] + [(9, None, "2024-01-01 10:00:00")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.id: r.allowed for r in token_bucket(df, "user_id", "ts", 2, 1 / 3600).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 9: True}


def test_places_in_a_whole_order(spark):
    df = spark.range(500).select("id", (F.col("id") * 37 % 101).alias("v")).withColumn("v", F.when(F.col("v") != 7, F.col("v"))).repartition(7)
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    want = {r.id: r.n for r in df.select("id", F.row_number().over(Window.orderBy(*order)).alias("n")).collect()}
    assert {r.id: r.place for r in R.placed(df, order).collect()} == want and R.placed(df.where("false"), order).count() == 0
