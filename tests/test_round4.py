"""Cases of the fourth round: events of one time, and boxes that meet in the rounding alone."""

import math

import pytest

from lodestar.fixtures import TABLES
from lodestar.registry import QUERIES


def table_of(folder, name, sql):
    """A table for queries to read, from SQL."""
    import duckdb

    duckdb.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def events(folder, rows):
    """Events (event_id, second of the day, user_id, value), all of one kind."""
    values = ", ".join(f"({i}, {at}, {user}, {v})" for i, at, user, v in rows)
    return table_of(folder, "events", f"SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-01' + to_seconds(sec) AS ts, u::BIGINT AS user_id, 'view' AS event_type, v::DOUBLE AS value, '' AS props FROM (VALUES {values}) t(i, sec, u, v)")


def test_rate_of_events_of_one_time(spark, tmp_path):
    """a rise in no time stopped the query; it is infinite, as in the SQL, and nothing over nothing is no number."""
    at = events(tmp_path, [(1, 10, 5, 1.0), (2, 12, 5, 5.0), (3, 12, 5, 6.0), (4, 12, 5, 6.0), (5, 14, 5, 4.0)])
    got = {r.event_id: r.rate for r in QUERIES["m4_rate_per_second"](spark, at).collect()}
    assert math.isnan(got.pop(4)) and got == {2: 2.0, 3: math.inf, 5: 2.0}


def test_fixes_of_one_time_keep_the_order_of_their_ids(spark, tmp_path):
    """the order was that of their places, so a track that goes to and fro in one second came out short."""
    rows = [(1, 0, 7, 0), (97, 0, 7, 0), (98, 0, 7, 0), (99, 0, 7, 0)]
    at = events(tmp_path, rows)
    place = lambda k: ((k * 37) % 3600 / 10 - 180, (k * 53) % 1700 / 10 - 85)
    places = [place(r[0]) for r in rows]
    way = sum(math.dist(p, q) for p, q in zip(places, places[1:]))
    got = QUERIES["d27_densify"](spark, at).first()
    assert sorted(places) != places and got.length == pytest.approx(way, abs=1e-3)


def test_a_segment_that_parts_fill_is_cut_as_in_the_sql(spark):
    """`hypot` is one digit off the root of the sum of squares, so a length of thirty came out a part short."""
    from pyspark.sql import functions as F

    from lodestar.functions import geometry as Y

    spans = [(dx / 10, dy / 10) for dx in range(0, 3000, 7) for dy in range(0, 1700, 11)]
    odd = [(x, y) for x, y in spans if math.ceil(math.hypot(x, y)) != math.ceil(math.sqrt(x * x + y * y))]
    df = spark.createDataFrame(odd, "x double, y double").withColumn("line", F.array(Y.point(F.lit(0.0), F.lit(0.0)), Y.point(F.col("x"), F.col("y"))))
    got = df.select("x", "y", F.size(Y.densify(F.col("line"), 1.0)).alias("n")).collect()
    assert odd and all(r.n == 1 + math.ceil(math.sqrt(r.x * r.x + r.y * r.y)) for r in got)


def test_boxes_that_meet_in_the_rounding_alone(spark, tmp_path):
    """quadrilaterals whose boxes miss each other by the last digit of a number were a pair; the SQL does not meet them."""
    from oracle import compare

    from lodestar.registry import ORACLE

    at = table_of(tmp_path, "customer", "SELECT k::BIGINT AS c_custkey, 1::INTEGER AS c_nationkey, '' AS c_name, 0.0::DOUBLE AS c_acctbal, '' AS c_mktsegment FROM (VALUES (374), (35974), (767), (37267), (73217), (3), (5)) t(k)")
    for other in TABLES:
        if other != "customer":
            table_of(tmp_path, other, "SELECT 1 AS unused")
    assert compare(spark, at, "e16_holed_overlay", QUERIES["e16_holed_overlay"], ORACLE["e16_holed_overlay"]) == ""
    rings = {(r.id, r.id2) for r in QUERIES["e16_overlay_rings"](spark, at).collect()}
    assert (374, 35974) not in rings


@pytest.mark.parametrize("name", ["d20_matrix", "d19_predicates", "d23_overlay", "d19_lines"])
def test_pairs_of_one_shape_are_related_once(spark, tmp_path, monkeypatch, name):
    """every pair of lots was overlaid, though lots have few shapes."""
    from oracle import compare

    from lodestar.operators import overlay as O
    from lodestar.registry import ORACLE

    at = table_of(tmp_path, "supplier", "SELECT (k+6300*n)::BIGINT AS s_suppkey, ((k+n)%5)::INTEGER AS s_nationkey, '' AS s_name, 0.0::DOUBLE AS s_acctbal FROM (VALUES (100), (400), (2200)) t(k), range(9) r(n)")
    for other in TABLES:
        if other != "supplier":
            table_of(tmp_path, other, "SELECT 1 AS unused")
    met, step = [], "line_matrix" if name == "d19_lines" else "arrangement"
    real = getattr(O, step)
    monkeypatch.setattr(O, step, lambda a, b, pairs, band: (met.append(pairs.count()), real(a, b, pairs, band))[1])
    assert compare(spark, at, name, QUERIES[name], ORACLE[name]) == ""
    assert len(met) == 1 and 3 <= met[0] <= 9


def test_long_rings_do_not_fill_the_planner(spark):
    """F8: the size that the planner takes for a ring's pointers doubled in digits each round."""
    from pyspark.sql import functions as F

    from lodestar.operators import overlay as O

    nodes = spark.range(300).select(F.col("id").alias("node"), ((F.col("id") + 1) % 300).alias("follows"))
    got = O._doubling(nodes)
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 500
    assert sorted((r.ring, r.place, r.node) for r in got.collect()) == [(0, k - 299, k) for k in range(300)]


@pytest.mark.parametrize("name", ["d23_box_overlay", "e16_layer_intersect", "e5_box_join"])
def test_pairs_of_boxes_are_dealt_to_the_cores(spark, name):
    """the few boxes that are read made one task of all their pairs."""
    found = QUERIES[name](spark, "/root/testdata/sf0.01")
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_boxes_that_meet_none_stay_once(spark):
    """what a left join gives for boxes that meet none, whatever cells they are in, and for boxes without a corner."""
    from pyspark.sql import functions as F

    from lodestar.operators import geostat as T

    rows = [(1, 0.0, 0.0, 25.0, 25.0, 1), (2, 24.0, 24.0, 30.0, 30.0, 2), (3, 50.0, 50.0, 90.0, 90.0, 1), (4, 50.0, 50.0, 90.0, 90.0, 1), (5, None, 0.0, 1.0, 1.0, 1), (3, 50.0, 50.0, 90.0, 90.0, 1), (6, 0.0, 0.0, 25.0, 25.0, None)]
    a = spark.createDataFrame(rows, "id long, minx double, miny double, maxx double, maxy double, grp int")
    b = a.select(*[F.col(k).alias(f"{k}2") for k in a.columns])
    assert sorted(r.id for r in T.boxes_alone(a, b, 20.0, "grp", 4).collect()) == [3, 3, 4, 5, 6]
