import pytest
from pyspark.sql import functions as F
from oracle import compare

from lodestar.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert compare(spark, SF, name, QUERIES[name], ORACLE[name]) == ""


def test_shortest_paths_agree_with_single_source(spark):
    rows = QUERIES["f8_od_matrix"](spark, SF).collect()
    one = {r.node: r.cost for r in QUERIES["f5_shortest_paths"](spark, SF).collect()}
    assert {r.node: r.cost for r in rows if r.origin == 0} == one and len(rows) == 625


def test_index_keeps_every_posting(spark):
    rows = QUERIES["k4_index"](spark, SF).collect()
    assert sum(r.tf for r in rows) == sum(r.n for r in QUERIES["k1_analyze"](spark, SF).collect())
    assert all(len(set(r.positions)) == r.tf <= r.dl for r in rows) and sum(r.tf <= 3 for r in rows) > len(rows) / 2


def test_shuffled_column_keeps_its_values(spark):
    rows, real = QUERIES["n13_shuffle_column"](spark, SF).collect(), spark.read.parquet(f"{SF}/customer.parquet").collect()
    assert sorted(r.c_acctbal for r in rows) == sorted(r.c_acctbal for r in real)
    own = {r.c_custkey: r.c_acctbal for r in real}
    assert sum(own[r.c_custkey] == r.c_acctbal for r in rows) < 10


def test_token_bucket_by_hand(spark):
    from lodestar.operators.events import token_bucket

    rows = [(k, 1, f"2024-01-01 00:00:{t:02d}") for k, t in enumerate((0, 0, 0, 10, 10, 30))] + [(9, 1, "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.id: r.allowed for r in token_bucket(df, "user_id", "ts", 2, 0.1).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: False, 5: True, 9: True}


def test_schema_changes(spark):
    got = {r.column: (r.change, r.compatible) for r in QUERIES["n25_schema_changes"](spark, SF).collect()}
    assert got == {"o_orderpriority": ("removed", False), "o_totalprice": ("type", False), "o_note": ("added", False)}


def test_detected_language_and_parents_of_list_items(spark):
    rows = QUERIES["k3_language"](spark, SF).collect()
    told = [r for r in rows if r.guess]
    assert told and sum(r.guess == r.lang for r in told) > 0.7 * len(told)
    up = {(r.tag, r.parent_tag) for r in QUERIES["q1_parents"](spark, SF).collect()}
    assert ("li", "ul") in up and ("title", "head") in up and ("a", "li") in up and ("h1", "article") in up


def test_learners(spark):
    rows = QUERIES["g15_random_forest"](spark, SF).collect()
    assert sum(r.label == r.prediction for r in rows) > 0.8 * len(rows)
    parts = [r.part for r in QUERIES["g12_split"](spark, SF).collect()]
    assert 0.65 < parts.count("train") / len(parts) < 0.95
