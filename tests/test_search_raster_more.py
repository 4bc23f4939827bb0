import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import raster as A
from lodestar.operators import search as X


def test_water_runs_as_a_walk_tells(spark):
    rnd = random.Random(4)
    n = 12
    steps = {(r, c): rnd.choice([(0, 1), (1, 0), (1, 1), (0, 0)]) for r in range(n) for c in range(n)}
    df = spark.createDataFrame([(r, c, 0, dr, dc) for (r, c), (dr, dc) in steps.items()], "r long, c long, code int, dr int, dc int")
    want = dict.fromkeys(steps, 0)
    for cell in steps:
        at = cell
        while steps[at] != (0, 0):
            at = (at[0] + steps[at][0], at[1] + steps[at][1])
            if at not in steps:
                break
            want[at] += 1
    assert {(r.r, r.c): r.upstream for r in A.flow_accumulation(df).collect()} == want
    assert A.flow_accumulation(df.where("false")).count() == 0


def test_sounds_and_fields(spark):
    rows = [(1, "Robert met Rupert; robert left", "steel"), (2, "Rubin", None), (3, None, "robert"), (4, "Röbert x1", "")]
    df = spark.createDataFrame(rows, "id long, text string, other string")
    got = {(r.id, r.asked): (r.terms, r.n) for r in X.sounds_like(df, "id", "text", ["robert", "ruben"]).collect()}
    assert got == {(1, "robert"): (["robert", "rupert"], 3), (2, "ruben"): (["rubin"], 1)}
    scores = {how: {r.id: r.score for r in X.multi_match(df, "id", {"text": 2.0, "other": 1.0}, ["robert", "steel"], how).collect()} for how in ("best", "most", "cross")}
    assert set(scores["best"]) == {1, 3} and scores["most"][1] > scores["best"][1] and scores["cross"][1] >= scores["best"][1]
    with pytest.raises(ValueError):
        X.multi_match(df, "id", {"text": 1.0}, ["x"], "worst")
    assert X.bm25(df.where("false"), "id", "text", ["a"]).count() == 0


def test_sun_on_slopes(spark):
    flat = spark.createDataFrame([(r, c, 5.0) for r in range(3) for c in range(3)], "r long, c long, z double")
    assert [tuple(r) for r in A.sunlit(flat, "z", 40.0, 90.0).collect()] == [(1, 1, 1.0)]
    steep = flat.withColumn("z", F.col("c") * 2.0)
    r = A.sunlit(steep, "z", 40.0, 0.0).first()
    assert r.factor != 1.0 and A.high_pass(flat, "z", []).where("detail <> 0").count() == 0
