import math
import random

from lodestar.llm.topk import top_k


def brute(rows, k=10):
    good = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: v for i, v in good if i % 100 == 0}.items():
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found)}
    return out


def test_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(900)]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)] + [(1400, None), (1500, [1.0, None] + [0.0] * 6), (1600, [float("nan")] * 8), (1700, [float("inf")] * 8), (None, [0.1] * 8), (1800, []), (2000, [1.0, 2.0]), (2001, [3.0, 4.0]), (2100, [1e12] * 8)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, slot string").repartition(5)
    got = {tuple(r) for r in top_k(df.where("vec_id % 100 = 0"), df, query_block=4, tile_rows=100).collect()}
    assert got == brute(rows)


def test_empty_and_few(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(none, none).collect() == []
    one = spark.createDataFrame([(0, [1.0, 1.0]), (5, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(one.where("vec_id = 0"), one).collect()] == [(0, 1, 5, 3 * 1024 * 1024)]


def test_repeated_queries_and_numbers_too_large_to_scale(spark):
    rows = [(0, [2.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1e307, 1.0]), (3, [-1e307, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in top_k(df.where("vec_id = 0"), df.repartition(3)).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 2**63 - 1), (0, 2, 1, 1024 * 1024), (0, 3, 3, -(2**63 - 1))]
