import math
import random

import numpy as np

from lodestar.llm.whitening import op12_whitening, whiten

COLUMNS = "vec_id long, embedding array<double>, label int, n long, x string"


def brute(rows, components=32):
    good = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in good], float)
    n, total = len(good), [sum(v[j] for _, v in good) for j in range(x.shape[1])]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, total)] for _, v in good])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    y = centred @ vectors / np.sqrt(values)
    dev = [sum((n * c - s) ** 2 for c, s in zip(v, total)) for _, v in good]
    return good, n, dev, y, values / np.trace(centred.T @ centred / n)


def check(got, rows):
    good, n, dev, y, explained = brute(rows)
    k = y.shape[1]
    by = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(good) * k == len(by)
    for c in range(k):
        ours = np.array([by[i, c + 1].whitened for i, _ in good])
        assert np.allclose(ours, y[:, c] * np.sign(ours @ y[:, c]), atol=1e-7)
        assert {by[i, c + 1].explained for i, _ in good} == {got_e := by[good[0][0], c + 1].explained} and abs(got_e - explained[c]) < 1e-9
    assert [(by[i, 1].n, by[i, 1].deviation) for i, _ in good] == [(n, d) for d in dev]
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_against_brute_force(spark):
    rnd = random.Random(3)
    axes = [[rnd.gauss(0, 1) for _ in range(12)] for _ in range(12)]
    rows = []
    for i in range(700):
        a = [rnd.gauss(0, 1 + j) for j in range(12)]
        rows.append((i, [sum(a[j] * axes[j][c] for j in range(12)) for c in range(12)]))
    rows += [(900 + i, rows[5][1]) for i in range(60)] + [(1000, None), (1001, []), (1002, [None] * 12), (1003, [float("nan")] * 12), (1004, [float("inf")] * 12), (1005, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], COLUMNS).repartition(5)
    check(whiten(df, block_cells=600).collect(), [r for r in rows if r[0] != 1005])


def test_whole_table(spark):
    where = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{where}/embeddings.parquet").collect()]
    check(op12_whitening(spark, where).collect(), rows)


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (4, [3.0, 1.0]), (4, [3.0, 1.0]), (5, [0.0, 7.0])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 10 and sum(r.vec_id is None for r in got) == 4 and {r.n for r in got} == {5}


def test_degenerate(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert whiten(none).collect() == []
    one = whiten(spark.createDataFrame([(1, [0.5, 1.0, 2.0]), (2, [0.5, 1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert len(one) == 6 and all(r.whitened == 0 and r.deviation == 0 and r.identity_error == 0 for r in one)
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(40)] + [(99, [1e300, 0.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert len(line) == 41 * 3 and line[0].identity_error < 1e-4
