import math
import random

import numpy as np
from pyspark.sql import functions as F

from lodestar.operators import arima as M
from lodestar.operators import landcover as L


def test_isodata_finds_planted_clusters(spark):
    rnd = random.Random(2)
    truth = [(0.1, 0.1), (0.9, 0.1), (0.5, 0.9), (0.1, 0.8), (0.9, 0.85)]
    rows = [(k, rnd.gauss(truth[k % 5][0], 0.03), rnd.gauss(truth[k % 5][1], 0.03), k % 5) for k in range(1000)] + [(5000, None, 0.1, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, kind int")
    for start in ([(0.5, 0.5)], [(x / 4, y / 4) for x in range(5) for y in range(5)]):
        centres = L.isodata(df, ["a", "b"], start, rounds=40, least=5, spread=0.1, near=0.1, most=20)
        assert len(centres) == 5 and all(min(math.dist(t, m) for m in centres) < 0.02 for t in truth)
    got = L.classified(df, ["a", "b"], centres).groupBy("kind").agg(F.count_distinct("class").alias("n")).where("kind IS NOT NULL").collect()
    assert {r.n for r in got} == {1} and L.isodata(df.where("false"), ["a", "b"], [(0.0, 0.0)]) == [(0.0, 0.0)]


def regions(grid):
    """cell -> least cell of its region."""
    out = {}
    for start in sorted(grid):
        if start in out:
            continue
        todo = [start]
        out[start] = start
        while todo:
            r, c = todo.pop()
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in grid and n not in out and grid[n] == grid[start]:
                    out[n] = start
                    todo.append(n)
    return out


def plain_sieve(grid, unit):
    """The rule cell by cell on the whole grid. A merged region keeps the name of the one it joined, or of the least of several that came to touch."""
    names = regions(grid)
    while True:
        size, border = {}, {}
        for cell, name in names.items():
            size[name] = size.get(name, 0) + 1
            r, c = cell
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in names and names[n] != name:
                    border.setdefault(name, {}).setdefault(names[n], 0)
                    border[name][names[n]] += 1
        moves = {}
        for a in size:
            if size[a] < unit and a in border and all((size[a], a) < (size[b], b) for b in border[a] if size[b] < unit):
                moves[a] = min(border[a], key=lambda b: (-border[a][b], b))
        if not moves:
            return grid
        kinds = {names[cell]: grid[cell] for cell in grid}
        names = {cell: moves.get(n, n) for cell, n in names.items()}
        grid = {cell: kinds[n] for cell, n in names.items()}
        whole = regions(grid)
        least = {}
        for cell in grid:
            least[whole[cell]] = min(least.get(whole[cell], names[cell]), names[cell])
        names = {cell: least[whole[cell]] for cell in grid}


def test_sieve_against_the_plain_rule(spark):
    for seed, n, classes, unit in ((1, 5, 3, 4),):
        rnd = random.Random(seed)
        grid = {(r, c): rnd.randrange(classes) for r in range(n) for c in range(n) if (r, c) != (3, 3)}
        df = spark.createDataFrame([(r, c, k) for (r, c), k in grid.items()], "r long, c long, class int")
        got = {(r.r, r.c): r["class"] for r in L.sieve(df, unit).collect()}
        assert got == plain_sieve(grid, unit)
        sizes = {}
        for cell, name in regions(got).items():
            sizes[name] = sizes.get(name, 0) + 1
        assert min(sizes.values()) >= unit
    alone = spark.createDataFrame([(0, 0, 1), (5, 5, 2)], "r long, c long, class int")
    assert L.sieve(alone, 9).count() == 2


def series(rnd, n, c, ar, ma, sd=1.0):
    z, e = [0.0] * 5, [0.0] * 5
    for _ in range(n + 200):
        e.append(rnd.gauss(0, sd))
        z.append(c + sum(a * z[-k - 1] for k, a in enumerate(ar)) + e[-1] + sum(m * e[-k - 2] for k, m in enumerate(ma)))
    return z[-n:]


def test_arima_recovers_planted_parameters(spark):
    rnd = random.Random(9)
    planted = {1: (0.5, [0.6], [], 0), 2: (0.2, [0.5, 0.3], [], 0), 3: (0.0, [0.7], [0.5], 0), 4: (0.3, [0.5], [], 1), 5: (1.0, [], [], 0)}
    rows = []
    for key, (c, ar, ma, d) in planted.items():
        z = series(rnd, 4000, c, ar, ma)
        z = np.cumsum(z).tolist() if d else z
        rows += [(key, t, v) for t, v in enumerate(z)]
    rows += [(6, t, float(t)) for t in range(20)] + [(7, t, None) for t in range(99)] + [(None, 1, 1.0)]
    df = spark.createDataFrame(rows, "key long, t long, v double").repartition(4)
    got = {r.key: r for r in M.arima(df, "key", ["t"], "v").collect()}
    assert set(got) >= set(planted) and 7 not in got and 6 not in got
    for key, (c, ar, ma, d) in planted.items():
        r = got[key]
        assert r.d == d and abs(r.sigma2 - 1) < 0.1, key
        full = list(r.ar) + [0.0] * (2 - len(r.ar))
        assert all(abs(a - b) < 0.12 for a, b in zip(full, [*ar, 0.0, 0.0])), (key, r)
        if ma:
            assert r.q == 1 and abs(r.ma[0] - ma[0]) < 0.1
    walk = [v for k, _, v in rows if k == 4]
    assert abs(got[4].next - walk[-1]) < 5
