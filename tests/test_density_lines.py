import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.functions import geometry as Y
from lodestar.operators import density as N
from lodestar.operators import lines as L

POINTS = "id long, lon double, lat double, note string"


def crowd(rnd, n):
    """Some dense spots, repeated places, and far points."""
    rows = [(rnd.gauss(10, 0.01), rnd.gauss(5, 0.01)) for _ in range(n)] + [(rnd.uniform(-170, 170), rnd.uniform(-80, 80)) for _ in range(n // 2)]
    rows += [(1.0, 1.0)] * 9 + [(float(k % 4), 50.0 + k // 4) for k in range(16)]
    return [(k, x, y, "n") for k, (x, y) in enumerate(rows)]


def test_adaptive_neighbours_against_brute_force(spark):
    rows = crowd(random.Random(1), 150)
    a = spark.createDataFrame(rows, POINTS)
    b = a.select(F.col("id").alias("id2"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    got = {}
    for r in N.nearest_adaptive(a, b, 3, self_join=True).collect():
        got.setdefault(r.id, []).append((r.rank, r.id2))
    for i, x, y, _ in rows:
        want = sorted((math.hypot(x - p, y - q), j) for j, p, q, _ in rows if j != i)[:3]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want], i
    few = N.nearest_adaptive(a, b.where("id2 < 2"), 3).groupBy("id").count()
    assert {r["count"] for r in few.collect()} == {2} and N.nearest_adaptive(a.where("false"), b, 3).count() == 0


def test_local_outliers_against_brute_force(spark):
    rows = crowd(random.Random(2), 60)
    dist = lambda a, b: math.hypot(a[1] - b[1], a[2] - b[2])
    near, far, lrd = {}, {}, {}
    for p in rows:
        d = sorted((dist(p, q), q[0]) for q in rows if q[0] != p[0])
        far[p[0]] = d[3][0]
        near[p[0]] = [(x, j) for x, j in d if x <= d[3][0]]
    for i in near:
        lrd[i] = len(near[i]) / (sum(max(far[j], x) for x, j in near[i]) + 1e-10)
    got = {r.id: r.lof for r in N.local_outliers(spark.createDataFrame(rows, POINTS), 4).collect()}
    for i in near:
        assert math.isclose(got[i], sum(lrd[j] for _, j in near[i]) / len(near[i]) / lrd[i], rel_tol=1e-6)


def brute_linkage(rows, how, cutoff, clusters):
    groups, merges = {r[0]: [r] for r in rows}, []
    while len(groups) > clusters:
        best = None
        keys = sorted(groups)
        for n, a in enumerate(keys):
            for b in keys[n + 1 :]:
                d = [math.hypot(p[1] - q[1], p[2] - q[2]) for p in groups[a] for q in groups[b]]
                if max(d) <= cutoff:
                    h = max(d) if how == "complete" else sum(d) / len(d)
                    if best is None or (h, a, b) < best:
                        best = (h, a, b)
        if best is None:
            break
        h, a, b = best
        groups[a] += groups.pop(b)
        merges.append((a, b, round(h, 6)))
    return {p[0]: k for k, ps in groups.items() for p in ps}, merges


@pytest.mark.parametrize("how, cutoff, clusters", [("complete", 45.0, 1), ("average", 1e6, 5)])
def test_linkage_against_one_merge_at_a_time(spark, how, cutoff, clusters):
    rnd = random.Random(3)
    rows = [(k, rnd.uniform(0, 100), rnd.uniform(0, 100), "n") for k in range(45)]
    names, merges = N.linkage(spark.createDataFrame(rows, POINTS), how, cutoff, clusters)
    want, order = brute_linkage(rows, how, cutoff, clusters)
    assert {r.id: r.cluster for r in names.collect()} == want
    assert Counter((r.cluster, r.merged, round(r.height, 6)) for r in merges.collect()) == Counter(order)


def test_lines_are_merged_like_a_walk(spark):
    rnd = random.Random(6)
    pieces, want = [], []
    for k in range(6):  # chains of shuffled, turned pieces
        pts = [(100.0 * k + j, float(k)) for j in range(rnd.randrange(2, 40))]
        want.append((len(pts) - 1, min(pts, pts[::-1])))
        pieces += [pts[j : j + 2] if rnd.random() < 0.5 else pts[j : j + 2][::-1] for j in range(len(pts) - 1)]
    ring = [(0.0, 900.0), (1.0, 900.0), (1.0, 901.0), (0.0, 901.0)]
    pieces += [[a, b] for a, b in zip(ring, ring[1:] + ring[:1])]
    pieces += [[(0.0, 950.0), (1.0, 950.0), (0.0, 950.0)]]  # a line that closes on itself
    star = [[(500.0, 500.0), (500.0 + math.cos(k), 500.0 + math.sin(k))] for k in range(3)]  # three ends meet: nothing is merged
    rnd.shuffle(pieces)
    df = spark.createDataFrame(list(enumerate(pieces + star)), f"id long, line {Y.RING}")
    got = [(r.n, [tuple(p) for p in r.line]) for r in L.merge_lines(df).collect()]
    chains = [(n, line) for n, line in got if line[0][1] < 100]
    assert sorted(chains) == sorted(want)
    rings = [(n, line) for n, line in got if 890 < line[0][1] < 940]
    assert len(rings) == 1 and rings[0][0] == 4 and rings[0][1][0] == rings[0][1][-1] and len(set(rings[0][1])) == 4
    assert sum(n == 1 for n, line in got) == 3 + 1 + sum(w[0] == 1 for w in want)
    assert L.merge_lines(df.where("false")).count() == 0
