import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np

from lodestar.llm.periods import op13_periods, periodic_runs, solve, tiles


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                found.setdefault((s, i + q - s), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def brute(doc_id, text, plant):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_solve_finds_all_runs():
    rnd = random.Random(1)
    for trial in range(300):
        docs = []
        for _ in range(rnd.randrange(1, 6)):
            words = []
            while len(words) < rnd.randrange(1, 200):
                unit = [rnd.randrange(rnd.choice([2, 3, 9])) for _ in range(rnd.randrange(1, 14))]
                words += (unit * rnd.randrange(1, 9))[: rnd.randrange(1, 100)]
            docs.append(words)
        docs.sort(key=len, reverse=True)
        edges = np.r_[0, np.cumsum([len(d) for d in docs])]
        got = sorted(zip(*(x.tolist() for x in solve(np.array(sum(docs, [])), edges))))
        want = sorted((q, s + int(edges[k]), s + length + int(edges[k])) for k, d in enumerate(docs) for s, length, q in brute_runs(d))
        assert got == want, trial


def test_tiles_overlap_and_cover():
    for n in (300, 1000, 5000):
        seen = {}
        for level, a, b in tiles(n, tile=64, low=3):
            seen.setdefault(level, []).append((a, b))
        for level, spans in seen.items():
            assert spans[0][0] == 0 and spans[-1][1] == n
            assert all(b0 - a1 == 8 << (2 + level) for (_, b0), (a1, _) in zip(spans, spans[1:]))


def periodic_docs():
    rnd = random.Random(5)
    rows = []
    for k in range(60):
        words = [f"w{rnd.randrange(2000)}" for _ in range(rnd.randrange(30))]
        for _ in range(rnd.randrange(1, 4)):
            unit = [f"u{rnd.randrange(5)}" for _ in range(rnd.choice([1, 2, 3, 7, 20, 40]))]
            words += (unit * rnd.randrange(3, 30))[: rnd.randrange(5, 900)] + [f"w{rnd.randrange(2000)}" for _ in range(rnd.randrange(40))]
        rows.append((1000 + k, rnd.choice([" ", "\n", "\t "]).join(words)))
    return rows


def test_against_brute_force(spark, odd_docs, odd_rows):
    rows = [(d, t) for d, t, *_ in odd_rows] + periodic_docs()
    docs = odd_docs.select("text", "doc_id", "source").unionByName(spark.createDataFrame([(t, d, "x") for d, t in periodic_docs()], "text string, doc_id long, source string")).repartition(4)
    for plant in (False, True):
        got = Counter(map(tuple, periodic_runs(docs, plant).collect()))
        assert got == Counter(brute(d, t, plant) for d, t in rows)


def test_documents_of_many_tiles(spark):
    docs = spark.createDataFrame(periodic_docs(), "doc_id long, text string")
    got = Counter(map(tuple, periodic_runs(docs, tile=64, low=3).collect()))
    assert got == Counter(brute(d, t, False) for d, t in periodic_docs())


def test_one_word_over_and_over(spark):
    rows = [(1, "ha " * 300_000), (2, "a b " * 100_000 + "c " + "d e f " * 5)]
    got = {r.doc_id: r for r in periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period) == (1, 0, 300_000, 1)
    assert (got[2].n_runs, got[2].start, got[2].length, got[2].period) == (2, 0, 200_000, 2)
    assert got[2].collapsed_sha256 == hashlib.sha256(b"a b c d e f").hexdigest()


def test_empty(no_docs):
    assert periodic_runs(no_docs).collect() == []


def test_query_on_the_smallest_table(spark):
    where = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    rows = [(d, t) for d, t in rows if len(t or "") < 12_000]
    got = {r.doc_id: tuple(r) for r in op13_periods(spark, where).collect()}
    assert all(got[d] == brute(d, t, True) for d, t in rows) and len(rows) > 150
