import random

import numpy as np

from lodestar.llm.licenses import TEMPLATES, align, scan_licenses, winnow


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_align_is_the_longest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = (np.array([rnd.randrange(4) for _ in range(rnd.randrange(1, 10))]) for _ in range(2))
        n, x, y = align(a, b, 0, 12)
        assert n == lcs(a.tolist(), b.tolist()) == lcs(a.tolist(), b[x:y].tolist())


def test_winnow_keeps_one_of_every_window():
    rnd = np.random.default_rng(1)
    g, edges = rnd.integers(0, 9, 60).astype(np.uint64), np.array([0, 3, 3, 40, 60])
    kept = set(winnow(g, edges, 4).tolist())
    assert all(kept & set(range(s, s + 4)) for a, b in zip(edges[:-1], edges[1:]) for s in range(a, b - 3)) and kept & {0, 1, 2}


def test_scan(spark, odd_docs, no_docs):
    texts = dict(TEMPLATES)
    mit = texts["MIT-body"].split()
    gone = " ".join(w for k, w in enumerate(mit) if k % 9)
    rows = [(k, f"some words {t}\nmore words here", [n]) for k, (n, t) in enumerate(TEMPLATES)]
    rows += [(100, "before " + gone.upper() + " after", ["MIT-body"]), (101, None, []), (102, "", []), (103, "the License is a word", []), (104, texts["MIT"] + " x " + texts["MIT"], ["MIT", "MIT"])]
    got = scan_licenses(spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string").repartition(2)).collect()
    for d, t, want in rows:
        mine = [r for r in got if r.doc_id == d]
        assert sorted(set(want) - {r.license for r in mine}) == [] and (want or not mine)
        assert d != 104 or len(mine) == 2
        for r in mine:
            assert 0.8 <= r.coverage <= 1 and lcs(texts[r.license].lower().split(), t.encode()[r.start : r.end].decode().lower().split()) >= r.matched
    assert scan_licenses(no_docs).collect() == [] and scan_licenses(odd_docs).collect() == []


def test_notice_repeated_thousands_of_times(spark):
    text = "Released under the MIT License. " * 4000
    rows = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sorted(r.start for r in rows) == [32 * k for k in range(4000)]
