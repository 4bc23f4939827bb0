import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import minhash
from lodestar.llm.minhash import common_counts, minhash_components, op11_minhash, shingle_sets, sketches


def brute_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    return frozenset([" ".join(words)] if 0 < len(words) < 5 else [" ".join(words[k : k + 5]) for k in range(len(words) - 4)])


def brute(rows, percent):
    sets = [brute_set(t) for _, t in rows]
    label = {k: rows[k][0] for k in range(len(rows)) if rows[k][0] is not None}
    links = [(a, b) for a in label for b in label if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            least = min(label[a], label[b])
            moved |= label[a] != least or label[b] != least
            label[a] = label[b] = least
    out = Counter()
    for k, (d, _) in enumerate(rows):
        same = [label[j] for j in label if sets[j] and sets[j] == sets[k]]
        component = label[k] if k in label else min(same, default=None)
        out[d, len(sets[k]), component, d == component if d is not None and component is not None else component is None] += 1
    return out


def edited(rnd, words, share):
    return [w if rnd.random() > share else f"e{rnd.randrange(10**6)}" for w in words]


def near_rows():
    """Chains and clusters of copies around the threshold."""
    rnd = random.Random(11)
    prose = lambda n: [f"w{rnd.randrange(3000)}" for _ in range(n)]
    rows, at = [], 200
    for k in range(25):
        words = prose(rnd.choice([6, 20, 60, 200, 500]))
        for _ in range(rnd.randrange(2, 8)):
            rows.append((at := at + 1, " ".join(words).replace("w", rnd.choice("wW"))))
            words = edited(rnd, words, rnd.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05]))
    base = prose(150)
    rows += [(1000 + k, " ".join(edited(rnd, base, 0.012))) for k in range(90)]
    return rows


def test_against_brute_force(spark, odd_docs, odd_rows):
    rows = [(d, t) for d, t, *_ in odd_rows] + near_rows()
    docs = odd_docs.select("doc_id", "text", "key", "rep").unionByName(spark.createDataFrame([(d, t, "k", 1) for d, t in near_rows()], "doc_id long, text string, key string, rep long")).repartition(5)
    for percent in (85, 80):
        assert Counter(map(tuple, minhash_components(docs, percent).collect())) == brute(rows, percent)


def test_blocks_of_a_large_mixed_bucket(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds in (0, 1, 3):
        assert Counter(map(tuple, minhash_components(docs, 85, rounds=rounds, block=7).collect())) == brute(rows, 85)


def test_empty(no_docs):
    assert minhash_components(no_docs).collect() == []


def test_one_text_in_most_rows(spark):
    rows = [(k, "one text that most of all rows have in common") for k in range(3000)] + [(5000, "one text"), (5001, "ONE text"), (5002, None), (5003, " ")]
    got = {r.doc_id: r for r in minhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].component_id == 0 for k in range(3000)) and got[5001].component_id == 5000 and got[5002].kept and got[5003].component_id == 5003
    assert sum(r.kept for r in got.values()) == 4


def test_sketches_are_filled_and_concentrated():
    rnd = np.random.default_rng(4)
    for n in (1, 3, 50, 2000):
        miss = []
        for share in (0.5, 0.85):
            both = int(round(2 * n * share / (1 + share)))
            errors = []
            for _ in range(60):
                h = rnd.integers(0, 2**63, 2 * n - both).astype(np.uint64)
                s = sketches(np.r_[h[:n], h[n - both :]], np.array([0, n, 2 * n]), 160)
                assert (s != minhash.FREE).all()
                errors.append((s[0] == s[1]).mean() - both / (2 * n - both))
            miss.append((np.mean(errors), np.std(errors)))
        assert all(abs(m) < 0.03 and sd < 1.25 * (0.25 / 160) ** 0.5 for m, sd in miss), (n, miss)


def test_common_counts():
    rnd = random.Random(2)
    sets = [np.unique(np.array([rnd.randrange(40) for _ in range(rnd.randrange(1, 30))], np.uint64)) for _ in range(12)]
    assert (common_counts(sets[:5], sets[5:], most=7) == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]).all()


def test_sets_do_not_hang_on_what_else_is_in_the_batch():
    texts = [b"", b"a b", b"a b c d e f a b c d e", b"A B", b"x " * 50]
    h, edges = shingle_sets(texts, 5)
    for k, t in enumerate(texts):
        assert (shingle_sets([t], 5)[0] == h[edges[k] : edges[k + 1]]).all() and edges[k + 1] - edges[k] == len(brute_set(t.decode()))


@pytest.mark.parametrize("where", ["/root/testdata/sf0.001"])
def test_query_on_the_smallest_table(spark, where):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    assert Counter(map(tuple, op11_minhash(spark, where).collect())) == brute(rows, 85)
