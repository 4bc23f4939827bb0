import random

import numpy as np
import pytest

from lodestar.llm.decontaminate import Index, edit_match, fold, matches


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_match_is_the_least_distance():
    rnd = random.Random(1)
    for _ in range(300):
        item, window = (bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, n))) for n in (9, 16))
        best = min(distance(item, window[a:b]) for a in range(len(window) + 1) for b in range(a, len(window) + 1))
        got = edit_match(item, window, len(item))
        assert got[2] == best and distance(item, window[got[0] : got[1]]) == best
        assert best == 0 or edit_match(item, window, best - 1) is None


def test_recall_and_precision(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9)))
    items = [(k, " ".join(word() for _ in range(35))) for k in range(20)] + [(90, "tiny one"), (91, ""), (92, None), (None, "no id of this item at all")]
    docs, planted = [], {}
    for k in range(300):
        noise = [" ".join(word() for _ in range(rnd.randrange(60))) for _ in range(2)]
        middle = ""
        if k % 3 == 0:
            item, text = items[k % 20]
            words = text.split()
            for at in rnd.sample(range(len(words)), k % 4):
                words[at] = word()
            middle = " ".join(words)
            middle = middle.upper() if k % 2 else middle.replace(" ", "\n")
            best = edit_match(fold(text.encode()), fold(middle.encode()), len(text))
            planted[k] = (item, best[2], len(text))
        docs.append((k, noise[0] + " " + middle + " " + noise[1]))
    docs += [(400, None), (401, ""), (402, "a tiny one here"), (None, items[0][1])]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, hits string, h long").repartition(3)
    got = {r.doc_id: {h.item_id: h for h in r.hits} for r in matches(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=2000).collect()}
    assert len(got) == len(docs) and got[400] == {} and list(got[402]) == [90] and list(got[None]) == [0]
    due = {k for k, (_, d, n) in planted.items() if d <= int(0.2 * n)}
    found = {k for k in due if planted[k][0] in got[k] and got[k][planted[k][0]].distance <= planted[k][1]}
    assert len(found) >= 0.95 * len(due) and all(k in found for k in due if planted[k][1] == 0)
    assert all(set(h) <= {planted[k][0]} if k in planted else not h for k, h in got.items() if k is not None and k < 300)


def test_empty(spark, no_docs):
    items = spark.createDataFrame([(1, "some benchmark item")], "item_id long, text string")
    assert matches(no_docs, items).collect() == []
    assert [r.hits for r in matches(items.selectExpr("item_id doc_id", "text"), items.where("false")).collect()] == [[]]


def edited(rnd, text, rate, every=0):
    """`text` with that share of its places substituted, inserted before or deleted; evenly spaced if `every`."""
    part, n = list(text), int(rate * len(text))
    for at in sorted(range(5, len(text), every)[:n] if every else rnd.sample(range(len(text)), n), reverse=True):
        part[at : at + 1] = (["z"], ["z", part[at]], [])[rnd.randrange(3)]
    return "".join(part)


@pytest.mark.parametrize("rate, every", [(0.05, 0), (0.1, 0), (0.15, 0), (0.2, 0), (0.1, 10), (0.2, 5)])
def test_recall_against_brute_force(spark, rate, every):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9)))
    items = [" ".join(word() for _ in range(35)) for _ in range(20)]
    rows, due = [], {}
    for k in range(100):
        rows.append((k, "noise here " + edited(rnd, items[k % 20], rate, every) + " and noise there " + word()))
        best = edit_match(items[k % 20].encode(), rows[k][1].encode(), int(0.2 * len(items[k % 20]) + 1e-9))
        if best:
            due[k] = (k % 20, best[2])
    got = matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), block_bytes=3000).collect()
    found = {r.doc_id: {(h.item_id, h.distance) for h in r.hits} for r in got}
    assert len(due) == 100 and sum(x in found[k] for k, x in due.items()) >= 90
    assert all({h[0] for h in found[k]} <= {k % 20} for k in found)


def test_pieces_never_sum_to_more_than_the_distance():
    rnd = random.Random(6)
    items = [bytes(rnd.choice(b"abcd ") for _ in range(rnd.randrange(50, 300))) for _ in range(30)]
    index = Index(list(range(30)), items, 0.8)
    texts = [b"x" * 70 + edited(rnd, t.decode(), 0.2).encode() + b"y" * 70 for t in items]
    x = np.frombuffer(b" ".join([*texts, bytes(1000)]), np.uint8)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1] + 70
    assert index.plausible(x, np.arange(30), begin, begin).tolist() == list(range(30))


def test_odd_rows_repeated_rows_and_very_long_texts(spark, odd_docs, odd_rows):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9)))
    item, brief = " ".join(word() for _ in range(30)), "qqq zzz www"
    items = spark.createDataFrame([(1, item), (2, brief), (2, brief), (3, odd_rows[14][1])], "item_id long, text string")
    want = {d for d, t, *_ in odd_rows if odd_rows[14][1] in (t or "")}
    got = matches(odd_docs, items).collect()
    assert len(got) == len(odd_rows) and {r.doc_id for r in got if r.hits} == want
    long = " ".join(word() for _ in range(500_000))
    rows = [(1, long + " " + edited(rnd, item, 0.1) + " " + long[:1000]), (1, brief), (1, brief), (2, long[:500] + " qqq zxz www")]
    got = matches(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id, [h.item_id for h in r.hits]) for r in got) == [(1, [1]), (1, [2, 2]), (1, [2, 2]), (2, [2, 2])]
