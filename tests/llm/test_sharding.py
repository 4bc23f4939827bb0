import zlib
from collections import Counter, defaultdict

import pytest

from lodestar.llm.sharding import shard


def check(rows, docs, n=8, law="bytes"):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    slots, size, count = defaultdict(list), Counter(), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        count[r.shard] += 1
        assert r.law == law and r.grown_shard is None and 0 <= r.shard < n
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return size, count


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_odd_rows(odd_docs, odd_rows, law):
    docs = [(d, t) for d, t, *_ in odd_rows]
    size, count = check(shard(odd_docs, law=law).collect(), docs, law=law)
    if law == "rows":
        assert max(count[k] for k in range(8)) - min(count[k] for k in range(8)) <= 1


def test_empty(no_docs):
    assert shard(no_docs).collect() == []


def test_sizes_near_equal_with_a_hot_text(spark):
    docs = [(k, "hot text " * 20 if k % 3 == 0 else f"document {k} " * (1 + k % 40)) for k in range(6000)]
    rows = shard(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), rows_per_range=50).collect()
    size, _ = check(rows, docs)
    mean = sum(size.values()) / 8
    assert max(abs(s - mean) for s in size.values()) < 0.01 * mean
    by_text = defaultdict(set)
    for r in rows:
        by_text[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in by_text.values()) <= 8
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in shard(spark.createDataFrame(docs[::-1], "doc_id long, text string").repartition(3), rows_per_range=50).collect()}
