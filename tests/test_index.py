"""The inverted index with places: made where a document is read, and together for rows that share a key."""

from collections import defaultdict

from lodestar.operators import search as S


def plain(rows):
    places, long_ = defaultdict(list), defaultdict(int)
    for k, ws in rows:
        for n, w in enumerate(ws or []):
            places[w, k].append(n)
            long_[w, k] = max(long_[w, k], len(ws))
    return {at: (len(p), sorted(p), long_[at]) for at, p in places.items()}


def indexed(df):
    return {(r.term, r.k): (r.tf, r.positions, r.dl) for r in df.collect()}


def test_a_document_is_indexed_without_a_shuffle_of_words(spark, monkeypatch):
    rows = [(k, [f"w{k * j % 7}" for j in range(k % 11)] or None) for k in range(60)] + [(None, ["a", "b", "a"]), (99, [])]
    df = spark.createDataFrame(rows, "k long, words array<string>").repartition(3)
    got = S.positions(df, "k", "words")
    assert indexed(got) == plain(rows) and "Exchange hashpartitioning(term" not in got._jdf.queryExecution().toString()
    monkeypatch.setattr(S, "CHUNK", 10)
    assert indexed(S.positions(df, "k", "words")) == plain(rows)


def test_rows_that_share_a_key_are_one_entry(spark):
    rows = [(1, ["a", "b", "a"]), (1, ["b", "a"]), (2, ["a"]), (None, ["c"]), (None, ["d", "c"]), (3, None), (3, ["z"])]
    assert indexed(S.positions(spark.createDataFrame(rows, "k long, words array<string>"), "k", "words")) == plain(rows)
    assert S.positions(spark.createDataFrame([], "k long, words array<string>"), "k", "words").count() == 0
