import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, key string, rep long, shard int"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows and near copies, as (doc_id, text, lang, source)."""
    rnd = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "Éclair", "über", "the", "of", "日本", "x1"]
    prose = lambda n: " ".join(rnd.choice(words) + str(rnd.randrange(50)) for _ in range(n))
    shared, long = prose(80), prose(6000)
    rows = [(1, "", "en", "a"), (2, None, "en", "a"), (3, " \t\n ", None, None), (4, "one", "en", "b"), (5, "one two", "de", "b"), (4, "one", "en", "b")]
    rows += [(10 + k, prose(40 + k), "en", "hot") for k in range(8)]
    rows += [(30 + k, shared, "fr", "hot") for k in range(12)]
    rows += [(50 + k, prose(30) + "\n" + shared + "\n" + prose(30), "es", "c") for k in range(6)]
    rows += [(60 + k, shared + f" tail{k}", "fr", "c") for k in range(5)]
    rows += [(80, long, "en", "d"), (81, long + " end", "en", "d"), (82, "\U0001f600 emoji \x00 zero", "en", "d"), (None, "no id here", None, None), (None, shared, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    rows = [(d, t, lang, s, None if t is None else len(t), 1, "k", 2, 3) for d, t, lang, s in odd_rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
