import random

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import langid, toxicity
from lodestar.llm.common import held_out

SYLLABLES = {"aa": ["tion", "the", "ing", "er"], "bb": ["sch", "und", "ich", "ein"], "cc": ["que", "oi", "eau", "les"]}


def corpus(rnd, n=360):
    rows = []
    for k in range(n):
        lang = ("aa", "bb", "cc")[k % 3]
        rows.append((k, " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randrange(1, 5))) for _ in range(rnd.randrange(20, 60))), lang))
    return rows


def test_language_held_out_accuracy(spark, odd_docs, no_docs):
    rows = corpus(random.Random(1)) + [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !!", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = langid.learn(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    assert set(found) == {"aa", "bb", "cc"}
    got = {r.doc_id: r for r in langid.identify(docs, found).collect()}
    held = [r.doc_id for r in docs.where(held_out(F.col("doc_id"), 4, 2) & (F.col("doc_id") < 1000)).collect()]
    assert np.mean([got[k].lang_pred == rows[k][2] for k in held]) > 0.95 and all(0 <= r.score <= 1 for r in got.values())
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3
    assert langid.identify(odd_docs, found).count() == odd_docs.count() and langid.identify(no_docs, found).collect() == []
    assert langid.learn(no_docs) == {} and {r.lang_pred for r in langid.identify(odd_docs, {}).collect()} == {"und"}


def test_languages_of_long_texts_and_rows_without_ids_are_learnt(spark):
    rnd = random.Random(5)
    rows = [(None, " ".join(t for _, t, lang2 in corpus(rnd, 300) if lang2 == lang) * (3 if lang == "aa" else 1), lang) for lang in ("aa", "bb") for _ in range(3)]
    assert all(len(t) > 30_000 for _, t, lang in rows if lang == "aa")
    rows += [(None, "que eau les oi", "cc")] * 4000
    found = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    assert set(found) == {"aa", "bb", "cc"} and found["cc"].split() == b"que eau les oi".split()


def plain_language(text, dictionaries):
    """Re-scoring by a plain loop: every block of 4 KB packed with every dictionary."""
    import re

    import zstandard

    data = " ".join(re.findall(r"[^\W\d_]+", (text or "").lower())).encode()
    if not data:
        return "und"
    best = {}
    for lang, content in dictionaries.items():
        packer = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        best[lang] = sum(len(packer.compress(data[at : at + 4096])) for at in range(0, len(data), 4096))
    return min(sorted(best), key=best.get)


def test_language_against_a_plain_loop(spark, odd_docs):
    rows = corpus(random.Random(3), 90)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.learn(docs)
    both = docs.select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    from collections import Counter

    want = Counter((r.doc_id, plain_language(r.text, found)) for r in both.collect())
    assert Counter((r.doc_id, r.lang_pred) for r in langid.identify(both, found).collect()) == want


def test_toxicity_held_out_accuracy(spark, odd_docs, no_docs):
    rnd = random.Random(2)
    rows, labels = [], []
    for k, text, _ in corpus(rnd, 600):
        bad = k % 7 == 0  # independent of the language
        if bad:
            words = text.split()
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "grobz", "flarn", "scum"]))
            text = " ".join(words)
        rows.append((k, text))
        labels.append((k, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marked = spark.createDataFrame(labels + [(9999, 1, 1), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, marked.where(~held_out(F.col("doc_id"), 5, 0)))
    assert {"grobz", "flarn"} <= set(model.terms)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs.where(held_out(F.col("doc_id"), 5, 0)), model).collect()}
    assert np.mean([(got[k] >= 0.5) == bool(labels[k][2]) for k in got]) > 0.97
    odd = toxicity.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(r.toxicity < 0.5 for r in odd)
    assert toxicity.score(no_docs, model).collect() == [] and len(toxicity.learn(no_docs, marked.where("false")).weights) > 1


def test_label_model_counts_repeated_voters_once():
    rnd = np.random.default_rng(1)
    truth = rnd.random(3000) < 0.3
    one = np.where(truth, rnd.random(3000) < 0.6, rnd.random(3000) < 0.05)
    other = np.where(truth, rnd.random(3000) < 0.5, rnd.random(3000) < 0.05)
    fired = np.stack([one, one, one, other], axis=1).astype(float)
    post, rate1, rate0, overlap = toxicity.label_model(fired, np.where(np.arange(3000) < 600, truth, -1))
    assert (overlap[:3] > 2).all() and overlap[3] < 1.5 and (rate1 > rate0).all()
    assert np.mean((post > 0.5) == truth) > 0.8
