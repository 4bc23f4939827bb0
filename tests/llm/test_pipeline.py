import hashlib
import random

import corpus_pipeline
import public_tokenizers
import tiktoken

from lodestar.llm.bpe import read_ranks


def test_stages_keep_clean_documents_and_drop_the_rest(spark, tmp_path):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, item = prose(70), prose(30)
    rows, labels, clean, toxic = [], [], {}, set()
    for k in range(200):
        text = prose(60)
        if k % 8 == 3:
            words = text.split()
            for _ in range(5):
                words.insert(rnd.randrange(60), rnd.choice(["idiot", "moron", "scum"]))
            text = " ".join(words)
            toxic.add(k)
        else:
            clean[k] = text
        rows.append((k, text))
        labels.append((k, 1, int(k in toxic)))
    rows += [(300 + k, rows[0][1]) for k in range(5)] + [(310, prose(40) + " " + item + " " + prose(40))]
    parts = [prose(40), prose(40)]
    rows += [(320, "x " + shared), (321, parts[0] + " " + shared + " " + parts[1]), (330, "")]
    clean |= {320: "x " + shared, 330: ""}
    where = str(tmp_path)
    full = [(d, t, "en", "s", len(t)) for d, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, where).collect()}
    assert set(got) == set(clean) | {321}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for k, text in (clean | {321: parts[0] + "  " + parts[1]}).items():
        assert got[k].n_tokens == len(coder.encode_ordinary(text)) and got[k].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest(), k


def test_stages_return_the_columns_of_documents(spark, odd_docs, tmp_path):
    docs = odd_docs.select(*corpus_pipeline.COLUMNS)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing like it is in there")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == list(corpus_pipeline.COLUMNS) and 0 < out.count() <= docs.count()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
