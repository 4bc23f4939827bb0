"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; all but the
last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.bpe import round_trip
from lodestar.llm.common import checkpoint_dir, table
from lodestar.llm.decontaminate import matches
from lodestar.llm.passages import dedup_passages
from lodestar.llm.simhash import simhash_components
from lodestar.llm.toxicity import learn, score

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not take for toxic (score below 0.5); fitted on all labels."""
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).where("toxicity < 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id. Rows without doc_id stay.

    Near-duplicates have an equal or similar set of 5-word shingles: one of six fingerprints within 5 bits. How that follows the
    similarity is in the README. Rows that share a doc_id go or stay together, but of rows equal in doc_id and text one stays.
    """
    keep = simhash_components(docs, budget=5, width=5, prints=6).where("doc_id = component_id").select("doc_id").distinct()
    first = docs.where("doc_id IS NOT NULL").join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return first.unionByName(docs.where("doc_id IS NULL")).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; a document of which no word is left goes."""
    cut = dedup_passages(docs.select(*COLUMNS), carry=("lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    return cut.where("n_words = 0 OR n_removed < n_words").select(
        "doc_id", F.col("kept").alias("text"), "lang", "source", F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, exactly or nearly."""
    return matches(docs, table(spark, sf_dir, "benchmark")).where("size(hits) = 0").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=False)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("tokens", tokens)]
#: Fitting a classifier, finding components and encoding are not SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each result but the last is a Parquet table in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
