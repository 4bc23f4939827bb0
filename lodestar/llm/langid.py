"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, table

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def _letters(text: str) -> bytes:
    """The words of a text in lower case, joined by spaces."""
    return " ".join(LETTERS.findall(text.lower())).encode("utf-8", "replace")


def learn(docs: DataFrame, dict_bytes: int = 256 * 1024, piece: int = 4096) -> dict[str, bytes]:
    """language -> raw dictionary content of at most `dict_bytes` of text, from rows of `docs` (text, lang).

    Texts of any length are cut into pieces of `piece` characters and the pieces are drawn, so that a language of long texts alone is learnt like any
    other. The sample is bounded: per language the pieces with the smallest hashes that fit together. Bytes are summed per
    language first, so that a draw in proportion, about four times what is taken, is all that a language sends to its one task, however
    many rows it has; a piece that many rows hold is drawn once. At most dict_bytes per language reach the driver.

    Rows with a null text or lang and empty texts teach nothing; doc_id plays no part, so null and repeated ids do not matter. Pieces of equal hash are
    ordered by their text. Without any row to learn from the result is empty. Other columns are ignored.
    """
    size = F.octet_length("text")
    fit = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(size > 0)
    sums = fit.groupBy("lang").agg(F.sum(size).alias("bytes")).collect()
    if not sums:
        return {}
    share = docs.sparkSession.createDataFrame([(r.lang, 4.0 * dict_bytes / r.bytes) for r in sums], "lang string, share double")
    first = Window.partitionBy("lang").orderBy("draw", "text")
    pieces = fit.select("lang", F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))).alias("text")).withColumn("draw", F.xxhash64("text", F.lit(6)))
    some = (
        pieces.join(F.broadcast(share), "lang").where(F.col("draw") / F.lit(2.0**64) + 0.5 < F.col("share")).select("lang", "text", "draw").distinct()
        .withColumn("upto", F.sum(size).over(first.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= dict_bytes)
    )
    texts: dict[str, list[bytes]] = {}
    for row in some.select("lang", "text").collect():
        texts.setdefault(row.lang, []).append(_letters(row.text))
    return {lang: b" ".join(parts) for lang, parts in sorted(texts.items())}


@lru_cache(maxsize=2)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...], level: int):
    found = []
    for _, content in dictionaries:
        made = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=level)
        found.append(zstd.ZstdCompressor(dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False))
    return found


def classify(text: str | None, dictionaries: tuple[tuple[str, bytes], ...], level: int = 6, block: int = 4096) -> tuple[str, float, float]:
    """(language, margin, score) of a whole text.

    The text is compressed block by block with every dictionary, so that later blocks lean on the dictionary and not
    on the text before them; the language with the fewest bytes in all wins, ties going to the first by name. margin
    is the runner-up's excess over it.
    """
    data = _letters(text) if text else b""
    if not data or not dictionaries:
        return UNKNOWN, 0.0, 0.0
    sizes = np.zeros(len(dictionaries), np.int64)
    packers = _compressors(dictionaries, level)
    for at in range(0, len(data), block):
        part = data[at : at + block]
        sizes += [len(p.compress(part)) for p in packers]
    order = np.argsort(sizes, kind="stable")
    margin = float(sizes[order[1]] / sizes[order[0]] - 1) if len(order) > 1 else 0.0
    return dictionaries[order[0]][0], margin, float(1 / (1 + np.exp(-60 * margin)))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], narrow: float = 0.01, level: int = 6) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, lang_pred, score, margin, rejected.

    `rejected` marks texts whose margin is below `narrow`; lang_pred still names the best language, and a caller who
    wants none takes it as unknown. A text that is null or has no letter gets 'und', score 0 and rejected, as every text does when there is no dictionary.
    Texts are scored whole. Repeated rows repeat; an empty table gives an empty result; other columns are ignored.
    """
    content = docs.sparkSession.sparkContext.broadcast(tuple(sorted(dictionaries.items())))

    def run(batches):
        for batch in batches:
            found = [classify(t.as_py(), content.value, level) for t in batch.column(1)]
            lang, margin, score = ([f[k] for f in found] for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array([m < narrow for m in margin], pa.bool_())], names=["doc_id", "lang_pred", "score", "margin", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = learn(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    return identify(docs, dictionaries).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")
