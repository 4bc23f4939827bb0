"""Text search over tables of terms: an inverted index, scored queries, suggestions; pages as tables of elements."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoint import durable

#: Words indexed at once.
CHUNK = 1 << 20
SPLIT = r"[^\p{L}\p{N}]+"
# Frequent short words that name a language.
STOP_WORDS = {"en": ["the", "and", "of", "to", "in", "that", "is", "for", "with", "was"], "de": ["der", "die", "und", "das", "ist", "nicht", "ein", "zu", "mit", "auf"], "fr": ["le", "la", "les", "des", "et", "une", "que", "dans", "pour", "est"], "es": ["el", "los", "que", "del", "las", "una", "por", "con", "para", "como"]}


def words(text: str | Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda x: x != "")


def without(terms: Column, stop: list[str]) -> Column:
    return F.filter(terms, lambda x: ~x.isin(stop))


def detected(terms: Column) -> Column:
    """The language whose frequent words occur most, ties to the first by name; null if none occurs."""
    n = lambda lang: F.size(F.filter(terms, lambda x: x.isin(STOP_WORDS[lang])))
    best = F.array_max(F.array(*[F.struct(n(k).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("lang")) for i, k in enumerate(sorted(STOP_WORDS))]))
    return F.when(best["n"] > 0, best["lang"])


def edge_grams(term: Column, least: int, most: int) -> Column:
    return F.transform(F.sequence(F.lit(least), F.greatest(F.lit(least), F.least(F.lit(most), F.length(term)))), lambda k: F.left(term, k))


def counted(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, dl, tf_0, tf_1 ...): length and counts of a few terms per document, in one pass over its text that builds no words."""
    low = docs.select(F.col(key), F.lower(text).alias("t"))
    alone = lambda t: rf"(?<![\p{{L}}\p{{N}}])\Q{t}\E(?![\p{{L}}\p{{N}}])"
    return low.select(key, F.regexp_count("t", F.lit(r"[\p{L}\p{N}]+")).alias("dl"), *[F.regexp_count("t", F.lit(alone(t))).alias(f"tf_{i}") for i, t in enumerate(terms)])


def positions(docs: DataFrame, key: str, terms: str) -> DataFrame:
    """(term, key, tf, positions, dl) of documents (key, terms: an array): an inverted index with the places of each term.

    A document lies in one row, so its part of the index is made where it is read, without a shuffle of words. Rows that share a key are one entry, with the
    places of all of them; only such rows are shuffled.
    """
    docs = docs.select(key, terms)
    several = durable(docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("_key")))
    out = f"term string, {key} {docs.schema[key].dataType.simpleString()}, tf long, positions array<long>, dl long"
    if several.isEmpty():
        return docs.mapInArrow(_indexed(key, terms), out)
    same = F.col(key).eqNullSafe(F.col("_key"))
    t = docs.join(several, same, "left_semi").select(key, F.size(terms).cast("long").alias("dl"), F.posexplode(terms).alias("place", "term"))
    shared = t.groupBy("term", key).agg(F.count("*").alias("tf"), F.sort_array(F.collect_list(F.col("place").cast("long"))).alias("positions"), F.max("dl").alias("dl"))
    return docs.join(several, same, "left_anti").mapInArrow(_indexed(key, terms), out).unionByName(shared)


def _indexed(key: str, terms: str):
    """A mapInArrow function that gives each document's terms with their places."""
    def part(keys: pa.Array, lists: pa.Array, lengths: np.ndarray) -> pa.RecordBatch:
        coded = lists.flatten().dictionary_encode()
        code, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary) or 1
        row = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        pair = row * n + code
        order = np.argsort(pair, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(pair[order]) != 0]) if len(order) else np.zeros(0, np.int64)
        at = order[first]
        ends = np.r_[first, len(order)].astype(np.int32)
        return pa.RecordBatch.from_pydict({
            "term": coded.dictionary.take(pa.array(code[at])), key: keys.take(pa.array(row[at])), "tf": np.diff(ends).astype(np.int64),
            "positions": pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order], pa.int64())), "dl": lengths[row[at]],
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.column(key), batch.column(terms)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            turn = np.cumsum(lengths) // CHUNK
            cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(lengths)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    yield part(keys.slice(lo, hi - lo), lists.slice(lo, hi - lo), lengths[lo:hi])

    return run


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], every: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the documents that hold any, or every, of the terms; only documents with words count for the mean length.

    Texts are read once: a few numbers a document are kept, and both the statistics and the scores come from them.
    """
    from ..checkpoint import durable

    t = durable(counted(docs, key, text, terms).where("dl > 0"))
    stats = t.agg(F.count("*").alias("n"), F.avg("dl").alias("av"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))]).first()
    n, av = stats["n"], stats["av"] or 1.0
    tf = [F.col(f"tf_{i}") for i in range(len(terms))]
    idf = [math.log(1 + (n - stats[f"df_{i}"] + 0.5) / (stats[f"df_{i}"] + 0.5)) for i in range(len(terms))]
    score = sum((w * x * (k1 + 1) / (x + k1 * (1 - b + b * F.col("dl") / av)) for w, x in zip(idf, tf)), F.lit(0.0))
    hit = reduce(lambda p, q: p & q if every else p | q, [x > 0 for x in tf])
    return t.where(hit).select(key, score.alias("score"))


def multi_match(docs: DataFrame, key: str, fields: dict[str, float], terms: list[str], how: str = "best", tie: float = 0.0) -> DataFrame:
    """(key, score) over several text fields, each with a boost: `best` is the best field's score plus `tie` times the others', `most` the sum of all, `cross` a
    sum over terms of each term's best field. Every field is scored on its own statistics; documents that hold a term in no field are left out.
    """
    if how not in ("best", "most", "cross"):
        raise ValueError("how is best, most or cross")
    groups = [[t] for t in terms] if how == "cross" else [terms]
    parts = []
    for n, group in enumerate(groups):
        for field, boost in fields.items():
            parts.append(bm25(docs, key, field, group).select(key, F.lit(n).alias("group"), (F.col("score") * boost).alias("score")))
    each = reduce(DataFrame.unionByName, parts).groupBy(key, "group").agg(F.max("score").alias("top"), F.sum("score").alias("all"))
    value = {"best": F.col("top") + tie * (F.col("all") - F.col("top")), "most": F.col("all"), "cross": F.col("top")}[how]
    return each.groupBy(key).agg(F.sum(value).alias("score"))


def sounds_like(docs: DataFrame, key: str, text: str, names: list[str]) -> DataFrame:
    """(key, asked, terms, n): documents that hold words which sound like one of `names`, those words in order, and how many they are in all. Words are matched by their sound code, Latin letters alone."""
    asked = F.array(*[F.struct(F.lit(n).alias("asked"), F.soundex(F.lit(n)).alias("sound")) for n in names])
    each = docs.select(key, F.explode(F.filter(words(text), lambda w: w.rlike("^[a-z]+$"))).alias("term"))
    hit = each.withColumn("a", F.explode(F.filter(asked, lambda a: a["sound"] == F.soundex("term")))).groupBy(key, F.col("a.asked").alias("asked"), "term").agg(F.count("*").alias("k"))
    return hit.groupBy(key, "asked").agg(F.array_sort(F.collect_list("term")).alias("terms"), F.sum("k").alias("n"))


def phrase(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, n): how often the terms stand one after another in a document."""
    w = docs.select(key, words(text).alias("w"))
    # each term's places, moved to where the phrase would begin; the words are named a fixed number of times, as each name splits the text again
    fit = F.greatest(F.size("w") - (len(terms) - 1), F.lit(0))
    same = lambda t: lambda x: x == t
    here = [F.transform(F.slice("w", i + 1, fit), same(t)) for i, t in enumerate(terms)]
    at = F.filter(reduce(lambda p, q: F.zip_with(p, q, lambda x, y: x & y), here), lambda x: x)
    return w.select(key, F.size(at).alias("n")).where("n > 0")


def dictionary(docs: DataFrame, text: str) -> DataFrame:
    """(term, n, docs) of all terms."""
    each = docs.select(F.monotonically_increasing_id().alias("_d"), F.explode(words(text)).alias("term")).groupBy("term", "_d").agg(F.count("*").alias("k"))
    return each.groupBy("term").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))


def fuzziness(term: str | Column) -> Column:
    """Edits allowed for a term: none up to 2 letters, one up to 5, else two."""
    n = F.length(F.lit(term) if isinstance(term, str) else term)
    return F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2)


def suggestions(terms: DataFrame, asked: list[str], k: int) -> DataFrame:
    """(asked, term, distance, n, rank): the nearest terms of a dictionary (term, n) for a few asked words, by distance, then frequency."""
    each = F.explode(F.array(*map(F.lit, asked))).alias("asked")
    d = F.levenshtein("asked", "term")
    near = terms.select("term", "n", each).where(F.abs(F.length("term") - F.length("asked")) <= 2).withColumn("distance", d).where((F.col("distance") > 0) & (F.col("distance") <= fuzziness(F.col("asked"))))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy("distance", F.desc("n"), "term"))).where(F.col("rank") <= k)


def factor(value: Column, modifier: str) -> Column:
    """A field's value as a factor of a score."""
    forms = {
        "none": value, "log": F.log10(value), "log1p": F.log10(value + 1), "log2p": F.log10(value + 2), "ln": F.log(value), "ln1p": F.log(value + 1), "ln2p": F.log(value + 2),
        "square": value * value, "sqrt": F.sqrt(value), "reciprocal": 1 / value,
    }
    return forms[modifier]


def decay(distance: Column, kind: str, scale: float, offset: float = 0.0, left: float = 0.5) -> Column:
    """1 within the offset, `left` at offset + scale, by gauss, exp or linear."""
    x = F.greatest(F.lit(0.0), distance - offset)
    if kind == "gauss":
        return F.exp(x * x * math.log(left) / scale**2)
    if kind == "exp":
        return F.exp(x * math.log(left) / scale)
    return F.greatest(F.lit(0.0), 1 - x * (1 - left) / scale)


def elements(pages: DataFrame) -> DataFrame:
    """(page_id, pos, kind, tag, level, parent, attributes, text) of the start and end tags of pages, in order; comments, scripts and styles are left out.

    `level` counts the open tags before; void tags open nothing. `parent` is the pos of the last start tag one level up. `text` is what
    follows the tag up to the next one.
    """
    void = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
    clean = F.regexp_replace("html", r"(?is)<!--.*?-->|<!doctype[^>]*>|<script\b.*?</script>|<style\b.*?</style>", "")
    part = F.explode(F.transform(F.regexp_extract_all(clean, F.lit(r"(<[a-zA-Z/][^>]*>[^<]*)"), 1), lambda x, i: F.struct(i.alias("pos"), x.alias("raw")))).alias("p")
    t = pages.select("page_id", part).select("page_id", "p.pos", "p.raw")
    head = F.regexp_extract("raw", r"^<(/?)([a-zA-Z][a-zA-Z0-9]*)", 2)
    t = t.withColumn("tag", F.lower(head)).withColumn("kind", F.when(F.col("raw").startswith("</"), "end").when(F.col("tag").isin(void), "void").otherwise("start"))
    names = F.regexp_extract_all("raw", F.lit(r"\s([a-zA-Z][\w-]*)\s*="), 1)
    t = t.withColumn("attributes", F.when(F.col("kind") == "end", F.array().cast("array<string>")).otherwise(F.transform(names, F.lower))).withColumn("text", F.trim(F.regexp_extract("raw", r"(?s)>([^<]*)$", 1)))
    w = Window.partitionBy("page_id").orderBy("pos")
    move = F.when(F.col("kind") == "start", 1).when(F.col("kind") == "end", -1).otherwise(0)
    opened = F.coalesce(F.sum(move).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("level", (opened - F.when(F.col("kind") == "end", 1).otherwise(0)).cast("int"))
    # the last start tag of each level so far, as an array that a fold over the page keeps
    up = Window.partitionBy("page_id", "_up").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    both = t.withColumn("_up", F.col("level")).withColumn("_own", F.lit(False)).unionByName(t.where("kind = 'start'").withColumn("_up", F.col("level") + 1).withColumn("_own", F.lit(True)))
    both = both.withColumn("parent", F.max(F.when(F.col("_own"), F.col("pos"))).over(up))
    return both.where("NOT _own").select("page_id", "pos", "kind", "tag", "level", "parent", "attributes", "text", "raw")


def attribute(name: str) -> Column:
    """The value of an attribute in a tag; null if it is not there."""
    found = F.regexp_extract("raw", rf"(?i)\s{name}\s*=\s*[\"']?([^\"'>]*)", 1)
    return F.when(F.col("raw").rlike(rf"(?i)\s{name}\s*="), found)


def luminance(colour: Column) -> Column:
    """Relative luminance of #rrggbb."""
    def channel(at: int) -> Column:
        v = F.conv(F.substring(colour, at, 2), 16, 10).cast("double") / 255
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * channel(2) + 0.7152 * channel(4) + 0.0722 * channel(6)


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)
