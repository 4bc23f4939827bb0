"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posterior labels."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, held_out, slices, table

WORD = re.compile(r"[^\W\d_]+")
# Common English insults, the lexicon that does not depend on labels.
INSULTS = (
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "fool", "loser", "losers", "scum", "trash", "garbage", "pathetic", "worthless",
    "disgusting", "clown", "ugly", "pig", "imbecile", "jerk", "creep", "freak", "vermin", "filth", "bastard",
)
# Surface patterns of hostile writing.
PATTERNS = (
    r"\b(?:you|u)\s+(?:are|r)\s+(?:an?\s+)?(?:\w+\s+)?(?:idiot|moron|fool|loser|clown)",
    r"\b(?:shut up|go away|get lost|drop dead|i hate you|kill yourself)\b",
    r"!{3,}",
    r"\b[A-Z]{4,}(?:\W+[A-Z]{4,}){3,}",
)


@dataclass(frozen=True)
class Model:
    terms: tuple[str, ...]
    accuracy: tuple[float, ...]
    overlap: tuple[float, ...]
    weights: tuple[float, ...]


def votes(text: str | None, index: dict[str, int], patterns: list[re.Pattern]) -> tuple[np.ndarray, float, float]:
    """Which lexicon and pattern voters fire on a whole text; how many lexicon words it has, and per word."""
    fired, words, hits = np.zeros(len(index) + len(patterns), np.float32), 0, 0
    if text:
        said = WORD.findall(text.lower())
        found = [at for at in map(index.get, said) if at is not None]
        words, hits = len(said), len(found)
        fired[found] = 1
        for k, p in enumerate(patterns):
            if p.search(text):
                fired[len(index) + k] = 1
    return fired, float(np.log1p(hits)), hits / max(1, words)


def features(text: str | None, index: dict[str, int], patterns: list[re.Pattern]) -> np.ndarray:
    fired, count, share = votes(text, index, patterns)
    return np.r_[1.0, fired, count, min(1.0, 20 * share), float(count > 0), float(count > 1)]


def lexicon(sample: DataFrame, size: int = 48, least: int = 5) -> list[str]:
    """Words of toxic rows of `sample` (text, toxic) that tell most, at least `least` rows having them: a voter each.

    A word is taken if it occurs in toxic rows well beyond chance: its smoothed log odds, less two standard errors,
    exceed 1. An occurrence counts once per pair of neighbours it has, as else the words of a text that is copied
    many times would all look telling. Only `size` words reach the driver.
    """
    said = sample.select("toxic", F.split(F.lower("text"), r"[^\p{L}]+").alias("w"))
    met = F.transform("w", lambda x, i: F.struct(x.alias("word"), F.xxhash64(F.get("w", i - 1), F.get("w", i + 1)).alias("beside")))
    words = said.select("toxic", F.explode(met).alias("m")).select("toxic", "m.word", "m.beside").where("word <> ''").distinct()
    rows = words.agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).first()
    positive, negative = float(rows.p or 0), float((rows.n or 0) - (rows.p or 0))
    if not positive or not negative:
        return []
    p, n = F.col("p"), F.col("n") - F.col("p")
    odds = F.log((p + 0.5) / (positive - p + 0.5)) - F.log((n + 0.5) / (negative - n + 0.5))
    error = F.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
    kept = words.groupBy("word").agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).where(F.col("p") >= least).select("word", (odds - 2 * error).alias("s"), "p")
    return [r.word for r in kept.where("s > 1").orderBy(F.desc(F.col("s") * F.sqrt("p")), "word").limit(size).collect()]


def label_model(fired: np.ndarray, known: np.ndarray, noise: float = 0.02, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over voters: (posterior of toxic per row, rates if toxic, rates if clean, overlap).

    Voter j fires with one probability in toxic and another in clean rows. Voters are not independent: within a class
    the correlation of their residuals is estimated as well, and the evidence of a voter that fires is divided by one
    plus its correlations with the others that fire, so that voters that repeat one another count once; the evidence
    of its silence is divided by its correlations with all. `known` is 1, 0 or -1 (no
    label); a label is itself a voter that is wrong with probability `noise`.
    """
    rows, m = fired.shape
    any_fired = fired.any(axis=1)
    post = np.where(known >= 0, np.where(known == 1, 1 - noise, noise), np.where(any_fired, 0.5, 0.1))
    rate1 = rate0 = np.full(m, 0.5)
    overlap = np.ones(m)
    for _ in range(rounds):
        w1, w0 = post.sum() + 1e-9, (1 - post).sum() + 1e-9
        rate1, rate0 = (post @ fired + 0.1) / (w1 + 1), ((1 - post) @ fired + 0.1) / (w0 + 1)
        residual = fired - post[:, None] * rate1 - (1 - post)[:, None] * rate0
        cov = residual.T @ residual / rows
        sd = np.sqrt(np.diag(cov)) + 1e-6
        shared = np.clip(cov / sd[:, None] / sd - np.eye(m), 0, 1)
        overlap = 1 + shared.sum(axis=1)
        prior = np.clip(w1 / (w1 + w0), 0.005, 0.995)
        hit = np.log(rate1 / rate0)
        miss = np.log((1 - rate1) / (1 - rate0)) / overlap
        logit = np.log(prior / (1 - prior)) + (fired * hit / (1 + fired @ shared)).sum(axis=1) + (1 - fired) @ miss
        logit += np.where(known == 1, 1, np.where(known == 0, -1, 0)) * np.log((1 - noise) / noise)
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post, rate1, rate0, overlap


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.2, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * np.r_[0, w[1:]]
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(np.r_[1e-6, np.full(len(w) - 1, ridge)])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, seed: int = 9) -> Model:
    """Fit voters, label model and classifier on about `max_rows` labelled rows and as many without a label.

    That bounded sample (by a hash of doc_id) is all that is fitted on; only its votes, not its texts, reach the driver. Labels other
    than 0 and 1 are ignored; of several labels of a document the largest counts.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n_marked, n_docs = marked.count(), docs.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    sample = texts.join(marked.where(draw < max_rows / max(1, n_marked)), "doc_id").select("text", "toxic")
    rest = texts.where(draw < max_rows / max(1, n_docs)).join(marked, "doc_id", "left_anti").select("text", F.lit(-1).alias("toxic"))
    terms = list(dict.fromkeys([*INSULTS, *lexicon(sample)]))
    index, compiled = {t: k for k, t in enumerate(terms)}, [re.compile(p) for p in PATTERNS]

    def run(batches):
        for batch in batches:
            x = [features(t.as_py(), index, compiled).astype(np.float32).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.binary())], names=["toxic", "x"])

    got = sample.unionByName(rest).mapInArrow(run, "toxic int, x binary").collect()
    width = len(terms) + len(compiled) + 5
    if not got:
        return Model(tuple(terms), (0.5,) * (len(terms) + len(compiled)), (1.0,) * (len(terms) + len(compiled)), (-3.0, *[0.0] * (width - 1)))
    known, x = np.array([r.toxic for r in got]), np.stack([np.frombuffer(r.x, np.float32) for r in got]).astype(float)
    fired = x[:, 1 : 1 + len(terms) + len(compiled)]
    post, rate1, rate0, overlap = label_model(fired, known)
    return Model(tuple(terms), tuple((rate1 / (rate1 + rate0)).tolist()), tuple(overlap.tolist()), tuple(_logistic(x, post).tolist()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with the column toxicity (0 to 1) for every row's whole text; null and empty texts get the score of no evidence.

    Repeated rows repeat, an empty table gives an empty result, and other columns pass through, but for one named
    toxicity, which is replaced.
    """
    weights = np.array(model.weights)

    def run(batches):
        index, compiled = {t: k for k, t in enumerate(model.terms)}, [re.compile(p) for p in PATTERNS]
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            logit = [float(features(t.as_py(), index, compiled) @ weights) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(np.array(logit, float), -30, 30))), pa.float64())], names=[*batch.schema.names, "toxicity"])
        give_back()

    docs = docs.drop("toxicity")
    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", toxicity double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
