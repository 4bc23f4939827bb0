"""Sharding by sampled splitters, in DataFrame functions only."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SAMPLE = 1 << 40


def _positions(splitters: list[tuple[int, int]], h: Column, d: Column) -> Column:
    """How many of the sorted `splitters` are <= (h, d): a branch-free binary search over two literal arrays."""
    if not splitters:
        return F.lit(0)
    size = 1 << len(splitters).bit_length()
    padded = splitters + [(2**63 - 1, 2**63 - 1)] * (size - len(splitters))
    hs, ds = F.array(*[F.lit(x).cast("long") for x, _ in padded]), F.array(*[F.lit(y).cast("long") for _, y in padded])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(size.bit_length() - 1))])

    def step(at, s):
        x, y = F.get(hs, at + s - 1), F.get(ds, at + s - 1)
        return at + F.when((x < h) | ((x == h) & (y <= d)), s).otherwise(0)

    return F.least(F.aggregate(steps, F.lit(0), step), F.lit(len(splitters)))


def _sample(base: DataFrame, rate: float, seed: int, within: Column | None = None) -> list[tuple[int, int, int]]:
    """Keys drawn with probability weight * rate, by a hash of the key, so that a recomputed task draws the same ones."""
    drawn = base.where(F.pmod(F.xxhash64("h", "d", F.lit(seed)), F.lit(SAMPLE)) < F.col("weight") * rate * SAMPLE)
    drawn = drawn if within is None else drawn.where(within)
    return sorted((r.h, r.d, r.weight) for r in drawn.select("h", "d", "weight").collect())


def _quantiles(keys: list[tuple[int, int, int]], rate: float, pieces: int) -> list[tuple[int, int]]:
    """Boundaries of `pieces` parts of about equal weight; a key kept for certain counts with its own weight."""
    if not keys or pieces < 2:
        return []
    ends, total = [], 0.0
    for _, _, w in keys:
        total += max(1.0, w * rate)
        ends.append(total)
    return sorted({keys[min(bisect_right(ends, total * k / pieces), len(keys) - 1)][:2] for k in range(1, pieces)})


def shard(docs: DataFrame, n_shards: int = 8, law: str = "bytes", rows_per_range: int = 50_000, keys_per_range: int = 40, slack: float = 0.005, seed: int = 42) -> DataFrame:
    """Put every row of `docs` (doc_id, text, ...) into one of `n_shards` shards: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes (null: none) plus 1; `law` 'bytes' keeps the shards' sizes near equal, 'rows' keeps
    their counts at most one apart. Rows are ordered by (hash of the text, doc_id), which puts equal texts together.
    Keys are sampled with a probability in proportion to size, their quantiles are the splitters, and ranges that turn
    out above twice the mean are subdivided by a denser sample inside them; as the splitters hold doc_id, a hot text is
    cut like any other. A cut between shards moves to the nearest border of a group of equal texts where that is
    within `slack` of a shard's size; larger groups are cut inside, so sizes stay near equal with any skew.

    The driver holds splitters and one total per range (at most 4096 ranges), never rows. Null doc_id sorts first; null
    text is a text of its own of size 1; repeated rows get slots of their own; an empty table gives an empty result;
    other columns are ignored.
    """
    if law not in ("bytes", "rows"):
        raise ValueError("law is 'bytes' or 'rows'")
    text = F.col("text")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"),
    ).withColumn("weight", F.col("size") if law == "bytes" else F.lit(1).cast("long"))
    rows, total = base.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    ranges = max(64, min(4096, rows // rows_per_range))
    rate = ranges * keys_per_range / max(1, total)
    splitters = _quantiles(_sample(base, rate, seed), rate, ranges) if rows else []

    for again in range(1, 4):
        placed = base.withColumn("range", _positions(splitters, F.col("h"), F.col("d")))
        sums = {r["range"]: (r["n"], r["w"]) for r in placed.groupBy("range").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
        ideal = total / ranges
        over = [k for k, (n, w) in sums.items() if n > 1 and w > 2 * ideal]
        if not over or again == 3:
            break
        dense = rate * 16**again
        inside: dict[int, list] = {k: [] for k in over}
        for key in _sample(placed, dense, seed + again, F.col("range").isin(over)):
            inside[bisect_right(splitters, key[:2])].append(key)
        more = {s for k, keys in inside.items() for s in _quantiles(keys, dense, int(sums[k][1] // ideal) + 1)} - set(splitters)
        if not more:
            break
        splitters = sorted({*splitters, *more})

    ids = range(len(splitters) + 1)
    first_row, first_weight, n, w = [], [], 0, 0
    for k in ids:
        first_row.append(n)
        first_weight.append(w)
        n, w = n + sums.get(k, (0, 0))[0], w + sums.get(k, (0, 0))[1]
    pick = lambda values: F.get(F.array(*[F.lit(x).cast("long") for x in values]), F.col("range"))
    order = Window.partitionBy("range").orderBy("h", "d", "doc_id")
    numbered = placed.withColumn("g", F.row_number().over(order) - 1 + pick(first_row))

    targets = [total * k / n_shards for k in range(1, n_shards)]
    cuts = [-(-rows * k // n_shards) for k in range(1, n_shards)]
    if law == "bytes" and rows:
        at = [bisect_right(first_weight, t) - 1 for t in targets]
        near = numbered.where(F.col("range").isin(sorted(set(at)))).withColumn("ahead", F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight") + pick(first_weight)).withColumn("starts", F.coalesce(F.lag("h").over(order) != F.col("h"), F.lit(False)))
        tolerance = slack * total / n_shards
        cost = lambda t: F.abs(F.col("ahead") - F.lit(t)) + F.when(F.col("starts"), 0.0).otherwise(tolerance)
        best = near.agg(*[F.min(F.when(F.col("range") == k, F.struct(cost(t).alias("c"), F.col("g").alias("g")))).alias(f"c{i}") for i, (k, t) in enumerate(zip(at, targets))]).first()
        cuts, least = [], 0
        for i in range(n_shards - 1):
            least = max(least, best[i]["g"] if best[i] else least)
            cuts.append(least)
    number = sum(((F.col("g") >= c).cast("int") for c in cuts), F.lit(0))
    return numbered.withColumn("shard", number.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard",
        (F.col("g") - F.get(F.array(*[F.lit(c).cast("long") for c in [0, *cuts]]), F.col("shard"))).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
