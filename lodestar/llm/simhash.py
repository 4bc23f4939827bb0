"""SimHash near-dedup: 64-bit fingerprints linked by a binary-trie self-join, then connected components."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, durable, give_back, local_roots, partitions, slices, table, utf8
from .words import mix

SEED = 42


def fingerprints(text: str | None, width: int = 3, prints: int = 1) -> list[int]:
    """`prints` SimHashes of the text's word shingles as signed 64-bit integers, 0 where it has no word; the first is over the shingles' hashes, the others over hashes of these."""
    words = utf8(text).lower().split()
    if not words:
        return [0] * prints
    if len(words) < width:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles, n = map(b" ".join, zip(*(words[k:] for k in range(width)))), len(words) - width + 1
    ones, left = np.zeros((prints, 64), np.int64), n
    while left:
        take = min(left, 1 << 15)
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED, take)), np.uint64, take) if take < left else np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, take)
        for k in range(prints):
            other = mix(h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) if k else h
            ones[k] += np.unpackbits(other.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        left -= take
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.int64).ravel().tolist()


def with_fingerprints(docs: DataFrame, width: int = 3, prints: int = 1) -> DataFrame:
    """(doc_id, fps array of long) of every row of `docs`."""
    def run(batches):
        for batch in slices(batches):
            fps = pa.array([fingerprints(t.as_py(), width, prints) for t in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["doc_id", "fps"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fps array<long>")


def blocks(n_blocks: int, budget: int) -> list[int]:
    """Masks of the bits that are held equal: all blocks but `budget` of them, in every choice.

    Two fingerprints within `budget` bits agree on at least one of these masks in full.
    """
    edges = [64 * k // n_blocks for k in range(n_blocks + 1)]
    mask = [sum(1 << b for b in range(edges[k], edges[k + 1])) for k in range(n_blocks)]
    return [sum(mask[k] for k in keep) for keep in combinations(range(n_blocks), n_blocks - budget)]


def first_bits(fps: np.ndarray, mask: int) -> np.ndarray:
    """The fingerprints with the bits of `mask`, then the others, from the top; the order within both is kept."""
    out, bits = np.zeros(len(fps), np.uint64), [b for b in range(63, -1, -1) if mask >> b & 1] + [b for b in range(63, -1, -1) if not mask >> b & 1]
    at = 0
    while at < 64:  # runs of neighbouring bits move together
        n = 1
        while at + n < 64 and bits[at + n] == bits[at] - n:
            n += 1
        out |= (fps >> np.uint64(bits[at] - n + 1) & np.uint64((1 << n) - 1)) << np.uint64(64 - at - n)
        at += n
    return out


def trie_pairs(fps: np.ndarray, group: np.ndarray, mask: int, budget: int, most: int = 1 << 16):
    """Yield index arrays (a, b), a before b, of the fingerprints of one group within `budget` differing bits.

    `fps` (uint64, no repeats in a group) are sorted by (group, bits outside `mask`) and agree on `mask` in a group. An
    interval of that order is a node of the group's trie. Pairs of nodes go down together one bit at a time, starting
    with every group's root beside itself; a pair whose differing bits exceed the budget is dropped with all below it.
    At most about `most` pairs are held per level; the rest wait on a stack.
    """
    bits = [b for b in range(63, -1, -1) if not mask >> b & 1]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(group)]
    keep = ends - starts > 1
    lo, hi = starts[keep].astype(np.int64), ends[keep].astype(np.int64)
    zeros: dict[int, np.ndarray] = {}
    stack = [(0, np.stack([lo, hi, lo, hi, np.zeros_like(lo)]))] if len(lo) else []
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > most:
            stack.append((depth, pairs[:, most:]))
            pairs = pairs[:, :most]
        if depth == len(bits):
            a, b = pairs[0], pairs[2]
            apart = a != b
            if apart.any():
                yield a[apart], b[apart]
            continue
        if depth not in zeros:
            zeros[depth] = np.r_[0, np.cumsum((fps >> np.uint64(bits[depth]) & np.uint64(1)) == 0)]
        z = zeros[depth]
        alo, ahi, blo, bhi, err = pairs
        amid, bmid = alo + z[ahi] - z[alo], blo + z[bhi] - z[blo]
        below = np.concatenate([
            np.stack([alo, amid, blo, bmid, err]), np.stack([amid, ahi, bmid, bhi, err]),
            np.stack([alo, amid, bmid, bhi, err + 1]), np.stack([amid, ahi, blo, bmid, err + 1])[:, alo != blo],
        ], axis=1)
        alone = (below[0] == below[2]) & (below[1] - below[0] < 2)
        below = below[:, (below[1] > below[0]) & (below[3] > below[2]) & (below[4] <= budget) & ~alone]
        if below.shape[1]:
            stack.append((depth + 1, below))


def link_fingerprints(nodes: DataFrame, budget: int = 2, n_blocks: int = 7, prints: int = 1, rows_per_task: int = 250_000) -> DataFrame:
    """Links (src, dst) that connect the nodes (fps array of long, rep long) of which any fingerprint differs in `budget` bits or fewer from the same one of the other.

    Every node is dealt out once per mask of `blocks`, so a task only meets nodes that agree on the mask: with 7 blocks
    and budget 2 a group has at most 2**19 fingerprints, however many documents there are. In a task the links of all
    its groups are contracted to a star per component, so copies do not become pairs. The number of tasks follows the
    number of nodes, at about `rows_per_task` dealt rows a task.
    """
    masks = blocks(n_blocks, budget)
    signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
    each = nodes.select(F.posexplode("fps").alias("turn", "fp"), "rep")
    alike = Window.partitionBy("turn", "fp")
    named = each.withColumn("least", F.min("rep").over(alike))
    equal = named.where("rep <> least").select(F.col("rep").alias("src"), F.col("least").alias("dst"))
    dealt = named.where("rep = least").select("turn", "fp", "rep", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("way"))
    key = F.col("fp").bitwiseAND(F.get(signed, F.col("way")))

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got)
        del got
        turn, fp, rep, way = (whole.column(c).to_numpy() for c in ("turn", "fp", "rep", "way"))
        # the bits of the mask go first, so that one walk serves the groups of all masks
        moved = np.zeros(len(fp), np.uint64)
        for k, m in enumerate(masks):
            mine = np.flatnonzero(way == k)
            moved[mine] = first_bits(fp[mine].view(np.uint64), m)
        kept = ((1 << 64) - 1) ^ ((1 << 64 - min(m.bit_count() for m in masks)) - 1)
        order = np.lexsort((moved, way, turn))
        turn, way, moved, rep = turn[order], way[order], moved[order], rep[order]
        head = moved & np.uint64(kept)
        group = np.cumsum(np.r_[True, (turn[1:] != turn[:-1]) | (way[1:] != way[:-1]) | (head[1:] != head[:-1])])
        a_all, b_all = [], []
        for a, b in trie_pairs(moved, group, kept, budget):
            a_all.append(rep[a])
            b_all.append(rep[b])
        if a_all:
            roots = local_roots(np.concatenate(a_all), np.concatenate(b_all))
            pairs = [(x, y) for x, y in roots.items() if x != y]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["src", "dst"])
        del whole, turn, fp, rep, way, moved, order, head, group, a_all, b_all
        give_back()

    n_tasks = max(partitions(nodes.sparkSession), nodes.count() * prints * len(masks) // rows_per_task)
    links = dealt.repartition(n_tasks, "turn", "way", key).mapInArrow(run, "src long, dst long")
    return links.unionByName(equal)


def simhash_components(docs: DataFrame, budget: int = 2, width: int = 3, prints: int = 1) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, fingerprint (the first, 16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of `budget` differing bits or fewer in any of the `prints` fingerprints, itself included.
    Copies share one node (their fingerprints), represented by their smallest doc_id, so a group of any size costs one
    node. A text without words (null, empty, white space) has fingerprint zero and is linked like any other. A row with
    null doc_id keeps its fingerprint and gets the component of the other rows of that fingerprint, null if there are
    none. Repeated rows repeat in the result; an empty table gives an empty result; other columns are ignored.
    """
    found = durable(with_fingerprints(docs, width, prints))
    nodes = found.groupBy("fps").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL")
    component = connected_components(link_fingerprints(nodes, budget, prints=prints))
    named = nodes.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("fps", F.coalesce("component", "rep").alias("component_id"))
    return found.join(named, "fps", "left").select("doc_id", F.lpad(F.lower(F.hex(F.get("fps", F.lit(0)))), 16, "0").alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
