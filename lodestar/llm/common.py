"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoint import checkpoint_dir, durable  # noqa: F401  the operators take them from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches, text: str = "text", most: int = 4 << 20):
    """The record batches `batches`, cut so that a slice has about `most` bytes of the column `text`, or one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
        cell = np.cumsum(sizes, dtype=np.int64) // most
        cuts = np.r_[0, np.flatnonzero(np.diff(cell)) + 1, batch.num_rows]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b > a:
                yield batch.slice(a, b - a)


def give_back() -> None:
    """Return freed memory to the system, as Python workers are used again for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def held_out(doc_id, modulus: int, remainder: int):
    """True where crc32(doc_id as text) mod `modulus` is `remainder`; null ids are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (src long, dst long); component is the least node reachable.

    Alternates large-star and small-star rounds until the edge set stands still; every round is two aggregations
    with map-side combine and two equi joins, and is checkpointed, so no link ever visits the driver. Null ends and
    self loops are ignored. An error is raised if links still change after `max_rounds`.
    """
    def signature(df):
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    now = durable(
        edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    )
    before = signature(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(root, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(root.select("u", F.col("m").alias("v"))).distinct()
        now = durable(small)
        after = signature(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"links still changed after {max_rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def local_roots(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """node -> least node of its component, for the links (a[i], b[i]) of one task."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}
