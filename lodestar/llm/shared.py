"""Which keys occur in more than one document, without sending any key's documents to one place.

Documents are dealt into batches. Each batch sends every bucket the distinct keys it has there, once, however many of
its documents hold them; the bucket answers each batch with one bit per key. So a key that a third of all documents
share costs a bucket one entry per batch, and what comes back is an eighth of a byte per key.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = "batch int, bucket int, bits binary"
BITS_SCHEMA = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])
KEYS = "batch int, bucket int, keys binary, many binary"
KEYS_SCHEMA = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("many", pa.binary())])


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def into_batches(docs: DataFrame, total: int, batch_bytes: int = 6 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """(batch, doc_id, text, and a struct `rest` of the columns `carry`) with about `batch_bytes` of text a batch.

    A row's batch hangs on its doc_id and text alone, so that a recomputed task deals it alike; rows that repeat both share a batch.
    """
    n = max(8, ceil(total / batch_bytes))
    rest = [F.struct(*carry).alias("rest")] if carry else []
    pick = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest)
    return pick.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))


class Keys:
    """A batch's distinct keys by bucket; the same for every run over the batch."""

    def __init__(self, keys: np.ndarray, docs: np.ndarray, buckets: int):
        order = np.argsort(keys, kind="stable")
        keys, docs = keys[order], docs[order]
        new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        self.unique = keys[at]
        self.many = np.minimum.reduceat(docs, at) != np.maximum.reduceat(docs, at) if len(at) else np.zeros(0, bool)
        self.bucket = ((self.unique >> np.uint64(17)) % np.uint64(buckets)).astype(np.int32)
        self.order = np.argsort(self.bucket, kind="stable")
        self.edges = np.searchsorted(self.bucket[self.order], np.arange(buckets + 1))

    def rows(self, batch: int) -> pa.Table:
        found = []
        for b in np.unique(self.bucket).tolist():
            mine = self.order[self.edges[b] : self.edges[b + 1]]
            found.append({"batch": batch, "bucket": b, "keys": self.unique[mine].tobytes(), "many": np.packbits(self.many[mine]).tobytes()})
        return pa.Table.from_pylist(found, schema=KEYS_SCHEMA)

    def shared(self, keys: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
        """For each of `keys`, whether its bucket answered that another document has it."""
        flags = np.zeros(len(self.unique), bool)
        for b, bits in answers.items():
            mine = self.order[self.edges[b] : self.edges[b + 1]]
            flags[mine] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(mine)).astype(bool)
        return flags[np.searchsorted(self.unique, keys)] if len(keys) else np.zeros(0, bool)


def _answer(table: pa.Table) -> pa.Table:
    batch, bucket = table.column("batch").to_pylist(), table.column("bucket").to_pylist()
    parts = [np.frombuffer(k.as_py(), np.uint64) for k in table.column("keys")]
    sizes = [len(p) for p in parts]
    keys = np.concatenate(parts)
    many = np.concatenate([np.unpackbits(np.frombuffer(m.as_py(), np.uint8), count=n).astype(bool) for m, n in zip(table.column("many"), sizes)])
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = np.r_[False, ordered[1:] == ordered[:-1]]
    near = same | np.r_[same[1:], False]
    hit = np.empty(len(keys), bool)
    hit[order] = near
    # a key that one batch has in many documents and no other batch has stands alone in this order
    hit |= many
    out, at = [], 0
    for b, k, n in zip(batch, bucket, sizes):
        out.append({"batch": b, "bucket": k, "bits": np.packbits(hit[at : at + n]).tobytes()})
        at += n
    return pa.Table.from_pylist(out, schema=BITS_SCHEMA)


def shared_bits(keys: DataFrame) -> DataFrame:
    """(batch, bucket, bits): for each batch's keys of a bucket, in their order, whether two documents or more have the key."""
    return keys.groupBy("bucket").applyInArrow(_answer, BITS)
