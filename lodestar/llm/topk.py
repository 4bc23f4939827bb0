"""Exact top-k search: tiled matrix products of query blocks and candidate tiles, merged as a tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table

#: Products are clipped to TOP and -TOP; EMPTY is less than any of them and marks a place of a list that no candidate fills.
SCALE, TOP, EMPTY = 1024.0, np.iinfo(np.int64).max, np.iinfo(np.int64).min
TILE = "tile long, dim int, n int, ids binary, cells binary, kind string"
LISTS = "block long, slot long, n int, queries binary, width int, ids binary, scores binary"


def _pack(values: np.ndarray) -> tuple[bytes, str]:
    """Whole-number components in the narrowest of two exact forms."""
    small = not values.size or np.abs(values).max() < 32000
    return (values.astype(np.int16).tobytes(), "int16") if small else (values.tobytes(), "float64")


def _tiles(rows_per_tile: int):
    """A group of vectors of one length to tiles; the rows are sorted first, so a task that runs again makes the same tiles."""
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ids = rows.column("vec_id").to_numpy()
        cells = np.asarray(rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(len(ids), -1)
        cells = np.nan_to_num(np.floor(SCALE * cells))  # what is too large to scale becomes the largest number
        order = np.lexsort((*cells.T[::-1], ids))
        ids, cells, out = ids[order].astype(np.int64), cells[order], []
        for at in range(0, len(ids), rows_per_tile):
            part = slice(at, at + rows_per_tile)
            cell, kind = _pack(cells[part])
            out.append({"tile": key[0].as_py() * (1 << 20) + at // rows_per_tile, "dim": key[1].as_py(), "n": len(ids[part]), "ids": ids[part].tobytes(), "cells": cell, "kind": kind})
        return pa.Table.from_pylist(out, schema=SCHEMA)

    SCHEMA = pa.schema([("tile", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("cells", pa.binary()), ("kind", pa.string())])
    return run


def _tiled(vectors: DataFrame, rows_per_tile: int) -> DataFrame:
    """Vectors (vec_id, embedding) in tiles of about `rows_per_tile`; which rows share a tile hangs on their content alone."""
    n = max(1, -(-vectors.count() // rows_per_tile))
    keyed = vectors.withColumn("tile", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n))).withColumn("dim", F.size("embedding"))
    return keyed.groupBy("tile", "dim").applyInArrow(_tiles(rows_per_tile), TILE)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]  # ~ falls like -, and has no overflow
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole-number rows."""
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(v) for v in row] for row in a], object) @ np.array([[int(v) for v in row] for row in b], object).T
    return np.clip(exact, -TOP, TOP).astype(np.int64)


def _search(k: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                qids, ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                q = np.frombuffer(r["q_cells"], r["q_kind"]).reshape(r["q_n"], -1).astype(float)
                scores = _products(q, np.frombuffer(r["cells"], r["kind"]).reshape(r["n"], -1).astype(float))
                own = ids[None, :] == qids[:, None]
                width = min(k, len(ids))
                top_ids, top = np.full((len(qids), width), TOP), np.full((len(qids), width), EMPTY)
                for i in range(len(qids)):
                    row = np.where(own[i], EMPTY, scores[i])
                    least = np.partition(row, len(row) - width)[len(row) - width]
                    found = np.flatnonzero((row >= least) & ~own[i])
                    found = found[np.lexsort((ids[found], ~row[found]))[:width]]
                    top_ids[i, : len(found)], top[i, : len(found)] = ids[found], row[found]
                yield pa.RecordBatch.from_pylist([{"block": r["block"], "slot": r["slot"], "n": len(qids), "queries": r["q_ids"], "width": width, "ids": top_ids.tobytes(), "scores": top.tobytes()}], schema=OUT)

    OUT = pa.schema([("block", pa.int64()), ("slot", pa.int64()), ("n", pa.int32()), ("queries", pa.binary()), ("width", pa.int32()), ("ids", pa.binary()), ("scores", pa.binary())])
    return run


def _merge(k: int):
    def run(key: tuple, lists: pd.DataFrame) -> pd.DataFrame:
        n = int(lists["n"].iloc[0])
        ids = np.concatenate([np.frombuffer(x, np.int64).reshape(n, -1) for x in lists["ids"]], axis=1)
        scores = np.concatenate([np.frombuffer(x, np.int64).reshape(n, -1) for x in lists["scores"]], axis=1)
        ids, scores = _best(ids, scores, k)
        return pd.DataFrame({"block": [key[0]], "slot": [key[1]], "n": [n], "queries": [lists["queries"].iloc[0]], "width": [ids.shape[1]], "ids": [ids.tobytes()], "scores": [scores.tobytes()]})

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, query_block: int = 1024, tile_rows: int = 4096, fan_in: int = 8) -> DataFrame:
    """The `k` best candidates of every query, both (vec_id, embedding): query_id, rank, vec_id, score.

    Components are taken as floor(1024 * x), so the score is an exact integer inner product; ties go to the smaller
    vec_id. Candidates are packed into tiles of `tile_rows` vectors, queries into blocks; each block meets each tile once
    in a matrix product, of which the k best per query are selected, and the lists of a block are merged `fan_in` at
    a time until one is left. Only blocks, tiles and lists of k are moved.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows with null vec_id; only
    vectors of one length are compared. A row's own vec_id is no candidate for it, and repeated rows give repeated
    candidates; queries are taken once per vec_id, of several vectors the least. With fewer candidates than k all are returned; empty tables give an
    empty result; other columns are ignored. Products outside the range of a long are clipped to it.
    """
    spark = candidates.sparkSession
    slots = partitions(spark)
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vector = lambda df: df.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where((F.size("embedding") > 0) & whole)
    tiles = _tiled(vector(candidates), tile_rows).withColumn("slot", F.pmod("tile", F.lit(slots).cast("long"))).drop("tile")
    asked = vector(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = _tiled(asked, query_block).select(F.xxhash64("tile", "dim").alias("block"), F.col("dim"), F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"), F.col("kind").alias("q_kind"))
    sent = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).withColumn("slot", F.col("slot").cast("long"))
    lists = sent.join(tiles, ["slot", "dim"]).mapInArrow(_search(k), LISTS)
    lists = lists.groupBy("block", "slot").applyInPandas(_merge(k), LISTS)
    left = slots
    while left > 1:
        left = -(-left // fan_in)
        lists = lists.withColumn("slot", F.floor(F.col("slot") / fan_in)).groupBy("block", "slot").applyInPandas(_merge(k), LISTS)

    def rows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q, ids, scores = (np.frombuffer(r[c], np.int64) for c in ("queries", "ids", "scores"))
                width = r["width"]
                full = scores != EMPTY
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, width)[full]), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(q))[full]), pa.array(ids[full]), pa.array(scores[full])], names=["query_id", "rank", "vec_id", "score"])

    return lists.mapInArrow(rows, "query_id long, rank int, vec_id long, score long")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.where("vec_id % 100 = 0"), vectors)
