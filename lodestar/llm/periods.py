"""Periodic runs: tiles of words per period octave, Z-values at block boundaries, fragments stitched by document and period."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, give_back, partitions, slices, table, utf8
from .words import Words, mix

#: Words of the lowest tiles, which are solved for all periods under 2**LOW; an octave k above has tiles of 2**(k+5) words.
TILE, LOW = 1 << 16, 12
REST = "uid binary, doc_id long, kind string, level int, period long, lo long, hi long, payload binary, digest string"
REST_SCHEMA = pa.schema([("uid", pa.binary()), ("doc_id", pa.int64()), ("kind", pa.string()), ("level", pa.int32()), ("period", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("payload", pa.binary()), ("digest", pa.string())])
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
RESULT_SCHEMA = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")], ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
EMPTY = hashlib.sha256(b"").hexdigest()


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(first word, period) of the repetition that the query writes into a tenth of the documents; None for the others."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def sources(doc_id: int | None, n: int, plant: bool) -> np.ndarray | None:
    """The original word that stands at each place, or None where the words stand as they are."""
    found = planted(doc_id, n) if plant else None
    if found is None:
        return None
    a, p = found
    return np.r_[np.arange(a), a + np.arange(n - a) % p]


def least_length(period):
    """Words that a run of `period` must have."""
    return np.maximum(6, 4 * period)


def solve(words: np.ndarray, edges: np.ndarray, low: int = 0, high: int = 62) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, lo, hi) of the stretches of `words` with least period in [2**low, 2**high) that are long enough, inside the tiles edges[i]..edges[i+1].

    `edges` are the places where tiles begin and end, tiles in falling order of length. For the octave 2**k..2**(k+1) the words
    are cut at every multiple of B = 2**k. A stretch of period p repeats at least 3p words, so it covers a whole block
    [c, c+B) that equals [c+p, c+p+B): at c the Z-value for the shift p is B or more, which one comparison of block hashes with the next
    block row tells for all c and p. Neighbouring blocks of one shift make a chain, which reaches within B words of the
    stretch's ends; these are then found by comparing the words. A shift whose words a stretch of a lower octave covers is a multiple of that one's period.
    """
    sizes = np.diff(edges)
    ends = np.repeat(edges[1:], sizes)
    begins = np.repeat(edges[:-1], sizes)
    cover = np.zeros(len(words) + 1, np.int64)
    found: list[tuple[int, int, int]] = []
    h = mix(words.astype(np.uint64))
    k, n = 0, len(words)
    while k < high:
        size = 1 << k
        n = int(sizes[sizes >= max(6, 4 * size)].sum())  # tiles are in falling order of length
        if not n:
            break
        if k >= low:
            rows = n // size
            grid = h[: rows * size].reshape(rows, size)
            at = np.flatnonzero(grid[1:] == grid[:-1, :1])
            c, p = at // size * size, size + at % size
            keep = (c + p + size <= ends[c]) & (cover[c] < c + p + size)
            c, p = c[keep], p[keep]
            order = np.lexsort((c, p))
            c, p = c[order], p[order]
            if len(c):
                head = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (c[1:] != c[:-1] + size) | (begins[c[1:]] != begins[c[:-1]])])
                tail = np.r_[head[1:], len(c)] - 1
                enough = (c[tail] - c[head]) + 3 * size > np.maximum(5, 3 * p[head])
                for first, last, period in zip(c[head][enough].tolist(), c[tail][enough].tolist(), p[head][enough].tolist()):
                    a, b = max(int(begins[first]), first - size), min(int(ends[first]) - period, last + 2 * size)
                    same = np.flatnonzero(np.diff(np.r_[False, words[a:b] == words[a + period : b + period], False].view(np.int8)))
                    for s, e in zip((a + same[::2]).tolist(), (a + same[1::2]).tolist()):
                        if e - s + period >= max(6, 4 * period):
                            found.append((period, s, e + period))
                new = np.array(found, np.int64).reshape(-1, 3)
                cover[:] = 0
                np.maximum.at(cover, new[:, 1], new[:, 2])
                np.maximum.accumulate(cover, out=cover)
        k += 1
        if 2 * size <= n:
            h = np.r_[mix(h[: n - size] * np.uint64(0x9E3779B97F4A7C15) + h[size:n]), np.zeros(size, np.uint64)]
    got = np.unique(np.array(found, np.int64).reshape(-1, 3), axis=0)
    return got[:, 0], got[:, 1], got[:, 2]


def tiles(n: int, tile: int = TILE, low: int = LOW):
    """(level, first word, end) of the overlapping tiles of a document of `n` words; level 0 takes all octaves under `low`, level j the octave low+j-1.

    Tiles of one level share eight times the least period of their highest octave, twice what a stretch of the largest period needs: what one
    tile cuts too short is whole in the next one, and the pieces of a longer stretch overlap.
    """
    level = 0
    while True:
        octave = low - 1 + level
        if level and 4 << octave > n:
            return
        size, shared = (tile if not level else 32 << octave), 8 << octave
        if size < 2 * shared:
            size = 4 * shared
        at = 0
        while True:
            yield level, at, min(at + size, n)
            if at + size >= n:
                break
            at += size - shared
        level += 1


def joined_sha(text: bytes, words: Words, order: np.ndarray) -> str:
    """SHA-256 of the words `order` of the single text in `words`, joined by a space."""
    said, first = hashlib.sha256(), True
    for at in range(0, len(order), 1 << 16):
        part = order[at : at + (1 << 16)]
        said.update((b"" if first else b" ") + b" ".join([text[a:b] for a, b in zip(words.start[part].tolist(), words.end[part].tolist())]))
        first = False
    return said.hexdigest()


def _uid(doc_id: int | None, text: bytes) -> bytes:
    return hashlib.blake2b(repr(doc_id).encode() + b"\0" + text, digest_size=16).digest()


def _cut(plant: bool, tile: int, low: int):
    """Documents to rows of four kinds: done (no run), text (to be finished), part (a fragment), tile (of a document longer than a tile)."""
    def rows_of(batch):
        ids = batch.column(0).to_pylist()
        texts = [utf8(t) for t in batch.column(1).to_pylist()]
        words = Words(texts, fold=False)
        counts = np.diff(words.word_edge)
        out, short = [], []
        hashes = words.hash.copy()
        for k in range(len(ids)):
            a, n = int(words.word_edge[k]), int(counts[k])
            src = sources(ids[k], n, plant)
            if src is not None:
                hashes[a : a + n] = words.hash[a : a + n][src]
            (short if n <= tile else out).append(k)
        short.sort(key=lambda k: -counts[k])
        long, out = out, []
        hot: dict[int, list] = {}
        if short:
            order = np.concatenate([np.arange(words.word_edge[k], words.word_edge[k + 1]) for k in short])
            edges = np.r_[0, np.cumsum(counts[short])]
            period, lo, hi = solve(hashes[order], edges)
            owner = np.searchsorted(edges, lo, side="right") - 1
            for p, a, b, o in zip(period.tolist(), lo.tolist(), hi.tolist(), owner.tolist()):
                hot.setdefault(short[o], []).append((p, a - int(edges[o]), b - int(edges[o])))
        for k in range(len(ids)):
            text = texts[k]
            if k in hot or counts[k] > tile:
                uid = _uid(ids[k], text)
                out.append({"uid": uid, "doc_id": ids[k], "kind": "text", "payload": text})
                out += [{"uid": uid, "kind": "part", "period": p, "lo": a, "hi": b} for p, a, b in hot.get(k, ())]
                if counts[k] > tile:
                    named = np.unique(hashes[words.word_edge[k] : words.word_edge[k + 1]], return_inverse=True)[1].astype(np.int32)
                    out += [{"uid": uid, "kind": "tile", "level": level, "lo": a, "hi": b, "payload": named[a:b].tobytes()} for level, a, b in tiles(int(counts[k]), tile, low)]
            else:
                src = sources(ids[k], int(counts[k]), plant)
                said = text.split()
                said = said if src is None else [said[i] for i in src.tolist()]
                out.append({"doc_id": ids[k], "kind": "done", "digest": hashlib.sha256(b" ".join(said)).hexdigest()})
        return out

    def run(batches):
        for batch in slices(batches):
            out = rows_of(batch)
            for at in range(0, len(out), 2000):
                yield pa.RecordBatch.from_pylist(out[at : at + 2000], schema=REST_SCHEMA)
        give_back()

    return run


def _solve_tiles(low: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                words = np.frombuffer(r["payload"], np.int32)
                octave = low - 1 + r["level"]
                period, lo, hi = solve(words, np.array([0, len(words)]), 0 if not r["level"] else octave, low if not r["level"] else octave + 1)
                if len(period):
                    yield pa.RecordBatch.from_arrays([pa.array([r["uid"]] * len(period), pa.binary()), pa.array(period), pa.array(lo + r["lo"]), pa.array(hi + r["lo"])], names=["uid", "period", "lo", "hi"])

    return run


def stitched(parts: DataFrame) -> DataFrame:
    """(uid, lo, hi, period) of whole runs: fragments (uid, period, lo, hi) of a document and period that overlap by a period or more are one stretch; of equal stretches the least period stays."""
    by = Window.partitionBy("uid", "period").orderBy("lo", "hi")
    apart = F.col("lo") + F.col("period") > F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    chained = parts.distinct().withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("nth", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = chained.groupBy("uid", "period", "nth").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return whole.groupBy("uid", "lo", "hi").agg(F.min("period").alias("period")).where("hi - lo >= greatest(6, 4 * period)")


def _finish(plant: bool):
    def run(batches):
        for batch in slices(batches, "payload"):
            out = []
            for doc_id, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = Words([text], fold=False)
                n = len(words.start)
                src = sources(doc_id, n, plant)
                flat = runs.values if runs.is_valid else None
                lo, hi, period = (flat.field(c).to_numpy() if flat is not None else np.zeros(0, np.int64) for c in range(3))
                order = np.lexsort((period, lo))
                lo, hi, period = lo[order], hi[order], period[order]
                gone = np.zeros(n + 1, np.int64)
                np.add.at(gone, lo + period, 1)
                np.add.at(gone, hi, -1)
                keep = np.flatnonzero(np.cumsum(gone)[:n] == 0)
                row = {"doc_id": doc_id, "n_runs": len(lo), "collapsed_sha256": joined_sha(text, words, keep if src is None else src[keep])}
                row["runs_sha256"] = hashlib.sha256("".join(f"{a},{b - a},{p}\n" for a, b, p in zip(lo.tolist(), hi.tolist(), period.tolist())).encode()).hexdigest()
                if len(lo):
                    best = np.lexsort((period, lo, lo - hi))[0]
                    size = int(hi[best] - lo[best])
                    row |= {"start": int(lo[best]), "length": size, "period": int(period[best]), "exponent_milli": 1000 * size // int(period[best])}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=RESULT_SCHEMA)
        give_back()

    return run


def periodic_runs(docs: DataFrame, plant: bool = False, tile: int = TILE, low: int = LOW) -> DataFrame:
    """The periodic runs of every row of `docs` (doc_id, text), and the text without their repetitions.

    A run is a stretch of words (runs of bytes other than space and 0x09-0x0D) with least period q and max(6, 4q) words or more that
    neither neighbour extends. Result: doc_id, n_runs, of the longest run (ties: smallest start, then period) start, length,
    period and exponent_milli, runs_sha256 of all runs as lines `start,length,period`, collapsed_sha256 of the words that are not in a
    run after its first q words, joined by a space. With `plant`, a tenth of the documents get a repetition first (see `planted`).

    A document up to `tile` words is one tile, solved where it is read. Longer ones are exploded into overlapping tiles per period octave, which are
    dealt out and solved alone; the fragments meet by document and period and are stitched. Only texts that have fragments move.

    A null text has no words; null and empty texts have no run, four nulls and the digest of nothing. A null doc_id stays null and gets no
    repetition. Repeated rows repeat in the result, ties are settled as above, an empty table gives an empty result and other columns are ignored. A text of
    any length is held by one task, as bytes and a few numbers a word. Words are compared by 64-bit hashes.
    """
    pick = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rest = durable(pick.mapInArrow(_cut(plant, tile, low), REST))
    dealt = rest.where("kind = 'tile'").select("uid", "level", "lo", "payload").repartition(partitions(docs.sparkSession), "uid", "level", "lo")
    parts = rest.where("kind = 'part'").select("uid", "period", "lo", "hi").unionByName(dealt.mapInArrow(_solve_tiles(low), "uid binary, period long, lo long, hi long"))
    runs = stitched(parts).groupBy("uid").agg(F.collect_list(F.struct("lo", "hi", "period")).alias("runs"))
    texts = rest.where("kind = 'text'").select("uid", "doc_id", "payload").join(runs, "uid", "left").select("doc_id", "payload", "runs")
    none = F.lit(None).cast("long")
    done = rest.where("kind = 'done'").select("doc_id", F.lit(0).cast("long").alias("n_runs"), *[none.alias(c) for c in ("start", "length", "period", "exponent_milli")], F.lit(EMPTY).alias("runs_sha256"), F.col("digest").alias("collapsed_sha256"))
    return texts.mapInArrow(_finish(plant), RESULT).unionByName(done)


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True)
