"""Benchmark decontamination: CGK walks embed item-sized windows, bit-sampling LSH proposes them, exact edit distance decides."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, give_back, slices, table, utf8
from .words import LOWER, SPACE, mix

FOLD = LOWER.copy()
FOLD[SPACE] = 0x20
CHUNK, LANES, PIECE, SHORT = 1 << 17, 4096, 64, 48
STEPS, SAMPLED, WALKS, SAMPLES = 40, 10, 3, 5
ONE, ALL = np.uint64(1), np.uint64(2**64 - 1)


def fold(text: bytes) -> bytes:
    """ASCII capitals as small letters and every white space as a blank; no byte moves."""
    return text.translate(FOLD.tobytes())


def anchors(x: np.ndarray) -> np.ndarray:
    """Where walks start: words, characters of three bytes or more, and, for long runs of neither, about every 32nd place, chosen by its two bytes."""
    before = np.r_[np.uint8(0x20), x[:-1]]
    word = (before == 0x20) & (x != 0x20)
    return np.flatnonzero(word | (x >= 0xE0) | ((before * np.uint8(37) + x * np.uint8(101)) & np.uint8(31) == 0))


class Embedding:
    """WALKS random walks of STEPS steps (CGK): a walk stands on a byte, writes it, and a random bit drawn for the step and the byte says whether it moves on.

    Two strings with few edits between them soon write the same bytes again after each edit, so their edit distance
    becomes a Hamming distance of what is written. An item-sized window is embedded by parts: the walk starts afresh at each of its
    anchors, so one that lost step does not spoil the rest, and windows that overlap share the walks of their anchors. A hash table
    is a sample of SAMPLED of the steps of a walk, one from each of as many equal stretches; each walk serves SAMPLES tables.
    """

    def __init__(self, seed: int = 5):
        rng, stratum = np.random.default_rng(seed), STEPS // SAMPLED
        # bit k of a byte's number: whether a walk that stands on that byte moves on at step k
        self.moves = rng.integers(0, 2**62, (WALKS, 256))
        self.sampled = [[{k * stratum + int(rng.integers(stratum)) for k in range(SAMPLED)} for _ in range(SAMPLES)] for _ in range(WALKS)]

    def keys(self, x: np.ndarray, start: np.ndarray):
        """The key of every start in each table; `x` must reach STEPS bytes beyond the last. A sampled byte enters a key by its number."""
        for moves, sampled in zip(self.moves, self.sampled):
            every, at, found = moves[x], start.copy(), [np.zeros(len(start), np.int64) for _ in sampled]
            here, move = np.empty_like(at), np.empty_like(at)
            for step in range(STEPS):
                np.take(every, at, out=here, mode="clip")
                for key, steps in zip(found, sampled):
                    if step in steps:
                        key *= 0x1E3779B97F4A7C15
                        key += here
                np.right_shift(here, step, out=move)
                move &= 1
                at += move
            yield from (mix(k.view(np.uint64)) for k in found)


def nearest_piece(x: np.ndarray, at: np.ndarray, columns: int, masks: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """For each lane, the least edit distance of its piece (at most 64 bytes) to any part of the `columns` bytes of `x` from `at`.

    Bit-parallel columns (Myers) of all lanes at once. masks[lane] is the offset of the piece's 256 match masks in `bits[0]`, bits[1][lane] its length.
    """
    peq, length = bits
    top = length.astype(np.uint64) - ONE
    pv, mv = np.full(len(at), ALL), np.zeros(len(at), np.uint64)
    score = length.astype(np.int64)
    best = score.copy()
    for j in range(columns):
        eq = peq[masks + x[at + j]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score += (ph >> top & ONE).astype(np.int64)
        score -= (mh >> top & ONE).astype(np.int64)
        ph <<= ONE
        mh <<= ONE
        pv, mv = mh | ~(xv | ph), ph & xv
        np.minimum(best, score, out=best)
    return best


def edit_match(item: bytes, window: bytes, most: int) -> tuple[int, int, int] | None:
    """(start, end, distance) of the part of `window` nearest to `item` by edit distance, if within `most`; the first end of least distance.

    Bit-parallel columns (Myers): one step per byte of the window over all prefixes of the item at once; a second pass
    from that end backwards finds the start.
    """
    def ends(pattern: bytes, text: bytes, anchored: bool) -> tuple[int, int]:
        m = len(pattern)
        peq: dict[int, int] = {}
        for k, b in enumerate(pattern):
            peq[b] = peq.get(b, 0) | 1 << k
        ones, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score, best = ones, 0, m, (m, 0)
        for j, b in enumerate(text):
            eq = peq.get(b, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv) & ones, pv & xh
            score += bool(ph & top) - bool(mh & top)
            ph, mh = (ph << 1 | anchored) & ones, mh << 1 & ones
            pv, mv = mh | ~(xv | ph) & ones, ph & xv
            if score < best[0]:
                best = (score, j + 1)
        return best

    at = window.find(item)
    if at >= 0:
        return at, at + len(item), 0
    distance, end = ends(item, window, False)
    if distance > most:
        return None
    _, back = ends(item[::-1], window[:end][::-1], True)
    return end - back, end, distance


@dataclass
class Index:
    """Items ready for search; built once per task from at most a block of items."""

    ids: list[int]
    items: list[bytes]
    similar: float

    def __post_init__(self):
        self.size = np.array([len(t) for t in self.items], np.int64)
        self.most = ((1 - self.similar) * self.size + 1e-9).astype(np.int64)
        self.short = [k for k, n in enumerate(self.size.tolist()) if 0 < n < SHORT]
        self.embedding = Embedding()
        joined = np.frombuffer(b" ".join([*self.items, bytes(2 * STEPS)]), np.uint8)
        begin = np.r_[0, np.cumsum(self.size + 1)]
        start = anchors(joined[: begin[-1]])
        item = np.searchsorted(begin, start, "right") - 1
        keep = (self.size[item] >= SHORT) & (begin[item] + self.size[item] - start >= STEPS // 2)
        start, item = start[keep], item[keep].astype(np.int32)
        offset = (start - begin[item]).astype(np.int32)
        self.width = max(1 << 16, 1 << (32 * max(1, len(start)) - 1).bit_length())
        self.tables = []
        for key in self.embedding.keys(joined, start):
            order = np.argsort(key, kind="stable")
            seen = np.zeros(self.width, bool)
            seen[(key & np.uint64(self.width - 1)).astype(np.int64)] = True
            self.tables.append((seen, key[order], item[order], offset[order]))
        # pieces of at most PIECE bytes, of even length within an item
        cuts = [np.linspace(0, n, -(-n // PIECE) + 1).astype(np.int64).tolist() for n in self.size.tolist()]
        self.first_piece = np.r_[0, np.cumsum([len(c) - 1 for c in cuts])].astype(np.int64)
        self.peq = np.zeros((int(self.first_piece[-1]), 256), np.uint64)
        self.piece_at = np.array([a for c in cuts for a in c[:-1]], np.int64)
        self.piece_size = np.array([b - a for c in cuts for a, b in zip(c[:-1], c[1:])], np.int64)
        for k, t in enumerate(self.items):
            for row in range(int(self.first_piece[k]), int(self.first_piece[k + 1])):
                at = int(self.piece_at[row])
                for i, byte in enumerate(t[at : at + int(self.piece_size[row])]):
                    self.peq[row, byte] |= np.uint64(1 << i)

    def hits(self, x: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(item, start of its window) of the table entries that the anchors in begin..end meet; starts may lie before the text's."""
        start = anchors(x[begin:end])
        part = x[begin : end + 2 * STEPS]
        items, starts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for key, (seen, keys, item, offset) in zip(self.embedding.keys(part, start), self.tables):
            at = np.flatnonzero(seen[(key & np.uint64(self.width - 1)).astype(np.int64)])
            low, high = np.searchsorted(keys, key[at], "left"), np.searchsorted(keys, key[at], "right")
            n = high - low
            entry = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else low
            items.append(item[entry])
            starts.append(np.repeat(start[at], n) + begin - offset[entry])
        return np.concatenate(items), np.concatenate(starts)

    def windows(self, x: np.ndarray, edges: np.ndarray):
        """(text, item, first start, last start) of the windows proposed for the joined texts; starts of an item within an eighth of its length are one row."""
        found = [self.hits(x, at, min(at + CHUNK, int(edges[-1]))) for at in range(0, int(edges[-1]), CHUNK)]
        item, start = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        middle = np.clip(start + self.size[item] // 2, 0, edges[-1] - 1)
        text = np.searchsorted(edges, middle, "right") - 1
        cell = start // np.maximum(self.size[item] // 8, 1)
        order = np.lexsort((start, cell, item, text))
        text, item, start, cell = text[order], item[order], start[order], cell[order]
        if not len(text):
            return text, item, start, start
        at = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (cell[1:] != cell[:-1])])
        return text[at], item[at], start[at], start[np.r_[at[1:], len(start)] - 1]

    def plausible(self, x: np.ndarray, item: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which of the windows may hold their item: the distances of the item's pieces, each within its own part of the window, do not sum to more than is allowed."""
        left = np.arange(len(item))
        total = np.zeros(len(item), np.int64)
        for p in range(int(np.diff(self.first_piece).max(initial=0))):
            has = self.first_piece[item[left]] + p < self.first_piece[item[left] + 1]
            for at in range(0, len(left), LANES):
                lane = left[at : at + LANES][has[at : at + LANES]]
                if not len(lane):
                    continue
                k = item[lane]
                piece, most = self.first_piece[k] + p, self.most[k]
                columns = int((self.piece_size[piece] + 2 * most + last[lane] - first[lane]).max())
                begin = np.clip(first[lane] + self.piece_at[piece] - most, 0, len(x) - columns)
                total[lane] += nearest_piece(x, begin, columns, piece * 256, (self.peq.ravel(), self.piece_size[piece]))
            left = left[total[left] <= self.most[item[left]]]
        return left

    def scan(self, k: int, x: np.ndarray, edges: np.ndarray):
        """(text, item) of the texts that hold the short item k: its whole distance to every stretch of the joined texts."""
        n, most = int(self.size[k]), int(self.most[k])
        step = 4 * SHORT
        at = np.arange(0, int(edges[-1]), step)
        piece = np.full(len(at), self.first_piece[k])
        near = np.concatenate([nearest_piece(x, at[j : j + LANES], step + n + most, piece[j : j + LANES] * 256, (self.peq.ravel(), self.piece_size[piece[j : j + LANES]])) for j in range(0, len(at), LANES)])
        at = at[near <= most]
        low, high = np.searchsorted(edges, at, "right") - 1, np.searchsorted(edges, at + step + n + most, "left")
        return sorted({(t, k) for a, b in zip(low.tolist(), high.tolist()) for t in range(a, min(b, len(edges) - 1))})

    def search(self, texts: list[bytes]):
        """(text, item, start, end, distance) of every item found in every text."""
        edges = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
        reach = int((self.size + 3 * self.most).max(initial=0)) + 8 * SHORT + 2 * STEPS
        x = np.frombuffer(b" ".join([*texts, bytes(reach)]), np.uint8)
        text, item, first, last = self.windows(x, edges)
        keep = self.plausible(x, item, first, last)
        found = []
        for t, k, a, b in zip(*(v[keep].tolist() for v in (text, item, first - edges[text], last - edges[text]))):
            n, most = len(self.items[k]), int(self.most[k])
            low = max(0, a - most)
            m = edit_match(self.items[k], texts[t][low : b + n + most], most)
            if m:
                found.append((t, k, low + m[0], low + m[1], m[2]))
        for k in self.short:
            for t, _ in self.scan(k, x, edges):
                m = edit_match(self.items[k], texts[t], int(self.most[k]))
                if m:
                    found.append((t, k, *m))
        return found


def _blocks(items: DataFrame, block_bytes: int):
    """The items (item_id, folded text) block by block; a block has about `block_bytes` of text, whatever their number."""
    some = items.where("item_id IS NOT NULL AND length(text) > 0").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = some.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-total // block_bytes)
    for k in range(n):
        rows = some.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        rows.sort(key=lambda r: (r.item_id, r.text))
        yield k == n - 1, [r.item_id for r in rows], [fold(utf8(r.text)) for r in rows]


def matches(docs: DataFrame, items: DataFrame, similar: float = 0.8, block_bytes: int = 1 << 20) -> DataFrame:
    """`docs` (doc_id, text, ...) with the column hits: array of (item_id, start, end, distance, similarity) of the items in its text.

    An item is found where a stretch of the text is within an edit distance of (1 - `similar`) of its length, both
    with ASCII case and the kind of white space ignored; places and distances are in UTF-8 bytes. The best stretch per item is reported.
    Item-sized windows are proposed by `Embedding`: CGK walks, sampled into WALKS * SAMPLES hash tables; those whose pieces alone differ too
    much are ruled out without loss, the others are verified by exact edit distance. Measured recall at 20 % mixed edits is
    in the README. Items under SHORT bytes are compared with every place of every text, exactly.

    Items are shipped to the tasks in blocks of bounded size, each block meeting all documents; texts are searched
    whole. One block is held at a time: before the next one, the documents with their hits so far are written to the checkpoint
    folder. Null and empty items or item_ids are ignored, null texts have no hits; repeated rows repeat, repeated items
    give repeated hits; an empty table of documents gives an empty result, one of items no hits; a column named hits is replaced.
    """
    kind = "array<struct<item_id:long,start:long,end:long,distance:long,similarity:double>>"
    docs = docs.drop("hits")
    out = docs.withColumn("hits", F.from_json(F.lit("[]"), kind))
    hit = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("distance", pa.int64()), ("similarity", pa.float64())])
    for last, ids, texts in _blocks(items, block_bytes):
        content = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def run(batches, content=content):
            ids, texts = content.value
            index = Index(ids, texts, similar)
            for batch in slices(batches):
                at = batch.schema.get_field_index("text")
                bodies = [fold(utf8(t.as_py())) for t in batch.column(at)]
                hits: list[dict[int, dict]] = [{} for _ in bodies]
                for t, i, a, b, d in index.search(bodies):
                    old = hits[t].get(i)
                    if old is None or (d, a) < (old["distance"], old["start"]):
                        hits[t][i] = {"item_id": ids[i], "start": a, "end": b, "distance": d, "similarity": 1 - d / len(texts[i])}
                earlier = batch.column(batch.schema.get_field_index("hits")).to_pylist()
                both = pa.array([(e or []) + [h[i] for i in sorted(h)] for e, h in zip(earlier, hits)], pa.list_(hit))
                yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names) if n != "hits"), both], names=[*(n for n in batch.schema.names if n != "hits"), "hits"])
            give_back()

        out = out.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields if f.name != "hits") + f", hits {kind}")
        if not last:
            out = durable(out)
            content.destroy()
    return out


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
