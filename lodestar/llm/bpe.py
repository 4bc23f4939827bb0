"""Byte-level BPE: a lazily determinised transducer encodes, an incremental UTF-8 state machine decodes."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, slices, table, utf8


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a vocabulary file of lines 'base64 rank'."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Turns the bytes of one piece into token ids, the same as merging the best-ranked neighbours again and again.

    A piece's encoding is the one split into tokens of which every neighbouring pair could stand beside each other
    (no merge would have crossed their border earlier). Dropping the last token gives the encoding of the shorter
    prefix, so one token ends each prefix for certain, but which token covers a byte is only known some bytes later.
    The nondeterministic reader follows all starts from which a longer token may still come, each with the token
    before it. A determinised state is that list of (token before, place in the token trie); its step over a byte also
    says which token ends there. Where no start but the newest is left, all tokens up to there are certain and are
    emitted, following the ends back. States and their steps are made when first needed; both stores are bounded and
    begun anew when full.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = 250_000, max_pieces: int = 250_000):
        self.ranks, self.max_states, self.max_pieces = ranks, max_states, max_pieces
        self.token = {r: t for t, r in ranks.items()}
        self.size = {r: len(t) for t, r in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.child: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for text, rank in ranks.items():
            if len(text) > 1 and self._split(rank) is None:
                continue  # no sequence of merges makes it; it stands only for a piece equal to it
            node = 0
            for byte in text:
                if byte not in self.child[node]:
                    self.child[node][byte] = len(self.child)
                    self.child.append({})
                    self.ends.append(-1)
                node = self.child[node][byte]
            self.ends[node] = rank
        self._fresh()

    def _fresh(self) -> None:
        self.states: list[tuple] = [((-1, 0),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.step: dict[int, tuple[int, int, bool]] = {}  # state * 256 + byte -> state * 256, token that ends, whether it is certain
        self.fits: dict[int, bool] = {}  # left << 32 | right
        self.pieces: dict[str, bytes] = {}

    def _split(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one when its own bytes are merged; None for bytes and dead tokens."""
        if rank not in self.halves:
            parts = [bytes([b]) for b in self.token[rank]]
            while len(parts) > 2:
                best = min((self.ranks.get(parts[k] + parts[k + 1], rank), k) for k in range(len(parts) - 1))
                if best[0] >= rank:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            self.halves[rank] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[rank]

    def _edge(self, rank: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stood at one edge of a token while it grew, each with the rank of the merge that took it up."""
        found, until = [], 1 << 60
        while True:
            found.append((rank, until))
            halves = self._split(rank)
            if halves is None:
                return found
            until, rank = rank, halves[side]

    def _fit(self, left: int, right: int) -> bool:
        """Whether no merge across the border of two tokens comes before the merges that close them off.

        Of equal ranks the leftmost is merged first: a merge inside the left token precedes one over the border, which
        precedes one inside the right token.
        """
        pair = left << 32 | right
        known = self.fits.get(pair)
        if known is None:
            known = True
            for a, a_until in self._edge(left, 1):
                for b, b_until in self._edge(right, 0):
                    rank = self.ranks.get(self.token[a] + self.token[b])
                    if rank is not None and rank < a_until and rank <= b_until:
                        known = False
            self.fits[pair] = known
        return known

    def _next(self, at: int) -> tuple[int, int, bool]:
        byte, alive, whole = at & 255, [], -1
        for before, node in self.states[at >> 8]:
            node = self.child[node].get(byte)
            if node is None:
                continue
            if self.child[node]:
                alive.append((before, node))
            rank = self.ends[node]
            if rank >= 0 and (before < 0 or self._fit(before, rank)):
                whole = rank
        if whole < 0:
            raise ValueError("the vocabulary lacks a byte")
        key = (*alive, (whole, 0))
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        found = self.step[at] = (number << 8, whole, not alive)
        return found

    def piece(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        rank = self.ranks.get(data)
        if rank is not None:
            return [rank]
        if len(self.states) > self.max_states:
            self._fresh()
        out: list[int] = []
        ends: list[int] = []  # token that ends after each byte not emitted yet
        state, known = 0, self.step.get
        for byte in data:
            state, token, certain = known(state | byte) or self._next(state | byte)
            ends.append(token)
            if certain:
                self._emit(ends, out)
        self._emit(ends, out)
        return out

    def _emit(self, ends: list[int], out: list[int]) -> None:
        last, at = [], len(ends)
        while at > 0:
            last.append(ends[at - 1])
            at -= self.size[last[-1]]
        out.extend(reversed(last))
        ends.clear()

    def packed(self, text: str, pattern) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; each match of `pattern` is one piece."""
        out, cache = [], self.pieces
        for part in pattern.findall(text):
            ids = cache.get(part)
            if ids is None:
                ids = np.array(self.piece(utf8(part)), "<u4").tobytes()
                cache = self.pieces  # it may be a new one
                if len(part) < 64:
                    if len(cache) >= self.max_pieces:
                        cache.clear()
                    cache[part] = ids
            out.append(ids)
        return b"".join(out)


class Utf8Stream:
    """Incremental UTF-8: push bytes, get the text that is complete; a malformed byte becomes U+FFFD, as `bytes.decode` with 'replace' does.

    The machine's state is the number of continuation bytes still expected and the range the next one must lie in.
    """

    def __init__(self):
        self.rest = b""

    @staticmethod
    def lead(byte: int) -> tuple[int, int, int]:
        """Continuations after this lead byte and the range of the first of them; 0 for ASCII, -1 for no lead."""
        if byte < 0x80:
            return 0, 0, 0
        if 0xC2 <= byte <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= byte <= 0xEF:
            return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
        if 0xF0 <= byte <= 0xF4:
            return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
        return -1, 0, 0

    def push(self, data: bytes) -> str:
        data = self.rest + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):  # only the last three bytes can be an unfinished character
            need, low, high = self.lead(data[-back])
            if need >= 0:
                tail = data[len(data) - back + 1 :]
                if need > len(tail) and (not tail or low <= tail[0] <= high) and all(0x80 <= b <= 0xBF for b in tail):
                    cut = len(data) - back
                break
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.rest = self.rest, b""
        return rest.decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _coder(path: str, pattern: str):
    coder = Transducer(read_ranks(path))
    return coder, regex.compile(pattern), [coder.token[k] for k in range(len(coder.token))]


def stream_text(ids, path: str, pattern: str, chunk: int = 4096):
    """Text of token ids, chunk by chunk."""
    tokens, stream = _coder(path, pattern)[2], Utf8Stream()
    for at in range(0, len(ids), chunk):
        yield stream.push(b"".join([tokens[k] for k in ids[at : at + chunk]]))
    yield stream.close()


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """`docs` with the column ids (array of int): whole texts encoded by the vocabulary file at `path`.

    Null texts are taken as empty and give an empty array. The file is read where the tasks run, so `path` must exist
    on every machine; it is never copied. Other columns pass through, but for one named ids, which is replaced.
    """
    def run(batches):
        coder, compiled, _ = _coder(path, pattern)
        for batch in slices(batches, text):
            at = batch.schema.get_field_index(text)
            ids = [np.frombuffer(coder.packed(t.as_py() or "", compiled), "<u4").astype(np.int32) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, "ids"])

    docs = docs.drop("ids")
    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """`encoded` with the column decoded: the text of its ids, decoded as a stream; null ids give null; a column named decoded is replaced."""
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            texts = [None if x.as_py() is None else "".join(stream_text(x.as_py(), path, pattern)) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields) + ", decoded string")


def round_trip(docs: DataFrame, path: str, pattern: str, keep: bool = True) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_ok.

    The ids are those of `encode`; they are decoded again as a stream, and the digests cover the ids as little-endian
    unsigned 32-bit integers and the decoded UTF-8 bytes. Texts are not moved between tasks. The transducer stays in a Python
    worker for its next task, some 250 MB, unless `keep` is false. Null text counts as empty (no tokens,
    digests of nothing); repeated rows repeat; an empty table gives an empty result; other columns are ignored.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_ok"]

    def run(batches):
        coder, compiled, tokens = _coder(path, pattern)
        for batch in slices(batches):
            out: list[list] = [[], [], [], []]
            for cell in batch.column(1):
                text = cell.as_py() or ""
                ids = coder.packed(text, compiled)
                numbers = np.frombuffer(ids, "<u4").tolist()
                digest, stream, whole = hashlib.sha256(), Utf8Stream(), []
                for at in range(0, len(numbers), 1 << 16):
                    part = b"".join([tokens[k] for k in numbers[at : at + (1 << 16)]])
                    digest.update(part)
                    whole.append(stream.push(part))
                whole.append(stream.close())
                for to, value in zip(out, (len(numbers), hashlib.sha256(ids).hexdigest(), digest.hexdigest(), "".join(whole) == text)):
                    to.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names=names)
        if not keep:
            del coder, compiled, tokens
            _coder.cache_clear()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_ok boolean")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
