import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from lodestar.llm.bpe import Transducer, Utf8Stream, decode, encode, read_ranks, round_trip

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def texts():
    rnd = random.Random(5)
    marks = "abcdefgh ABC  \n\t.,'!?0123456789éüñ日本語😀\x1c\x85\xa0\x00 'sll"
    yield from ("", " ", "  a", "hello world", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", " " * 50, "<|endoftext|>", "it's we'll I'd", "\r\n\r\n x")
    for n in range(400):
        yield "".join(rnd.choice(marks) for _ in range(n))
    for _ in range(600):
        yield "".join(rnd.choice(["tion", "ing", "th", "er", "and", "re", "Qu", "xq", "ciónes", "ß", "==", "--", "the"]) for _ in range(rnd.randrange(1, 14)))


def test_ids_equal_the_library(reference):
    coder, pattern = Transducer(read_ranks(PATH), max_states=3000, max_pieces=50), regex.compile(PATTERN)
    for t in texts():
        assert np.frombuffer(coder.packed(t, pattern), "<u4").tolist() == reference.encode_ordinary(t), t


def test_every_token_pair_border(reference):
    coder = Transducer(read_ranks(PATH))
    rnd = random.Random(1)
    tokens = list(coder.ranks)
    for _ in range(4000):
        data = rnd.choice(tokens) + rnd.choice(tokens) + rnd.choice(tokens)
        assert coder.piece(data) == reference._core_bpe.encode_single_piece(data)


def test_utf8_stream():
    rnd = random.Random(2)
    for _ in range(3000):
        data = "".join(rnd.choice("aé日😀") for _ in range(8)).encode()
        if rnd.random() < 0.5:
            data = bytes(rnd.choice([b, rnd.randrange(256)]) for b in data)
        stream, out, at = Utf8Stream(), "", 0
        while at < len(data):
            step = rnd.randrange(1, 4)
            out, at = out + stream.push(data[at : at + step]), at + step
        assert out + stream.close() == data.decode("utf-8", "replace")


def test_round_trip(spark, odd_docs, odd_rows, no_docs, reference):
    def want(d, t):
        ids = reference.encode_ordinary(t or "")
        return d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True

    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, round_trip(odd_docs, PATH, PATTERN).collect()), key=key) == sorted((want(d, t) for d, t, *_ in odd_rows), key=key)
    assert round_trip(no_docs, PATH, PATTERN).collect() == []
    back = decode(encode(odd_docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert all((r.text or "") == r.decoded for r in back) and len(back) == len(odd_rows)
    assert decode(encode(no_docs, PATH, PATTERN), PATH, PATTERN).collect() == []
