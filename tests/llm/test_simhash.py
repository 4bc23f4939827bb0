import random
from collections import Counter

import numpy as np
import xxhash

from lodestar.llm.common import connected_components
from lodestar.llm.simhash import blocks, first_bits, simhash_components, trie_pairs


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words)] if len(words) < 3 else [" ".join(words[k : k + 3]) for k in range(len(words) - 2)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [brute_fp(t) for _, t in rows]
    comp = list(range(len(rows)))
    known = [k for k in range(len(rows)) if rows[k][0] is not None]
    moved = True
    label = {k: rows[k][0] for k in known}
    while moved:
        moved = False
        for a in known:
            for b in known:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and label[b] < label[a]:
                    label[a], moved = label[b], True
    out = []
    for k, (d, _) in enumerate(rows):
        same = [label[j] for j in known if fps[j] == fps[k]]
        out.append((d, f"{fps[k]:016x}", min(same) if same else None))
    return Counter(out)


def test_against_brute_force(odd_docs, odd_rows):
    got = Counter(map(tuple, simhash_components(odd_docs).collect()))
    assert got == brute([(d, t) for d, t, *_ in odd_rows])


def test_empty(no_docs):
    assert simhash_components(no_docs).collect() == []


def test_trie_pairs_are_all_pairs_within_the_budget():
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(20)]
    fps = list({b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(4))) for b in base for _ in range(30)})
    want = {(min(a, b), max(a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2}
    got = set()
    for m in blocks(7, 2):
        arr = np.array(sorted(fps, key=lambda f: (f & m, f & ~m)), np.uint64)
        for a, b in trie_pairs(arr, arr & np.uint64(m), m, 2, most=50):
            got |= {(min(x, y), max(x, y)) for x, y in zip(arr[a].tolist(), arr[b].tolist())}
    assert got == want


def test_components_of_long_chains(spark):
    chain = [(k, k + 1) for k in range(0, 300)] + [(1000 + 7 * k % 50, 1000 + 7 * (k + 1) % 50) for k in range(49)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert all(got[k] == 0 for k in range(301)) and {got[k] for k in got if k >= 1000} == {1000}


def test_near_copies_are_linked_by_several_fingerprints(spark):
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(20000)}"
    rows, pairs = [], []
    for k in range(200):
        words = [word() for _ in range(200)]
        other = list(words)
        for at in rnd.sample(range(200), (1, 3, 40)[k % 3]):
            other[at] = word()
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in simhash_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 5, 6).collect()}
    linked = [got[2 * k + 1] == 2 * k for k in range(200)]
    assert sum(linked[0::3]) >= 65 and sum(linked[1::3]) >= 35 and not any(linked[2::3])
    assert all(got[2 * k] == 2 * k for k in range(200))


def test_first_bits_is_a_permutation_with_the_mask_on_top():
    rnd = random.Random(2)
    for m in blocks(7, 5):
        bits = [b for b in range(63, -1, -1) if m >> b & 1] + [b for b in range(63, -1, -1) if not m >> b & 1]
        x = rnd.getrandbits(64)
        assert int(first_bits(np.array([x], np.uint64), m)[0]) == sum((x >> b & 1) << 63 - k for k, b in enumerate(bits))
