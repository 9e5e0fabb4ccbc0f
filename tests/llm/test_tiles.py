import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from lumenfold.llm import tiles

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(rows):
    """Every row against every other; rows without an id link nothing."""
    prints = [(i, plain_print(t)) for i, t in rows]
    own = list(range(len(rows)))

    def root(k):
        while own[k] != k:
            k = own[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if None not in (rows[a][0], rows[b][0]) and (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                own[y] = x
    least = {}
    for k, (i, _) in enumerate(prints):
        least[root(k)] = min(i, least.get(root(k), i)) if i is not None else None
    return sorted((str(i), f"{f:016x}", str(least[root(k)])) for k, (i, f) in enumerate(prints))


def found(df, **more):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in tiles.near_duplicates(df, **more).collect())


@pytest.mark.parametrize("more", [{}, {"tile": 5, "block": 30}])
def test_documents(docs, more):
    assert found(docs, **more) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(odd, empty):
    assert found(odd) == plain([(r.doc_id, r.text) for r in odd.collect()])
    assert found(odd.where("doc_id is null")) == plain([(r.doc_id, r.text) for r in odd.where("doc_id is null").collect()])
    assert found(empty) == []


def test_prints():
    texts = ["", None, " \t\n", "One", "one TWO", "a b c", "a b c d", "Ä éé \U0001f600 x y z", "w " * 500]
    assert tiles.fingerprints(pa.array(texts)).tolist() == [plain_print(t) for t in texts]
    assert tiles.fingerprints(pa.array([], pa.string())).tolist() == []


def _components(pairs):
    parent = {}

    def root(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {frozenset(k for k in parent if root(k) == r) for r in map(root, list(parent))}


@pytest.mark.parametrize("radius", [0, 3, 5])
def test_links_connect_what_is_within_the_radius(spark, radius):
    r = random.Random(4)
    prints = [r.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    for x in prints[:60]:
        for _ in range(4):
            for bit in r.sample(range(64), r.choice([1, 2, 3, 4, 5, 6])):
                x ^= 1 << bit
            prints.append(x)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "print long")
    want = _components([(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= radius])
    for tile, block in ((256, 1 << 17), (4, 20), (1, 8)):
        got = [(u % (1 << 64), v % (1 << 64)) for u, v in tiles.links(df, radius, tile, block).collect()]
        assert _components(got) == want


def test_a_group_gives_no_pairs_of_its_members(spark):
    """4,000 fingerprints of which each has all others of its size within the radius: links stay far below the pairs."""
    r = random.Random(5)
    prints = list({sum(1 << b for b in r.sample(range(20), 2)) for _ in range(3_000)} | {1 << b for b in range(64)} | {sum(1 << b for b in r.sample(range(64), 2)) for _ in range(6_000)})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "print long")
    got = tiles.links(df, tile=64, block=512).collect()
    assert len(_components(got)) == 1 and len({x for pair in got for x in pair}) == len(prints)
    pairs = sum((a ^ b).bit_count() <= 3 for a in prints[:100] for b in prints) * len(prints) // 200
    assert len(got) < pairs / 20


def test_reduced_links_connect_the_same():
    rng = np.random.default_rng(2)
    pairs = rng.integers(0, 400, (300, 2)).astype(np.uint64)
    assert _components(map(tuple, tiles._linked([pairs]).tolist())) == _components((a, b) for a, b in pairs.tolist() if a != b)
    assert len(tiles._linked([])) == 0


def test_counts_never_exclude_a_near_one():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 3_000, np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, len(a)).astype(np.uint64)
    low, other = tiles.counts(a), tiles.counts(b)
    assert all(tiles.near_tiles(low[k], low[k], other[k : k + 1], other[k : k + 1], 3)[0] for k in range(len(a)))
    far = tiles.near_tiles(low[0], low[0], low[1:], low[1:], 3)
    assert far.mean() < 0.05


def test_text_ids_are_refused(spark):
    with pytest.raises(TypeError, match="doc_id must be a whole number"):
        tiles.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
