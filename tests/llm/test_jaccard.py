import random
import re
from itertools import combinations

import numpy as np
import pytest
from lumenfold.llm import components, hot, jaccard
from lumenfold.llm.words import mix

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def plain(rows, n, per_cent):
    sets = [(r.doc_id, shingles(r.text, n)) for r in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in combinations([x for x in sets if x[1] and x[0] is not None], 2):
        if min(len(a), len(b)) * 100 >= per_cent * max(len(a), len(b)) and 100 * (both := len(a & b)) >= per_cent * (len(a) + len(b) - both):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return sorted(((str(i), len(s), str(root(i) if s else i)) for i, s in sets))


def found(df, n, similarity):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.near_duplicates(df, n, similarity).collect())


def near_copies(seed, count):
    r = random.Random(seed)
    rows, vocabulary = [], [f"w{k}" for k in range(500)]
    for base in range(count):
        words = r.choices(vocabulary, k=r.choice([3, 11, 12, 30, 60, 120, 400]))
        for _ in range(r.choice([1, 2, 6, 15])):
            own = list(words)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
    return rows


def test_passage_and_copies_in_many_texts(spark, monkeypatch):
    """A passage in a third of the texts and one text many times: their cells are hot beyond the broadcast, and dealt over parts."""
    r = random.Random(8)
    words = lambda k: [f"w{r.randrange(400)}" for _ in range(k)]
    passage, copied = words(40), " ".join(words(60))
    texts = [" ".join(words(20) + passage + words(20)) for _ in range(60)] + [copied] * 300 + [copied + f" end{k % 4}" for k in range(40)] + [" ".join(words(50)) for _ in range(60)]
    r.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain(df.collect(), 3, 90)
    assert found(df, 3, 0.9) == want
    for name in ("BROADCAST_IDS", "BLOCK_SETS"):
        monkeypatch.setattr(jaccard, name, 5)
    monkeypatch.setattr(hot, "HOT_ROWS", 3)
    dealt = []
    split = jaccard.join_split
    monkeypatch.setattr(jaccard, "join_split", lambda rows, values, keys, hot_, spread: dealt.append(hot_.count()) or split(rows, values, keys, hot_, spread))
    assert found(df, 3, 0.9) == want and dealt[0] > 0


def test_ties_of_large_sets_are_exact():
    for both, union in ((9_000_000, 10_000_000), (8_999_999, 9_999_999), (8_999_999, 10_000_000)):
        a = np.arange(both, dtype=np.uint64)
        b = np.arange(union, dtype=np.uint64)
        assert jaccard.linked(a, b, 0.9) == (100 * both >= 90 * union)
    assert jaccard.linked(np.arange(2, dtype=np.uint64), np.arange(3, dtype=np.uint64), 2 / 3)


@pytest.mark.parametrize(("n", "similarity"), [(3, 0.9), (5, 0.8)])
def test_near_copies(spark, n, similarity, monkeypatch):
    df = spark.createDataFrame(near_copies(n, 60), "doc_id long, text string")
    want = plain(df.collect(), n, round(100 * similarity))
    assert found(df, n, similarity) == want
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    assert found(df, n, similarity) == want


def test_documents(docs):
    assert found(docs, 3, 0.9) == plain(docs.collect(), 3, 90)


def test_odd_rows(odd, empty):
    assert [x if x[0] != "None" else (*x[:2], "None") for x in plain(odd.collect(), 3, 90)] == found(odd, 3, 0.9)
    assert found(empty, 3, 0.9) == []


def test_tree_loses_nothing():
    rng = np.random.default_rng(3)
    sets = [np.unique(mix(rng.integers(0, 400, rng.integers(5, 300)).astype(np.uint64))) for _ in range(150)]
    points = np.array([np.bincount((x >> np.uint64(58)).astype(int), minlength=64) for x in sets])
    sizes = np.array([len(x) for x in sets])
    tree = jaccard.CountTree(points, sizes)
    for a in range(len(sets)):
        got = set(tree.search(points[a], sizes[a], 0.6).tolist())
        assert {b for b in range(len(sets)) if jaccard.linked(sets[a], sets[b], 0.6)} <= got


@pytest.mark.parametrize("split", [False, True])
def test_components(spark, monkeypatch, split):
    if split:
        monkeypatch.setattr(components, "BROADCAST_NODES", 0)
        monkeypatch.setattr(hot, "HOT_ROWS", 5)
    r = random.Random(5)
    pairs = [(k, k + 1) for k in range(100, 140)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(500, k) for k in range(501, 540)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in pairs:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: root(i) for i in parent}


def sets_of(hashes):
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum([len(x) for x in hashes])])


def share_a_cell(one, other, similarity):
    of, keys, _, _ = jaccard.cells(*sets_of([np.sort(one), np.sort(other)]), similarity)
    return bool(set(keys[of == 0].tolist()) & set(keys[of == 1].tolist()))


@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_small_linked_sets_share_a_cell(similarity):
    rng = np.random.default_rng(7)
    sizes = [(a, b, both) for a in range(1, 25) for b in range(a, 25) for both in range(1, a + 1) if both >= similarity * (a + b - both) - 1e-9 and a + b > 2 * both]
    assert ((4, 5, 4) in sizes) == (similarity == 0.8)
    for a, b, both in sizes:
        count = 20_000 if b == 5 else 300
        every = rng.integers(0, 1 << 64, (count, a + b - both), np.uint64)
        of, keys, _, _ = jaccard.cells(*sets_of([x for row in every for x in (np.sort(row[:a]), np.sort(np.concatenate([row[:both], row[a:]])))]), similarity)
        pairs = np.unique(np.stack([of.astype(np.uint64), keys]), axis=1)
        both_have = np.unique(np.stack([pairs[0] // 2, pairs[1]]), axis=1, return_counts=True)
        assert len(np.unique(both_have[0][0][both_have[1] == 2])) == count, (a, b, both)


@pytest.mark.parametrize("hashes", [1, 2, 3])
def test_sets_in_one_block_share_a_cell(hashes, monkeypatch):
    """Sets of 9 and 10 shingles whose counts all fall into one block, under every hash but the last or under all."""
    monkeypatch.setattr(jaccard, "HASHES", hashes)
    rng = np.random.default_rng(11)
    x = rng.integers(0, 1 << 64, 400_000, np.uint64)
    for seed in range(hashes):
        x = x[(mix(x + np.uint64(0x51ED2701 + 0x9E3779B9 * seed)) >> np.uint64(20)) % np.uint64(8) == 3]
    for k in range(0, 200, 10):
        assert share_a_cell(x[k : k + 9], x[k : k + 10], 0.9)
        assert jaccard.linked(np.sort(x[k : k + 9]), np.sort(x[k : k + 10]), 0.9)


def test_large_sets_take_few_cells():
    """About a quarter of the shingles for each band, at 0.8: no further hash is needed."""
    rng = np.random.default_rng(2)
    for n in (90, 500, 3_000, 20_000):
        of, *_ = jaccard.cells(*sets_of([np.sort(rng.integers(0, 1 << 64, n, np.uint64))]), 0.8)
        assert len(of) <= 0.6 * n + 12


@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_linked_sets_share_as_many_cells_as_they_need(similarity):
    rng = np.random.default_rng(4)
    for n in (9, 10, 13, 14, 19, 20, 29, 30, 64, 65, 150, 700, 2_000):
        for _ in range(30):
            x = rng.integers(0, 1 << 64, 3 * n, np.uint64)
            differ = int(n * (1 - similarity) / similarity + 1e-9)
            gone = rng.integers(0, differ + 1)
            one, other = np.sort(x[:n]), np.sort(np.concatenate([x[gone:n], x[n : n + differ - gone]]))
            if not jaccard.linked(one, other, similarity):
                continue
            of, keys, band, need = jaccard.cells(*sets_of([one, other]), similarity)
            both = set(keys[of == 0].tolist()) & set(keys[of == 1].tolist())
            common = [b for b in set(band.tolist()) if all((x := (of == k) & (band == b)).any() and len(both & set(keys[x].tolist())) >= need[x].max() for k in (0, 1))]
            assert common, (n, len(other))


def test_every_link_comes_through_the_tree(spark, monkeypatch):
    df = spark.createDataFrame(near_copies(3, 30), "doc_id long, text string")
    want = plain(df.collect(), 3, 90)
    assert len({x[2] for x in want}) < len({x[0] for x in want})
    sets = df.select("doc_id", "text")
    monkeypatch.setattr(jaccard, "_searched", lambda keys, similarity: lambda batches: iter(()))  # no search, no link
    alone = {x[0]: x[2] for x in found(sets, 3, 0.9)}
    equal = {}
    for r in df.collect():
        equal.setdefault(shingles(r.text, 3), []).append(r.doc_id)
    assert alone == {str(i): str(min(ids)) for ids in equal.values() for i in ids}


@pytest.mark.parametrize(("seed", "whole"), [(1, 0), (2, 100)])
def test_large_cluster(spark, seed, whole, monkeypatch):
    """One passage puts all texts into one cluster of several families, larger than the pivots."""
    monkeypatch.setattr(jaccard, "PIVOTS", 4)
    monkeypatch.setattr(jaccard, "BEST", 1)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 5)
    monkeypatch.setattr(jaccard, "WHOLE", whole)
    r = random.Random(seed)
    shared, rows = [f"p{k}" for k in range(60)], []
    for family in range(6):
        own = [f"f{family}_{k}" for k in range(r.choice([20, 40, 60]))]
        for _ in range(r.choice([1, 3, 12])):
            words = shared + own
            for _ in range(r.choice([0, 1, 3])):
                words[r.randrange(len(words))] = f"x{r.random()}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, 3, 0.9) == plain(df.collect(), 3, 90)
    assert found(df, 5, 0.8) == plain(df.collect(), 5, 80)


def test_members_that_different_pivots_link(spark, monkeypatch):
    """Chains of texts, each linked with the next alone, with pivots at their ends: the link in the middle is one of two members that a pivot each links.

    In the last chain one of them is linked by a pivot in another cluster only, through another text of its doc_id.
    """
    chain = lambda name, count: [" ".join(f"{name}{k}" for k in range(4 * s, 4 * s + 120)) for s in range(count)]
    rows = [(20 + k, t) for k, t in enumerate(chain("c", 4))] + [(k, t) for k, t in zip((0, 10), chain("a", 2), strict=True)] + [(k, t) for k, t in zip((10, 5, 3), chain("b", 3), strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(df.collect(), 3, 90)
    assert {x[2] for x in want} == {"0", "20"}
    monkeypatch.setattr(jaccard, "_pivots", lambda sets, degree: sets.where("node in (0, 3, 20, 23)").select("cluster", "node"))
    assert found(df, 3, 0.9) == want
