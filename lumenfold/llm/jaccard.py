"""N-gram Jaccard join: which documents share at least 90 % of their word shingles, directly or by links.

1. One scan gives each text's set of distinct shingle hashes, as a fingerprint of the set. Texts with equal sets
   form one class, of which the smallest doc_id stands for all (the copies are combined before the shuffle).
2. Shingles are hashed into groups, and the counts by group are a set's point. Linked sets differ in d shingles
   at most, which their size bounds, so their points differ in d coordinates' blocks at most if the coordinates are
   cut into more than d blocks: in some block all counts are equal. So the first level of the search tree are cells: the points
   with equal counts in one block (GROUPS groups each), for each block and band of sizes. Only sets that
   meet in a cell can be linked. A block without any count is no cell; where a set has counts in d blocks at
   most, so that it could agree with another in empty blocks alone, it takes cells of another hash as well,
   and after HASHES of them one cell for its band. So no link is lost, by chance or otherwise.
   Linked sets even agree in all of their cells but d, so a set that shares fewer of its cells with any other is
   linked with none, and goes no further.
3. Cells that share sets are joined to clusters, and a cluster is searched through count-vector R-trees: leaves
   and nodes keep the largest coordinates (of DIMENSIONS groups) and the range of sizes, the sum of coordinate minima
   bounds the overlap from above, and pairs that survive and aren't connected yet are verified exactly.
   First all members are searched in the tree of PIVOTS members of their cluster, the best connected and others by a
   hash; a small cluster is done by this.
4. The members outside the largest component of their cluster that these links make are searched in the trees of all
   its members but the pivots, by pairs of blocks whose sizes fit, so that no task holds a whole cluster. Of two sets in
   different components one at least is such a member, and sets in one component need no link; only links that connect something are emitted.
5. Connected components of the links.

Hashes have 64 bits, fingerprints of sets 128.

Cases: a text that is null, empty or without words has no shingle and is a component of its own; a text
of fewer words than a shingle has its whole sequence as one; rows that repeat a doc_id count as one
document with the links of all its rows; a null doc_id gives a null component_id and no link; extra
columns are ignored; an empty table gives no row. Texts of any length are compared whole. doc_id must be a whole number.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.blocks import runs
from lumenfold.llm.components import components
from lumenfold.llm.hot import hot_keys, join_split
from lumenfold.llm.scratch import forget, whole_numbers, written
from lumenfold.llm.words import chunks, mix, split_words

#: Groups of one block of coordinates of a cell, and hashes after which a set goes to the cell of its band.
GROUPS, HASHES = 1 << 20, 3
#: Members of a cluster whose tree all others are searched in: the best connected, and others.
BEST, PIVOTS = 8, 32
#: A block of a cluster holds about so many sets, and so many shingles. In a cluster of more than WHOLE blocks, the sizes in
#: a block are within a factor of STEP.
BLOCK_SETS, BLOCK_SHINGLES, WHOLE, STEP = 1_024, 1_000_000, 12, 1.05
#: Rows of ids up to which a side is broadcast (24 bytes a row); beyond, the join shuffles.
BROADCAST_IDS = 2_000_000
#: Groups of the points in the trees, and children of a node.
DIMENSIONS, LEAF = 64, 16


def bands(similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower edges of the bands of sizes, and in how many shingles linked sets of a band differ at most; a size below the first links with equal sets alone."""
    edges = [int(np.ceil(similarity / (1 - similarity) - 1e-9))]
    while edges[-1] < 1 << 40:
        edges.append(int(np.ceil(edges[-1] * 1.5)))
    return np.array(edges[:-1]), np.floor((np.array(edges[1:]) - 1) * (1 - similarity) / similarity + 1e-9).astype(np.int64)


def _sets(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes, ascending within each text, and the offsets of the texts."""
    words = split_words(batch.column("text"), lower=True)
    h, doc = words.shingles(words.hashes(), n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(batch.num_rows + 1))


def _band_cells(h: np.ndarray, at: np.ndarray, seed: int, band: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set and cell of each block with counts, and each set's number of such blocks. h: the sets' hashes, cut at `at`; band and blocks: of each set."""
    row = np.repeat(np.arange(len(band)), np.diff(at))
    base = np.concatenate([[0], np.cumsum(blocks)])
    x = mix(h + np.uint64(0x51ED2701 + 0x9E3779B9 * seed))
    slot = base[row] + ((x >> np.uint64(20)) % blocks.astype(np.uint64)[row]).astype(np.int64)
    group = mix(x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(65 - GROUPS.bit_length())
    counts = np.zeros(base[-1], np.uint64)  # a sum by group is the same for the same counts alone
    np.add.at(counts, slot, mix(group + np.uint64(0xA5A5A5A5A5A5A5A5)))
    used = np.flatnonzero(np.bincount(slot, minlength=base[-1]))
    row = np.searchsorted(base, used, "right") - 1
    place = (band[row] * HASHES + seed).astype(np.uint64) * np.uint64(1 << 40) + (used - base[row]).astype(np.uint64)
    return row, mix(counts[used] + mix(place)), np.bincount(row, minlength=len(band))


def cells(h: np.ndarray, offsets: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set, cell, band, and how many cells of the band the set shares with a linked one at least: of all cells, ascending by set.

    Sets that are linked have that many cells of one band in common.
    """
    edges, differ = bands(similarity)
    blocks = np.maximum(differ + differ // 16 + 5, 8)  # some more than differ, so that few sets have counts in so few
    size = np.diff(offsets)
    most = np.floor(size * (1 - similarity) / similarity + 1e-9).astype(np.int64)  # in how many shingles a set may differ from a linked one
    own = np.searchsorted(edges, size, "right") - 1
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for below in (0, 1):
        band = own - below
        open_ = np.flatnonzero((band >= 0) & ((below == 0) | (np.ceil(size * similarity - 1e-9) < edges[np.maximum(own, 0)])))
        for seed in range(HASHES):
            if not len(open_):
                break
            at = np.concatenate([[0], np.cumsum(size[open_])])
            x = h[np.repeat(offsets[open_] - at[:-1], size[open_]) + np.arange(at[-1])]
            row, key, used = _band_cells(x, at, seed, band[open_], blocks[band[open_]])
            over = used - np.minimum(most[open_], differ[band[open_]])
            parts.append((open_[row], key, band[open_][row], np.maximum(over, 1)[row] if seed == 0 else np.ones(len(row), np.int64)))
            open_ = open_[over <= 0]
        parts.append((open_, mix(band[open_].astype(np.uint64) + np.uint64(0xBA5D)), band[open_], np.ones(len(open_), np.int64)))
    of, key, band, need = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(of, kind="stable")
    return of[order], key[order], band[order], need[order]


def _sum_by(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64)


def count_vector(x: np.ndarray) -> np.ndarray:
    """Counts of a set's hashes by DIMENSIONS groups."""
    return np.bincount((x >> np.uint64(65 - DIMENSIONS.bit_length())).astype(np.int64), minlength=DIMENSIONS)


@cache
def _fraction(similarity: float) -> tuple[int, int]:
    """The fraction that a similarity such as 0.9 stands for."""
    return Fraction(similarity).limit_denominator(10_000).as_integer_ratio()


def linked(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two ascending arrays of distinct hashes have the Jaccard similarity or more."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    share, of = _fraction(similarity)
    return of * both >= share * (len(a) + len(b) - both)  # in whole numbers: a tie is exact at any size


class CountTree:
    """R-tree over count vectors: leaves of LEAF points and nodes of LEAF leaves, by size; each keeps the largest coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points[:, 0], points[:, 1], sizes)) if len(sizes) else np.zeros(0, np.int64)
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = [(self.points, self.sizes, self.sizes)]
        while len(self.levels[-1][0]) > LEAF:
            top, least, most = self.levels[-1]
            at = np.arange(0, len(top), LEAF)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))

    def search(self, point: np.ndarray, size: int, similarity: float) -> np.ndarray:
        """Indexes of the points whose overlap with `point` may suffice."""
        found = np.arange(len(self.levels[-1][0]))
        for depth, (top, least, most) in reversed(list(enumerate(self.levels))):
            low = np.maximum(least[found], np.ceil(similarity * size - 1e-9))
            fits = (low <= most[found]) & (least[found] <= size / similarity + 1e-9)
            found, low = found[fits], low[fits]
            bound = np.minimum(top[found], point).sum(1, dtype=np.int64)
            found = found[bound * (1 + similarity) >= similarity * (size + low) - 1e-9]
            if depth:
                found = (found[:, None] * LEAF + np.arange(LEAF)).ravel()
                found = found[found < len(self.levels[depth - 1][0])]
        return self.order[found]


def spanning_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, known: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between a left and another set that connect what wasn't connected before; sets of equal `known` were."""
    points = np.array([count_vector(x) for x in sets]).reshape(-1, DIMENSIONS)
    sizes = np.array([len(x) for x in sets], np.int64)
    targets = np.flatnonzero(right)
    _, first, own = np.unique(known, return_index=True, return_inverse=True)
    tree, parent, out = CountTree(points[targets], sizes[targets]), first[own], []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for a in np.flatnonzero(left):
        near = targets[tree.search(points[a], int(sizes[a]), similarity)]
        for b in near[own[near] != own[a]]:
            if (x := root(a)) != (y := root(b)) and linked(sets[a], sets[b], similarity):
                parent[max(x, y)] = min(x, y)
                out.append((int(a), int(b)))
    return out


def _fingerprint(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return _sum_by(mix(h + np.uint64(11)), offsets)


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            h, offsets = _sets(batch, n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(_fingerprint(h, offsets)), pa.array(_sum_by(mix(h ^ np.uint64(0xC0FFEE1234567)), offsets))], ["doc_id", "n_shingles", "f1", "f2"])

    return run


def _cells(n: int, similarity: float, more: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            h, offsets = _sets(batch, n)
            of, *columns = cells(h, offsets, similarity)
            at = pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x.view(np.int64) if k == 0 else x.astype(np.int32))) for k, x in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([pa.array(_fingerprint(h, offsets)), *(lists if more else lists[:1])], ["f1", "cell", "band", "need"][: 4 if more else 2])

    return run


def _set_bytes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            h, at = _sets(batch, n)
            own = np.flatnonzero(_fingerprint(h, at) == batch.column("f1").to_numpy())  # a doc_id may have other texts
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(own)), batch.column("cluster").take(pa.array(own)), pa.array(np.diff(at)[own]), pa.array([h[at[k] : at[k + 1]].tobytes() for k in own], pa.binary()), batch.column("f1").take(pa.array(own))], ["node", "cluster", "size", "shingles", "f1"])

    return run


def _searched(keys: list[str], similarity: float):
    """u and v: links of the members of each run of rows with equal `keys`; each row is a left, a right member, or both, and has its component so far."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def work(rows: list[tuple]) -> Iterator[tuple]:
        sets = [np.frombuffer(x[3], np.uint64) for x in rows]
        side = np.array([x[1] for x in rows])
        for a, b in spanning_links(sets, side != "right", side != "left", np.array([x[2] for x in rows]), similarity):
            yield rows[a][0], rows[b][0]

    return lambda batches: runs(batches, keys, ["node", "side", "component", "shingles"], work, schema)


def _with_text(docs: DataFrame, members: DataFrame) -> DataFrame:
    few = members.count() <= BROADCAST_IDS  # the size is checked
    return docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(F.broadcast(members) if few else members, "node")


def _parts() -> Column:
    """How many blocks a group of sets needs."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("size") / float(BLOCK_SHINGLES))).cast("int")


def _pivots(sets: DataFrame, degree: DataFrame) -> DataFrame:
    """node and cluster of the members that a cluster's others are searched for first: at most PIVOTS, and BLOCK_SHINGLES shingles or one."""
    known = sets.select("node", "cluster", "size").join(degree, "node")
    first = lambda order, n: known.withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy(*order))).where(F.col("k") <= n)  # noqa: E731  each task keeps n a cluster
    both = first([F.col("degree").desc(), "node"], BEST).unionByName(first([F.xxhash64("node"), "node"], PIVOTS - BEST).withColumn("k", F.col("k") + BEST))
    ranked = both.groupBy("cluster", "node", "size").agg(F.min("k").alias("k"))
    before = Window.partitionBy("cluster").orderBy("k", "node").rowsBetween(Window.unboundedPreceding, 0)  # PIVOTS rows at most
    return ranked.withColumn("upto", F.sum("size").over(before)).where((F.col("upto") <= BLOCK_SHINGLES) | (F.col("upto") == F.col("size"))).select("cluster", "node")


def _links(sets: DataFrame, placed: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """u and v: what a search finds in each run of rows of `placed` (node, cluster, side, component and the other `keys`), written; only here the sets are sent."""
    placed = written(placed)
    few = placed.count() <= BROADCAST_IDS
    rows = sets.select("cluster", "node", "shingles").join(F.broadcast(placed) if few else placed, ["cluster", "node"])
    found = written(rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_searched(keys, similarity), "u long, v long"))
    forget(placed)
    return found


def _against_pivots(ids: DataFrame, pivots: DataFrame) -> DataFrame:
    """Rows of a search of all members for the pivots of their cluster, by parts (i) of the members. ids: node, cluster, size."""
    marked = ids.join(pivots.withColumn("pivot", F.lit(True)), ["cluster", "node"], "left").withColumn("pivot", F.col("pivot").isNotNull())
    others = marked.where("not pivot")
    sizes = others.groupBy("cluster").agg(_parts().alias("parts"))
    left = others.join(sizes, "cluster").select("cluster", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("i"), "node", F.lit("left").alias("side"))
    part = F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("parts", F.lit(1)), F.lit(1)) - 1))
    pivot = marked.where("pivot").join(sizes, "cluster", "left").select("cluster", part.alias("i"), "node", F.lit("both").alias("side"))
    return left.unionByName(pivot).withColumn("component", F.col("node"))


def _among_rest(ids: DataFrame, pivots: DataFrame, found: DataFrame, similarity: float) -> tuple[DataFrame | None, list[DataFrame]]:
    """Rows of a search of the members outside their cluster's largest component, for each other and for all but the pivots, by pairs of blocks (i, j), and the tables they are read from.

    Members that different pivots link may be linked with each other, so they are left out only where one component holds them.
    """
    others = ids.join(pivots, ["cluster", "node"], "left_anti").join(components(found), "node", "left")
    others = written(others.withColumn("component", F.coalesce("component", "node")))
    held = others.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = held.groupBy("cluster").agg(F.max(F.struct("n", "component")).alias("most")).select("cluster", F.col("most.component").alias("largest"))
    rest = written(others.join(largest, "cluster").where("component <> largest").select("node", "cluster").distinct())
    if rest.isEmpty():
        return None, [others, rest]
    rest_of = others.join(rest.select("cluster").distinct(), "cluster").groupBy("cluster").agg((_parts() > WHOLE).alias("by_size"))
    sided = others.join(rest_of, "cluster").join(rest.withColumn("left", F.lit(True)), ["cluster", "node"], "left").withColumn("left", F.col("left").isNotNull())
    sided = written(sided.withColumn("band", F.when(F.col("by_size"), F.floor(F.log(F.col("size").cast("double")) / float(np.log(STEP)))).otherwise(0).cast("int")))
    groups = sided.groupBy("cluster", "left", "band").agg(F.min("size").alias("low"), F.max("size").alias("high"), _parts().alias("parts"))
    at = groups.select("cluster", "left", "band", "low", "high", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    name = F.struct(~F.col("left"), "band", "part")
    a = at.where("left").select("cluster", name.alias("i"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
    b = at.select("cluster", name.alias("j"), "left", F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    fits = (F.col("a_low") * similarity <= F.col("b_high") + 1e-9) & (F.col("b_low") * similarity <= F.col("a_high") + 1e-9)
    pairs = written(a.join(b, "cluster").where(fits & (~F.col("left") | (F.col("i") <= F.col("j")))).select("cluster", "i", "j"))  # a row a pair of blocks, none of sets
    placed = sided.join(groups.select("cluster", "left", "band", "parts"), ["cluster", "left", "band"])
    placed = placed.select("cluster", "node", "component", F.struct(~F.col("left"), "band", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part")).alias("name"))
    as_left = placed.join(pairs.withColumn("name", F.col("i")), ["cluster", "name"]).withColumn("side", F.when(F.col("i") == F.col("j"), "both").otherwise("left"))
    as_right = placed.join(pairs.where("i <> j").withColumn("name", F.col("j")), ["cluster", "name"]).withColumn("side", F.lit("right"))
    return as_left.unionByName(as_right).select("cluster", F.xxhash64("i").alias("i"), F.xxhash64("j").alias("j"), "node", "side", "component"), [others, rest, sided, pairs]


def near_duplicates(docs: DataFrame, n: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs` (doc_id: an integer)."""
    whole_numbers(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = written(texts.mapInArrow(_fingerprints(n), "doc_id long, n_shingles long, f1 long, f2 long"))
    same = ["n_shingles", "f1", "f2"]
    nodes = written(found.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("node")))

    # sets that meet in a cell, by stars around the smallest; of copies of one set only the first is read for its cells
    texts = texts.where("doc_id is not null").select("doc_id", "text")
    if nodes.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(nodes.select(F.col("node").alias("doc_id")).distinct()), "doc_id", "left_semi").select("doc_id", "text")
    cell = texts.mapInArrow(_cells(n, similarity, False), "f1 long, cell array<long>").select("f1", F.explode("cell").alias("cell"))
    shared = written(cell.groupBy("cell").agg(F.min("f1").alias("star"), F.max("f1").alias("other"), F.count(F.lit(1)).alias("n")).where("star <> other").drop("other"))
    again = texts.mapInArrow(_cells(n, similarity, True), "f1 long, cell array<long>, band array<int>, need array<int>").select("f1", F.inline(F.arrays_zip("cell", "band", "need")))
    if shared.count() <= BROADCAST_IDS:
        met = again.join(F.broadcast(shared.drop("n")), "cell")
    else:  # a cell that very many sets share is dealt over parts
        met = join_split(again, shared.drop("n"), ["cell"], hot_keys(shared, ["cell"], shared.agg(F.sum("n")).first()[0]), ["f1"])
    met = met.dropDuplicates(["f1", "cell"])
    by_band = met.groupBy("f1", "band").agg(F.count(F.lit(1)).alias("degree"), F.max("need").alias("need"), F.collect_set("star").alias("stars"))
    stars = written(by_band.where("degree >= need").select("f1", F.explode("stars").alias("star"), (F.col("degree") / F.size("stars")).alias("degree")))
    forget(shared)
    clusters = components(stars.select(F.col("f1").alias("u"), F.col("star").alias("v"))).select(F.col("node").alias("f1"), F.col("component").alias("cluster"))
    members = written(nodes.join(clusters, "f1").join(stars.groupBy("f1").agg(F.sum("degree").alias("degree")), "f1").select("node", "f1", "cluster", "degree"))
    alone = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("cluster")
    members = written(members.join(alone, "cluster", "left_anti"))
    degree = members.groupBy("node").agg(F.max("degree").alias("degree"))
    sets = _with_text(docs, members.select("node", "f1", "cluster")).mapInArrow(_set_bytes(n), "node long, cluster long, size long, shingles binary, f1 long")
    if not found.groupBy("doc_id", "f1").count().where("count > 1").isEmpty():  # only rows that repeat need a shuffle of sets
        sets = sets.dropDuplicates(["node", "f1"])
    sets = written(sets.drop("f1"))

    ids = sets.select("node", "cluster", "size")
    pivots = written(_pivots(ids, degree))
    links = _links(sets, _against_pivots(ids, pivots), ["cluster", "i"], similarity)
    rest, read = _among_rest(ids, pivots, links, similarity)
    if rest is not None:
        links = links.unionByName(_links(sets, rest, ["cluster", "i", "j"], similarity))
    forget(stars, sets, pivots, *read)
    joined = components(links)
    named = nodes.select(*same, "node").join(joined, "node", "left").select(*same, F.coalesce("component", "node").alias("component_id"))
    return found.select("doc_id", *same).join(named, same, "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))
