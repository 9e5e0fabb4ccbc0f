"""SimHash near-dedup by tiled exact comparison.

A fingerprint has a bit set where more than half of a text's shingle hashes (XXH64) have it. Every pair of different
fingerprints is compared, or excluded by its population counts:

1. Equal fingerprints are one node, with their smallest doc_id (combined before the shuffle).
2. Nodes are sorted by population counts, of all bits first, then of ever smaller segments of the bits, and cut into tiles of TILE nodes.
   A tile keeps the smallest and largest count of each segment. Two fingerprints differ in as many bits at least as the counts of
   their segments differ by in sum, on each level of segments; so tiles whose counts are farther apart than the
   radius hold no link, and are skipped. The more nodes there are, the narrower their tiles' counts.
3. The sorted nodes are dealt to blocks by range. A pair of blocks that isn't excluded by its counts is a unit of work of its own,
   of two times BLOCK nodes at most; within it each pair of tiles is compared by exclusive-or and bit counts, if not skipped.
4. A tile's own links come first, so that a group of near copies is one root in each of its tiles, and a pair of tiles gives what
   connects roots that weren't connected; never the pairs of a group.
5. Connected components of the links.

Comparisons grow less than with the square of the different fingerprints, but more than in proportion.

Cases: a null or empty text, or one without words, has the fingerprint zero, which is linked like any other; rows that repeat a
doc_id are rows of their own, each with the component of its fingerprint; a row without an id links nothing and has no component_id; extra
columns are ignored; an empty table gives no row. Texts of any length are read whole. doc_id must be a whole number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.blocks import runs
from lumenfold.llm.components import components
from lumenfold.llm.hot import hot_keys, join_split
from lumenfold.llm.scratch import whole_numbers, written
from lumenfold.llm.words import chunks, release

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Nodes of a tile, nodes of a block, and blocks that smaller tables are cut into, so that there is work for every core.
TILE, BLOCK, BLOCKS = 256, 1 << 17, 16
#: Nodes, or pairs of blocks, up to which a side is broadcast (about 24 bytes each).
BROADCAST_ROWS = 2_000_000
#: Links of a unit that are held before they are reduced to those that connect something.
HELD = 1_000_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: bytes) -> Iterator[int]:
    words = text.translate(_LOWER).split()
    if 0 < len(words) < SHINGLE:
        return iter([xxhash.xxh64_intdigest(b" ".join(words), SEED)])
    return (xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(words[k:] for k in range(SHINGLE)), strict=False))


def fingerprints(texts: pa.Array) -> np.ndarray:
    """One number of 64 bits a text."""
    each = [np.fromiter(shingle_hashes(x or b""), np.uint64) for x in texts.cast(pa.large_binary()).to_pylist()]
    sizes = np.array([len(x) for x in each], np.int64)
    raw = np.concatenate([*each, np.zeros(0, np.uint64)]).astype("<u8").view(np.uint8).reshape(-1, 8)
    at = np.repeat(np.arange(len(each)), sizes) * 256
    out = np.zeros((len(each), 8), np.uint8)
    for k in range(8):  # how often each value of the k-th byte occurs in a text, and with it each bit
        values = np.bincount(at + raw[:, k], minlength=256 * len(each)).reshape(-1, 256)
        out[:, k] = np.packbits(2 * (values @ _BITS) > sizes[:, None], axis=1)[:, 0]
    return out.reshape(-1).view("<u8").astype(np.uint64)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and print (64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(batch.column("text")).view(np.int64))], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, print long")


def counts(prints: np.ndarray) -> np.ndarray:
    """Population counts of the bytes, the four and two larger segments, and the whole: 15 a fingerprint."""
    levels = [np.bitwise_count(prints.astype("<u8").view(np.uint8).reshape(-1, 8)).astype(np.int16)]
    while levels[-1].shape[1] > 1:
        levels.append(levels[-1][:, ::2] + levels[-1][:, 1::2])
    return np.concatenate(levels, axis=1)


#: Where the levels of `counts` begin and end.
LEVELS = [(0, 8), (8, 12), (12, 14), (14, 15)]


def _order() -> list[Column]:
    """Sorts fingerprints by the counts of all bits, of half of them, and of half of each half."""
    of = lambda low, width: F.bit_count(F.shiftrightunsigned("print", low).bitwiseAND(F.lit((1 << width) - 1)))
    return [F.bit_count("print"), of(0, 32), of(0, 16), of(32, 16), of(0, 8), of(16, 8), of(32, 8), of(48, 8), F.col("print")]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number that each of n numbers is connected with by the links i - j."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        while (after != (further := after[after])).any():
            after = further
        if (after == root).all():
            return root
        root = after


def close(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of two lists that differ in `radius` bits at most."""
    return np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)


def near_tiles(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray, radius: int) -> np.ndarray:
    """Which tiles may hold a fingerprint within the radius of another tile's, by the ranges of their counts."""
    gap = np.maximum(np.maximum(other_low - high, low - other_high), 0)
    return np.logical_and.reduce([gap[:, x:y].sum(1) <= radius for x, y in LEVELS])


def _tiles(tile: int, radius: int):
    """Tiles of the sorted rows of a task: block, low and high (of counts), and the fingerprints with their roots in the tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, block = np.zeros(0, np.uint64), 0
        for batch in [*batches, None]:
            if batch is not None and batch.num_rows:
                block = batch.column("block")[0].as_py()
                rest = np.concatenate([rest, batch.column("print").to_numpy().view(np.uint64)])
            whole = len(rest) - (len(rest) % tile if batch is not None else 0)
            cut = [rest[at : min(at + tile, whole)] for at in range(0, whole, tile)]
            rest = rest[whole:]
            if cut:
                own = [x[roots(len(x), *close(x, x, radius))] for x in cut]
                ranges = [counts(x) for x in cut]
                columns = [[block] * len(cut), [x.min(0).tolist() for x in ranges], [x.max(0).tolist() for x in ranges], [x.tobytes() for x in cut], [x.tobytes() for x in own]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.list_(pa.int16()), pa.list_(pa.int16()), pa.binary(), pa.binary()), strict=True)], ["block", "low", "high", "prints", "roots"])

    return run


def _linked(pairs: list[np.ndarray]) -> np.ndarray:
    """Rows of two fingerprints, reduced to links from each to the root of its component."""
    both = np.concatenate([*pairs, np.zeros((0, 2), np.uint64)])
    names, at = np.unique(both, return_inverse=True)
    at = at.reshape(-1, 2)
    root = roots(len(names), at[:, 0], at[:, 1])
    out = np.stack([names, names[root]], axis=1)
    return out[out[:, 0] != out[:, 1]]


def _compared(radius: int, held: int):
    """u and v: links between the roots of the tiles of a pair of blocks."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def work(rows: list[tuple]) -> Iterator[tuple]:
        same = rows[0][0] == rows[0][1]
        low, high = (np.array([r[k] for r in rows], np.int16) for k in (3, 4))
        prints, own = ([np.frombuffer(r[k], np.uint64) for r in rows] for k in (5, 6))
        right = np.flatnonzero(np.array([same or r[2] == "right" for r in rows]))
        found, size = [], 0
        for a in np.flatnonzero(np.array([r[2] == "left" for r in rows])):
            others = right[right > a] if same else right
            for b in others[near_tiles(low[a], high[a], low[others], high[others], radius)]:
                i, j = close(prints[a], prints[b], radius)
                if not len(i):
                    continue
                links = np.stack([own[a][i], own[b][j]], axis=1)
                links = np.unique(links[links[:, 0] != links[:, 1]], axis=0)
                found.append(links)
                size += len(links)
                if size > held:
                    found = [_linked(found)]
                    size = len(found[0])
        for u, v in _linked(found).view(np.int64).tolist():
            yield u, v

    return lambda batches: runs(batches, ["i", "j"], ["i", "j", "side", "low", "high", "prints", "roots"], work, schema)


def _pairs(tiles: DataFrame, radius: int) -> DataFrame:
    """i and j: the pairs i <= j of blocks that may hold a link, by the ranges of their counts; a row a pair of blocks."""
    n = LEVELS[-1][1]
    ranges = tiles.groupBy("block").agg(F.array(*[F.min(F.col("low")[k]) for k in range(n)]).alias("low"), F.array(*[F.max(F.col("high")[k]) for k in range(n)]).alias("high"))
    ranges = written(ranges)
    totals = lambda more: F.explode(F.sequence(F.col("low")[n - 1].cast("int") - more, F.col("high")[n - 1].cast("int") + more)).alias("total")
    a = ranges.select(F.col("block").alias("i"), "low", "high", totals(0))
    b = ranges.select(F.col("block").alias("j"), F.col("low").alias("b_low"), F.col("high").alias("b_high"), totals(radius))
    gap = lambda k: F.greatest(F.col("b_low")[k] - F.col("high")[k], F.col("low")[k] - F.col("b_high")[k], F.lit(0))
    fits = [sum((gap(k) for k in range(x, y)), F.lit(0)) <= radius for x, y in LEVELS]
    met = a.join(b, "total").where(F.col("i") <= F.col("j"))
    for x in fits:
        met = met.where(x)
    return met.select("i", "j").distinct()


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE, block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """u and v: what connects the fingerprints (print, each once) that are within the radius of others."""
    spark, n = nodes.sparkSession, nodes.count()
    if not n:
        return spark.createDataFrame([], "u long, v long")
    parts = max(-(-n // block), min(blocks, -(-n // tile)))
    dealt = nodes.select("print").repartitionByRange(parts, *_order()).sortWithinPartitions(*_order()).withColumn("block", F.spark_partition_id())
    tiles = written(dealt.mapInArrow(_tiles(tile, radius), "block int, low array<smallint>, high array<smallint>, prints binary, roots binary"))
    pairs = written(_pairs(tiles, radius))
    units = pairs.count()
    small = F.broadcast(pairs) if units <= BROADCAST_ROWS else pairs
    left = tiles.withColumn("i", F.col("block")).join(small, "i").withColumn("side", F.lit("left"))
    right = tiles.withColumn("j", F.col("block")).join(small.where("i <> j"), "j").withColumn("side", F.lit("right"))
    columns = ["i", "j", "side", "low", "high", "prints", "roots"]
    tasks = min(units, max(64, 4 * spark.sparkContext.defaultParallelism))
    placed = left.select(*columns).unionByName(right.select(*columns)).repartition(tasks, "i", "j").sortWithinPartitions("i", "j", "side")
    between = placed.mapInArrow(_compared(radius, HELD), "u long, v long")
    within = tiles.mapInArrow(_own_links, "u long, v long")
    return written(within.unionByName(between))


def _own_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u and v: each fingerprint and its root in its tile, where it is another."""
    for batch in batches:
        u, v = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64) for c in ("prints", "roots"))
        yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])
    release()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of `docs`."""
    whole_numbers(docs)
    prints = written(fingerprint(docs))
    nodes = written(prints.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    joined = components(links(nodes, radius, tile, block)).select(F.col("node").alias("print"), "component")
    marked = written(nodes.join(joined, "print", "left"))
    groups = written(marked.where("component is not null").groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    few = groups.count() <= BROADCAST_ROWS
    linked = marked.where("component is not null").select("print", "component")
    linked = linked.join(F.broadcast(groups.drop("n")), "component") if few else join_split(linked, groups.drop("n"), ["component"], hot_keys(groups, ["component"], nodes.count()), ["print"])
    named = written(linked.select("print", "component_id").unionByName(marked.where("component is null").select("print", F.col("least").alias("component_id"))))
    if named.count() <= BROADCAST_ROWS:
        found = prints.join(F.broadcast(named), "print", "left")
    else:
        found = join_split(prints, named, ["print"], hot_keys(nodes, ["print"], prints.count()), ["doc_id"], "left")
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
