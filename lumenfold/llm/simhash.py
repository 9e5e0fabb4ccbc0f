"""SimHash fingerprints: weighted term hashes vote on the signs of BITS bits.

Terms are the lower-cased words and pairs of neighbouring words. A term's weight is the square root of
its length in bytes, less for short words, which occur everywhere. A text's votes come from one table of
byte values a byte of the term hash, so no bit is counted term by term. The likeness of two fingerprints
is the cosine that their Hamming distance stands for, not below 0.

`neighbours` counts for every fingerprint the others within a Hamming radius, and `within` gives the pairs: the bits
are cut into radius + 1 blocks, and two such fingerprints agree in one block at least; so for each block a table
leads with that block, and only fingerprints that share its value are compared, each pair in the first block that
it shares. The fingerprints of a value come in parts of PART rows, and each pair of parts is a unit of work of its own, so a
value that very many fingerprints share is held by no task; the pairs themselves are never emitted for a count.

Cases: a null or empty text, or one without words, has the fingerprint of no vote (all bits 0); equal texts have
equal fingerprints; a text that repeats gives its row each; extra columns are ignored; texts of any length are
read whole; an empty table gives no row. A doc_id must be a whole number or null for `edit_test`, any that a long can hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.blocks import runs
from lumenfold.llm.scratch import whole_numbers, written
from lumenfold.llm.words import chunks, mix, split_words

BITS, RADIUS = 128, 3
#: Fingerprints of one value of a block that a task holds at once.
PART = 2_048
#: Fingerprints with neighbours up to which they are broadcast (about 60 bytes each).
BROADCAST_PRINTS = 500_000
#: Rows of one range of ids that a task holds in order.
RANGE_ROWS = 4_000
#: Most ranges, whose first rows' ids are broadcast (24 bytes each), and the quantiles they are cut from.
MAX_RANGES, QUANTILES = 200_000, 200

_SIGNS = 2 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) - 1


def fingerprints(texts: pa.Array) -> np.ndarray:
    """Texts by BITS // 8 bytes."""
    words = split_words(texts, lower=True)
    h = words.hashes()
    pair, at = words.pairs(h)
    length = words.length.astype(np.float64)
    weight = np.sqrt(length) * np.where(words.length <= 3, 0.25, 1.0)
    both = np.concatenate([h, pair])
    doc = np.concatenate([words.doc, words.doc[at]])
    weight = np.concatenate([weight, np.sqrt(length[at] + length[at + 1]) if len(at) else weight[:0]])
    votes = np.zeros((words.texts, BITS))
    for part in range(BITS // 64):
        raw = mix(both + np.uint64(0x632BE59BD9B4E019) * np.uint64(part + 1)).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            table = np.bincount(doc * 256 + raw[:, k], weight, words.texts * 256).reshape(words.texts, 256)
            votes[:, 64 * part + 8 * k : 64 * part + 8 * k + 8] = table @ _SIGNS
    return np.packbits(votes > 1e-9, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = np.unpackbits(a ^ b, axis=1).sum(1)
    return np.where(apart == 0, 1.0, np.maximum(0.0, np.cos(np.pi * apart / BITS)))


def _hex(prints: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes().hex() for x in prints], pa.string())


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hexadecimal) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _hex(fingerprints(batch.column("text")))], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def _edges(radius: int) -> list[int]:
    """Where the blocks of the hexadecimal digits begin, and their end."""
    return [BITS // 4 * k // (radius + 1) for k in range(radius + 2)]


def close_pairs(a: np.ndarray, b: np.ndarray, block: int, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes and distance of the pairs of two lists of different fingerprints (bytes) within `radius` of which `block` is the first they share; of one list, each pair once."""
    edges = _edges(radius)
    found = []
    x, y = a.view(np.uint64), b.view(np.uint64)
    for low in range(0, len(a), 256):
        apart = sum(np.bitwise_count(x[low : low + 256, None, k] ^ y[None, :, k]).astype(np.int16) for k in range(x.shape[1]))
        i, j = np.nonzero((apart <= radius) & (apart > 0))
        found.append((i + low, j, apart[i, j]))
    i, j, apart = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    digits = lambda of: np.stack([of >> 4, of & 15], axis=2).reshape(len(of), 2 * of.shape[1])
    equal = digits(a[i]) == digits(b[j])
    first = np.array([~equal[:, edges[k] : edges[k + 1]].all(1) for k in range(block)]).all(0) if block else np.ones(len(i), bool)
    keep = first & ((i < j) | (not same))
    return i[keep], j[keep], apart[keep]


def _compared(radius: int, pairs: bool):
    """The pairs within the radius, or how many each fingerprint has, of each run of rows of a pair of parts."""
    schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("distance", pa.int32())] if pairs else [("fingerprint", pa.string()), ("n", pa.int64())])

    def work(rows: list[tuple]) -> Iterator[tuple]:
        block, i, j = rows[0][0], rows[0][2], rows[0][3]
        sides = [[r[1] for r in rows if r[4] == part] for part in (i, j)]
        a, b = (np.frombuffer(bytes.fromhex("".join(side)), np.uint8).reshape(-1, BITS // 8) for side in sides)
        x, y, apart = close_pairs(a, b, block, radius, i == j)
        if pairs:
            for k, m, d in zip(x.tolist(), y.tolist(), apart.tolist(), strict=True):
                yield min(sides[0][k], sides[1][m]), max(sides[0][k], sides[1][m]), d
            return
        for side, at in zip(sides, (x, y), strict=True):
            count = np.bincount(at, minlength=len(side))
            for k in np.flatnonzero(count):
                yield side[k], int(count[k])

    return lambda batches: runs(batches, ["block", "value", "i", "j"], ["block", "fingerprint", "i", "j", "part"], work, schema)


def _tables(prints: DataFrame, radius: int) -> DataFrame:
    """block, value, i, j, fingerprint and part: each fingerprint for each pair of parts, of the values that several share."""
    edges = _edges(radius)
    every = written(prints.select("fingerprint").where(F.col("fingerprint").isNotNull()).distinct())
    blocks = F.array(*[F.substring("fingerprint", edges[k] + 1, edges[k + 1] - edges[k]) for k in range(radius + 1)])
    tables = every.select("fingerprint", F.posexplode(blocks).alias("block", "value"))
    sizes = tables.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block", "value", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    rows = tables.join(sizes, ["block", "value"]).withColumn("part", F.pmod(F.xxhash64("fingerprint"), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("block", "value", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "fingerprint", "part")


def _search(prints: DataFrame, radius: int, pairs: bool, schema: str) -> DataFrame:
    keys = ["block", "value", "i", "j"]
    return _tables(prints, radius).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compared(radius, pairs), schema)


def within(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b and distance of the pairs a < b of different fingerprints at most `radius` bits apart."""
    return _search(prints, radius, True, "a string, b string, distance int")


def neighbours(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fingerprint and n: how many other fingerprints of `prints` are at most `radius` bits apart, where any is."""
    return _search(prints, radius, False, "fingerprint string, n long").groupBy("fingerprint").agg(F.sum("n").alias("n"))


def _edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and place in it. A row is compared with the next of its range; the last row of a range only serves the one before."""
    last: tuple | None = None
    for batch in chunks(batches, "text"):
        rows = list(zip(batch.column("range").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("helper").to_pylist(), (x or "" for x in batch.column("text").to_pylist()), strict=True))
        rows, last = ([last] if last else []) + rows, rows[-1]
        pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and not a[2]]
        if not pairs:
            continue
        edited = [_edited(a[3], b[3]) for a, b in pairs]
        own = fingerprints(pa.array([r[3] for r in rows], pa.large_string()))
        at = np.array([k for k in range(len(rows) - 1) if rows[k][0] == rows[k + 1][0] and not rows[k][2]])
        changed = fingerprints(pa.array(edited, pa.large_string()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([a[1] for a, _ in pairs], pa.int64()),
                pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                _hex(own[at]),
                _hex(changed),
                pa.array(likeness(own[at], changed)),
                pa.array(likeness(own[at], own[at + 1])),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def _ranges(docs: DataFrame) -> DataFrame:
    """`docs` with range, which ascends with doc_id: parts between approximate quantiles, each cut at equal steps of the id."""
    parts = max(1, min(MAX_RANGES, -(-docs.count() // RANGE_ROWS)))
    quantiles = min(parts, QUANTILES)
    steps = -(-parts // quantiles)
    found = docs.agg(F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [k / quantiles for k in range(quantiles)], 20 * quantiles)).first()
    if parts == 1 or found[0] is None:
        return docs.withColumn("range", F.lit(0))
    edges = sorted({found[0], *found[2]})
    listed = lambda of: F.array(*[F.lit(x).cast("long") for x in of])
    at = F.greatest(F.size(F.filter(listed(edges), lambda x: x <= F.col("doc_id"))), F.lit(1))
    place = lambda c: c.cast("double")  # noqa: E731  differences of longs may not fit a long; rounded places still ascend with the id
    low, high = place(F.element_at(listed(edges), at)), place(F.element_at(listed([*edges[1:], found[1]]), at))
    step = F.floor((place(F.col("doc_id")) - low) * float(steps) / F.greatest(high - low, F.lit(1.0))).cast("long")
    return docs.withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise((at - 1) * steps + F.least(step, F.lit(steps - 1))).cast("long"))


def edit_test(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint against that of its edited text and of the next document.

    The next document is the one that follows in descending doc_id (rows of one doc_id by a hash of the text, a null
    id last); after the last comes the first. Ranges of ids are shuffled to their tasks once; the row with
    which a range would go on is sent to it as a helper. n_near: how many other fingerprints are within RADIUS bits.
    """
    whole_numbers(docs)
    rows = _ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("tie"))
    rows = rows.withColumn("place", place)
    heads = rows.groupBy("range").agg(F.max("place").alias("place"))  # a row a range
    before = Window.orderBy(F.col("range").asc())
    heads = written(heads.select("place", F.coalesce(F.lead("range").over(before), F.min("range").over(Window.partitionBy())).alias("to")))
    joined = rows.join(F.broadcast(heads.select("place", "to")), "place", "left")  # MAX_RANGES rows at most
    # the tie of equal rows: only one of them is sent on
    own = joined.select("range", "place", "doc_id", "text", F.lit(False).alias("helper"))
    sent = joined.where(F.col("to").isNotNull()).dropDuplicates(["place"]).select(F.col("to").alias("range"), "place", "doc_id", "text", F.lit(True).alias("helper"))
    both = own.unionByName(sent)
    found = both.repartition("range").sortWithinPartitions(F.col("range"), F.col("helper"), F.col("place").desc()).select("range", "doc_id", "helper", "text").mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    found = written(found)
    near = written(neighbours(found).withColumnRenamed("n", "n_near"))
    few = near.count() <= BROADCAST_PRINTS
    return found.join(F.broadcast(near) if few else near, "fingerprint", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
