"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the hashed slots of its lower-cased words, of the words' first 4, 5 and 6 bytes (a
truncation stem, so that inflected forms of a word share a slot), of pairs of neighbouring words and of
pairs with one word between them. A slot counts once per text, and further slots stand for its recurrence: one
for each of RATES that its share of the text's words reaches, since words that a text holds once by
chance differ from words that it keeps using, whatever its length. Training runs on a bounded, documented
sample of the labelled rows (MAX_TRAIN_DOCS rows and MAX_TRAIN_SLOTS slots in all), which one task takes in the
order of a hash of the id: FTRL-proximal with per-coordinate rates and L1, the same at every size of the input. L1
leaves few weights, which are broadcast: at most SLOTS numbers, whatever the input. Scoring is one scan of the
documents, without a shuffle.

Cases: a null or empty text has no feature and gets the score of the intercept; rows with a null label or
a null id are not learned from; of labelled rows that repeat an id one text is learned from (the one with the
smallest hash), with the largest of the id's labels; repeated rows are scored alike; extra columns of the input are
ignored; without any labelled row every score is 0.0. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.scratch import forget, written
from lumenfold.llm.words import Words, chunks, distinct, mix, split_words

#: Hash slots; bounds the model that is collected and broadcast (8 bytes each).
SLOTS = 1 << 20
#: Most labelled rows that are learned from, chosen by a hash of the id, and most slots of them in all (4 bytes each);
#: fewer are all used.
MAX_TRAIN_DOCS, MAX_TRAIN_SLOTS = 16_000, 64_000_000
EPOCHS, ALPHA, BETA, L1, L2 = 8, 1.0, 1.0, 5.0, 0.02
#: A slot recurs at a rate if it occurs twice, and once in so many words of the text.
RATES = (30, 60, 120, 240)
_SHIFT = np.uint64(64 - SLOTS.bit_length() + 1)
_STEMS = (4, 5, 6)


def held_out(doc_id: Column) -> Column:
    """Whether a row is held out: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and slot of each feature occurrence."""
    h = words.hashes()
    doc, out = [words.doc], [h]
    for k in _STEMS:
        doc.append(words.doc)
        out.append(words.hashes(k) + np.uint64(k))
    for gap in (1, 2):
        pair, at = words.pairs(h, gap)
        doc.append(words.doc[at])
        out.append(pair)
    slots = ((np.concatenate(out) * np.uint64(0xD6E8FEB86659FD93)) >> _SHIFT).astype(np.int64)
    return np.concatenate(doc), slots


def recurring(slots: np.ndarray, rate: int) -> np.ndarray:
    """The slots that stand for the recurrence of `slots` at a rate."""
    return (mix(slots.astype(np.uint64) * np.uint64(1 << 10) + np.uint64(rate)) >> _SHIFT).astype(np.int64)


def by_text(doc: np.ndarray, slots: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and slot, once each, of the occurrences and of their recurrence in texts of `sizes` words."""
    key = np.sort(doc * SLOTS + slots)
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
    times = np.diff(np.append(at, len(key)))
    key = key[at]
    again = times >= 2
    doc, slots, times = key[again] // SLOTS, key[again] % SLOTS, times[again]
    found = [key]
    for rate in RATES:
        often = times * rate >= sizes[doc]
        found.append(doc[often] * SLOTS + recurring(slots[often], rate))
    key = distinct(np.concatenate(found))
    return key // SLOTS, key % SLOTS


def ftrl(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights that FTRL-proximal leaves non-zero; slot SLOTS is the intercept, without L1."""
    z, n = np.zeros(SLOTS), np.zeros(SLOTS)
    z0 = n0 = 0.0

    def rate(n):
        return (BETA + np.sqrt(n)) / ALPHA + L2

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / rate(ni))

    for _ in range(EPOCHS):
        for at, y in zip(rows, labels, strict=True):
            before = n[at]
            w, w0 = weights(z[at], before), -z0 / rate(n0)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + w0, -35, 35))) - y
            z[at] += g - (np.sqrt(before + g * g) - np.sqrt(before)) / ALPHA * w
            n[at] = before + g * g
            z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / ALPHA * w0
            n0 += g * g
    w = np.append(weights(z, n), -z0 / rate(n0))
    used = np.flatnonzero(w)
    return used, w[used]


def _train_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        words = split_words(batch.column("text"), lower=True)
        doc, slots = by_text(*features(words), np.diff(words.first))
        offsets = np.searchsorted(doc, np.arange(words.texts + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("rank"), batch.column("tie"), batch.column("label"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(slots.astype(np.int32)))],
            ["rank", "tie", "label", "slots"],
        )


def _train(table: pa.Table) -> pa.Table:
    rows, labels, ranks = [], [], []
    for batch in table.to_batches():
        column = batch.column("slots")
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
        rows += [values[i:j] for i, j in zip(offsets, offsets[1:], strict=False)]  # views: no row is copied
        labels += batch.column("label").to_pylist()
        ranks += batch.column("rank").to_pylist()
    order = np.argsort(np.array(ranks, np.int64), kind="stable")
    slots, weights = ftrl([rows[k] for k in order], np.array(labels, float)[order])
    return pa.table({"slot": slots, "weight": weights})


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_docs: int = MAX_TRAIN_DOCS, max_slots: int = MAX_TRAIN_SLOTS) -> dict[int, float]:
    """Weights by slot, from the rows of `labels` (doc_id, `label`) that aren't held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("label"))
    known = known.withColumn("rank", F.xxhash64("doc_id"))
    rows = known.count()
    if not rows:
        return {}
    up_to = lambda share: F.col("rank") <= F.lit(min(int((2 * share - 1) * (1 << 63)), (1 << 63) - 1))  # noqa: E731  a share of the hash's range
    sample = known.where(up_to(min(1.0, max_docs / rows)))  # about max_docs rows of 24 bytes at most: a fixed bound
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("rank", F.xxhash64("text").alias("tie"), F.col("label").cast("double").alias("label"), "text")
    read = picked.mapInArrow(_train_features, "rank long, tie long, label double, slots array<int>")
    found = written(read.groupBy("rank").agg(F.max("label").alias("label"), F.min_by("slots", "tie").alias("slots")))
    size = found.agg(F.sum(F.size("slots"))).first()[0] or 0
    share = min(1.0, max_docs / rows) * min(1.0, max_slots / max(size, 1))
    trained = found.where(up_to(share)).withColumn("sample", F.lit(0)).groupBy("sample").applyInArrow(_train, "slot long, weight double").collect()  # SLOTS + 1 rows at most
    forget(found)
    return {r.slot: r.weight for r in trained}


def score(docs: DataFrame, model: dict[int, float]) -> DataFrame:
    """doc_id and score of every row of `docs`: the probability that its label is 1."""
    table = np.zeros(SLOTS + 1)
    table[list(model)] = list(model.values())
    used = np.flatnonzero(table[:SLOTS])
    shared = docs.sparkSession.sparkContext.broadcast((used, table[used], table[SLOTS] if model else -np.inf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, weights, intercept = shared.value
        dense = np.zeros(SLOTS)
        dense[used] = weights
        every = np.arange(SLOTS)
        counts = (dense != 0) | np.any([dense[recurring(every, rate)] != 0 for rate in RATES], axis=0)
        for batch in chunks(batches, "text"):
            words = split_words(batch.column("text"), lower=True)
            doc, slots = features(words)
            hit = counts[slots]
            doc, slots = by_text(doc[hit], slots[hit], np.diff(words.first))
            total = intercept + np.bincount(doc, dense[slots], words.texts)
            with np.errstate(over="ignore"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1.0 / (1.0 + np.exp(-total)))], ["doc_id", "score"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs`."""
    scored = score(docs, fit(docs, labels, label))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
