"""Quality: regularised quadratic discriminant over transformed document statistics.

Each text gives STATISTICS numbers (lengths, and shares of kinds of bytes and words, on root or log
scales), in one scan that is written as a small table. The class means and covariances are sums over the
labelled rows, added up by Spark: no row goes to the driver, only one row of sums a class. The class
covariances are shrunk towards the pooled one and towards a multiple of the identity; their Cholesky
factors are computed once and sent to the tasks, where a score is the logistic function of the
difference of the two log densities (Mahalanobis term, log determinant and log prior).

Cases: a null or empty text has the statistics of no word and is scored like any other; rows with a null
label or id are not learned from; repeated rows are scored alike; extra columns are ignored; without
labelled rows of both classes the score is the share of label 1, or 0.0 without any. Texts of any length
are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.scratch import written
from lumenfold.llm.toxicity import held_out
from lumenfold.llm.words import Words, chunks, distinct, split_words

STATISTICS = 14
#: Shrinkage of a class covariance towards the pooled one, and of the result towards the mean variance.
TO_POOLED, TO_IDENTITY = 0.5, 0.1
#: Divides the difference of the log densities: the statistics of a text are not as independent as a Gaussian has them.
TEMPERATURE = 2.0

_KINDS = np.zeros((5, 256), np.float64)
_KINDS[0, 0x41:0x5B] = 1  # upper case
_KINDS[1, 0x30:0x3A] = 1  # digits
_KINDS[2, [*b"#$%&*|~^@<>{}[]=_\\/+"]] = 1  # symbols
_KINDS[3, [*b"!?"]] = 1
_KINDS[4, [*b".,;:'\"()-"]] = 1
_UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _per_text(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(x, dtype=np.float64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def statistics(words: Words) -> np.ndarray:
    """Texts by STATISTICS."""
    size = np.diff(words.offsets).astype(float)
    count = np.diff(words.first).astype(float)
    chars, per_word = np.maximum(size, 1), np.maximum(count, 1)
    h = words.hashes()
    kinds = [np.sqrt(_per_text(k[words.data], words.offsets) / chars) for k in _KINDS]
    lines = _per_text(words.data == 0x0A, words.offsets) + 1
    letters = np.concatenate([[0], np.cumsum(_LETTER[words.data])])
    uppers = np.concatenate([[0], np.cumsum(_UPPER[words.data])])
    end = words.start + words.length
    all_upper = (uppers[end] - uppers[words.start] >= 2) & (uppers[end] - uppers[words.start] == letters[end] - letters[words.start])
    no_letter = letters[end] == letters[words.start]
    last = words.data[end - 1] if len(end) else np.zeros(0, np.uint8)
    odd_end = ~_LETTER[last] & ~np.isin(last, np.frombuffer(b".,;:", np.uint8)) & ~no_letter
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    key = distinct((words.doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    kept = np.bincount((key >> np.uint64(44)).astype(np.int64), minlength=words.texts)
    share = lambda x: np.sqrt(np.bincount(words.doc[x], minlength=words.texts) / per_word)
    return np.column_stack(
        [np.log1p(count), np.log(np.maximum(size - count, 1) / per_word + 0.5), *kinds, np.log(chars / lines), share(all_upper), share(no_letter), share(odd_end), share(again), np.log(np.maximum(kept, 1)) / np.log(per_word + 1.72), np.log1p(lines)]
    )


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        x = statistics(split_words(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, np.ascontiguousarray(x.T))], ["doc_id", *_columns()])


def _columns() -> list[str]:
    return [f"s{i}" for i in range(STATISTICS)]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the columns s0, s1, ... of every row."""
    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_statistics_of, f"doc_id {ids}, " + ", ".join(f"{c} double" for c in _columns()))


class Discriminant:
    """Means and Cholesky factors of two classes, from their sums."""

    def __init__(self, count: np.ndarray, total: np.ndarray, square: np.ndarray):
        self.share = count[1] / max(count.sum(), 1)
        self.usable = bool((count >= 2).all())
        if not self.usable:
            return
        mean = total / count[:, None]
        scatter = square - count[:, None, None] * mean[:, :, None] * mean[:, None, :]
        pooled = scatter.sum(0) / count.sum()
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        unit = self.scale[:, None] * self.scale
        self.mean, self.root, self.const = mean / self.scale, [], []
        for k in (0, 1):
            cov = (1 - TO_POOLED) * scatter[k] / count[k] / unit + TO_POOLED * pooled / unit
            cov = (1 - TO_IDENTITY) * cov + TO_IDENTITY * np.trace(cov) / len(cov) * np.eye(len(cov))
            lower = np.linalg.cholesky(cov)
            self.root.append(np.linalg.inv(lower))
            self.const.append(np.log(count[k] / count.sum()) - np.log(np.diag(lower)).sum())

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.usable:
            return np.full(len(x), self.share)
        x = x / self.scale
        density = [self.const[k] - 0.5 * (((x - self.mean[k]) @ self.root[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / TEMPERATURE, -500, 500)))


def fit(found: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """From all rows of `labels` (doc_id, `label`) that aren't held out; `found`: of document_statistics."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))
    names = _columns()
    products = [F.sum(F.col(names[i]) * F.col(names[j])) for i in range(STATISTICS) for j in range(i, STATISTICS)]
    rows = found.join(known, "doc_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in names]).alias("total"), F.array(*products).alias("square")).collect()  # two rows
    count, total, square = np.zeros(2), np.zeros((2, STATISTICS)), np.zeros((2, STATISTICS, STATISTICS))
    at = np.triu_indices(STATISTICS)
    for r in rows:
        count[r.label], total[r.label] = r.n, r.total
        square[r.label][at] = r.square
        square[r.label].T[at] = r.square
    return Discriminant(count, total, square)


def score(found: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score of the rows of document_statistics."""
    shared = found.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([batch.column(c).to_numpy() for c in _columns()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.probability(x))], ["doc_id", "score"])

    return found.mapInArrow(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs`."""
    found = written(document_statistics(docs))
    scored = score(found, fit(found, labels, label))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
