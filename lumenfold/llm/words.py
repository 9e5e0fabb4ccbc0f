"""Words and their hashes for whole Arrow batches at once.

A word is a maximal run of bytes other than space and 0x09-0x0D. The bytes of many texts are handled as
one array: a running sum of (random number of the byte) * P**position gives every word's, or word
prefix's, 64-bit polynomial hash by one subtraction; no Python code runs per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once; a longer single text is handled alone. Positions count anew in every such block.
CHUNK_BYTES = 1 << 20

_P = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """Powers of P and of its inverse, for the positions of one block."""
    if not _powers:
        steps = np.full((2, CHUNK_BYTES), 1, np.uint64)
        steps[0, 1:], steps[1, 1:] = np.uint64(_P), np.uint64(pow(_P, -1, 1 << 64))
        _powers[:] = [np.multiply.accumulate(x, dtype=np.uint64) for x in steps]
    return _powers


def release() -> None:
    """Give memory that is free back to the system, since a Python worker outlives its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values, ascending."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


@dataclass
class Words:
    """The words of some texts. doc: index of the word's text in the batch; first: each text's first word."""

    data: np.ndarray  # the bytes, lower case where asked for
    offsets: np.ndarray  # of the texts in data, one more than texts
    start: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # one more than texts
    _sums: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its first `prefix` bytes."""
        end = self.start + (self.length if prefix is None else np.minimum(self.length, prefix))
        at = self.start % CHUNK_BYTES if len(self.data) > CHUNK_BYTES else self.start
        below = np.where(at > 0, self._sums[self.start - 1], np.uint64(0))
        out = (self._sums[end - 1] - below) * _power_tables()[1][at]
        if len(self.data) > CHUNK_BYTES:
            for k in np.flatnonzero(self.start // CHUNK_BYTES != (end - 1) // CHUNK_BYTES):
                out[k] = self._across(int(self.start[k]), int(end[k]))
        return mix(out)

    def _across(self, start: int, end: int) -> int:
        """The sum of a word that goes over the end of a block."""
        total = 0
        for low in range(start - start % CHUNK_BYTES, end, CHUNK_BYTES):
            part = int(self._sums[min(low + CHUNK_BYTES, end) - 1])
            if low <= start:
                part -= int(self._sums[start - 1]) if start > low else 0
            total += part * pow(_P, low - start, 1 << 64)
        return total % (1 << 64)

    def pairs(self, hashes: np.ndarray, gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word with the word `gap` further on in the same text, and the index of the first."""
        if len(hashes) <= gap:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:-gap] == self.doc[gap:])
        return mix(hashes[at] * np.uint64(3 * gap + 2) + mix(hashes[at + gap] + np.uint64(gap))), at

    def shingles(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of each run of `n` words; a text of 1 to n - 1 words gives its whole sequence once."""
        count = np.diff(self.first)
        short = np.flatnonzero((count > 0) & (count < n))
        out, doc = [], []
        if len(hashes) >= n:
            at = np.flatnonzero(self.doc[: len(hashes) - n + 1] == self.doc[n - 1 :])
            h = np.zeros(len(at), np.uint64)
            for k in range(n):
                h = mix(h * np.uint64(5) + hashes[at + k] + np.uint64(k + 1))
            out.append(h)
            doc.append(self.doc[at])
        for d in short:
            h = np.full(1, count[d], np.uint64)
            for x in hashes[self.first[d] : self.first[d + 1]]:
                h = mix(h * np.uint64(7) + x + np.uint64(99))
            out.append(h)
            doc.append(np.array([d]))
        return (np.concatenate(out), np.concatenate(doc)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """The words of an Arrow array of strings; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, none, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = ~word[:-1], ~word[1:]
    start = np.flatnonzero(word & (before | edge[:-1]))
    end = np.flatnonzero(word & (after | edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    sums = np.empty(n, np.uint64)
    for low in range(0, n, CHUNK_BYTES):
        part = data[low : low + CHUNK_BYTES]
        np.cumsum(_BYTES[part] * _power_tables()[0][: len(part)], out=sums[low : low + len(part)])
    return Words(data, offsets, start, end - start, doc, first, sums)


def chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches, cut between rows so that `column` holds about CHUNK_BYTES in each; in the end memory is given back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK_BYTES, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()
