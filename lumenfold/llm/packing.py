"""Packing: token sequences of a fixed window, filled by minimum bin slack.

Every partition is packed by its own task, in one pass and without a shuffle. Documents are tokenized and
cut into whole windows; the remainders wait in a bounded pool of lengths. A window takes the longest
remainder, then a bitset subset-sum over the pool's lengths and their counts finds the multiset that fills
the rest closest to capacity, and the counts are read back from the stored bitsets. What slack is left is
filled by cutting one remainder; the last, partial windows of a partition are cut at powers of two, which
need no padding. A task holds POOL remainders at most (16 KB each), whatever the input.

Each different word is encoded once: its ids stand in arrays, found by the word's 64-bit hash, of at most
CACHED_WORDS words of at most CACHED_IDS ids, about 40 bytes each; longer words are encoded wherever they stand.

The result depends on how the input is dealt to partitions, so give it a table that was read (as
`pack` is here), or one written before, so that a lost task is repeated on the same rows.

Cases: a null or empty text is the end token alone; repeated rows are packed once each; texts of any
length are packed whole; a text that spells a special token of the tokenizer has that token's id there, as
the tokenizer gives it; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lumenfold.llm.words import chunks, split_words

WINDOW, POOL = 4096, 2048
TOKENIZER, END_ID = "word_bpe_49k.json", 2
#: Most words whose ids a worker keeps, and most ids of one of them (about 40 bytes a word, 45 MB in all).
CACHED_WORDS, CACHED_IDS = 1_000_000, 32

_LETTERS_THEN_MARK = re.compile(rb"([a-z\x80-\xff]*[a-z])([!-/:-@\[-`{-~].*)", re.DOTALL)
#: What special tokens begin with; only texts without it are lower-cased before the tokenizer does it.
_SPECIAL = b"<|"


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indexes first, first + 1, ... of each of the counts, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


class WordIds:
    """Ids of texts by a tokenizer that drops white space, lower-cases and never joins words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.hashes, self.used = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.first, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids; words of letters go to the tokenizer together."""
        parts, letters, others = [], set(), set()
        for word in words:
            if word.isalpha():  # ASCII letters
                letters.add(word)
                parts.append((word,))
            elif _SPECIAL not in word and (cut := _LETTERS_THEN_MARK.match(word)):  # the tokenizer starts anew where a mark follows a letter
                parts.append(cut.groups())
                others.update(cut.groups())
            else:
                parts.append((word,))
                others.add(word)
        rest = [x.decode() for x in others - letters]
        some = [x.decode() for x in letters] + [x for x in rest if x.isalpha()]
        known: dict[bytes, bytes] = {}
        for at in range(0, len(some), 1000):
            part = some[at : at + 1000]
            known.update(zip([x.encode() for x in part], self._joined(part), strict=True))
        rest = [x for x in rest if not x.isalpha()]
        known.update(zip([x.encode() for x in rest], self._each(rest), strict=True))
        return [b"".join([known[x] for x in p]) for p in parts]

    def _each(self, words: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[bytes]:
        """Words of letters in one call: each has one id that ends a word."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return self._each(words)
        raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[i:j] for i, j in zip(at, at[1:], strict=False)]

    def _keep(self, hashes: np.ndarray, first: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Add words; beyond CACHED_WORDS, those go that weren't met since the last time."""
        short = count <= CACHED_IDS
        hashes, first, count = hashes[short], first[short], count[short]
        stays = np.ones(len(self.hashes), bool)
        if len(self.hashes) + len(hashes) > CACHED_WORDS:
            stays = self.used if 2 * np.count_nonzero(self.used) <= CACHED_WORDS else ~stays
            self.used = np.zeros(len(self.hashes), bool)
        every = np.concatenate([self.hashes[stays], hashes])
        order = np.argsort(every, kind="stable")
        counts = np.concatenate([self.count[stays], count])
        if not stays.all():
            self.ids = self.ids[_spread(self.first[stays], self.count[stays])]
            old = np.cumsum(self.count[stays]) - self.count[stays]
        else:
            old = self.first
        own = ids[_spread(first, count)]
        new = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, own])
        self.hashes, self.count = every[order], counts[order]
        self.first = np.concatenate([old, new])[order]
        self.used = np.concatenate([self.used[stays], np.ones(len(hashes), bool)])[order]

    def _of_different(self, hashes: np.ndarray, spelled) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First, count and ids of ascending different hashes; spelled: the words at some of their indexes."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        self.used[at[known]] = True
        unknown = np.flatnonzero(~known)
        count = np.zeros(len(hashes), np.int64)
        first = np.zeros(len(hashes), np.int64)
        count[known], first[known] = self.count[at[known]], self.first[at[known]]
        ids = self.ids
        if len(unknown):
            fresh = self._encoded(spelled(unknown))
            count[unknown] = [len(x) // 4 for x in fresh]
            new = np.cumsum(count[unknown]) - count[unknown]
            learned = np.frombuffer(b"".join(fresh), "<u4")
            first[unknown] = len(ids) + new
            ids = np.concatenate([ids, learned])
            self._keep(hashes[unknown], new, count[unknown], learned)
        return first, count, ids

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        words = split_words(texts, lower=True)  # a tokenizer that lower-cases gives both the same ids
        if _SPECIAL in words.data.tobytes():
            words = split_words(texts)
        hashes, at, own = np.unique(words.hashes(), return_index=True, return_inverse=True)
        raw = words.data.tobytes()
        spelled = lambda some: [raw[words.start[k] : words.start[k] + words.length[k]] for k in at[some]]
        first, count, ids = self._of_different(hashes, spelled)
        for low in range(0, words.texts, 64):
            some = own[words.first[low] : words.first[min(low + 64, words.texts)]]
            counts = count[some]
            out = ids[_spread(first[some], counts)]
            ends = np.concatenate([[0], np.cumsum(counts)])[words.first[low : low + 65] - words.first[low]]
            for i, j in zip(ends, ends[1:], strict=False):
                yield out[i:j]


_tokenizers: dict[str, WordIds] = {}


def tokenizer_of(path: str | None) -> WordIds:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def fill(lengths: list[int], counts: list[int], capacity: int) -> dict[int, int]:
    """How many of each length come closest to `capacity` without passing it.

    reach holds a bit for each sum that some multiset has; a length with a count is offered in lots of 1, 2,
    4, ... so that lots make up any number of it. The bitsets before each lot are kept to read the lots back.
    """
    mask, reach, lots, before = (1 << (capacity + 1)) - 1, 1, [], []
    for length, count in zip(lengths, counts, strict=True):
        if length > capacity:
            continue
        lot = 1
        while count > 0 and lot * length <= capacity:
            take = min(lot, count)
            before.append(reach)
            lots.append((length, take))
            reach |= (reach << (take * length)) & mask
            count -= take
            lot *= 2
        if reach >> capacity:
            break
    left, taken = reach.bit_length() - 1, {}
    for (length, take), old in zip(reversed(lots), reversed(before), strict=True):
        if not old >> left & 1:
            taken[length] = taken.get(length, 0) + take
            left -= take * length
    return taken


class Packer:
    """Turns documents' ids into (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, window: int = WINDOW, pool: int = POOL):
        self.window, self.most = window, pool
        self.waiting: dict[int, list[tuple]] = {}
        self.held = self.tokens = self.sequence = 0

    def add(self, doc_id: object, ids: bytes) -> Iterator[tuple]:
        n, w = len(ids) // 4, self.window
        for start in range(0, n - n % w, w):
            yield doc_id, start, ids[4 * start : 4 * (start + w)], n, self.sequence, 0
            self.sequence += 1
        if n % w:
            self._wait((doc_id, n - n % w, ids[4 * (n - n % w) :], n))
        if self.held > self.most:
            while self.held > self.most // 2:
                yield from self._window()

    def finish(self) -> Iterator[tuple]:
        while self.tokens >= self.window:
            yield from self._window()
        while self.tokens:
            yield from self._place(self._take(1 << (self.tokens.bit_length() - 1)))

    def _wait(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        self.waiting.setdefault(n, []).append(piece)
        self.held, self.tokens = self.held + 1, self.tokens + n

    def _next(self, n: int) -> tuple:
        piece = self.waiting[n].pop()
        if not self.waiting[n]:
            del self.waiting[n]
        self.held, self.tokens = self.held - 1, self.tokens - n
        return piece

    def _take(self, room: int) -> list[tuple]:
        """Pieces of `room` ids together; the last is cut if none fits."""
        pieces = []
        while room:
            n = max((x for x in self.waiting if x <= room), default=0) or min(self.waiting)
            doc_id, start, ids, total = self._next(n)
            pieces.append((doc_id, start, ids[: 4 * room], total))
            if n > room:
                self._wait((doc_id, start + room, ids[4 * room :], total))
            room -= min(n, room)
        return pieces

    def _window(self) -> Iterator[tuple]:
        first = max(self.waiting)
        pieces = [self._next(first)]
        room = self.window - first
        lengths = sorted((x for x in self.waiting if x <= room), reverse=True)
        for length, count in fill(lengths, [len(self.waiting[x]) for x in lengths], room).items() if lengths else ():
            pieces += [self._next(length) for _ in range(count)]
            room -= length * count
        if self.tokens >= room:
            pieces += self._take(room)
        yield from self._place(pieces)

    def _place(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, ids, total, self.sequence, offset
            offset += len(ids) // 4
        self.sequence += 1


def pack(docs: DataFrame, window: int = WINDOW, tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of a document in a sequence.

    doc_id; start, length: the piece's place among the document's doc_tokens ids; sequence_id; offset: its
    place in the sequence, without gaps; ids: the piece's ids, as little-endian unsigned 32-bit numbers.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = tokenizer_of(tokenizer_path), Packer(window)
        base, end = TaskContext.get().partitionId() << 36, np.array([end_id], "<u4").tobytes()
        id_type = None

        def rows(found: list[tuple]) -> pa.RecordBatch:
            doc_id, start, ids, total, sequence, offset = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(doc_id, id_type), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(total, pa.int64()), pa.array([base + x for x in sequence], pa.int64()), pa.array(offset, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        for batch in chunks(batches, "text"):
            id_type = batch.schema.field("doc_id").type
            found = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokenizer(batch.column("text")), strict=True):
                found += packer.add(doc_id, ids.tobytes() + end)
            if found:
                yield rows(found)
        if found := list(packer.finish()):
            yield rows(found)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
