import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from lumenfold.llm import packing
from tokenizers import Tokenizer


def check(rows, texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((str(i), np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, x in texts)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[str(r.doc_id), r.doc_tokens].append((r.start, bytes(r.ids)))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert sum(map(len, (x for _, x in want))) == sum(len(r.ids) for r in rows)
    count = defaultdict(int)
    for i, x in want:
        count[i, len(x) // 4] += 1
    for (i, n), pieces in by_doc.items():
        at = defaultdict(int)
        for start, ids in pieces:
            at[start] += len(ids) // 4
        assert sum(at.values()) == n * count[i, n]
        if count[i, n] == 1:
            assert (i, b"".join(x for _, x in sorted(pieces))) in want
    padding = 0
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert 0 < end <= 4096
        padding += 0 if end & (end - 1) == 0 else 4096 - end
    return padding


def test_documents(docs):
    rows = packing.pack(docs).collect()
    assert check(rows, [(r.doc_id, r.text) for r in docs.collect()]) == 0


def test_crc(docs):
    from pyspark.sql import functions as F

    for r in packing.pack(docs).select("ids", F.crc32("ids").alias("crc")).collect():
        assert zlib.crc32(bytes(r.ids)) == r.crc


def test_odd_rows(odd, empty):
    assert check(packing.pack(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()]) == 0
    assert packing.pack(empty).count() == 0


def test_special_tokens_and_random_words(spark, monkeypatch):
    r = random.Random(4)
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "<", "<|", "Don't", "it's", "a", "Word", "caf\u00e9", "\u00c5", "12", ".", " ", " ", "\n", "\u00a0", "x" * 70, "\u0130"]
    texts = [(k, "".join(r.choices(pieces, k=r.choice([1, 2, 5, 30])))) for k in range(600)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert check(packing.pack(df).collect(), texts) == 0


def test_words_that_go_from_the_cache(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    t, r = Tokenizer.from_file(path), random.Random(9)
    monkeypatch.setattr(packing, "CACHED_WORDS", 50)
    ids = packing.WordIds(path)
    for _ in range(30):
        texts = [" ".join("".join(r.choices("abcde", k=r.choice([1, 2, 3, 90]))) for _ in range(r.choice([0, 3, 20]))) for _ in range(4)]
        assert [x.tolist() for x in ids(pa.array(texts))] == [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert len(ids.hashes) <= 80 and sorted(ids.hashes.tolist()) == ids.hashes.tolist()


@pytest.mark.parametrize("seed", range(20))
def test_fill_is_closest(seed):
    r = random.Random(seed)
    lengths = sorted(r.sample(range(1, 40), 5), reverse=True)
    counts = [r.randint(1, 3) for _ in lengths]
    capacity = r.randint(1, 120)
    sums = {sum(n * k for n, k in zip(lengths, take, strict=True)) for take in itertools.product(*[range(c + 1) for c in counts])}
    taken = packing.fill(lengths, counts, capacity)
    assert sum(n * k for n, k in taken.items()) == max(x for x in sums if x <= capacity)
    assert all(k <= counts[lengths.index(n)] for n, k in taken.items())
