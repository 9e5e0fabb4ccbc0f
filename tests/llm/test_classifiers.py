import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from lumenfold.llm import quality, toxicity
from lumenfold.llm.words import split_words


def accuracy(found, labels, column):
    rows = {r.doc_id: r for r in found.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in rows.items())
    known = [(rows[x.doc_id].predicted, x[column]) for x in labels.collect() if x.doc_id in rows and rows[x.doc_id].held_out]
    return sum(a == b for a, b in known) / len(known)


@pytest.fixture(scope="module")
def more(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_toxicity_held_out(more, labels):
    assert accuracy(toxicity.classify(more, labels), labels, "toxic") >= 0.95


def test_quality_held_out(more, labels):
    assert accuracy(quality.classify(more, labels), labels, "quality") >= 0.97


@pytest.mark.parametrize("classify", [toxicity.classify, quality.classify])
def test_odd_rows(classify, spark, odd, empty, labels):
    found = classify(odd, labels)
    assert found.count() == odd.count() and all(0 <= r.score <= 1 for r in found.collect())
    assert classify(empty, labels).count() == 0
    none = labels.limit(0)
    assert all(r.score == 0 and r.predicted == 0 for r in classify(odd, none).collect())
    nulls = spark.createDataFrame([(None, 1, 1), (4, None, None), (5, 0, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    assert classify(odd, nulls).count() == odd.count()


@pytest.mark.parametrize("classify", [toxicity.classify, quality.classify])
def test_held_out_labels_do_not_matter(classify, spark, docs, labels):
    from pyspark.sql import functions as F

    turned = labels.withColumns({c: F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    assert sorted(classify(docs, labels).collect()) == sorted(classify(docs, turned).collect())


def test_weights_are_sparse(more, labels):
    assert len(toxicity.fit(more, labels)) < 5000


def test_recurrence_counts_against_a_plain_count():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 60, n)) for n in (0, 1, 2, 7, 90, 700)] + ["again " * 50]
    words = split_words(pa.array(texts), lower=True)
    doc, slots = toxicity.features(words)
    sizes = [len(x.split()) for x in texts]
    expected = set()
    for d in range(len(texts)):
        for slot, times in Counter(slots[doc == d].tolist()).items():
            expected.add((d, slot))
            expected |= {(d, int(toxicity.recurring(np.array([slot]), r)[0])) for r in toxicity.RATES if times >= 2 and times * r >= sizes[d]}
    found = list(zip(*(x.tolist() for x in toxicity.by_text(doc, slots, np.array(sizes))), strict=True))
    assert len(found) == len(set(found)) and set(found) == expected
    assert toxicity.by_text(doc[:0], slots[:0], np.zeros(0))[0].size == 0


def plain_ftrl(rows, labels):
    """FTRL-proximal with dictionaries, one weight at a time."""
    z, n = {}, {}
    z0 = n0 = 0.0
    rate = lambda x: (toxicity.BETA + x**0.5) / toxicity.ALPHA + toxicity.L2
    sign = lambda x: (x > 0) - (x < 0)
    weight = lambda k: 0.0 if abs(z.get(k, 0.0)) <= toxicity.L1 else -(z[k] - sign(z[k]) * toxicity.L1) / rate(n[k])
    for _ in range(toxicity.EPOCHS):
        for slots, y in zip(rows, labels, strict=True):
            w, w0 = {k: weight(k) for k in slots}, -z0 / rate(n0)
            g = 1 / (1 + math.exp(-(sum(w.values()) + w0))) - y
            for k in slots:
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / toxicity.ALPHA * w[k]
                n[k] = old + g * g
            z0 += g - ((n0 + g * g) ** 0.5 - n0**0.5) / toxicity.ALPHA * w0
            n0 += g * g
    return {k: weight(k) for k in z if weight(k)} | {toxicity.SLOTS: -z0 / rate(n0)}


def test_ftrl_against_dictionaries(monkeypatch):
    monkeypatch.setattr(toxicity, "L1", 0.5)
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 40, rng.integers(0, 12))) for _ in range(60)]
    labels = np.array([float((x < 9).sum() >= 2) for x in rows])
    slots, weights = toxicity.ftrl(rows, labels)
    want = plain_ftrl([x.tolist() for x in rows], labels.tolist())
    assert set(slots.tolist()) == set(want) and len(want) > 5
    assert all(abs(want[k] - w) < 1e-9 for k, w in zip(slots.tolist(), weights, strict=True))


def test_fit_and_score_against_plain(spark, docs, labels):
    """The whole way on the small table: sample, order, weights and scores."""
    model = toxicity.fit(docs, labels)
    known = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    from pyspark.sql import functions as F

    ranked = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("rank")).orderBy("rank").collect()
    slots = {}
    for r in ranked:
        words = split_words(pa.array([r.text]), lower=True)
        slots[r.doc_id] = toxicity.by_text(*toxicity.features(words), np.diff(words.first))[1]
    train = [r.doc_id for r in ranked if r.doc_id in known]
    at, weights = toxicity.ftrl([slots[i] for i in train], np.array([float(known[i]) for i in train]))
    assert {k: pytest.approx(w) for k, w in zip(at.tolist(), weights.tolist(), strict=True)} == model
    for r in toxicity.score(docs, model).collect():
        total = model[toxicity.SLOTS] + sum(model.get(k, 0.0) for k in slots[r.doc_id].tolist())
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-9


def test_sample_is_bounded_and_takes_one_row_an_id(spark):
    rows = spark.createDataFrame([(k % 50, f"text {k % 50} word{k}") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, toxic int")
    seen = []
    original, toxicity._train = toxicity._train, lambda table: pa.table({"slot": pa.array([table.num_rows], pa.int64()), "weight": pa.array([1.0])})
    try:
        for most in ({}, {"max_docs": 10}, {"max_slots": 40}):
            seen.append(next(iter(toxicity.fit(rows, labels, **most))))
    finally:
        toxicity._train = original
    learned = sum(1 for k in range(50) if zlib.crc32(str(k).encode()) % 5)
    assert seen[0] == learned and seen[1] < learned and seen[2] < learned


def test_discriminant_against_plain_densities():
    rng = np.random.default_rng(8)
    x = [rng.normal(m, s, (n, 3)) @ rng.normal(0, 1, (3, 3)) for m, s, n in ((0, 1, 40), (1, 2, 25))]
    model = quality.Discriminant(np.array([len(k) for k in x], float), np.array([k.sum(0) for k in x]), np.array([k.T @ k for k in x]))
    every = np.concatenate(x)
    within = [np.cov(k.T, bias=True) for k in x]
    pooled = sum(len(k) * c for k, c in zip(x, within, strict=True)) / len(every)
    scale = np.sqrt(np.diag(pooled))
    density = []
    for k, c in zip(x, within, strict=True):
        cov = ((1 - quality.TO_POOLED) * c + quality.TO_POOLED * pooled) / np.outer(scale, scale)
        cov = (1 - quality.TO_IDENTITY) * cov + quality.TO_IDENTITY * np.trace(cov) / 3 * np.eye(3)
        away = (every - k.mean(0)) / scale
        density.append(math.log(len(k) / len(every)) - 0.5 * math.log(np.linalg.det(cov)) - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away))
    want = 1 / (1 + np.exp(-(density[1] - density[0]) / quality.TEMPERATURE))
    assert np.allclose(model.probability(every), want, atol=1e-9)
