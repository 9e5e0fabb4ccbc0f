import re
from itertools import permutations

import pytest
from lumenfold.llm import audit
from pyspark.sql import types as T

LABELS = "doc_id long, quality int, toxic int"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(rows, labels):
    """Each document through each order, one after the other."""
    smallest = {}
    for r in rows:
        if r.doc_id is not None:
            smallest[r.text or ""] = min(r.doc_id, smallest.get(r.text or "", r.doc_id))
    good, toxic = ({x.doc_id for x in labels if x.doc_id is not None and x[k] == 1} for k in (1, 2))
    judged = []
    for r in rows:
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "".join(f for f, x in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text)), r.doc_id is not None and r.doc_id > smallest[text]), strict=True) if x)
        judged.append((r.source or "", fails, r.doc_id in good, r.doc_id in toxic))
    out = {}
    for part in {x[0] for x in judged}:
        shapley = dict.fromkeys("ABCDE", 0)
        for p in permutations("ABCDE"):
            left = [x for x in judged if x[0] == part]
            for k, f in enumerate(p):
                gone = [x for x in left if f in x[1]]
                before = [x for x in judged if x[0] == part and f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                out[part, "".join(p), k + 1] = (len(left), len(gone), len(before) - len(gone), sum(x[1] == f for x in before), sum(x[2] for x in gone), sum(x[3] for x in gone))
        for p in permutations("ABCDE"):
            for k, f in enumerate(p):
                out[part, "".join(p), k + 1] += (shapley[f],)
    return sorted((*k, *v) for k, v in out.items())


def found(docs, labels):
    return sorted(map(tuple, audit.audit(docs, labels).select(COLUMNS).collect()))


def test_documents(docs, labels):
    assert found(docs, labels) == plain(docs.collect(), labels.collect())


def test_odd_rows(spark, odd, empty):
    said = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (6, 1, None), (7, None, 1), (8, 0, 1), (None, 1, 1)], LABELS)
    assert found(odd, said) == plain(odd.collect(), said.collect())
    assert found(empty, said) == []
    assert found(odd, said.where("false")) == plain(odd.collect(), [])


def test_copies_under_one_id_and_in_many_sources(spark):
    rows = [(5, "a b c", "x"), (5, "a b c", "y"), (5, "a b c", "x"), (9, "a b c", "y"), (None, "a b c", "y"), (2, "", None), (3, None, ""), (4, "UP $", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    said = spark.createDataFrame([(9, 1, 1)], LABELS)
    assert found(df, said) == plain(df.collect(), said.collect())
    assert len(found(df, said)) == 3 * 600


def test_lattice():
    assert len(audit.edges()) == 80 and len(set(audit.edges())) == 80
    assert len(audit.steps()) == 600 and {(s, f) for _, _, s, f in audit.steps()} == set(audit.edges())


def test_text_ids_are_refused(spark, labels):
    with pytest.raises(TypeError, match="doc_id must be a whole number"):
        audit.audit(spark.createDataFrame([("a", "b", "c")], T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "text", "source")])), labels)
