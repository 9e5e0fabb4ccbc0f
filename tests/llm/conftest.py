import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Nulls in every column, empty and blank texts, repeated rows and ids, ties, long texts, odd signs.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\r\n\x0b\x0c", "en", "a", 6),
    (4, "word", "en", None, 4),
    (5, "two words", "en", "b", 9),
    (6, "the same text of some words here\nand a second line", "en", "b", 1),
    (6, "the same text of some words here\nand a second line", "en", "b", 1),
    (6, "another text under the same id", "en", "c", 1),
    (7, "The SAME text of some words here\nand a second line", "en", "d", 1),
    (8, "long " * 30000 + "x" * 20000, "en", "c", 1),
    (9, "a\u00a0b \U0001f600 caf\u00e9 \u1e9e <|endoftext|> don't 12,5 \x00 end", "fr", "d", 1),
    (None, "a text without an id", "en", "d", 1),
    (11, "x y z " * 200, "en", "a", 1),
    (12, "x y z " * 200, "en", "b", 1),
]

#: Names inside the operators, and names of their results.
CLASHES = ["node", "size", "score", "line", "range", "gone", "label", "target", "n_lines", "n_removed", "spans_email", "spans", "n_email", "fingerprint", "component_id", "cluster", "taken", "start", "length", "offset", "rank", "held_out", "predicted", "n_near", "_row"]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with extra columns whose names clash with names inside the operators."""
    schema = T.StructType(SCHEMA.fields + [T.StructField(c, T.StringType()) for c in CLASHES])
    return spark.createDataFrame([(*r, *["?"] * len(CLASHES)) for r in ODD], schema)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
