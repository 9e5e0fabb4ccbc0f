"""A training corpus from raw documents: five stages, each over all that the one before kept.

toxicity: documents that the classifier rejects go. line_dedup: lines on many sites stay once; documents
that lose all their lines go. near_duplicates: of each group of near copies the smallest doc_id stays.
mixing: each source's words come to its target. packing: token sequences.

Cases, for all stages: columns beyond those of documents are kept by all but packing, whatever their names; an empty table gives an
empty result; texts of any length are read whole. toxicity: a null or empty text gets the score of the
intercept, rows that repeat an id go or stay together, rows without an id stay. line_dedup: a null or empty text stays; ties
of equal lines go to the smallest doc_id. near_duplicates: texts without words and rows without an id stay, of
rows that repeat an id one stays. mixing: a text without words is not taken, rows equal in id and text share
what is left over. packing: a null or empty text is the end token alone, rows that repeat are packed each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import jaccard, lines, mixing, packing, toxicity
from lumenfold.llm.scratch import written
from lumenfold.sources import table


def _as_documents(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars (if there) counted anew."""
    return df.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below one half. A row goes with its doc_id; rows with a null doc_id are kept."""
    toxic = toxicity.classify(docs, table(spark, sf_dir, "labels")).where("predicted = 1 and doc_id is not null").select("doc_id").distinct()
    toxic = written(toxic)
    small = toxic.count() <= jaccard.BROADCAST_IDS  # 8 bytes a row
    return docs.join(F.broadcast(toxic) if small else toxic, "doc_id", "left_anti").select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites carry; those of which no line is left go, others stay."""
    return _as_documents(lines.without_boilerplate(docs), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that shares four fifths of its shingles of five words, one document; repeated rows of its id once."""
    found = jaccard.near_duplicates(docs)
    others = written(found.where("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct())
    small = others.count() <= jaccard.BROADCAST_IDS
    kept = docs.join(F.broadcast(others) if small else others, "doc_id", "left_anti").select(docs.columns)
    again = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select("doc_id")
    again = written(again)
    if again.isEmpty():
        return kept
    twice = kept.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(twice)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target asks for."""
    return _as_documents(mixing.mixed(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack_sequences)]

#: No SQL expresses the trained classifier and the tokenizer; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
