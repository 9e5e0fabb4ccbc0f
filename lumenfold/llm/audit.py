"""Filter interaction audit: what each of five filters removes after every other set of them.

The filters applied so far (a subset of the five) and the next one make an edge of the lattice of subsets, 80 in all. Of a document only
the set of filters that it fails matters, so documents are first counted by source and failure set (32 at most); each count then
contributes to the 80 edges: kept, removed, redundant and the like. An order of the filters is a path through the lattice, so its
five steps are five edges: the aggregated edges are joined to the 600 steps of the 120 orders. Shapley sums take each edge as
often as paths go through it.

All counts are combined before a shuffle, so a source or a text that a third of all rows have costs a row a task. Whether a
text stands under a smaller id is found by the smallest id of each text and a join by id and text, in which copies don't meet.

Cases: a null text is the empty text, a null source the part with the empty name; rows that repeat are each counted; a document is
good (toxic) if any label row of its doc_id says so; a null doc_id has no label, is no smaller id and has none below it, so it
doesn't fail E; extra columns are ignored; without documents there is no row. Texts of any length are read whole. doc_id must be a whole
number.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.mixing import WORD
from lumenfold.llm.scratch import whole_numbers, written

FILTERS = "ABCDE"
#: Limits of the filters: words, per cent of distinct words, per cent of capitals, and signs.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 2, "[#$%&*|]"

_BIT = {f: 1 << k for k, f in enumerate(FILTERS)}
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _bits(filters: str) -> int:
    return sum(_BIT[f] for f in filters)


def _failed(conditions: dict[str, Column]) -> Column:
    """The failed filters as bits."""
    return sum((F.when(failed, _BIT[f]).otherwise(0) for f, failed in conditions.items()), F.lit(0))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, h1 and h2 (the text) and failed (of A to D), with n, the number of such rows."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    words, distinct = F.size("words"), F.size(F.array_distinct("words"))
    failed = _failed(
        {
            "A": words < LEAST_WORDS,
            "B": 100 * distinct.cast("long") < LEAST_DISTINCT * words.cast("long"),
            "C": 100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.length("text").cast("long"),
            "D": F.col("text").rlike(SIGNS),
        }
    )
    keys = ["doc_id", "part", "h1", "h2", "failed"]
    return rows.select("doc_id", "part", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), failed.alias("failed")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    known = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("good"), "toxic").groupBy("doc_id").agg(said("good"), said("toxic"))
    return rows.join(known, "doc_id", "left").fillna(0, ["good", "toxic"])


def failure_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part and failed (of A to E), with n, good and toxic: the rows of a source that fail exactly these filters."""
    rows = written(_labelled(judged(docs), labels))
    first = rows.where("doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = rows.join(first, ["doc_id", "h1", "h2"], "left")
    failed = F.col("failed") + F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), _BIT["E"]).otherwise(0)
    return marked.groupBy("part", failed.alias("failed")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def edges() -> list[tuple[int, int]]:
    """Each set of filters that may have been applied, and each next filter, as bits."""
    sets = [_bits("".join(s)) for size in range(len(FILTERS)) for s in combinations(FILTERS, size)]
    return [(s, f) for s in sets for f in _BIT.values() if not s & f]


def steps() -> list[tuple[str, int, int, int]]:
    """Order, number, filters applied before and the filter of each step of all orders."""
    return [("".join(p), k + 1, _bits("".join(p[:k])), _BIT[p[k]]) for p in permutations(FILTERS) for k in range(len(p))]


def on_edges(sets: DataFrame) -> DataFrame:
    """part, applied and filter with the counts of each of the 80 edges of each part."""
    every = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter")) for s, f in edges()])
    rows = sets.select("part", "failed", "n", "good", "toxic", F.inline(every))
    fails = F.col("failed").bitwiseAND(F.col("filter")) > 0
    reached = F.col("failed").bitwiseAND(F.col("applied")) == 0
    of = lambda which, c: F.sum(F.when(which, F.col(c)).otherwise(0)).alias
    return rows.groupBy("part", "applied", "filter").agg(
        of(reached & ~fails, "n")("kept"),
        of(reached & fails, "n")("removed"),
        of(~reached & fails, "n")("redundant"),
        of(F.col("failed") == F.col("filter"), "n")("unique_fails"),
        of(reached & fails, "good")("good_lost"),
        of(reached & fails, "toxic")("toxic_lost"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, and the counts of the step's filter, of every part, order and step."""
    whole_numbers(docs, labels)
    spark = docs.sparkSession
    found = written(on_edges(failure_sets(docs, labels)))
    paths = F.broadcast(spark.createDataFrame(steps(), "filter_order string, step int, applied int, filter int"))  # 600 rows
    through = F.broadcast(paths.groupBy("applied", "filter").agg(F.count(F.lit(1)).alias("paths")))  # 80 rows
    shapley = found.join(through, ["applied", "filter"]).groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("paths")).alias("shapley"))
    return found.join(shapley, ["part", "filter"]).join(paths, ["applied", "filter"]).select("part", "filter_order", "step", *_COUNTS, "shapley")
