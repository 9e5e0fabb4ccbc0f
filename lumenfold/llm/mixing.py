"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each source's target is its share, by weight, of all words; a target stops at MAX_EPOCHS times the
source's size and the excess is shared again by weight. Of a source, whole epochs come first; the rest of
the target is a weighted sample without replacement: a document with quality w and a uniform number u
from a hash of its id has the key -ln(u) / w, and the smallest keys are taken until the prefix sum of
their sizes reaches the budget; the document on the boundary gives the words that are left.

A source is never sorted as a whole: its keys are counted in BINS bins between the smallest and the largest, the bins' words are
added up, and the bin in which the budget ends is counted in bins again, until it holds RANGE_ROWS rows or keys that are all
equal; only that is sorted. So a hot source costs no long task, however its qualities are spread; a round reads the slim rows once,
and there are about log(rows) / log(BINS) of them. What is then joined to the rows is one row a source: its epochs and the key at which the sample ends.

Cases: a null or empty text has size 0 and takes 0; sources are ordered by code point, null last; rows
that are equal in doc_id and text share what the boundary leaves equally; a null doc_id counts as an empty id;
extra columns are passed through; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.scratch import forget, written

WEIGHTS, MAX_EPOCHS, RANGE_ROWS, BINS = (5, 2, 1), 3, 4096, 4096
#: Sources up to which one row each is broadcast (about 100 MB).
BROADCAST_SOURCES = 500_000

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column) -> Column:
    """Share of letters among the characters, from 0 (exclusive) to 1."""
    text = F.coalesce(text, F.lit(""))
    return (F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) + 1) / (F.length(text) + 1)


def key_of(doc_id: Column, quality: Column) -> Column:
    """Exponential key at the rate `quality`; the first 52 bits of the id's MD5 are the uniform number."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52)) / quality


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, key and tie of every row."""
    text = F.col("text")
    return docs.select("doc_id", "source", size_of(text).alias("size"), key_of(F.col("doc_id"), quality_of(text)).alias("key"), F.xxhash64("text").alias("tie"))


def targets(totals: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """totals: source, source_size and others, one row a source. Adds target.

    With the sources ordered by the multiple at which they are full, the level a source would get if all
    before it were full rises up to the right level and falls after it: the right level is the largest.
    """
    by_name, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    ordered = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, len(weights)).cast("int") + 1))
    ordered = ordered.withColumn("full", max_epochs * F.col("source_size").cast("double"))
    before = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = lambda c, of: F.sum(of).over(every) - F.coalesce(F.sum(c).over(before), F.lit(0.0))
    level = rest("full", F.col("source_size").cast("double")) / rest("weight", F.col("weight"))
    return ordered.withColumn("level", level).withColumn("target", F.least("full", F.max("level").over(every) * F.col("weight"))).drop("weight", "full", "level")


def _within(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """The rows with words whose keys lie between low and high of their source in `ends` (one row a source)."""
    few = ends.count() <= BROADCAST_SOURCES
    return rows.where("size > 0").join(F.broadcast(ends) if few else ends, F.col("source").eqNullSafe(F.col("e_source")) & F.col("key").between(F.col("low"), F.col("high")))


def _narrowed(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """`ends` with low and high of the bin in which the budget ends, base, the words before it, and n, its rows."""
    at = F.when(F.col("high") > F.col("low"), F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * BINS)).otherwise(0)
    binned = _within(rows, ends).withColumn("bin", F.least(at, F.lit(BINS - 1)))  # ascends with the key
    sums = binned.groupBy("e_source", "budget", "base", "bin").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    sums = sums.withColumn("upto", F.col("base") + F.sum("words").over(Window.partitionBy("e_source").orderBy("bin")))  # BINS rows a source
    last = sums.where("upto >= budget and upto - words < budget")
    return last.select("e_source", "budget", "low", "high", (F.col("upto") - F.col("words")).alias("base"), "n")


def ends(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """One row a source with a budget: low and high of the keys among which it ends, and base, the words before them."""
    found = written(goals.where("budget > 0").select(F.col("source").alias("e_source"), "budget", "low", "high", F.lit(0).cast("long").alias("base"), "n"))
    while not found.where((F.col("n") > RANGE_ROWS) & (F.col("high") > F.col("low"))).isEmpty():
        before, found = found, written(_narrowed(rows, found))
        forget(before)
    return found


def plan(rows: DataFrame) -> DataFrame:
    """One row a source: source_size, target, epochs, and where its sample ends (cut_key, cut_tie, cut_words)."""
    worded = F.when(F.col("size") > 0, F.col("key"))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(worded).alias("n"), F.min(worded).alias("low"), F.max(worded).alias("high"))
    words = F.floor(F.col("target") + 0.5)
    goals = targets(totals).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long"))
    goals = written(goals.withColumn("budget", (words - F.col("epochs") * F.col("source_size")).cast("long")))
    inner = _within(rows, ends(rows, goals)).groupBy("source", "budget", "base", "key", "tie").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("equal"))
    inner = inner.withColumn("upto", F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("key", "tie")))
    cuts = inner.where("upto >= budget and upto - words < budget").select(F.col("source").alias("c_source"), F.col("key").alias("cut_key"), F.col("tie").alias("cut_tie"), F.floor((F.col("budget") - F.col("upto") + F.col("words")) / F.col("equal")).alias("cut_words"))
    return written(goals.join(cuts, F.col("source").eqNullSafe(F.col("c_source")), "left").select(F.col("source").alias("p_source"), "source_size", "target", "epochs", "cut_key", "cut_tie", "cut_words"))


def taken(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """`rows` (with source, size, key, tie) with source_size, target and taken: the words that the mix takes of each."""
    few = plans.count() <= BROADCAST_SOURCES
    joined = rows.join(F.broadcast(plans) if few else plans, F.col("source").eqNullSafe(F.col("p_source")))
    before = (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.col("tie") < F.col("cut_tie")))
    at = (F.col("key") == F.col("cut_key")) & (F.col("tie") == F.col("cut_tie"))
    sample = F.when(before, F.col("size")).when(at, F.col("cut_words")).otherwise(0)
    return joined.withColumn("taken", (F.col("epochs") * F.col("size") + sample).cast("long")).drop("p_source", "epochs", "cut_key", "cut_tie", "cut_words")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row."""
    rows = written(sized(docs))
    return taken(rows, plan(rows)).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken whole, and once more for the words of a part."""
    text = F.col("_row.text")
    rows = docs.select(F.struct("*").alias("_row"), "source", size_of(F.col("text")).alias("size"), key_of(F.col("doc_id"), quality_of(F.col("text"))).alias("key"), F.xxhash64("text").alias("tie"))
    found = taken(rows, plan(written(sized(docs)))).where("taken > 0")
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), F.pmod("taken", "size").cast("int")), "")
    copies = F.concat(F.array_repeat(F.lit(True), F.floor(F.col("taken") / F.col("size")).cast("int")), F.when(F.pmod("taken", "size") > 0, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")))
    out = found.withColumn("_whole", F.explode(copies))
    return out.select(*[F.when(F.col("_whole"), text).otherwise(part).alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])
