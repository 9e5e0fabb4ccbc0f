"""Line dedup by distinct-site spread.

Per line hash one HyperLogLog sketch of the sites (sources) that carry the line; sketches merge in the
aggregation, before and after the shuffle, so a line that every document has costs one small row a task.
Lines whose estimate is within the sketch's error of the threshold are counted exactly. A line that
reaches MIN_SITES sites is boilerplate: its first occurrence (smallest doc_id, then position) stays, all
others go, so no content is lost.

A line is what stands between line feeds, compared without surrounding ASCII white space; blank lines are
never removed. Cases: a null text stays null with 0 lines, an empty text has one blank line; a null
source counts as the site with the empty name; of repeated rows with one doc_id and text all are treated
alike, so each keeps a first occurrence; a null doc_id comes before all others; extra columns are passed
through, but for those named n_lines or n_removed, which are replaced; an empty table gives no row. Texts of any
length are read whole, and take time in proportion to their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.scratch import written

MIN_SITES, LG_K = 5, 12
#: Standard errors of an estimate within which a line is counted exactly.
NEAR = 5.0
#: Sizes up to which the removals are broadcast (about 30 MB); beyond, documents and removals meet by a shuffle.
BROADCAST_ROWS, BROADCAST_WORDS = 200_000, 1_000_000
#: Lines to remove that are broadcast (about 50 bytes each). If there are more, those that make up over a BROADCAST_LINES-th of
#: all lines are, of which there can't be more; the others, none of which is frequent, meet their occurrences by a shuffle.
BROADCAST_LINES = 200_000

_BLANKS = " \t\r\x0b\x0c"


def _row() -> list[Column]:
    return [F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text_hash")]


def _lines(docs: DataFrame) -> DataFrame:
    # the text is hashed before its lines are made rows: what stands beside explode is computed, and carried along, a line
    split = docs.where(F.col("text").isNotNull()).select(*_row(), F.coalesce("source", F.lit("")).alias("site"), F.split("text", "\n", -1).alias("lines"))
    exploded = split.select("_id", "_text_hash", "site", F.posexplode("lines").alias("pos", "line"))
    trimmed = exploded.withColumn("line", F.btrim("line", F.lit(_BLANKS))).where("line <> ''")
    return trimmed.select("_id", "_text_hash", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2, first (id, pos) and n (occurrences) of the lines that reach `min_sites` distinct sites."""
    margin = max(1.0, NEAR * 1.04 / 2 ** (LG_K / 2) * min_sites)
    spread = written(
        lines.groupBy("h1", "h2")
        .agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min(F.struct("_id", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
        .select("h1", "h2", "first", "n", F.hll_sketch_estimate("sketch").cast("double").alias("sites"))
        .where(F.col("sites") >= min_sites - margin)
    )
    near = spread.where(F.col("sites") <= min_sites + margin)
    if near.count() <= BROADCAST_LINES:
        sites = lines.join(F.broadcast(near.select("h1", "h2")), ["h1", "h2"]).select("h1", "h2", "site").distinct()
    else:  # a line's occurrences on a site are combined before they are sent, so a line in all documents is no long task
        sites = lines.select("h1", "h2", "site").distinct().join(near.select("h1", "h2"), ["h1", "h2"])
    exact = sites.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("exact")).where(F.col("exact") >= min_sites)
    sure = spread.where(F.col("sites") > min_sites + margin).select("h1", "h2", "first", "n")
    return sure.unionByName(near.join(exact, ["h1", "h2"]).select("h1", "h2", "first", "n"))


def _occurrences(lines: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of `lines` that stand in `found`, with first."""
    few = found.count()
    found = found.select("h1", "h2", "first", "n")
    if few <= BROADCAST_LINES:
        return lines.join(F.broadcast(found.drop("n")), ["h1", "h2"])
    often = F.col("n") * BROADCAST_LINES > lines.count()
    return lines.join(F.broadcast(found.where(often).drop("n")), ["h1", "h2"]).unionByName(lines.join(found.where(~often).drop("n"), ["h1", "h2"]))


def _cleaned(docs: DataFrame, min_sites: int) -> DataFrame:
    """_row (the row of `docs`), _text (without the removed lines), _n_lines, _n_removed: no name of the input can clash with ours."""
    lines = _lines(docs)
    found = written(boilerplate(lines, min_sites))
    gone = _occurrences(lines, found).where(~(F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("pos") == F.col("first.pos"))))
    # the places to remove as bits of 64-bit words
    words = gone.groupBy("_id", "_text_hash", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    mapped = words.groupBy("_id", "_text_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("by_word"), F.max("word").alias("last"), F.sum(F.bit_count("bits")).alias("_removed"))
    dense = F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.coalesce(F.try_element_at("by_word", k), F.lit(0).cast("long")))
    gone = written(mapped.select(F.col("_id").alias("_gone_id"), F.col("_text_hash").alias("_gone_hash"), dense.alias("_gone"), "_removed"))
    size = gone.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("_gone")).alias("words")).first()
    small = size.rows <= BROADCAST_ROWS and (size.words or 0) <= BROADCAST_WORDS
    named = docs.select(F.struct("*").alias("_row"), *_row())
    joined = named.join(F.broadcast(gone) if small else gone, F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_text_hash") == F.col("_gone_hash")), "left")
    text = F.col("_row.text")
    split = F.split(text, "\n", -1)
    stays = lambda k: F.getbit(F.coalesce(F.get("_gone", F.floor(k / 64).cast("int")), F.lit(0).cast("long")), k % 64) == 0
    kept = F.array_join(F.filter(split, lambda line, k: stays(k)), "\n")
    return joined.select(
        "_row",
        F.when(F.col("_gone").isNull(), text).otherwise(kept).alias("_text"),
        F.when(text.isNull(), 0).otherwise(F.size(split)).alias("_n_lines"),
        F.coalesce("_removed", F.lit(0)).cast("int").alias("_n_removed"),
    )


def _columns(docs: DataFrame, but: tuple = ()) -> list[Column]:
    return [F.col("_text").alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns if c not in but]


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """All rows and columns of `docs`, text without the removed lines, and n_lines, n_removed (before, of them)."""
    return _cleaned(docs, min_sites).select(*_columns(docs, ("n_lines", "n_removed")), F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"))


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The rows of `docs` with something left, text without the removed lines; rows that lose nothing stay as they are."""
    return _cleaned(docs, min_sites).where("_n_removed = 0 or trim(_text) <> ''").select(*_columns(docs))
