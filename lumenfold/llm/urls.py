"""URL filters: host and path rules, and for the hosts without one, trust and distrust along links.

A rule names a host suffix and a path prefix; the longest that fits decides. For all other pages, the
hosts form a graph of the absolute links in the pages. Hosts most of whose pages a rule allows are
trusted seeds, hosts most of whose pages a rule blocks are blocked seeds. Personalised PageRank carries
trust along the links and distrust against them (a host that links to blocked hosts is suspect). A host
is blocked if its distrust exceeds its trust and MIN_DISTRUST of an even share; else it is allowed. The walks
go on until what is still on its way is at most ERROR of that limit, which the damping bounds.

Links are counted per pair of hosts before they are shuffled, so a host with a third of all pages is one
row per target; both walks run in one join and one aggregation a round, and the ranks are written to the
shared folder every round, where the round's before go. The links of a host with many targets (or, for
distrust, many sources) are dealt over parts (`hot`). Only host names and pairs of hosts take part, no page
text after the first scan. Verdicts reach the pages by broadcast up to BROADCAST_BYTES of names; beyond
that by a shuffle in which the pages of a hot host are dealt over parts too.

Cases: a null url, or one without "://", has an empty host and path, no rule, and an empty host has no
seed and no links, so it is allowed; null html has no links; repeated rows count as pages each; extra
columns are ignored; without seeds or links all hosts without a rule are allowed; an empty table gives no row.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.hot import hot_keys, join_split
from lumenfold.llm.scratch import forget, written

# Host suffix, path prefix, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING, SEED_SHARE, MIN_DISTRUST = 0.85, 0.5, 0.05
#: Names of blocked hosts that are broadcast, in bytes with 16 for each.
BROADCAST_BYTES = 64_000_000
#: What the ranks may still miss, as a share of the limit of a block.
ERROR = 1e-3


def rounds_for(missing: float, damping: float = DAMPING) -> int:
    """Rounds after which the ranks of a kind differ from their limits by `missing` in sum at most."""
    return math.ceil(math.log(missing / 2) / math.log(damping))


#: Rounds of a walk without a number of hosts.
ROUNDS = rounds_for(1e-5)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, like "net/", and its verdict; null where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))

    def fits(r: tuple) -> Column:
        return ((host == r[0]) | host.endswith("." + r[0])) & path.startswith(r[1])

    pick = lambda value: reduce(lambda acc, r: acc.when(fits(r), value(r)), ordered[1:], F.when(fits(ordered[0]), value(ordered[0])))
    return pick(lambda r: r[0] + r[1]), pick(lambda r: r[2])


def host_links(pages: DataFrame) -> DataFrame:
    """source, target and links: how many links lead from one host to another."""
    found = pages.select(host_of(F.col("url")).alias("source"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("target"))
    found = found.withColumn("target", F.translate("target", _UPPER, _LOWER)).where("source <> '' and source <> target")
    return found.groupBy("source", "target").agg(F.count(F.lit(1)).alias("links"))


def propagate(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, missing: float = 0.0) -> DataFrame:
    """kind ("trust", "distrust"), host, rank. seeds: kind, host, seed (the seeds of a kind sum to 1). It ends early if the ranks miss `missing` in sum at most."""
    ranks, node = seeds.select("kind", "host", F.col("seed").alias("rank")), ["kind", "host"]
    links = written(links.select("source", "target", "links"))
    if links.isEmpty():
        return ranks
    steps = links.select(F.lit("trust").alias("kind"), F.col("source").alias("host"), "target", "links").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("source").alias("target"), "links"))
    out = written(steps.groupBy(*node).agg(F.sum("links").alias("total"), F.count(F.lit(1)).alias("n")))
    found = written(hot_keys(out, node, 2 * links.count()))
    hot = None if found.isEmpty() else found
    steps = written(join_split(steps, out.select(*node, "total"), node, hot, ["target"]).select(*node, "target", (F.col("links") / F.col("total")).alias("share")))
    forget(links, out)
    zero, before = F.lit(0.0).alias("before"), None
    start = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"), zero)
    for _ in range(rounds):
        flow = join_split(steps, ranks, node, hot, ["target"]).select("kind", F.col("target").alias("host"), (F.col("share") * F.col("rank") * damping).alias("rank"), zero)
        old = ranks.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("before"))
        both = written(flow.unionByName(start).unionByName(old).groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("before").alias("before")))
        if before is not None:
            forget(before)
        ranks, before = both.where("rank > 0").select("kind", "host", "rank"), both
        change = both.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] or 0.0
        if change * damping / (1 - damping) <= missing:
            break
    forget(steps, found)
    return ranks


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of `pages`."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    ruled = named.withColumns({"rule": rule, "said": said})
    shares = [F.avg((F.coalesce("said", F.lit("")) == v).cast("double")).alias(k) for k, v in (("trust", "allow"), ("distrust", "block"))]
    counts = written(ruled.groupBy("host").agg(*shares, F.count(F.lit(1)).alias("n")))
    hosts = counts.where("host <> ''")
    seeds = hosts.select("host", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("weight")) for k in ("trust", "distrust")])).alias("x")).select("host", "x.kind", "x.weight").where(F.col("weight") > SEED_SHARE)
    sums = seeds.groupBy("kind").agg(F.sum("weight").alias("sum"))
    seeds = written(seeds.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("weight") / F.col("sum")).alias("seed")))  # two rows
    missing = ERROR * MIN_DISTRUST / max(1, hosts.count())
    ranks = propagate(host_links(pages), seeds, rounds_for(missing), missing=missing)
    even = hosts.agg(F.count(F.lit(1)).alias("hosts"))
    by_host = ranks.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")])
    bad = by_host.join(F.broadcast(even)).where((F.col("distrust") > F.col("trust")) & (F.col("distrust") * F.col("hosts") > MIN_DISTRUST)).select("host", F.lit("block").alias("method"))  # one row
    bad = written(bad)
    names = bad.agg(F.sum(F.octet_length("host") + 16)).first()[0] or 0
    if names <= BROADCAST_BYTES:
        found = ruled.join(F.broadcast(bad), "host", "left")
    else:
        rows = counts.agg(F.sum("n")).first()[0]
        found = join_split(ruled, bad, ["host"], written(hot_keys(counts, ["host"], rows)), ["page_id", "path"], "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("said", "method", F.lit("allow")).alias("verdict"))
