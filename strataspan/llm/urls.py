"""URL verdicts by rules, and for the rest by trust that spreads over links between hosts.

A rule is a host with a path; it fits the host and its subdomains where the url's path
starts with the rule's, and the longest rule that fits decides. Rules are a short stated
list and become one expression. Pages that no rule fits take their host's verdict:

- Hosts are joined by hyperlinks that name a host (``href`` with ``//``), weighted by
  their number, and by the tree of names: a host and the name above it (at least two
  labels) point at each other with weight 1. Links inside a host say nothing on it.
- Trust starts at hosts with allowed pages and follows edges, distrust starts at hosts with
  blocked pages and follows them backwards: who links to blocked hosts is suspect. Both are
  personalised PageRanks with a fixed number of rounds.
- A host is blocked when distrust makes up more than ``share`` per cent of both.

Scores are whole numbers (all seeds together have ``MASS``) and every division rounds
down, so that sums don't depend on the order of rows, on partitions or on repeated tasks. Mass
that reaches a host without edges stays there.

Defined cases: null urls and urls without ``://`` have an empty host and path, fit no rule
and are allowed; null html has no links; empty hosts are no nodes; ports and users stay
part of the host; addresses (no letter in the last label) have no name above them;
repeated rows count as often as they occur and stay rows; without seeds all scores are 0;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

MASS, DAMPING, ROUNDS, SHARE = 10**15, 85, 10, 50
# Names a host behind an optional scheme.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
MAX_RULES = 1000
_SALTS = 16


def _fold(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _host_path(url: Column, group: int) -> Column:
    """Host (1, folded) or path (2) of a url; empty without one."""
    part = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?s:.*?)://([^/?#]*)([^?#]*)", group)
    return _fold(part) if group == 1 else part


def parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path of every row."""
    return pages.select("page_id", _host_path(F.col("url"), 1).alias("host"), _host_path(F.col("url"), 2).alias("path"))


def rule_of(rules: list[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """Rule and verdict of the longest (host, path, verdict) that fits; the longer host goes first among equals."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, w: links between different hosts and the tree of their names."""
    host = _host_path(F.col("url"), 1)
    links = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(F.col("html").cast("string"), F.lit(LINK), 1)).alias("dst"))
    links = links.select("src", _fold(F.col("dst")).alias("dst")).filter("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))
    links = materialise(links, "host-links")
    hosts = pages.select(host.alias("host")).filter("host <> ''").distinct().unionByName(links.select(F.col("dst").alias("host"))).distinct()
    named = hosts.filter(F.col("host").rlike(r"^[^.]+\..*\.[^.]*[a-z][^.]*$")).select(F.split("host", r"\.").alias("l"))
    up = named.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("l") - 2), lambda i: F.struct(
        F.array_join(F.slice("l", i, F.size("l")), ".").alias("host"), F.array_join(F.slice("l", i + 1, F.size("l")), ".").alias("above")))).alias("e")).select("e.*").distinct()
    both = up.select(F.col("host").alias("src"), F.col("above").alias("dst")).unionByName(up.select(F.col("above").alias("src"), F.col("host").alias("dst")))
    return links.unionByName(both.withColumn("w", F.lit(1).cast("long"))).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: int = DAMPING) -> DataFrame:
    """kind, host, score after the rounds. seeds: kind (trust or distrust), host, pages;
    edges: src, dst, w. Distrust follows edges backwards."""
    ways = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "w")
    ways = ways.unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "w"))
    ways = materialise(ways.join(ways.groupBy("kind", "host").agg(F.sum("w").alias("total")), ["kind", "host"]), "host-ways")
    sums = seeds.groupBy("kind").agg(F.sum("pages").alias("all"))  # two rows
    seeded = materialise(seeds.join(F.broadcast(sums), "kind").select("kind", "host", F.expr(f"cast({MASS} as decimal(19,0)) * pages div all").alias("seed")), "host-seeds")
    scores, written = seeded.select("kind", "host", F.col("seed").alias("score")), []
    part = F.expr("cast(score as decimal(19,0)) * cast(w as decimal(19,0)) div cast(total as decimal(19,0))")
    for k in range(1, rounds + 1):
        sent = scores.join(ways, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(part).alias("inflow"))
        both = seeded.select("kind", "host", "seed", F.lit(0).cast("long").alias("inflow")).unionByName(sent.select("kind", "host", F.lit(0).cast("long").alias("seed"), "inflow"))
        scores = both.groupBy("kind", "host").agg(F.expr(f"({100 - damping} * sum(seed) + {damping} * sum(inflow)) div 100").alias("score"))
        if k % 4 == 0 or k == rounds:
            scores = materialise(scores, "host-scores")
            discard(*written)
            written = [scores]
    discard(ways, seeded)
    return scores


def host_verdicts(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: int = DAMPING, share: int = SHARE) -> DataFrame:
    """host, trust, distrust and verdict of every host that any score reaches."""
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0)).alias(kind)
    hosts = propagate(seeds, edges, rounds, damping).groupBy("host").agg(of("trust"), of("distrust"))
    return hosts.withColumn("verdict", F.when(F.expr(f"100 * distrust > {share} * (trust + distrust)"), "block").otherwise("allow"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], rounds: int = ROUNDS, damping: int = DAMPING, share: int = SHARE) -> DataFrame:
    """page_id, host, path, rule, verdict of every row, and its host's trust and distrust."""
    split = parts(pages)
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    ruled = split.withColumns({"rule": rule, "said": verdict})
    seeds = ruled.filter("host <> '' and said is not null").groupBy(F.when(F.col("said") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").alias("pages"))
    hosts = materialise(host_verdicts(seeds, host_edges(pages), rounds, damping, share), "host-verdicts")
    # A host may hold a third of all pages: its row goes to several salts.
    salted = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    rows = ruled.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(_SALTS)).cast("int"))
    joined = rows.join(salted, ["host", "salt"], "left")
    score = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("page_id", "host", "path", "rule", F.coalesce("said", "verdict", F.lit("allow")).alias("verdict"), score("trust"), score("distrust"))
