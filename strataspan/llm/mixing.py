"""Mixing sources to target weights.

Weights propagate down a tree of domain, language and source. A node can use at
most its supply times ``max_epochs``; what a node can't use goes to its siblings in
proportion to their weights, and only what all siblings together can't use is left
to the ancestors' other children (water filling with the true capacity of every
subtree, in whole tokens). Each leaf then takes whole epochs and the longest prefix
of the next epoch's seeded order that fits its budget.

Rows are summed per leaf and per range of the seeded hash before anything is
ordered, so only the one range per leaf in which a prefix ends is ever sorted.

Defined cases: null texts have no tokens, and documents without tokens are never
selected; null levels count as empty names; names without a weight weigh 1; a weight
of 0 takes nothing; ties in the hash go by doc_id; repeated rows are separate
documents; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release

LEVELS = ("domain", "lang", "source")
RANGES = 4096
_BIG = "decimal(38,0)"


def count_words(text: Column) -> Column:
    spaced = F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\x0b\x0c\r", " " * 5)
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def domain_of(source: Column) -> Column:
    """A domain for the numbered sources: their number modulo 4."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("domain"), (number.cast("long") % 4).cast("string")))


def seeded(doc_id: Column, seed: int, epoch: Column) -> Column:
    """A position in [0, 2**52) for a document in an epoch's order."""
    text = F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def _fill(children: DataFrame, parent: list[str]) -> DataFrame:
    """Split ``budget`` of each parent among its children (``weight``, ``cap``) into ``share``."""
    key = [F.col(c) for c in parent] or [F.lit(0)]
    order = [F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).asc_nulls_last(), F.col("node")]
    w = Window.partitionBy(*key)
    before = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = w.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    big = lambda c: c.cast("decimal(19,0)")
    out = children.withColumns({
        "spent": F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("long"),
        "rest_weight": F.sum("weight").over(onward),
    })
    full = (F.col("weight") > 0) & (big(F.col("cap")) * big(F.col("rest_weight")) <= big(F.col("weight")) * big(F.col("budget") - F.col("spent")))
    out = out.withColumn("full", full)
    out = out.withColumns({
        "open_budget": F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(w), F.lit(0)),
        "open_weight": F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(w),
    })
    part = F.expr("cast(cast(open_budget as decimal(19,0)) * cast(weight as decimal(19,0)) div cast(nullif(open_weight, 0) as decimal(19,0)) as long)")
    out = out.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(F.coalesce(part, F.lit(0))))
    takes = ~F.col("full") & (F.col("weight") > 0)
    out = out.withColumns({
        "left": F.when(F.col("open_weight") > 0, F.col("open_budget") - F.sum(F.when(~F.col("full"), F.col("share")).otherwise(0)).over(w)).otherwise(0),
        "turn": F.sum(F.when(takes, 1).otherwise(0)).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)),
    })
    return out.withColumn("share", F.col("share") + F.when(takes & (F.col("turn") <= F.col("left")), 1).otherwise(0))


def budgets(supply: DataFrame, weights: dict[str, dict[str, int]], target: Column, max_epochs: int) -> DataFrame:
    """Leaf budgets (``share``) for leaves with ``tokens``; ``target`` may use the total ``supply``."""
    leaf = supply
    for level in LEVELS:
        pairs = [x for k, v in weights.get(level, {}).items() for x in (F.lit(k), F.lit(int(v)))]
        own = F.coalesce(F.create_map(*pairs)[F.col(level)], F.lit(1)) if pairs else F.lit(1)
        leaf = leaf.withColumn(f"w_{level}", own.cast("long"))
    alive = reduce(lambda a, b: a & b, [F.col(f"w_{level}") > 0 for level in LEVELS])
    leaf = leaf.withColumn("cap", F.when(alive, F.col("tokens") * max_epochs).otherwise(0))
    total = leaf.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("supply"), F.coalesce(F.sum("cap"), F.lit(0)).alias("all_cap"))
    node = total.select(F.least(F.floor(target), F.col("all_cap")).cast("long").alias("budget"))
    for depth, level in enumerate(LEVELS):
        keys, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        children = leaf.groupBy(*keys).agg(F.max(f"w_{level}").alias("weight"), F.sum("cap").cast("long").alias("cap"))
        children = children.join(node, parent) if parent else children.crossJoin(node)  # one row
        shares = _fill(children.withColumn("node", F.col(level)), parent)
        node = shares.select(*keys, F.col("share").cast("long").alias("budget"))
    return leaf.select(*LEVELS, "tokens").join(node, list(LEVELS)).withColumnRenamed("budget", "share")


def mix(
    docs: DataFrame, weights: dict[str, dict[str, int]], *, target_tokens: int | None = None, target_share: float = 0.5,
    seed: int = 17, max_epochs: int = 2, domain: Column | None = None,
) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch of every selected copy."""
    release(docs.sparkSession)  # what earlier stages left behind on the driver
    names = {
        "domain": domain if domain is not None else domain_of(F.col("source").cast("string")),
        "lang": F.col("lang").cast("string"),
        "source": F.col("source").cast("string"),
    }
    slim = docs.select("doc_id", *[F.coalesce(names[k], F.lit("")).alias(k) for k in LEVELS], count_words(F.col("text")).alias("n_tokens"))
    slim = materialise(slim.filter("n_tokens > 0"), "mix-docs")
    supply = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    target = F.lit(target_tokens) if target_tokens is not None else F.col("supply") * target_share
    plan = materialise(
        budgets(supply, weights, target, max_epochs).select(
            *LEVELS, "share", F.expr("share div tokens").alias("whole"), F.expr("share % tokens").alias("rest")
        ),
        "mix-plan",
    )
    placed = slim.join(plan, list(LEVELS)).withColumn("at", seeded(F.col("doc_id"), seed, F.col("whole")))
    placed = placed.withColumn("range", F.shiftright("at", 40))
    sums = placed.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("in_range"))
    order = Window.partitionBy(*LEVELS).orderBy("range")
    sums = sums.withColumn("upto", F.sum("in_range").over(order)).withColumn("before", F.col("upto") - F.col("in_range"))
    rows = placed.join(sums, [*LEVELS, "range"])
    inside = rows.filter("upto <= rest")
    edge = rows.filter("before < rest and upto > rest")
    within = Window.partitionBy(*LEVELS, "range").orderBy("at", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("so_far", F.sum("n_tokens").over(within)).filter("before + so_far <= rest").drop("so_far")
    last = inside.unionByName(edge).select("doc_id", *LEVELS, "n_tokens", F.col("whole").alias("epoch"))
    whole = slim.join(plan.filter("whole > 0"), list(LEVELS)).select(
        "doc_id", *LEVELS, "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("epoch")
    )
    return whole.unionByName(last)


