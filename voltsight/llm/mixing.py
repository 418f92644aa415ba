"""Mixing sources to target weights by hierarchical budgeting.

Documents are leaves of a domain - language - source tree.  A token budget is
propagated from the root: each node's budget goes to its children in proportion
to their weights, but no child gets more than its usable leaves can supply
(``epochs`` passes over the tokens of leaves with no weight of 0 below the child).  What a short child can't use goes to
its siblings first; only what a whole node can't use reaches the siblings of its
ancestors.  Each level is one closed-form water-filling over windows of the
small tree tables.  A leaf takes whole epochs of its documents and then the
prefix of one more epoch, whose order is the md5 of seed, epoch, id and text: first
whole hash buckets by their totals, then row by row in the one bucket where the
quota ends, so a leaf of any size is never sorted in one task.  The leaf table
meets the documents as a broadcast if it counts at most
``MAX_BROADCAST_LEAVES`` rows, else by a join on the leaf.

Defined results: a null domain, language or source is the branch ``?``; null
and empty texts have no tokens - such a row is taken if its place in the epoch
comes before the quota ends; a document is taken if its first token is within
the quota; weights are shares of any size (finite, 0 or more, known levels: else
ValueError) and children of weight 0 get nothing; the tokens given out are the
budget or, if less, all that is usable; rows that repeat an id or lack one are told
apart by their text, and rows that repeat both are taken one by one; a very long text
is one row like any other; extra columns are kept whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialised

LEVELS = ("domain", "language", "leaf_source")
BUCKET_DIGITS = 4
MAX_BROADCAST_LEAVES = 100_000
WORD = r"[^ \t\n\r]+"


def default_domain() -> Column:
    """Domain of a source: its trailing number modulo 4."""
    return F.concat(F.lit("d"), (F.coalesce(F.expr(r"try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS INT)"),
                                            F.lit(0)) % 4).cast("string"))


def leaf_columns(domain: Column | None = None) -> dict[str, Column]:
    return {"domain": F.coalesce(default_domain() if domain is None else domain, F.lit("?")),
            "language": F.coalesce("lang", F.lit("?")), "leaf_source": F.coalesce("source", F.lit("?"))}


def tokens() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")


def checked(weights: dict) -> dict:
    """``weights`` if they name known levels and hold finite numbers of 0 or more."""
    for level, own in weights.items():
        if level not in LEVELS:
            raise ValueError(f"unknown level {level!r}: the levels are {LEVELS}")
        for name, w in own.items():
            if not (isinstance(w, (int, float)) and math.isfinite(w) and w >= 0):
                raise ValueError(f"weight of {level} {name!r} must be a finite number of 0 or more, not {w!r}")
    return weights


def _weight(weights: dict, level: str) -> Column:
    """Weight of a node by its own name (1 if not given)."""
    out = F.lit(1.0)
    for name, w in sorted(weights.get(level, {}).items()):
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def water_fill(level: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds ``given``: each row's share of its parent's ``budget`` by ``weight``,
    at most ``cap``; shortages go to the siblings in proportion to weight."""
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight"))
    level = level.withColumn("ratio", ratio)
    group = Window.partitionBy(*parents)
    earlier = group.orderBy(F.col("ratio").asc_nulls_last(), name).rowsBetween(Window.unboundedPreceding, -1)
    level = level.withColumns({"used": F.coalesce(F.sum("cap").over(earlier), F.lit(0)),
                               "gone": F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)),
                               "weights": F.sum("weight").over(group)})
    level = level.withColumn("rate", F.expr("(budget - used) / nullif(weights - gone, 0D)"))
    full = F.col("ratio") <= F.col("rate")
    level = level.withColumns({"full": full, "rate": F.max(F.when(~full, F.col("rate"))).over(group)})
    given = F.when(F.col("ratio").isNull(), 0.0).when(F.col("full"), F.col("cap").cast("double")).otherwise(
        F.col("rate") * F.col("weight"))
    return level.withColumn("given", given).drop("ratio", "used", "gone", "weights", "rate", "full")


def quotas(leaves: DataFrame, weights: dict, epochs: int, share: float) -> DataFrame:
    """``domain, language, leaf_source, tokens, quota`` of every leaf; the budget
    is ``share`` of all tokens, at most what the tree can supply."""
    checked(weights)
    everything = Window.partitionBy()
    out, parents, given = None, [], None
    for i, name in enumerate(LEVELS):
        keys = list(LEVELS[:i + 1])
        # what a node can use: the supply of leaves with no weight of 0 on the way down to them
        usable = F.col("tokens") * epochs
        for deeper in LEVELS[i + 1:]:
            usable = F.when(_weight(weights, deeper) > 0, usable).otherwise(0)
        level = leaves.groupBy(*keys).agg(F.sum(usable).alias("cap"), F.sum("tokens").alias("tokens"))
        if i == 0:
            level = level.withColumn("budget", F.sum("tokens").over(everything) * F.lit(float(share)))
        else:
            level = level.join(given, parents)
        filled = water_fill(level.withColumn("weight", _weight(weights, name)), parents, name)
        given = filled.select(*keys, F.col("given").alias("budget"))
        out, parents = filled, keys
    return out.select(*LEVELS, "tokens", F.col("given").alias("quota"))


def _order(seed: int, epoch: str, text_md5: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(epoch).cast("string"),
                             F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), text_md5))


def _text_md5() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def _bucket() -> Column:
    return F.substring("place", 1, BUCKET_DIGITS)


def _small(leaves: DataFrame, n: int) -> DataFrame:
    """Broadcast the leaf table if its counted rows are few; else it is joined by key."""
    return F.broadcast(leaves) if n <= MAX_BROADCAST_LEAVES else leaves


def plan(docs: DataFrame, weights: dict, epochs: int, share: float, seed: int, domain: Column | None = None) -> DataFrame:
    """One row per leaf: ``quota``, whole epochs ``epoch``, rest, and the hash
    ``bucket`` in which the rest ends (with the tokens of all earlier buckets)."""
    leaf = leaf_columns(domain)
    slim = materialised(docs.select("doc_id", *[c.alias(n) for n, c in leaf.items()], tokens().alias("tokens"),
                                    _text_md5().alias("text_md5")))
    leaves = slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    q = quotas(leaves, weights, epochs, share).withColumn(
        "epoch", F.coalesce(F.floor(F.expr("quota / nullif(tokens, 0)")), F.lit(0)).cast("bigint"))
    q = materialised(q.withColumn("rest", F.col("quota") - F.col("epoch") * F.col("tokens")))
    each = slim.join(_small(q.select(*LEVELS, "epoch", "rest"), q.count()), list(LEVELS)).withColumn("place", _order(seed, "epoch", F.col("text_md5")))
    buckets = each.groupBy(*LEVELS, _bucket().alias("bucket")).agg(
        F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    earlier = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    started = buckets.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where(
        F.col("before") < F.col("rest"))
    last = started.groupBy(*LEVELS).agg(F.max(F.struct("bucket", "before")).alias("last"))
    return q.join(last, list(LEVELS), "left").select(
        *LEVELS, F.col("tokens").alias("leaf_tokens"), "quota", "epoch", "rest", "last.bucket", "last.before")


def _mark(docs: DataFrame) -> str:
    """A prefix that no column of ``docs`` starts with."""
    mark = "_mix_"
    while any(c.startswith(mark) for c in docs.columns):
        mark = f"_{mark}"
    return mark


def mixed(docs: DataFrame, weights: dict | None = None, epochs: int = 4, share: float = 1.0, seed: int = 17,
          domain: Column | None = None) -> DataFrame:
    """``docs`` with its leaf, its leaf's plan and ``copies`` - how often the row is
    taken (0: not at all) - all under a prefix that ``docs`` does not use."""
    leaf = leaf_columns(domain)
    decided = materialised(plan(docs, weights or {}, epochs, share, seed, domain))
    mark = _mark(docs)
    own = {f"{mark}{n}": c for n, c in leaf.items()}
    right = decided.select(*[F.col(c).alias(f"{mark}{c}" if c in LEVELS else f"{mark}p_{c}") for c in decided.columns])
    rows = docs.withColumns(own).join(_small(right, decided.count()), list(own))
    rows = rows.withColumn(f"{mark}place", _order(seed, f"{mark}p_epoch", _text_md5()))
    bucket, last = F.substring(f"{mark}place", 1, BUCKET_DIGITS), F.col(f"{mark}p_bucket")
    sure = rows.where(last.isNull() | (bucket != last)).withColumn(
        f"{mark}more", F.coalesce(bucket < last, F.lit(False)).cast("int"))
    in_order = Window.partitionBy(*own).orderBy(
        f"{mark}place", "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where(bucket == last)
    start = F.col(f"{mark}p_before") + F.coalesce(F.sum(tokens()).over(in_order), F.lit(0))
    edge = edge.withColumn(f"{mark}more", (start < F.col(f"{mark}p_rest")).cast("int"))
    both = sure.unionByName(edge)
    return both.withColumn(f"{mark}copies", F.col(f"{mark}p_epoch") + F.col(f"{mark}more"))


def assignments(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, domain, language, leaf_source, quota, copies`` of every row."""
    m, mark = mixed(docs, **how), _mark(docs)
    return m.select("doc_id", *[F.col(f"{mark}{n}").alias(n) for n in LEVELS],
                    F.col(f"{mark}p_quota").alias("quota"), F.col(f"{mark}copies").cast("bigint").alias("copies"))


def take_mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows taken, each as often as its copies say, all columns kept."""
    copies = f"{_mark(docs)}copies"
    m = mixed(docs, **how).where(F.col(copies) > 0)
    taken = m.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])
