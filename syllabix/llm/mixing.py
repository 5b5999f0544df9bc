"""Mixing sources to target weights by hierarchical budgets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syllabix.functions.joins import lookup_join
from syllabix.session import pin

MISSING = "(missing)"
# Words stand for tokens: maximal runs of other than space and control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
# A document's place in an epoch is a number of so many bits; its leading bits are its bin.
ORDER_DIGITS, BIN_BITS = 13, 12


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("bigint")


def source_domain(source: str = "source") -> Column:
    """Domain of a source by its trailing number: web, books and forum in turn, other without a number."""
    number = F.expr(f"try_cast(regexp_extract({source}, '([0-9]+)$', 1) as bigint)")
    turn = F.pmod(number, F.lit(3))
    return F.when(number.isNull(), "other").when(turn == 0, "web").when(turn == 1, "books").otherwise("forum")


def budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], total: int, max_epochs: int
) -> DataFrame:
    """A whole-token ``budget`` for every leaf (``levels``, ``supply``).

    A node can take its leaves' supply times ``max_epochs``. Going down from ``total``, a
    node's budget is shared among its children by weight (1 if not named); a child that
    cannot take its share takes all it can, and what it leaves is shared again among its
    siblings. So a shortage reaches other branches only if a whole branch is short.
    Shares are rounded down. Weights times ``total`` must stay below 2**63.
    """
    parents = leaves.select(F.lit(total).cast("bigint").alias("_budget")).limit(1)
    for depth in range(1, len(levels) + 1):
        path, name = list(levels[:depth]), levels[depth - 1]
        known = [F.lit(x) for pair in weights.get(name, {}).items() for x in pair]
        weight = F.coalesce(F.create_map(*known)[F.col(name)] if known else F.lit(None), F.lit(1)).cast("bigint")
        children = leaves.groupBy(*path).agg((F.sum("supply") * max_epochs).cast("bigint").alias("_cap"))
        children = children.withColumn("_weight", weight)
        children = children.join(parents, path[:-1]) if depth > 1 else children.withColumn("_budget", F.lit(total).cast("bigint"))
        family = Window.partitionBy(*(path[:-1] or [F.lit(0)]))
        # Children that are full soonest come first; a prefix of them is filled.
        ranked = family.orderBy(F.col("_cap") / F.col("_weight"), F.col(name))
        before = F.coalesce(F.sum("_cap").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rest = F.sum("_weight").over(ranked.rowsBetween(0, Window.unboundedFollowing))
        full = F.col("_cap").cast("double") * rest <= F.col("_weight").cast("double") * (F.col("_budget") - before)
        children = children.withColumn("_full", full)
        taken = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(family), F.lit(0))
        sharing = F.sum(F.when(~F.col("_full"), F.col("_weight"))).over(family)
        children = children.withColumn("_taken", taken).withColumn("_sharing", sharing)
        share = F.when(F.col("_full"), F.col("_cap")).otherwise(F.expr("_weight * (_budget - _taken) div _sharing"))
        parents = children.select(*path, share.alias("_budget"))
    return parents.withColumnRenamed("_budget", "budget")


def mix(
    docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], fraction: float = 1.0,
    max_epochs: int = 4, seed: int = 0, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """Documents chosen so that leaves of the source tree hold their budgets of tokens.

    ``levels`` names the tree's levels from the top and gives their values; the budget
    at the root is ``fraction`` of all tokens. A leaf takes whole epochs and then the
    prefix of one more, in the order of a hash of seed, epoch and identifier, up to and
    with the document that reaches the budget. Returns ``doc_id``, the levels, ``epoch``
    (from 0) and ``n_tokens``, one row per document and epoch.

    Prefixes are found by a histogram of fixed size per leaf; only the bin in which the
    budget ends is ordered identifier by identifier, so no leaf has to fit one task, hot or not.

    Missing level values form the leaf ``"(missing)"``, a missing text has no tokens,
    missing identifiers come first in their order. Rows repeated with one identifier are
    chosen together. A leaf without tokens or budget gives no rows, and so does an empty
    table. Columns of ``docs`` with clashing names are not read.
    """
    names = list(levels)
    rows = docs.select(
        F.col(doc_id).alias("_id"), word_count(text).alias("_tokens"),
        *[F.coalesce(c.cast("string"), F.lit(MISSING)).alias(n) for n, c in levels.items()],
    )
    counted = pin(rows)
    leaves = pin(counted.groupBy(*names).agg(F.sum("_tokens").alias("supply")))
    total = int(int(leaves.agg(F.coalesce(F.sum("supply"), F.lit(0))).first()[0]) * fraction)
    shares = budgets(leaves, names, weights, total, max_epochs).join(leaves, names).filter("supply > 0 AND budget > 0")
    shares = pin(shares.select(*names, F.expr("budget div supply").alias("_whole"), F.expr("budget % supply").alias("_rest")))
    placed = lookup_join(counted, shares, names, "inner")

    whole = placed.filter("_whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_whole") - 1)))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_whole"), F.coalesce(F.col("_id").cast("string"), F.lit("")))), 1, ORDER_DIGITS)
    order = F.conv(digits, 16, 10).cast("bigint")
    part = placed.filter("_rest > 0").withColumn("_order", order)
    part = part.withColumn("_bin", F.shiftright("_order", 4 * ORDER_DIGITS - BIN_BITS))
    leaf = Window.partitionBy(*names)
    histogram = part.groupBy(*names, "_bin").agg(F.sum("_tokens").alias("_sum"), F.max("_rest").alias("_limit"))
    ends = pin(
        histogram.withColumn("_upto", F.sum("_sum").over(leaf.orderBy("_bin"))).filter("_upto >= _limit")
        .groupBy(*names).agg(F.min_by(F.struct("_bin", (F.col("_upto") - F.col("_sum")).alias("_before")), "_bin").alias("_end"))
        .select(*names, F.col("_end._bin").alias("_last"), F.col("_end._before").alias("_before"))
    )
    ended = lookup_join(part, ends, names, "inner")
    # Rows of one place and identifier are peers, together in or out, and meet the window as one row.
    last = ended.filter("_bin = _last")
    peers = last.groupBy(*names, "_order", "_id").agg(
        F.sum("_tokens").alias("_peers"), F.max("_before").alias("_before"), F.max("_rest").alias("_rest"))
    cuts = peers.withColumn("_upto", F.sum("_peers").over(leaf.orderBy("_order", "_id"))).filter("_before + _upto - _peers < _rest")
    cuts = cuts.groupBy(*names).agg(F.max(F.struct("_order", "_id")).alias("_cut"))
    last = lookup_join(last, cuts, names, "inner").filter(F.struct("_order", "_id") <= F.col("_cut"))
    columns = ["_id", *names, "epoch", "_tokens"]
    chosen = [whole, ended.filter("_bin < _last").withColumn("epoch", F.col("_whole")), last.withColumn("epoch", F.col("_whole"))]
    result = chosen[0].select(*columns).unionByName(chosen[1].select(*columns)).unionByName(chosen[2].select(*columns))
    return result.select(F.col("_id").alias(doc_id), *names, "epoch", F.col("_tokens").alias("n_tokens"))
