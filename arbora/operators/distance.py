"""Weighted multiset distances between trees that share sub-trees.

d(x, y) = W(x) + W(y) - 2 * common(x, y); a pair that shares nothing is no row, which stands for infinity. The pairs
come from an inverted index (an equi self-join on the sub-tree), never from a product of all trees. A sub-tree in
many trees makes many pairs by the definition; thresholds on the bags bound that, and `hot_limit` can leave out
hotter sub-trees explicitly, which turns some finite distances infinite (off by default).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.session import Scratch

INFINITY = None  # the absent row


def small_tree_filter(rows: DataFrame, least: int) -> DataFrame:
    """Main weight at least `least`: not strict, unlike the thresholds of bags."""
    return rows.where(F.col("weight") >= least)


def occurrences(rows: DataFrame, parent: str, subs: str = "subs") -> DataFrame:
    """(digest, weight, parent, n): how often each sub-tree occurs in each parent."""
    s = rows.select(F.col(parent).alias("parent"), F.explode(subs).alias("s"))
    return s.groupBy(F.col("s.digest").alias("digest"), F.col("s.weight").alias("weight"), "parent").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def total_weights(occ: DataFrame) -> DataFrame:
    """(parent, total) with multiplicity; parents with an empty bag have no row."""
    return occ.groupBy("parent").agg(F.sum(F.col("weight") * F.col("n")).cast("bigint").alias("total"))


def common_weights(occ: DataFrame, hot_limit: int | None = None) -> DataFrame:
    """(x, y, common), x < y, of pairs with a common sub-tree."""
    if hot_limit is not None:
        cold = occ.groupBy("digest").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") <= hot_limit).select("digest")
        occ = occ.join(cold, "digest")
    a = occ.select("digest", "weight", F.col("parent").alias("x"), F.col("n").alias("nx"))
    b = occ.select("digest", "weight", F.col("parent").alias("y"), F.col("n").alias("ny"))
    met = a.join(b, ["digest", "weight"]).where("x < y")
    return met.groupBy("x", "y").agg(F.sum(F.col("weight") * F.least("nx", "ny")).cast("bigint").alias("common"))


def symmetric_differences(rows: DataFrame, parent: str, subs: str = "subs", hot_limit: int | None = None) -> DataFrame:
    """(x, y, dist), x < y: the finite distances."""
    scratch = Scratch(rows.sparkSession, "distance")
    occ = scratch.write(occurrences(rows, parent, subs), "occurrences")  # read four times below
    total = scratch.write(total_weights(occ), "totals")
    tx, ty = total.select(F.col("parent").alias("x"), F.col("total").alias("wx")), total.select(F.col("parent").alias("y"), F.col("total").alias("wy"))
    return common_weights(occ, hot_limit).join(tx, "x").join(ty, "y").select("x", "y", (F.col("wx") + F.col("wy") - 2 * F.col("common")).cast("bigint").alias("dist"))


def distance_max(a, b):
    """The larger distance; null is infinity and wins."""
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.greatest(a, b))


def distance_min(a, b):
    """The smaller distance; null is infinity and loses (least ignores nulls)."""
    return F.least(a, b)


def distance_less(a, b):
    return a.isNotNull() & (b.isNull() | (a < b))
