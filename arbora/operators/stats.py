"""Statistics over classes: views, refinement, histograms, top-k, representatives.

A class is rows (cls, label); `is_tree` marks classes with an inner node, which count as real whatever their labels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions.scalars import package_prefix, strip_version

#: Words whose presence in every label excludes a class.
EXCLUDED = ("menhir", "oasis", "baseenvlight", "parse")


def without_versions(rows: DataFrame) -> DataFrame:
    """Labels stripped of versions, then distinct within each leaf only (cls, leaf, label)."""
    return rows.select("cls", "leaf", strip_version(F.col("label")).alias("label")).distinct()


def class_sizes(rows: DataFrame) -> DataFrame:
    """(cls, size): labels, copies counted."""
    return rows.groupBy("cls").agg(F.count("label").cast("bigint").alias("size"))


def refined(rows: DataFrame, more_than: int = 3, excluded: Sequence[str] = EXCLUDED) -> DataFrame:
    """Rows of the classes with strictly more than `more_than` package prefixes in which, for every excluded word, some label lacks it.

    Labels without a prefix count as having none."""
    # an exact distinct count without collecting any class in one task: distinct first, then counted
    prefixes = rows.select("cls", package_prefix(F.col("label")).alias("prefix")).where("prefix is not null").distinct()
    many = prefixes.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than).select("cls")
    low = F.lower("label")
    lacks = [F.bool_or(~F.contains(low, F.lit(w))).alias(f"_w{i}") for i, w in enumerate(excluded)]
    kept = rows.groupBy("cls").agg(*lacks)
    for i in range(len(excluded)):
        kept = kept.where(F.col(f"_w{i}"))
    return rows.join(many, "cls", "left_semi").join(kept.select("cls"), "cls", "left_semi")


def real_classes(sizes: DataFrame) -> DataFrame:
    """Classes with more than one label, or with an inner node (column is_tree, if there is one)."""
    return sizes.where((F.col("size") > 1) | (F.col("is_tree") if "is_tree" in sizes.columns else F.lit(False)))


def size_histogram(sizes: DataFrame) -> DataFrame:
    """(size, n), ascending by size."""
    return sizes.groupBy("size").agg(F.count(F.lit(1)).cast("bigint").alias("n")).orderBy("size")


def middle_size(sizes: DataFrame) -> DataFrame:
    """(middle): the size at place n/2, from 0, of the descending sizes; null for no class.

    From the histogram of sizes, so nothing is sorted but the different sizes."""
    hist = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    # one row per different size, so this window holds few rows however many classes there are
    down = Window.orderBy(F.desc("size"))
    run = hist.withColumn("upto", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return run.where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.max("size").alias("middle"))


def class_report(rows: DataFrame, view: str, is_tree: DataFrame | None = None) -> DataFrame:
    """One row (view, definitions, classes, real_classes, largest, middle); nulls where there is no real class (K7)."""
    sizes = class_sizes(rows)
    if is_tree is not None:
        sizes = sizes.join(is_tree, "cls", "left").withColumn("is_tree", F.coalesce("is_tree", F.lit(False)))
    real = real_classes(sizes)
    real_flag = (F.col("size") > 1) | (F.col("is_tree") if is_tree is not None else F.lit(False))
    one = sizes.agg(
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("definitions"), F.count(F.lit(1)).cast("bigint").alias("classes"),
        F.count_if(real_flag).cast("bigint").alias("real_classes"), F.max(F.when(real_flag, F.col("size"))).alias("largest"))
    key = F.lit(view).alias("view")
    # both sides are one row
    return one.select(key, "*").join(middle_size(real).select(key, "middle"), "view").select("view", "definitions", "classes", "real_classes", "largest", "middle")


def top_classes(sizes: DataFrame, k: int, tie: str = "cls") -> DataFrame:
    """The k largest classes; ties by the tie column; k <= 0, or fewer classes than k, gives what there is."""
    return sizes.orderBy(F.desc("size"), tie).limit(max(k, 0))


def take_first(array: Column, k: int) -> Column:
    return F.slice(array, 1, k) if k > 0 else F.slice(array, 1, 0)


def seeded_order(label: Column, seed: int = 42) -> Column:
    """A reproducible shuffle: the order of hashes of label and seed."""
    return F.md5(F.concat(label, F.lit(str(seed))))


def representatives(rows: DataFrame, m: int, seed: int = 42) -> DataFrame:
    """(cls, place, label): up to m labels of each class, in seeded order, ties by label."""
    w = Window.partitionBy("cls").orderBy(seeded_order(F.col("label"), seed), "label")
    return rows.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= m).select("cls", "place", "label")


def export_histogram(hist: DataFrame, prefix: str | None, suffix: str) -> str | None:
    """Lines `size,n` without header, ascending, in one file of the folder prefix + suffix; no prefix, no file (K8)."""
    if prefix is None:
        return None
    path = prefix + suffix
    hist.orderBy("size").coalesce(1).write.mode("overwrite").csv(path, header=False)
    return path
