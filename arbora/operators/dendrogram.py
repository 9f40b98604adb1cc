"""Dendrograms as merge tables: folds, sizes, roots, cuts, printing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.model import KIND_FOREST
from arbora.operators.skew import number_within_keys
from arbora.session import Scratch


def parents(merges: DataFrame) -> DataFrame:
    """(child, parent) of every merge."""
    return merges.select(F.explode(F.array("left_id", "right_id")).alias("child"), F.col("node_id").alias("parent"))


def roots_of(merges: DataFrame, leaves: DataFrame, leaf: str = "leaf") -> DataFrame:
    """(leaf, root) for every leaf, by pointer doubling: rounds grow with the logarithm of the height."""
    scratch = Scratch(merges.sparkSession, "roots")
    links = parents(merges)
    tops = merges.select(F.col("node_id").alias("child")).join(links.select("child"), "child", "left_anti").select("child", F.col("child").alias("parent"))
    up = scratch.write(links.union(tops), "up-0")
    k = 0
    while True:
        k += 1
        higher = F.coalesce("b.parent", "a.parent")
        twice = up.alias("a").join(up.alias("b"), F.col("a.parent") == F.col("b.child"), "left").select(F.col("a.child").alias("child"), higher.alias("parent"), (higher != F.col("a.parent")).alias("moved"))
        twice = scratch.write(twice, f"up-{k}")
        up = twice.select("child", "parent")
        if twice.where("moved").isEmpty():
            break
    return leaves.select(F.col(leaf).alias("child")).distinct().join(up, "child", "left").select(F.col("child").alias("leaf"), F.coalesce("parent", "child").alias("root"))


def fold_forest(merges: DataFrame, leaf_values: DataFrame, combine, value: str = "value") -> DataFrame:
    """(node, value) of every node, bottom-up: leaf_values is (node, value), combine(height, left, right) a Column.

    One round per level; every round joins the nodes whose two children are known."""
    scratch = Scratch(merges.sparkSession, "fold")
    known = scratch.write(leaf_values.select("node", value), "known-0")
    todo, k = scratch.write(merges.select("node_id", "left_id", "right_id", "height"), "todo-0"), 0
    while not todo.isEmpty():
        k += 1
        left, right = known.select(F.col("node").alias("left_id"), F.col(value).alias("_l")), known.select(F.col("node").alias("right_id"), F.col(value).alias("_r"))
        ready = scratch.write(todo.join(left, "left_id").join(right, "right_id").select(F.col("node_id").alias("node"), combine(F.col("height"), F.col("_l"), F.col("_r")).alias(value)), f"ready-{k}")
        if ready.isEmpty():
            raise ValueError("a merge refers to a node that is neither a leaf nor a merge")
        known = scratch.write(known.union(ready), f"known-{k}")
        todo = scratch.write(todo.join(ready.select(F.col("node").alias("node_id")), "node_id", "left_anti"), f"todo-{k}")
    return known


def forest_sizes(merges: DataFrame, leaves: DataFrame) -> DataFrame:
    """(root, label_count, tree_size, n_leaves): leaves is (leaf, n_labels). tree_size counts inner nodes too, label_count doesn't."""
    of = roots_of(merges, leaves).join(leaves, "leaf")
    return of.groupBy("root").agg(F.sum("n_labels").cast("bigint").alias("label_count"), (F.sum("n_labels") + F.count(F.lit(1)) - 1).cast("bigint").alias("tree_size"), F.count(F.lit(1)).cast("bigint").alias("n_leaves"))


def flatten_forest(merges: DataFrame, labelled: DataFrame) -> DataFrame:
    """(root, label): labelled is (leaf, label)."""
    return roots_of(merges, labelled).join(labelled, "leaf").select("root", "label")


def any_leaf(merges: DataFrame, labelled: DataFrame, predicate: Column) -> DataFrame:
    """(root, holds): whether a label of the tree satisfies the predicate."""
    return flatten_forest(merges, labelled).groupBy("root").agg(F.bool_or(predicate).alias("holds"))


def map_leaves(labelled: DataFrame, f: Column) -> DataFrame:
    """Labels rewritten; inner nodes keep their shape."""
    return labelled.select("leaf", f.alias("label"))


def cut(merges: DataFrame, leaves: DataFrame, height: int) -> DataFrame:
    """(leaf, cluster): the clusters of merges up to the height."""
    return roots_of(merges.where(F.col("height") <= height), leaves).select("leaf", F.col("root").alias("cluster"))


def ordered_forest(sizes: DataFrame, alone: DataFrame) -> DataFrame:
    """(place, root, tree_size): trees with neighbours by size downwards (ties by root), then the alone ones by name downwards.

    alone is (leaf, n_labels). Places count from 0 and are found by offsets of ranges, so no task holds the forest."""
    trees = number_within_keys(sizes.select("root", "tree_size", (-F.col("tree_size")).alias("_s"), F.lit(0).alias("_k")), ["_k"], ["_s", "root"])
    last = sizes.count() + alone.count() - 1
    names = number_within_keys(alone.select(F.col("leaf").alias("root"), F.col("n_labels").cast("bigint").alias("tree_size"), F.lit(0).alias("_k")), ["_k"], ["root"])
    both = trees.select(F.col("ordinal").alias("place"), "root", "tree_size").union(names.select((F.lit(last) - F.col("ordinal")).alias("place"), "root", "tree_size"))
    return both.select(F.col("place").cast("bigint").alias("place"), "root", "tree_size")


def write_forest(merges: DataFrame, labelled: DataFrame, path: str) -> None:
    """Two data sets, merges and leaves, marked as a forest (K2)."""
    merges.withColumn("kind", F.lit(KIND_FOREST)).write.mode("overwrite").parquet(f"{path}/merges")
    labelled.withColumn("kind", F.lit(KIND_FOREST)).write.mode("overwrite").parquet(f"{path}/leaves")


def read_forest(spark, path: str) -> tuple[DataFrame, DataFrame]:
    out = []
    for name in ("merges", "leaves"):
        df = spark.read.parquet(f"{path}/{name}")
        first = df.select("kind").first() if "kind" in df.columns else ("",)
        if first is not None and first[0] != KIND_FOREST:
            raise ValueError(f"{path} is no forest")
        out.append(df.drop("kind"))
    return out[0], out[1]


def render_tree(merges: list[tuple[str, str, str, int]], root: str, labels: dict[str, list[str]], number: int) -> list[str]:
    """Lines of one printed tree (K3): the class header, then nodes indented by depth from 1."""
    inner = {m[0]: m for m in merges}
    out, stack = [f"Class {number}:"], [(root, 1)]
    while stack:
        node, depth = stack.pop()
        if node in inner:
            _, left, right, height = inner[node]
            out.append(" " * depth + f"Node {height}:")
            stack += [(right, depth + 1), (left, depth + 1)]
        else:
            out.append(" " * depth + "".join(f"{x} " for x in labels.get(node, [])))
    return out


def print_forest(merges: DataFrame, labelled: DataFrame, roots: list[str]) -> list[str]:
    """Printed lines of the named trees, numbered from 0; only these trees come to the driver."""
    of = flatten_roots(merges, labelled, roots)
    out: list[str] = []
    for i, r in enumerate(roots):
        out += render_tree(of[r][0], r, of[r][1], i)
    return out


def flatten_roots(merges: DataFrame, labelled: DataFrame, roots: list[str]) -> dict[str, tuple[list, dict[str, list[str]]]]:
    trees = roots_of(merges, labelled).where(F.col("root").isin(roots))
    leaves: dict[str, tuple[list, dict[str, list[str]]]] = {r: ([], {}) for r in roots}
    for r in trees.join(labelled, "leaf").orderBy("leaf", "label").collect():
        leaves[r["root"]][1].setdefault(r["leaf"], []).append(r["label"])
    inner = roots_of(merges, merges.select(F.col("node_id").alias("leaf"))).where(F.col("root").isin(roots))
    for r in merges.join(inner.withColumnRenamed("leaf", "node_id"), "node_id").select("root", "node_id", "left_id", "right_id", "height").collect():
        leaves[r["root"]][0].append(tuple(r)[1:])
    return leaves
