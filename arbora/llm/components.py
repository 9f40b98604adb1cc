"""Consolidating pairwise matches into groups: connected components by random graph contraction.

Each round relabels every vertex by a fresh bijective hash, hooks it to the smallest hash in its closed
neighbourhood, moves the edges to the representatives and drops loops and repeats. A round keeps a constant
fraction of the vertices in expectation whatever the shape of the graph (a long chain included), so the number
of rounds is logarithmic. The mappings of all rounds are kept and composed backwards at the end.

Scale: everything is equi joins and partial aggregates on 64-bit ids. Every join side is a table read back from
the shared folder, so a hub holding a third of all edges is a plain skewed join that adaptive execution splits.
Nothing is collected; the driver only sees whether edges are left.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.session import Scratch


def _fresh(c, const: int):
    # XXH64 of one long is a permutation of the 64-bit integers (and so is xor), hence relabelling never collides
    return F.xxhash64(c.bitwiseXOR(F.lit(const)))


def connected_components(edges: DataFrame, src: str = "x", dst: str = "y", seed: int = 17) -> DataFrame:
    """(node, component) for every node with a link to another node; component is the smallest node of its group.

    Nodes of type bigint stay numbers, all others are taken as strings.

    Defined results: rows with a null end and self-pairs are no links; repeated pairs, either order, count once; an
    empty table gives an empty table; other columns are ignored, whatever their names. Strings compare in byte order.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    rng = random.Random(seed)
    kind = "bigint" if all(edges.schema[c].dataType.simpleString() == "bigint" for c in (src, dst)) else "string"
    pairs = scratch.write(
        edges.select(F.col(src).cast(kind).alias("s"), F.col(dst).cast(kind).alias("d"))
        .where(F.col("s").isNotNull() & F.col("d").isNotNull() & (F.col("s") != F.col("d")))
        .select(F.least("s", "d").alias("s"), F.greatest("s", "d").alias("d"))
        .distinct(),
        "pairs",
    )
    nodes = scratch.write(
        pairs.select(F.explode(F.array("s", "d")).alias("node")).distinct().select("node", F.monotonically_increasing_id().alias("id")),
        "nodes",
    )
    left = nodes.select(F.col("node").alias("s"), F.col("id").alias("u"))
    right = nodes.select(F.col("node").alias("d"), F.col("id").alias("v"))
    graph = scratch.write(pairs.join(left, "s").join(right, "d").select("u", "v"), "edges-0")

    levels: list[tuple[int, DataFrame]] = []
    while not graph.isEmpty():
        const = rng.getrandbits(63)
        hashed = graph.select(_fresh(F.col("u"), const).alias("u"), _fresh(F.col("v"), const).alias("v"))
        both = hashed.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.a", "e.b")
        hooks = scratch.write(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("r")), f"hooks-{len(levels)}")
        levels.append((const, hooks))
        moved = (
            hashed.join(hooks.select(F.col("a").alias("u"), F.col("r").alias("ru")), "u")
            .join(hooks.select(F.col("a").alias("v"), F.col("r").alias("rv")), "v")
            .where("ru <> rv")
            .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
            .distinct()
        )
        old, graph = graph, scratch.write(moved, f"edges-{len(levels)}")
        scratch.drop(old)
    if not levels:
        return nodes.select("node", F.col("node").alias("component"))

    # Roots of different rounds live in different hash spaces, so a root is named by (round, hash).
    labels = None
    for k in range(len(levels) - 1, -1, -1):
        hooks = levels[k][1]
        if labels is None:
            labels = hooks.select("a", F.lit(k).alias("level"), F.col("r").alias("root"))
            continue
        up = labels.select(F.col("a").alias("up"), F.col("level").alias("up_level"), F.col("root").alias("up_root"))
        labels = (
            hooks.withColumn("up", _fresh(F.col("r"), levels[k + 1][0]))
            .join(up, "up", "left")
            .select("a", F.coalesce("up_level", F.lit(k)).alias("level"), F.coalesce("up_root", "r").alias("root"))
        )
    named = scratch.write(nodes.select("node", _fresh(F.col("id"), levels[0][0]).alias("a")).join(labels, "a").select("node", "level", "root"), "named")
    groups = scratch.write(named.groupBy("level", "root").agg(F.min("node").alias("component")), "groups")
    for done in (pairs, nodes, graph, *(hooks for _, hooks in levels)):
        scratch.drop(done)
    return named.join(groups, ["level", "root"]).select("node", "component")
