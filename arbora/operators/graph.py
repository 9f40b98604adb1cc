"""Seen and alone nodes, adjacency, connected components.

Components by alternating large-star and small-star (Kiveris et al. 2014): every round is two grouped minima and
two joins on plain edges; the number of rounds grows with the logarithm of the graph, not with its diameter. Before
the rounds, each partition replaces its own edges by stars, which shrinks them to a forest without a shuffle. Hubs
are skewed keys of joins whose sides come from written tables, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.session import Scratch


def adjacency(edges: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(node, other): every edge in both directions."""
    pair = F.array(F.struct(F.col(x).alias("node"), F.col(y).alias("other")), F.struct(F.col(y).alias("node"), F.col(x).alias("other")))
    return edges.select(F.explode(pair).alias("e")).select("e.node", "e.other")


def seen_nodes(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    return nodes.join(adjacency(edges).select(F.col("node").alias(node)).distinct(), node, "left_semi")


def alone_nodes(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    return nodes.join(adjacency(edges).select(F.col("node").alias(node)).distinct(), node, "left_anti")


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) of one partition to (node, smallest node of its component within the partition)."""
    up: dict = {}

    def find(x):
        root = x
        while up[root] != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    schema = None
    for b in batches:
        schema = b.schema
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
            up.setdefault(u, u)
            up.setdefault(v, v)
            a, c = find(u), find(v)
            if a != c:
                up[max(a, c)] = min(a, c)
    if schema is not None:
        pairs = [(x, find(x)) for x in up]
        pairs = [p for p in pairs if p[0] != p[1]]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], schema.field("u").type), pa.array([p[1] for p in pairs], schema.field("v").type)], ["u", "v"])


def _summary(links: DataFrame) -> tuple:
    """Number and hash of the links; equal for equal sets."""
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(node, component) of every node with an edge to another; component is its smallest node.

    Null ends and self-edges are ignored; repeats and either direction count once; an empty graph is empty."""
    scratch = Scratch(edges.sparkSession, "stars")
    links = edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) != F.col(y)))
    kind = links.schema["u"].dataType.simpleString()
    links = links.mapInArrow(_local_stars, f"u {kind}, v {kind}").distinct()
    links, k = scratch.write(links, "links"), 0
    before = _summary(links)
    while True:
        k += 1
        # large star: the larger neighbours of every node link to the smallest of its neighbourhood
        both = adjacency(links, "u", "v")
        least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.join(least, "node").where("other > node").select(F.col("other").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.write(large, f"large-{k}")
        # small star: the smaller neighbours and the node itself link to the smallest of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).distinct()
        small = scratch.write(small, f"small-{k}")
        # a forest of stars that neither step changes is the result; the summaries spare the comparison of the rest
        after = _summary(small)
        settled = after == before and small.join(links, ["u", "v"], "left_anti").isEmpty()
        old, links, before = links, small, after
        for t in (old, large):
            scratch.drop(t)
        if settled:
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
