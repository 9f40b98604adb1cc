"""Complete-linkage clustering of the finite distances.

Small components go through a sequential kernel, one component per group; larger ones through rounds of reciprocal
nearest neighbours on the edge table, which need no task to hold a component. Both use the same order (distance,
smaller name, larger name), where a tree's name is its smallest leaf. No two pairs are equal in it, and a merged pair's
new edge never comes before both edges it replaces (the larger distance is kept, and the name is that of one half), so
reciprocal nearest neighbours stay so until they are merged: both ways give the same merges, with ties too. A missing edge is infinite: trees are merged only where every pair of leaves has a distance.

Merges are rows (component, node_id, left_id, right_id, height, n_leaves); a leaf's id is its name, an inner node's
id is '<smallest leaf>+<number of leaves>'.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.model import MERGES
from arbora.operators.graph import components
from arbora.session import Scratch


def node_id(name: str, n: int) -> str:
    return name if n == 1 else f"{name}+{n}"


def link_component(edges: list[tuple[str, str, int]]) -> list[tuple[str, str, str, int, int]]:
    """Merges (node_id, left_id, right_id, height, n_leaves) of one component, in order of merging."""
    near: dict[str, dict[str, int]] = {}
    heap = []
    for x, y, d in edges:
        near.setdefault(x, {})[y] = d
        near.setdefault(y, {})[x] = d
        heap.append((d, *sorted((x, y)), 1, 1))
    size = dict.fromkeys(near, 1)
    heapq.heapify(heap)
    out = []
    while heap:
        d, a, b, na, nb = heapq.heappop(heap)
        # a name stands for its current tree only, so an entry of another size is stale
        if size.get(a) != na or size.get(b) != nb:
            continue
        left, right = near.pop(a), near.pop(b)
        out.append((node_id(a, na + nb), node_id(a, na), node_id(b, nb), d, na + nb))
        for other in (left.keys() | right.keys()) - {a, b}:
            near[other].pop(a, None)
            near[other].pop(b, None)
        size[a] = na + nb
        del size[b]
        near[a] = {}
        for other in (left.keys() & right.keys()) - {a, b}:
            far = max(left[other], right[other])
            near[a][other] = near[other][a] = far
            lo, hi = sorted((a, other))
            heapq.heappush(heap, (far, lo, hi, size[lo], size[hi]))
    return out


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (component, x, y, dist) in order of component to merges; one component is held at a time."""

    def merged(component: str, edges: list) -> pa.RecordBatch:
        rows = [(component, *r) for r in link_component(edges)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = ["component", "node_id", "left_id", "right_id", "height", "n_leaves"]
    last, held = None, []
    for b in batches:
        columns = (b.column(c).to_pylist() for c in ("component", "x", "y", "dist"))
        for component, x, y, d in zip(*columns):
            if component != last:
                if held:
                    yield merged(last, held)
                last, held = component, []
            held.append((x, y, d))
    if held:
        yield merged(last, held)


def linkage_rounds(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Merges by rounds of reciprocal nearest neighbours; edges are (component, x, y, dist), x < y."""
    scratch = scratch or Scratch(edges.sparkSession, "linkage")
    now = scratch.write(edges.select("component", "x", "y", F.col("dist").cast("bigint").alias("dist"), F.lit(1).cast("bigint").alias("nx"), F.lit(1).cast("bigint").alias("ny")), "edges-0")
    merges, k = None, 0
    while not now.isEmpty():
        k += 1
        rank = F.struct("dist", "x", "y")
        best = now.select(F.explode(F.array("x", "y")).alias("node"), rank.alias("rank")).groupBy("node").agg(F.min("rank").alias("best"))
        best = scratch.write(best.select("node", "best.x", "best.y"), f"best-{k}")
        chosen = best.groupBy("x", "y").count().where("count = 2").select("x", "y")
        made = scratch.write(now.join(chosen, ["x", "y"]), f"made-{k}")
        fresh = made.select(
            "component", F.concat("x", F.lit("+"), F.col("nx") + F.col("ny")).alias("node_id"),
            F.when(F.col("nx") == 1, F.col("x")).otherwise(F.concat("x", F.lit("+"), "nx")).alias("left_id"),
            F.when(F.col("ny") == 1, F.col("y")).otherwise(F.concat("y", F.lit("+"), "ny")).alias("right_id"),
            F.col("dist").alias("height"), (F.col("nx") + F.col("ny")).alias("n_leaves"))
        merges = fresh if merges is None else merges.union(fresh)
        to = made.select(F.explode(F.array(F.struct(F.col("x").alias("old"), F.col("x").alias("new")), F.struct(F.col("y").alias("old"), F.col("x").alias("new")))).alias("m"), (F.col("nx") + F.col("ny")).alias("n")).select("m.old", "m.new", "n")
        moved = (
            now.join(to.select(F.col("old").alias("x"), F.col("new").alias("x2"), F.col("n").alias("mx")), "x", "left")
            .join(to.select(F.col("old").alias("y"), F.col("new").alias("y2"), F.col("n").alias("my")), "y", "left")
            .select(
                "component", "dist", F.coalesce("x2", "x").alias("a"), F.coalesce("y2", "y").alias("b"), F.coalesce("mx", "nx").alias("na"), F.coalesce("my", "ny").alias("nb"),
                (F.when(F.col("x2").isNull(), 1).otherwise(2) * F.when(F.col("y2").isNull(), 1).otherwise(2)).alias("parts"))
            .where("a <> b")
        )
        ordered = moved.select(
            "component", "dist", "parts", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"),
            F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("nx"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("ny"))
        # a distance to a merged tree is finite only if both halves had one
        now = scratch.write(
            ordered.groupBy("component", "x", "y", "nx", "ny", "parts").agg(F.max("dist").alias("dist"), F.count(F.lit(1)).alias("n")).where("n = parts").select("component", "x", "y", "dist", "nx", "ny"), f"edges-{k}")
    return merges if merges is not None else edges.sparkSession.createDataFrame([], MERGES)


def complete_linkage(edges: DataFrame, kernel_edges: int = 200_000) -> DataFrame:
    """Merges of all components; edges are (x, y, dist), x < y, at most one per pair.

    A component of up to kernel_edges edges is one group of the kernel; any larger one goes through rounds, so the
    bound limits a task's memory and drops nothing."""
    scratch = Scratch(edges.sparkSession, "linkage")
    edges = scratch.write(edges.select("x", "y", "dist"), "edges")
    comp = components(edges)
    placed = scratch.write(edges.join(comp.withColumnRenamed("node", "x"), "x").select("component", "x", "y", "dist"), "placed")
    sizes = scratch.write(placed.groupBy("component").count(), "sizes")
    small = placed.join(sizes.where(F.col("count") <= kernel_edges).select("component"), "component", "left_semi")
    large = placed.join(sizes.where(F.col("count") > kernel_edges).select("component"), "component", "left_semi")
    out = small.repartition("component").sortWithinPartitions("component").mapInArrow(_kernel, MERGES)
    if sizes.where(F.col("count") > kernel_edges).isEmpty():
        return out
    return out.union(linkage_rounds(large, scratch))
