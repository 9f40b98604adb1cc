"""Bags of sub-trees as sets of 64-bit elements, shared by the operators on near-duplicates.

A sub-tree becomes a token of 8 bits of its weight's logarithm above 55 bits of the hash of its digest, so that sorting
tokens downwards puts the heaviest, rarest sub-trees first; a digest is taken to have one weight, as it is a hash of the
whole sub-tree. A token's n-th copy in a bag becomes an element of its own,
which makes multiset Jaccard of bags the plain Jaccard of their element sets. Rows with the same bag are one bag
from here on: its id is the smallest id of a row that has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions.scalars import clean_digest

_MASK = (1 << 55) - 1


def tokens(subs: str | Column) -> Column:
    """Descending tokens of an array of struct<weight, digest>; entries without digest are left out."""
    c = F.col(subs) if isinstance(subs, str) else subs
    kept = F.filter(c, lambda s: s["digest"].isNotNull())
    # 12 steps per doubling, up to a weight of two millions
    step = lambda w: F.least(F.floor(12 * F.log2(1 + F.greatest(F.coalesce(w, F.lit(0)), F.lit(0)))), F.lit(255)).cast("bigint")
    token = lambda s: F.shiftleft(step(s["weight"]), 55).bitwiseOR(F.xxhash64(clean_digest(s["digest"])).bitwiseAND(F.lit(_MASK)))
    return F.sort_array(F.transform(kept, token), asc=False)


def keyed(df: DataFrame, id_col: str, subs_col: str, *keep: str) -> DataFrame:
    """id, the kept columns, the tokens and a 128-bit key of the bag; rows with a null id and null or empty bags are left out."""
    out = df.select(F.col(id_col).alias("id"), *keep, tokens(subs_col).alias("tokens")).where((F.size("tokens") > 0) & F.col("id").isNotNull())
    return out.withColumn("k1", F.xxhash64("tokens")).withColumn("k2", F.xxhash64(F.lit(7), F.col("tokens")))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and n+1 offsets of a list column without nulls."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        values, offsets = _flat(batch.column("tokens"))
        n = len(values)
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = values[1:] != values[:-1]
        fresh[offsets[:-1]] = True
        at = np.arange(n)
        nth = at - np.maximum.accumulate(np.where(fresh, at, 0))
        elements = values ^ (nth << 24)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(elements, pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("bag"), batch.column("k1"), batch.column("k2"), lists], ["bag", "k1", "k2", "elements"])


def distinct_bags(rows: DataFrame) -> DataFrame:
    """(bag, k1, k2, elements) of the output of keyed(): one row per different bag."""
    groups = rows.groupBy("k1", "k2", "tokens").agg(F.min("id").alias("bag"))
    return groups.select("bag", "k1", "k2", "tokens").mapInArrow(_elements, "bag bigint, k1 bigint, k2 bigint, elements array<bigint>")


def members(rows: DataFrame, bags: DataFrame) -> DataFrame:
    """(id, bag) of every row with a bag."""
    return rows.select("id", "k1", "k2").distinct().join(bags.select("bag", "k1", "k2"), ["k1", "k2"]).select("id", "bag")


def jaccard(a: str, b: str) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, …) whose bags in left and right have exact similarity `sim` of the threshold or more."""
    x = left.select(F.col("bag").alias("a"), F.col("elements").alias("ea"))
    y = right.select(F.col("bag").alias("b"), F.col("elements").alias("eb"))
    return pairs.join(x, "a").join(y, "b").withColumn("sim", jaccard("ea", "eb")).where(F.col("sim") >= threshold - 1e-12).drop("ea", "eb")


# ---- exact blocking by rare elements -------------------------------------------------------------------------

def common_elements(bags: DataFrame, share: float = 0.001) -> dict[int, int]:
    """Elements in at least `share` of all bags with their number of bags.

    Bounded whatever the number of bags: there are at most (mean bag size / share) such elements."""
    n = bags.count()
    least = max(8, int(n * share))
    rows = bags.select(F.explode("elements").alias("e")).groupBy("e").count().where(F.col("count") >= least).collect()
    return {r[0]: r[1] for r in rows}


def blocks(bags: DataFrame, common: dict[int, int], threshold: float, carry: str = "") -> DataFrame:
    """(element, bag, size, top): each bag's rarest elements, enough of them for the threshold.

    In one total order (elements common in the collection last, by frequency; heavy before light) two sets of
    similarity t share an element among each one's first size - ceil(t size) + 1, so a join on `element` finds
    every pair. top is the bag's heaviest element. With carry, that column is carried along."""
    values = np.array(sorted(common), dtype=np.int64)
    ranks = np.array([common[v] for v in values.tolist()], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, offsets = _flat(batch.column("elements"))
            sizes = np.diff(offsets)
            row = np.repeat(np.arange(len(sizes)), sizes)
            rank = np.zeros(len(flat), dtype=np.int64)
            if len(values):
                i = np.minimum(np.searchsorted(values, flat), len(values) - 1)
                rank = np.where(values[i] == flat, ranks[i], 0)
            order = np.lexsort((np.arange(len(flat)), np.where(rank > 0, values[np.minimum(np.searchsorted(values, flat), max(len(values) - 1, 0))] if len(values) else 0, 0), rank, row))
            first = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
            place = np.arange(len(flat)) - offsets[:-1][row]
            keep = place < first[row]
            who = row[keep]
            out = [pa.array(flat[order][keep]), batch.column("bag").take(pa.array(who)), pa.array(sizes[who].astype(np.int32)), pa.array(flat[offsets[:-1]][who])]
            names = ["element", "bag", "size", "top"]
            if carry:
                out.append(batch.column(carry).take(pa.array(who)))
                names.append(carry)
            yield pa.RecordBatch.from_arrays(out, names)

    source = bags.select("bag", "elements", *([carry] if carry else []))
    return source.mapInArrow(run, "element bigint, bag bigint, size int, top bigint" + (f", {carry} bigint" if carry else ""))
