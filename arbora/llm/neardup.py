"""Near-duplicate records with small edits: a MinHash LSH forest with exact verification.

Each different bag has a signature per tree: DEPTH MinHash values of 8 bits, most significant first. All signatures,
sorted, are the forest: a tree's prefixes of any length are neighbouring rows, so it is laid out once and read anew,
without a shuffle, for every prefix length. The search starts with whole signatures and shortens the matched prefix
until the recall reaches its target. The recall is estimated from the verified pairs: one of similarity s is met with
probability p(s) = 1 - (1 - s^depth)^trees, so those found stand for sum 1/p(s); to them come the pairs at the threshold
that may all have been missed at 95 % confidence. Every candidate is verified exactly.

Scale: the forest is laid out in ranges of equal size, so a hot prefix spreads over as many tasks as it needs. Runs of
one prefix are paired up only where they are short (`run_cap`) and lie within one stretch; the members of other runs
are joined on their rarest elements, which is exact for the threshold, so no pair is lost to the cap or to a border.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.bags import _flat, blocks, common_elements, distinct_bags, keyed, members, verified
from arbora.llm.components import connected_components
from arbora.session import Scratch

#: Values in a signature; a key is 7 bits of tree above 8 bits a value.
DEPTH = 7


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signatures(trees: int, seed: int):
    """Batches of (bag, elements) to rows (key, bag), one per tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        mult = rng.integers(1, 2**63, size=(trees, DEPTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                flat, offsets = _flat(batch.column("elements"))
                base = _mix(flat.astype(np.uint64))
                keys = np.empty((trees, batch.num_rows), dtype=np.uint64)
                for t in range(trees):
                    key = np.full(batch.num_rows, t, dtype=np.uint64)
                    for j in range(DEPTH):
                        h = base * mult[t, j]
                        h ^= h >> np.uint64(32)
                        least = np.minimum.reduceat(h, offsets[:-1])
                        key = (key << np.uint64(8)) | (_mix(least) >> np.uint64(56))
                    keys[t] = key
                bag = batch.column("bag").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(bag, trees))], ["key", "bag"])

    return run


_FOUND = "key bigint, a bigint, b bigint"


def _runs(depth: int, run_cap: int):
    """Sorted (key, bag, part) to pairs (key, a, b) that meet at this depth and at no longer prefix; b is null for the
    members of runs over the cap, and of runs at the ends of a stretch, which may go on in another one."""
    shift, finer = np.int64(8 * (DEPTH - depth)), np.int64(8 * (DEPTH - depth - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
        out: tuple[list, list, list] = ([], [], [])
        # the run in hand: its prefix and stretch, its whole keys and bags, and whether its members go out one by one
        prefix = part = None
        keys: list[int] = []
        ids: list[int] = []
        alone = False

        def members_out() -> None:
            out[0].extend([prefix] * len(ids))
            out[1].extend(ids)
            out[2].extend([None] * len(ids))
            keys.clear()
            ids.clear()

        def close(at_end: bool) -> None:
            nonlocal alone
            if alone or at_end:
                members_out()
            elif len(ids) > 1:
                for i, a in enumerate(ids):
                    for j in range(i + 1, len(ids)):
                        if depth == DEPTH or keys[i] >> finer != keys[j] >> finer:
                            b = ids[j]
                            out[0].append(prefix), out[1].append(min(a, b)), out[2].append(max(a, b))
            keys.clear()
            ids.clear()
            alone = False

        for batch in batches:
            if not batch.num_rows:
                continue
            key, bag, stretch = (batch.column(c).to_numpy() for c in ("key", "bag", "part"))
            short = key >> shift
            cuts = np.flatnonzero(np.concatenate([[True], (short[1:] != short[:-1]) | (stretch[1:] != stretch[:-1])]))
            ends = np.append(cuts[1:], len(key))
            first_of = np.concatenate([[True], stretch[1:] != stretch[:-1]])[cuts]
            last_of = np.append(stretch[1:] != stretch[:-1], True)[ends - 1]
            # runs of one row inside a stretch meet nothing
            for c in np.flatnonzero((ends - cuts > 1) | first_of | last_of):
                p, s = int(short[cuts[c]]), int(stretch[cuts[c]])
                if (p, s) != (prefix, part):
                    border = s != part
                    if prefix is not None:
                        close(border)
                    prefix, part, alone = p, s, border
                keys.extend(key[cuts[c] : ends[c]].tolist())
                ids.extend(bag[cuts[c] : ends[c]].tolist())
                if alone or len(ids) > run_cap:
                    alone = True
                    members_out()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=schema)
            out = ([], [], [])
        if prefix is not None:
            close(True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=schema)

    return run


def plant(bags: DataFrame, trees: int, seed: int, scratch: Scratch) -> DataFrame:
    """The forest: (key, bag, part), sorted by key within each part."""
    entries = scratch.write(bags.select("bag", "elements").mapInArrow(_signatures(trees, seed), "key bigint, bag bigint"), "entries")
    laid = entries.repartitionByRange("key", "bag").sortWithinPartitions("key", "bag").withColumn("part", F.spark_partition_id())
    forest = scratch.write(laid, "forest")
    scratch.drop(entries)
    return forest


def estimated_recall(found: DataFrame, threshold: float, depth: int, trees: int) -> float:
    """Lower estimate of the share of all pairs that found (a, b, sim) holds, at this depth."""
    p = 1 - F.pow(1 - F.pow(F.col("sim"), depth), trees)
    n, stands_for = found.agg(F.count("a"), F.coalesce(F.sum(1 / p), F.lit(0.0))).first()
    hidden = math.floor(math.log(20) / -(trees * math.log1p(-(threshold**depth))))
    if not n and not hidden:  # what the least likely pair would have been met with
        return 1 - (1 - threshold**depth) ** trees
    return n / (stands_for + hidden)


def similar_bags(bags: DataFrame, threshold: float, scratch: Scratch, trees: int = 64, least_depth: int = 2, recall: float = 0.999995, run_cap: int = 64, seed: int = 11) -> DataFrame:
    """(a, b, sim), a < b, of different bags of similarity threshold or more."""
    forest = plant(bags, trees, seed, scratch)
    found = tried = common = None
    for depth in range(DEPTH, least_depth - 1, -1):
        met = scratch.write(forest.mapInArrow(_runs(depth, run_cap), _FOUND), f"met-{depth}")
        pairs = met.where("b is not null").select("a", "b")
        # members of a run, in any of its stretches; a run of one is none
        lone = met.where("b is null").select("key", F.col("a").alias("bag"))
        hot = scratch.write(lone.join(lone.groupBy("key").count().where("count > 1").select("key"), "key"), f"hot-{depth}")
        if not hot.isEmpty():
            common = common_elements(bags) if common is None else common
            inside = hot.join(bags.select("bag", "elements"), "bag")
            rare = scratch.write(blocks(inside, common, threshold, carry="key"), f"rare-{depth}")
            x, y = (rare.select("key", "element", F.col("bag").alias(n), F.col("size").alias(f"s{n}")) for n in "ab")
            close = (F.col("sa") >= threshold * F.col("sb") - 1e-9) & (F.col("sb") >= threshold * F.col("sa") - 1e-9)
            pairs = pairs.union(x.join(y, ["key", "element"]).where((F.col("a") < F.col("b")) & close).select("a", "b"))
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.write(pairs, f"tried-{depth}")
        tried = pairs if tried is None else tried.union(pairs)
        fresh = scratch.write(verified(pairs, bags, bags, threshold).select("a", "b", "sim"), f"pairs-{depth}")
        found = fresh if found is None else found.union(fresh)
        if estimated_recall(found, threshold, depth, trees) >= recall:
            break
    return found


def _linked(df: DataFrame, id_col: str, subs_col: str, threshold: float, **forest) -> tuple[DataFrame, DataFrame]:
    """(id, bag) of every row with a bag, and the pairs of similar bags."""
    scratch = Scratch(df.sparkSession, "neardup")
    rows = keyed(df, id_col, subs_col)
    bags = scratch.write(distinct_bags(rows), "bags")
    who = scratch.write(members(rows, bags), "members")
    return who, similar_bags(bags, threshold, scratch, **forest)


def near_duplicates(df: DataFrame, id_col: str, subs_col: str, threshold: float = 0.7, **forest) -> DataFrame:
    """(id_a, id_b, sim), id_a < id_b: pairs of different records with bag similarity of threshold or more.

    Every pair of exact copies comes out, so use near_duplicate_classes where a bag may have many.

    Defined results: a row without id is left out; a null or empty bag is similar to nothing; entries without digest are ignored; a repeated id
    is one record; exact copies of a bag (any number) come from a join on the bag, not through the forest; an empty
    table gives no pairs; other columns are ignored."""
    who, pairs = _linked(df, id_col, subs_col, threshold, **forest)
    x, y = who.select(F.col("bag").alias("a"), F.col("id").alias("ia")), who.select(F.col("bag").alias("b"), F.col("id").alias("ib"))
    across = pairs.join(x, "a").join(y, "b").select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"), "sim")
    copies = x.join(y.withColumnRenamed("b", "a"), "a").where("ia < ib").select(F.col("ia").alias("id_a"), F.col("ib").alias("id_b"), F.lit(1.0).alias("sim"))
    return across.union(copies)


def near_duplicate_classes(df: DataFrame, id_col: str, subs_col: str, threshold: float = 0.7, **forest) -> DataFrame:
    """(id, class, links) of every record that is similar to another: its class is the smallest id of all records linked
    to it directly or indirectly, links the number of records it is itself similar to.

    One row per record however many copies a bag has: copies are counted, never paired. Defined results as in near_duplicates."""
    who, pairs = _linked(df, id_col, subs_col, threshold, **forest)
    scratch = Scratch(df.sparkSession, "classes")
    pairs = scratch.write(pairs.select("a", "b"), "pairs")
    size = scratch.write(who.groupBy("bag").agg(F.count(F.lit(1)).alias("n")), "sizes")
    both = pairs.select(F.col("a").alias("bag"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    near = both.join(size.select(F.col("bag").alias("other"), "n"), "other").groupBy("bag").agg(F.sum("n").alias("near"))
    # a bag's id is its smallest record, so the smallest bag of a component is its smallest record
    named = connected_components(pairs, "a", "b").select(F.col("node").alias("bag"), F.col("component").alias("class"))
    per_bag = size.join(near, "bag", "left").join(named, "bag", "left").select("bag", F.coalesce("class", "bag").alias("class"), (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    return who.join(per_bag.where("links > 0"), "bag").select("id", "class", "links")
