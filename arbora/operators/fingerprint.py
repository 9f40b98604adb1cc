"""Fingerprints as columns: a kernel for trees of any depth, and relational ones for trees given as rows.

The kernel is one Arrow pass (no shuffle); threshold and sort happen inside it, and `with_subs=False` skips the bag
where only the main fingerprint is needed. Relational fingerprints aggregate one level per groupBy, bottom-up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions.hashing import hash_tree, text_hasher
from arbora.functions.irtree import TreeError, parse_tree, print_tree
from arbora.functions.normalise import normalise
from arbora.model import STRICT, Config, Threshold, hard
from arbora.sources.nested import TREE_OF

PARSERS = {"ir": parse_tree, **TREE_OF}

_BAG = pa.list_(pa.struct([("weight", pa.int64()), ("digest", pa.string())]))


def fingerprint_trees(df: DataFrame, ir: str, config: Config = STRICT, threshold: Threshold | None = None, *, kind: str = "ir", with_subs: bool = True, passes: int = 0, self_name: str | None = None, strict_fix: bool = False, keep_mutable: bool = False) -> DataFrame:
    """df plus weight, digest, subs and error (H11-H14; with passes > 0 after N4 and N5).

    kind says what the column holds: ir text, or html, json or text, whose trees are hashed without being written
    out. self_name names a column holding the tree's own name. A null or malformed tree gets null results and an error;
    with_subs=False leaves subs null. Columns of df with the result's names are replaced."""
    threshold = (threshold or hard(0)) if with_subs else None
    df = df.drop(*[c for c in ("weight", "digest", "subs", "error") if c not in (ir, self_name)])
    names = df.columns
    at, own = names.index(ir), names.index(self_name) if self_name else None
    parse = PARSERS[kind]
    by_shape = kind == "ir" and not passes and threshold is None

    def one(text: str | None, name: str | None, hasher):
        if text is None:
            return None, None, None, "no tree"
        try:
            if hasher:
                return *hasher(text), None, None
            tree = parse(text)
            if passes:
                tree = normalise(tree, name, passes, strict_fix, keep_mutable)
            return *hash_tree(tree, config, threshold), None
        except (ValueError, RecursionError) as e:  # TreeError is a ValueError
            return None, None, None, str(e) or type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = text_hasher(config) if by_shape else None
        for b in batches:
            own_names = b.column(own).to_pylist() if own is not None else [None] * b.num_rows
            rows = [one(t, n, hasher) for t, n in zip(b.column(at).to_numpy(zero_copy_only=False).tolist(), own_names)]  # faster than to_pylist
            bags = [None if r[2] is None else [{"weight": w, "digest": d} for w, d in r[2]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array(bags, _BAG), pa.array([r[3] for r in rows], pa.string())],
                [*names, "weight", "digest", "subs", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, weight bigint, digest string, subs array<struct<weight:bigint,digest:string>>, error string")


def normalised_text(df: DataFrame, ir: str, out: str, passes: int = 1, self_name: str | None = None, strict_fix: bool = False, keep_mutable: bool = False) -> DataFrame:
    """df plus the normalised tree's text; null where there is no tree (N1-N5 as a column)."""
    names = df.columns
    at, own = names.index(ir), names.index(self_name) if self_name else None

    def one(text, name):
        try:
            return None if text is None else print_tree(normalise(parse_tree(text), name, passes, strict_fix, keep_mutable))
        except TreeError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own_names = b.column(own).to_pylist() if own is not None else [None] * b.num_rows
            texts = [one(t, n) for t, n in zip(b.column(at).to_pylist(), own_names)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, `{out}` string")


# ---- columns (H1, H2, H5, H6, H9, H12) ----------------------------------------------------------------------

def leaf_digest(c: Column) -> Column:
    return F.md5(c.cast("string"))


def combined_digest(parts: Column, label: str = "", should_sort: bool = False) -> Column:
    """Digest of a node from an array of hex digests: MD5 of the raw bytes, the label's digest among the parts."""
    if label:
        parts = F.concat(F.array(F.md5(F.lit(label))), parts)
    if should_sort:
        parts = F.sort_array(parts)
    return F.md5(F.unhex(F.array_join(parts, "")))


def case_digest(key: Column, body: Column) -> Column:
    return F.md5(F.concat(F.encode(key.cast("string"), "UTF-8"), F.unhex(body)))


def variable_digest(name: Column, hash_var: bool, prefix: str = "Lvar") -> Column:
    return F.md5(name) if hash_var else F.md5(F.lit(prefix))


def optional_digest(digest: Column) -> Column:
    return F.coalesce(digest, F.md5(F.lit("None")))


def kept_subs(subs: Column, main_weight: Column, threshold: Threshold, should_sort: bool = False) -> Column:
    """The bag above the threshold (strictly); sorted by (weight, digest) if asked for."""
    limit = F.lit(threshold.value / 100.0) * main_weight if threshold.percent else F.lit(threshold.value)
    kept = F.filter(subs, lambda s: s["weight"] > limit)
    return F.sort_array(kept) if should_sort else kept


# ---- relational trees ---------------------------------------------------------------------------------------

def roll_up(children: DataFrame, keys: Sequence[str], weight: str = "weight", digest: str = "digest", *, label: str = "", order: Sequence[str] | None = None, reverse: bool = False, with_subs: bool = False) -> DataFrame:
    """One level of a tree given as rows: (keys, weight, digest[, subs]) of the parents of the given children.

    With order the children are in that order (reverse: from the last to the first, the rule of lists), without it
    they are a commutative set and all digests, the label's included, are sorted. with_subs needs a column `subs`."""
    child = F.struct(*[F.col(c) for c in order or []], F.col(digest).alias("d"), F.col(weight).alias("w"), *([F.col("subs").alias("s")] if with_subs else []))
    rows = F.sort_array(F.collect_list(child), asc=not reverse)
    grouped = children.groupBy(*keys).agg(F.sum(weight).alias("_w"), rows.alias("_rows"))
    digests = F.transform(F.col("_rows"), lambda r: r["d"])
    out = [*keys, (F.col("_w") + 1).cast("bigint").alias(weight), combined_digest(digests, label, should_sort=order is None).alias(digest)]
    if with_subs:
        bags = F.transform(F.col("_rows"), lambda r: F.concat(F.array(F.struct(r["w"].alias("weight"), r["d"].alias("digest"))), r["s"]))
        out.append(F.flatten(bags).alias("subs"))
    return grouped.select(*out)
