"""Partition of submissions: accept or reject, fingerprint, cluster, decorate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.functions.scalars import once
from arbora.model import Config, Threshold, percent
from arbora.operators.classes import first_bag
from arbora.operators.distance import symmetric_differences
from arbora.operators.fingerprint import fingerprint_trees
from arbora.operators.linkage import complete_linkage
from arbora.operators.parsing import first_of_name, last_value
from arbora.session import Scratch


def name_of(weight, digest):
    """A fingerprint as a sortable name: weights compare as numbers, digests bytewise."""
    return F.concat(F.lpad(weight.cast("string"), 19, "0"), F.lit("-"), digest)


def accept_reject(units: DataFrame, bindings: DataFrame, name: str, signature: str) -> DataFrame:
    """units plus status: 'accepted', 'unparsable' or a reason to reject (F1, F2).

    units is (key, …, error); bindings (unit, ord, name, sig, ir, plain) of top-level bindings. The signature is that
    of the last binding of the name, the tree that of the first; a plain binding must exist (first by order)."""
    mine = bindings.where(F.col("name") == name)
    sig = last_value(mine, ["unit"], "sig")
    tree = first_of_name(mine, ["unit"]).select("unit", "ir")
    plain = mine.where("plain").select("unit").distinct().withColumn("_plain", F.lit(True))
    out = units.join(sig.withColumnRenamed("unit", "key").withColumn("_has", F.lit(True)), "key", "left").join(tree.withColumnRenamed("unit", "key"), "key", "left").join(plain.withColumnRenamed("unit", "key"), "key", "left")
    status = (
        F.when(F.col("error") == "type error", "type error").when(F.col("error").isNotNull(), "unparsable").when(F.col("_has").isNull(), "not found")
        .when(~F.col("sig").eqNullSafe(signature), "wrong type").when(F.col("ir").isNull(), "no tree").when(F.col("_plain").isNull(), "no plain binding").otherwise("accepted")
    )
    return out.withColumn("status", status).drop("_has", "_plain")


def rejected(judged: DataFrame) -> DataFrame:
    """(key, reason) of the rejects; unparsable units are in neither result, see quarantined."""
    return judged.where("status not in ('accepted', 'unparsable')").select("key", F.col("status").alias("reason"))


def quarantined(judged: DataFrame) -> DataFrame:
    return judged.where("status = 'unparsable'").select("key", F.col("error").alias("reason"))


def with_representative(rows: DataFrame, texts: DataFrame, key: str = "key", order: str = "ord") -> DataFrame:
    """rows plus `text` of the first match of their key (J6); rows without one keep null."""
    first = first_of_name(texts, [key], order).select(key, "text")
    return rows.join(first, key, "left")


@dataclass
class Clusters:
    """merges as in linkage; leaves (leaf, label); fingerprints per label; alone (leaf)."""

    merges: DataFrame
    leaves: DataFrame
    fingerprints: DataFrame
    alone: DataFrame


def cluster(rows: DataFrame, label: str = "label", order: str | None = None, least_weight: int | None = None, kernel_edges: int = 200_000) -> Clusters:
    """Rows (label, weight, digest, subs) to dendrograms over their different main fingerprints.

    order decides whose bag stands for a fingerprint (the smallest; by default the smallest label)."""
    scratch = Scratch(rows.sparkSession, "cluster")
    rows = rows.where("weight is not null and digest is not null")
    if least_weight is not None:
        rows = rows.where(F.col("weight") >= least_weight)
    rows = rows.withColumn("leaf", name_of(F.col("weight"), F.col("digest")))
    leaves = scratch.write(rows.select("leaf", F.col(label).alias("label"), "weight", "digest"), "leaves")
    bags = first_bag(rows, order or label).withColumn("leaf", name_of(F.col("weight"), F.col("digest")))
    edges = scratch.write(symmetric_differences(bags.where("subs is not null"), "leaf"), "edges")
    merges = scratch.write(complete_linkage(edges, kernel_edges), "merges")
    seen = edges.select(F.explode(F.array("x", "y")).alias("leaf")).distinct()
    alone = leaves.select("leaf").distinct().join(seen, "leaf", "left_anti")
    return Clusters(merges, leaves.select("leaf", "label"), leaves, alone)


@dataclass
class Partition:
    rejected: DataFrame
    quarantine: DataFrame
    clusters: Clusters
    implementations: DataFrame


def partition(units: DataFrame, bindings: DataFrame, name: str, signature: str, keep_percent: int = 0, config: Config | None = None, threshold: Threshold | None = None, passes: int = 1) -> Partition:
    """Entry A: reject, hash (sorted, without identifiers, by percentage), cluster, and attach each label's text."""
    config, threshold = config or Config(True, False), threshold or percent(keep_percent)
    judged = Scratch(units.sparkSession, "partition").write(accept_reject(once(units, "key"), bindings, name, signature), "judged")
    hashed = fingerprint_trees(judged.where("status = 'accepted'").select(F.col("key").alias("label"), "ir"), "ir", config, threshold, passes=passes)
    clusters = cluster(hashed)
    implementations = with_representative(clusters.leaves.withColumnRenamed("label", "key"), units.select("key", "ord", "text"))
    return Partition(rejected(judged), quarantined(judged), clusters, implementations)
