"""The three entry points: partition of submissions, clone look-up, corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.functions.scalars import strip_version
from arbora.operators.classes import clone_report, upsert
from arbora.operators.dendrogram import roots_of
from arbora.operators.partition import Clusters, cluster, partition
from arbora.operators.stats import class_report, refined
from arbora.session import Scratch

__all__ = ["partition", "clone_lookup", "corpus_report", "classes_of"]


def clone_lookup(own: DataFrame, database: DataFrame, keys: list[str], limit: int = 10) -> DataFrame:
    """Entry B: own (label, weight, digest, …) is added to the database and looked up in it.

    keys name the columns of own that identify a definition, the label among them."""
    return clone_report(own, upsert(database, own), keys, limit=limit)


def classes_of(clusters: Clusters) -> tuple[DataFrame, DataFrame]:
    """(cls, leaf, label) of every tree of the forest, the alone leaves included, and (cls, is_tree)."""
    of = roots_of(clusters.merges, clusters.leaves)
    rows = clusters.leaves.join(of, "leaf").select(F.col("root").alias("cls"), "leaf", "label")
    return rows, clusters.merges.select(F.col("node_id").alias("cls"), F.lit(True).alias("is_tree"))


def corpus_report(rows: DataFrame, more_than: int = 3, least_weight: int | None = None) -> DataFrame:
    """Entry C: cluster (label, weight, digest, subs), then the statistics of the three views."""
    labelled, trees = classes_of(cluster(rows, least_weight=least_weight))
    labelled = Scratch(rows.sparkSession, "corpus").write(labelled, "labelled")
    stripped = labelled.select("cls", "leaf", strip_version(F.col("label")).alias("label")).distinct()
    return class_report(labelled, "all", trees).union(class_report(stripped, "only", trees)).union(class_report(refined(labelled, more_than), "refinement", trees))
