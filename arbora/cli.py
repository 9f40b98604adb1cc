"""Command line: look-up of clones, databases, corpus statistics.

    python -m arbora.cli lookup [--limit 10] [--database DIR] [--machine] TREES...
    python -m arbora.cli database OUT TREES...
    python -m arbora.cli corpus OUT THRESHOLD TREES...
    python -m arbora.cli inspect FOREST TOP REPRESENTATIVES [CSV-PREFIX]

TREES are Parquet files or folders with def_name, source, loc_start, loc_end and ir. Failures go to standard error
and end with status 1. The session is the cluster's, or a local one.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.model import STRICT, hard
from arbora.operators import classes, dendrogram, stats
from arbora.operators.fingerprint import fingerprint_trees
from arbora.operators.partition import cluster
from arbora.plans.pipelines import clone_lookup
from arbora.session import drop_scratch, local_session
from arbora.sources.files import dump_labels


def _trees(spark: SparkSession, paths: list[str]) -> DataFrame:
    return dump_labels(spark.read.parquet(*paths))


def lookup(spark: SparkSession, paths: list[str], limit: int = 10, database: str | None = None, machine: bool = False) -> DataFrame:
    """Records of the definitions with clones: (record). The limit doesn't apply to machine records."""
    own = fingerprint_trees(_trees(spark, paths), "ir", STRICT, with_subs=False, passes=2, self_name="def_name").where("error is null")
    keys = ["label", "source", "loc_start", "loc_end"]
    known = classes.read_database(spark, database)
    if machine:
        m = classes.clone_matches(own.select(*keys, "weight", "digest"), classes.upsert(known, own))
        named = m.groupBy(*keys).agg(F.sort_array(F.collect_list("other")).alias("names"))
        return named.select(classes.machine_record(F.col("loc_start"), F.col("loc_end"), F.col("names")).alias("record"))
    found = clone_lookup(own.select(*keys, "weight", "digest"), known, keys, limit)
    place = F.format_string("%s, characters %d-%d", "source", "loc_start", "loc_end")
    return found.select(classes.human_record(F.col("label"), place, F.col("n_matches"), F.col("names")).alias("record"))


def build_database(spark: SparkSession, out: str, paths: list[str]) -> None:
    hashed = fingerprint_trees(_trees(spark, paths), "ir", STRICT, with_subs=False, passes=1).where("error is null")
    classes.write_database(hashed, out)


def build_forest(spark: SparkSession, out: str, threshold: int, paths: list[str]) -> None:
    hashed = fingerprint_trees(_trees(spark, paths), "ir", STRICT, hard(threshold), passes=1).where("error is null")
    c = cluster(hashed)
    dendrogram.write_forest(c.merges, c.leaves, out)


def inspect(spark: SparkSession, forest: str, top: int, m: int, prefix: str | None = None) -> DataFrame:
    """The statistics of the three views, with the representatives of the largest classes: (view, line)."""
    merges, leaves = dendrogram.read_forest(spark, forest)
    rows = leaves.join(dendrogram.roots_of(merges, leaves), "leaf").select(F.col("root").alias("cls"), "leaf", "label")
    trees = merges.select(F.col("node_id").alias("cls"), F.lit(True).alias("is_tree"))
    out = None
    for view, data in (("all", rows), ("only", stats.without_versions(rows)), ("refinement", stats.refined(rows))):
        report = stats.class_report(data, view, trees)
        text = F.format_string("%d definitions, %d classes, %d real ones, largest %s, middle %s", "definitions", "classes", "real_classes", F.col("largest").cast("string"), F.col("middle").cast("string"))
        best = stats.top_classes(stats.real_classes(stats.class_sizes(data)), top)
        shown = stats.representatives(data.join(best.select("cls"), "cls", "left_semi"), m).select(F.lit(view).alias("view"), F.concat_ws(" ", "cls", "label").alias("line"))
        both = report.select("view", text.alias("line")).union(shown)
        out = both if out is None else out.union(both)
        stats.export_histogram(stats.size_histogram(stats.real_classes(stats.class_sizes(data))), prefix, f"{view}.csv")
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="arbora")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("lookup")
    a.add_argument("--limit", type=int, default=10)
    a.add_argument("--database")
    a.add_argument("--machine", action="store_true")
    a.add_argument("trees", nargs="+")
    a = sub.add_parser("database")
    a.add_argument("out")
    a.add_argument("trees", nargs="+")
    a = sub.add_parser("corpus")
    a.add_argument("out")
    a.add_argument("threshold", type=int)
    a.add_argument("trees", nargs="+")
    a = sub.add_parser("inspect")
    a.add_argument("forest")
    a.add_argument("top", type=int)
    a.add_argument("representatives", type=int)
    a.add_argument("prefix", nargs="?")
    o = p.parse_args(argv)
    try:
        spark = SparkSession.getActiveSession() or local_session()
        if o.command == "database":
            build_database(spark, o.out, o.trees)
        elif o.command == "corpus":
            build_forest(spark, o.out, o.threshold, o.trees)
        else:
            df = lookup(spark, o.trees, o.limit, o.database, o.machine) if o.command == "lookup" else inspect(spark, o.forest, o.top, o.representatives, o.prefix)
            for r in df.toLocalIterator():
                print(*r, sep=": ", end="" if o.command == "lookup" and o.machine else "\n")
        drop_scratch(spark)
    except Exception as e:  # noqa: BLE001
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
