"""Incremental upkeep of the exact-class database as a stream (A7 by foreachBatch), an addition to the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arbora.model import KIND_CLASSES, STRICT, TREES, Config
from arbora.operators.classes import clone_report, read_database
from arbora.operators.fingerprint import fingerprint_trees


def stream_trees(spark: SparkSession, path: str, schema=TREES, files_per_trigger: int = 100) -> DataFrame:
    """Trees arriving as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def upsert_stream(trees: DataFrame, database: str, reports: str, checkpoint: str, label: str = "tree_id", ir: str = "ir", config: Config = STRICT, limit: int = 10) -> StreamingQuery:
    """Every batch is appended to the database and its clones, within it and before it, are reported.

    A batch writes under its own number and overwrites itself when replayed, so both outputs are exactly-once;
    history is cut to the batch's fingerprints by a semi join (a broadcast one while the batch is small) as it is scanned,
    and never shuffled whole or rewritten."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = fingerprint_trees(batch.select(F.col(label).cast("string").alias("label"), F.col(ir).alias("ir")), "ir", config, with_subs=False).where("error is null").select("weight", "digest", "label")
        own.withColumn("kind", F.lit(KIND_CLASSES)).write.mode("overwrite").parquet(f"{database}/batch={number}")
        past = read_database(spark, database)
        mine = read_database(spark, f"{database}/batch={number}")
        clone_report(mine, past, ["label", "weight", "digest"], limit=limit).write.mode("overwrite").parquet(f"{reports}/batch={number}")

    return trees.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
