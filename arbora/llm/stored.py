"""Tables that grow by batches, stored bucketed by their join key.

A table is a folder of Parquet files, partitioned by batch and bucketed by key, which any session can open again. A join on
the key reads it bucket by bucket: only the other side is shuffled, however large the table has become. A batch is
written under its number after whatever an interrupted attempt left there is deleted, so writing it again repeats nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, columns: str, keys: list[str], buckets: int):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.name = f"arbora_{uuid.uuid4().hex}"
        by = ", ".join(keys)
        spark.sql(f"CREATE TABLE {self.name} ({columns}, batch INT) USING parquet PARTITIONED BY (batch) CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        if root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
            spark.catalog.recoverPartitions(self.name)
        self.columns = [c for c in spark.table(self.name).columns if c != "batch"]

    def append(self, rows: DataFrame, batch: int) -> None:
        """Store the rows of a batch, in place of any it has."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={batch}")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        laid = rows.select(*self.columns, F.lit(batch).cast("int").alias("batch")).repartition(self.buckets, *self.keys).sortWithinPartitions(*self.keys)
        laid.write.mode("append").insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def close(self) -> None:
        """Take the table out of the session's catalogue; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def upto(self, batch: int) -> DataFrame:
        """The rows of the batches up to a number."""
        return self.spark.table(self.name).where(F.col("batch") <= batch).drop("batch")
