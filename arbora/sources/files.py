"""File sources: whole files, directories, labels of dumped trees."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators.parsing import path_base


def read_units(spark: SparkSession, paths: list[str], extension: str = ".ml") -> DataFrame:
    """(key, source, text): whole files.

    A directory contributes its own files with the extension, not those of directories below; a file named
    explicitly is taken whatever its extension. A missing path fails."""
    files = [p for p in paths if not os.path.isdir(p.removeprefix("file:"))]
    folders = [p for p in paths if os.path.isdir(p.removeprefix("file:"))]
    out = None
    for chosen, pattern in ((files, None), (folders, f"*{extension}")):
        if not chosen:
            continue
        reader = spark.read.format("binaryFile")
        if pattern:
            reader = reader.option("pathGlobFilter", pattern)
        df = reader.load(chosen).select(path_base(F.col("path")).alias("key"), F.col("path").alias("source"), F.decode("content", "UTF-8").alias("text"))
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], "key string, source string, text string")


def dump_labels(trees: DataFrame, file: str = "source", name: str = "def_name") -> DataFrame:
    """trees plus label: base name of the dump file, ':' and the name."""
    return trees.withColumn("label", F.concat(path_base(F.col(file)), F.lit(":"), F.col(name)))
