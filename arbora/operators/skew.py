"""Per-key results without imbalance: exact offset chunking.

Rows are laid out in range partitions of one global order, counted per (partition, key), and the prefix sums of
those counts over the partitions give each partition the offset at which its rows of a key start. Offset plus the
position inside (partition, key) is the row's exact ordinal within its key, so a key of any size is cut into
equal chunks; chunks are processed apart and their ordered boundary states merged. No task ever holds more than
one input partition or one chunk of a key, and no row is dropped or sampled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.session import Scratch


def _free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def number_within_keys(df: DataFrame, keys: Sequence[str], order: Sequence[str], scratch: Scratch | None = None) -> DataFrame:
    """df plus `ordinal` (0-based, exact) within each key in the given order.

    Defined results: null keys are keys like others; ties in the order get distinct ordinals (any order among
    them); an empty table gives an empty table; other columns are kept, but one named ordinal is replaced.
    """
    pid, n, pos, base = (_free(df, x) for x in ("pid", "n", "pos", "base"))
    scratch = scratch or Scratch(df.sparkSession, "chunking")
    laid = scratch.write(df.repartitionByRange(*order).withColumn(pid, F.spark_partition_id()), "laid")
    counts = laid.groupBy(pid, *keys).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*keys).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(pid, *keys, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy(pid, *keys).orderBy(*order)
    a, b = laid.withColumn(pos, F.row_number().over(inside) - 1).alias("a"), offsets.alias("b")
    on = F.col(f"a.{pid}") == F.col(f"b.{pid}")
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, on).select(*[F.col(f"a.{c}") for c in df.columns if c != "ordinal" or c in (*keys, *order)], (F.col(base) + F.col(pos)).alias("ordinal"))


def chunk_states(numbered: DataFrame, keys: Sequence[str], states: Sequence[Column], chunk_rows: int = 100_000) -> DataFrame:
    """One row per (key, chunk) with the given aggregates: every chunk has chunk_rows rows but a key's last."""
    return numbered.groupBy(*keys, F.floor(F.col("ordinal") / chunk_rows).alias("chunk")).agg(*states)


def key_counts(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk_rows: int = 100_000) -> DataFrame:
    """Rows per key, each key's chunks counted apart and merged."""
    numbered = number_within_keys(df.select(*dict.fromkeys([*keys, *order])), keys, order)
    return chunk_states(numbered, keys, [F.count(F.lit(1)).alias("n")], chunk_rows).groupBy(*keys).agg(F.sum("n").cast("bigint").alias("n"))


def heavy_keys(df: DataFrame, keys: Sequence[str], order: Sequence[str], share_percent: int = 2, chunk_rows: int = 100_000) -> DataFrame:
    """Keys that hold at least share_percent of all rows of df, rows with a null in the key included in the total.

    Returns the keys (none of them null) and n. An empty table has no heavy key."""
    counts = Scratch(df.sparkSession, "heavy").write(key_counts(df, keys, order, chunk_rows), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return counts.where(whole & (F.col("n") * 100 >= F.lit(total) * share_percent) & (F.col("n") > 0))


def key_bursts(df: DataFrame, keys: Sequence[str], at: str, tie: str, gap_seconds: int = 3600, chunk_rows: int = 100_000) -> DataFrame:
    """Per key: rows, first and last time, and the number of bursts (maximal runs of rows no more than the gap apart).

    A chunk's state is its rows, its ends and its inner breaks; two neighbouring chunks break between them where
    the gap from one's last to the next one's first time is larger, which the merge sees from the ends alone.
    Rows with a null time are left out."""
    base = df.select(*keys, F.col(at).alias("at"), F.col(tie).alias("tie")).where(F.col("at").isNotNull())
    numbered = number_within_keys(base, keys, ["at", "tie"]).withColumn("chunk", F.floor(F.col("ordinal") / chunk_rows))
    inside = Window.partitionBy(*keys, "chunk").orderBy("ordinal")
    broke = (F.unix_micros(F.to_timestamp("at")) - F.unix_micros(F.to_timestamp(F.lag("at").over(inside)))) > gap_seconds * 1_000_000
    states = numbered.withColumn("broke", F.coalesce(broke, F.lit(False)).cast("bigint")).groupBy(*keys, "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.sum("broke").alias("breaks"))
    between = Window.partitionBy(*keys).orderBy("chunk")
    edge = (F.unix_micros(F.to_timestamp("first_at")) - F.unix_micros(F.to_timestamp(F.lag("last_at").over(between)))) > gap_seconds * 1_000_000
    return (
        states.withColumn("edge", F.coalesce(edge, F.lit(False)).cast("bigint"))
        .groupBy(*keys)
        .agg(F.sum("n").cast("bigint").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), (F.sum("breaks") + F.sum("edge") + 1).cast("bigint").alias("bursts"))
    )
