"""Exact classes: grouping by main fingerprint, the stored database, look-ups and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.model import KIND_CLASSES
from arbora.operators.skew import chunk_states, number_within_keys
from arbora.session import Scratch


def class_counts(rows: DataFrame, least: int = 2) -> DataFrame:
    """(weight, digest, n) of the main fingerprints with at least `least` rows."""
    return rows.groupBy("weight", "digest").agg(F.count(F.lit(1)).cast("bigint").alias("n")).where(F.col("n") >= least)


def exact_classes(rows: DataFrame, label: str = "label", least: int = 2) -> DataFrame:
    """(weight, digest, label, n): the members of every class with at least `least` rows, copies kept (A1, A2).

    A class stays rows, whatever its size; class_chunks packs them into arrays of bounded length."""
    counts = Scratch(rows.sparkSession, "classes").write(class_counts(rows, least), "counts")
    return rows.select("weight", "digest", F.col(label).alias("label")).join(counts, ["weight", "digest"])


def class_chunks(members: DataFrame, chunk_rows: int = 10_000) -> DataFrame:
    """(weight, digest, chunk, labels sorted) of every class, chunk_rows members a chunk but the last; chunks follow in label order."""
    numbered = number_within_keys(members.select("weight", "digest", "label"), ["weight", "digest"], ["label"])
    return chunk_states(numbered, ["weight", "digest"], [F.sort_array(F.collect_list("label")).alias("labels")], chunk_rows)


def first_bag(rows: DataFrame, order: str) -> DataFrame:
    """(weight, digest, subs sorted): the bag of the first row per main fingerprint."""
    return rows.groupBy("weight", "digest").agg(F.sort_array(F.min_by("subs", order)).alias("subs"))


def write_database(rows: DataFrame, path: str, mode: str = "overwrite", partitions: int | None = None) -> None:
    """Rows (weight, digest, label), one per label: a key with any number of labels stays many rows, never one."""
    out = rows.select("weight", "digest", "label").withColumn("kind", F.lit(KIND_CLASSES))
    if partitions:
        out = out.repartitionByRange(partitions, "weight", "digest", "label").sortWithinPartitions("weight", "digest")
    out.write.mode(mode).parquet(path)


def read_database(spark: SparkSession, path: str | None) -> DataFrame:
    """The stored rows; no path, an empty database. Another kind of data set is refused."""
    if path is None:
        return spark.createDataFrame([], "weight bigint, digest string, label string")
    df = spark.read.parquet(path)
    # a data set is written with one kind, so its first row tells it without a scan
    first = df.select("kind").first() if "kind" in df.columns else ("",)
    if first is not None and first[0] != KIND_CLASSES:
        raise ValueError(f"{path} is no database of classes")
    return df.select("weight", "digest", "label")


def upsert(database: DataFrame, own: DataFrame) -> DataFrame:
    """The database with the own labels added (as in A7, copies stay)."""
    return database.select("weight", "digest", "label").unionByName(own.select("weight", "digest", "label"))


def clone_matches(own: DataFrame, database: DataFrame, label: str = "label") -> DataFrame:
    """Own rows joined with the database's labels of the same fingerprint, the own name left out.

    Every pair of a fingerprint comes out: for small or unlimited reports; clone_report counts without pairs. database rows are (weight, digest, label); rows of own without any other label don't come out."""
    other = database.select("weight", "digest", F.col("label").alias("other"))
    return own.join(other, ["weight", "digest"]).where(F.col(label) != F.col("other"))


def clone_report(own: DataFrame, database: DataFrame, keys: list[str], label: str = "label", limit: int = 10) -> DataFrame:
    """keys of own, the number of all other labels of its fingerprint, and at most limit of them in order.

    Equal to counting clone_matches, but no pair is ever formed: a fingerprint's labels are counted per label and cut
    to the first limit + 1 different ones before they meet own rows, so own and database rows of one hot fingerprint
    cost one row each. The database is cut to the fingerprints of own first: only those are grouped and written. Rows of own without any other label don't come out; limit <= 0 lists no names."""
    met = own.select("weight", "digest").where("weight is not null and digest is not null").distinct()
    per_label = Scratch(own.sparkSession, "report").write(
        database.where("label is not null").join(met, ["weight", "digest"], "left_semi").groupBy("weight", "digest", F.col("label").alias("other")).agg(F.count(F.lit(1)).alias("k")), "labels")
    total = per_label.groupBy("weight", "digest").agg(F.sum("k").alias("all"))
    mine = own.join(total, ["weight", "digest"]).join(per_label.withColumnRenamed("other", label).withColumnRenamed("k", "same"), ["weight", "digest", label], "left")
    found = mine.withColumn("n_matches", (F.col("all") - F.coalesce("same", F.lit(0))).cast("bigint")).where(F.col("n_matches") > 0)
    if limit <= 0:
        return found.select(*keys, "n_matches", F.array().cast("array<string>").alias("names"))
    place = F.row_number().over(Window.partitionBy("weight", "digest").orderBy("other"))
    first = per_label.withColumn("_p", place).where(F.col("_p") <= limit + 1)
    heads = first.groupBy("weight", "digest").agg(F.sort_array(F.collect_list(F.struct("other", F.least(F.col("k"), F.lit(limit)).cast("int").alias("k")))).alias("heads"))
    others = F.filter("heads", lambda h: h["other"] != F.col(label))
    names = F.slice(F.flatten(F.transform(others, lambda h: F.array_repeat(h["other"], h["k"]))), 1, limit)
    return found.join(heads, ["weight", "digest"]).select(*keys, "n_matches", names.alias("names"))


def name_lists(own: DataFrame, database: DataFrame, chunk_rows: int = 1000) -> DataFrame:
    """(weight, digest, chunk, names): the database's labels of every fingerprint of own, sorted, chunk_rows a chunk but the last.

    The lists stand once per fingerprint, however many definitions have it; a definition's machine record is its place and
    the names of its fingerprint's chunks but its own."""
    met = own.select("weight", "digest").where("weight is not null and digest is not null").distinct()
    return class_chunks(database.where("label is not null").join(met, ["weight", "digest"], "left_semi"), chunk_rows).withColumnRenamed("labels", "names")


def machine_record(start: Column, end: Column, names: Column) -> Column:
    """`start;end;` and all names as a bulleted list, ended by `#`; no limit applies (K5)."""
    return F.concat(F.format_string("%d;%d;* ", start, end), F.array_join(names, "\n* "), F.lit("#"))


def human_record(name: Column, location: Column, n_matches: Column, names: Column) -> Column:
    """The report of one definition for people (K4)."""
    return F.concat(name, F.lit(" in "), location, F.lit(" matches "), n_matches.cast("string"), F.lit(" definition(s):\n* "), F.array_join(names, "\n* "))


def read_machine_records(text: Column) -> Column:
    """array<struct<start, end, names>> of a text of machine records; offsets count from 1, as editors do (K6)."""
    pieces = F.split(text, "#", -1)
    records = F.slice(pieces, 1, F.size(pieces) - 1)  # what follows the last terminator is no record
    fields = F.transform(records, lambda r: F.split(r, ";", 3))
    name = lambda f: F.transform(F.split(f[2], "\n"), lambda n: F.regexp_replace(n, r"^\* ", ""))
    return F.transform(fields, lambda f: F.struct((f[0].cast("int") + 1).alias("start"), (f[1].cast("int") + 1).alias("end"), name(f).alias("names")))
