"""Units, bindings and their selection.

Bindings are rows (unit, ord, path, name, sig, ir, plain): one per named top-level or nested binding of a unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strip_directives(text: Column) -> Column:
    """Pieces between `;;` that are blank or start with `#` are dropped, the others joined by `;;` again.

    The cut is textual, inside literals and comments too; a dropped piece goes as a whole."""
    pieces = F.split(text, ";;", -1)
    kept = F.filter(pieces, lambda p: (F.trim(p, F.lit(" \t\r\n\f")) != "") & ~F.startswith(F.trim(p, F.lit(" \t\r\n\f")), F.lit("#")))
    return F.array_join(kept, ";;")


def first_of_name(bindings: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The first row per key, whole."""
    w = Window.partitionBy(*keys).orderBy(order)
    return bindings.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def last_value(bindings: DataFrame, keys: list[str], value: str, order: str = "ord") -> DataFrame:
    """keys and the value of the last row."""
    return bindings.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def value_or_fail(units: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """units with the value of their key; a unit without one fails the query when its row is computed."""
    found = units.join(values.select(key, value, F.lit(True).alias("_found")), key, "left")
    missing = F.raise_error(F.concat(F.lit("not found: "), F.col(key).cast("string")))
    return found.withColumn(value, F.when(F.col("_found"), F.col(value)).otherwise(missing)).drop("_found")


def qualified_name(prefix: Column, *parts: Column) -> Column:
    """prefix.part.…; no prefix gives a leading dot, an anonymous part an empty segment."""
    return F.concat_ws(".", F.coalesce(prefix, F.lit("")), *[F.coalesce(p, F.lit("")) for p in parts])


def explode_bindings(df: DataFrame, items: str, prefix: str, depth: int) -> DataFrame:
    """Rows (…, name, loc_start, loc_end, ir) of nested items, descending into modules up to the depth of the schema (P10).

    items is an array of struct<kind, name, loc_start, loc_end, ir, items>, where kind is 'value', 'module' or
    anything else, which is skipped; the innermost level has no items field. Order is kept by `ord`."""
    out, level = None, df.withColumn("_p", F.coalesce(F.col(prefix), F.lit(""))).withColumn("_o", F.array().cast("array<int>")).withColumnRenamed(items, "_items")
    rest = [c for c in df.columns if c not in (items, prefix)]
    for d in range(depth):
        rows = level.select(*rest, "_p", "_o", F.posexplode("_items").alias("_i", "_x"))
        rows = rows.withColumn("_o", F.concat("_o", F.array("_i"))).withColumn("_p", qualified_name(F.col("_p"), F.col("_x.name")))
        here = rows.where("_x.kind = 'value' and _x.name is not null").select(*rest, F.col("_o").alias("ord"), F.col("_p").alias("name"), "_x.loc_start", "_x.loc_end", "_x.ir")
        out = here if out is None else out.union(here)
        if d + 1 < depth:
            level = rows.where("_x.kind = 'module'").select(*rest, "_p", "_o", F.col("_x.items").alias("_items"))
    return out


def build_path_lines(df: DataFrame, text: str) -> DataFrame:
    """Paths of the lines that start with 'B', from their third character on (S5); a bare 'B' gives an empty path."""
    lines = df.withColumn("_line", F.explode(F.split(F.col(text), "\n", -1))).where(F.startswith("_line", F.lit("B")))
    return lines.withColumn("path", F.substring("_line", 3, 1 << 30)).drop("_line")


def with_base(path: Column, base: Column | str) -> Column:
    """Absolute paths as they are, others below base (S6); an empty path gives null."""
    base = F.lit(base) if isinstance(base, str) else base
    return F.when(path == "", F.lit(None)).when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(base, F.lit("/"), path))


def path_directory(path: Column) -> Column:
    """Up to the last '/', '.' without one."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"(?s)^(.*)/", 1)).otherwise(F.lit("."))


def path_base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def has_extension(path: Column, extension: str = ".ml") -> Column:
    return F.endswith(path, F.lit(extension))


def stem(path: Column) -> Column:
    return F.regexp_replace(path_base(path), r"\.[^.]*$", "")


def find_artifacts(files: DataFrame, artifacts: DataFrame, file: str = "file", ending: str = ".cmt") -> tuple[DataFrame, DataFrame]:
    """(found, missing): for each file the artifact whose name ends with its stem or capitalised stem plus ending.

    artifacts is (dir_ord, ord, path). Within a directory the first hit wins, over directories the last one; the match
    is by suffix, so xfoo.cmt matches foo.ml. A suffix match is an equi join on all suffixes of the artifact's name
    that are as long as some file's candidate."""
    low = F.concat(stem(F.col(file)), F.lit(ending))
    cand = files.select(file, F.explode(F.array_distinct(F.array(low, F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1 << 30))))).alias("cand"))
    base = path_base(F.col("path"))
    suffixes = artifacts.withColumn("_b", base).where(F.endswith("_b", F.lit(ending)))
    # the different lengths of file names: a few hundred at most, whatever the number of files
    lengths = sorted(r[0] for r in cand.select(F.length("cand")).distinct().collect())
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("_b"))
    suffixes = suffixes.withColumn("_k", F.explode(fitting)).withColumn("cand", F.right("_b", F.col("_k"))).drop("_b", "_k")
    hits = cand.join(suffixes, "cand")
    best = hits.groupBy(file).agg(F.max_by("path", F.struct(F.col("dir_ord"), -F.col("ord"))).alias("path"))
    return best, files.join(best.select(file), file, "left_anti")


def catalog_range(names: DataFrame, name: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """Names within the bounds, each optional, inclusive, in byte order; '.' and '..' left out; sorted."""
    out = names.where(~F.col(name).isin(".", ".."))
    if low is not None:
        out = out.where(F.col(name) >= low)
    if high is not None:
        out = out.where(F.col(name) <= high)
    return out.orderBy(name)
